"""The whole report on one run of an aligner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import write_scored
from . import reads as R


def full_report(alignments: DataFrame, variant: DataFrame, path: str, window: int = 0, width: int | None = 50000, most: int = 20, smooth: int = 5, genotype: DataFrame | None = None, contig: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the report, by name; scored and bad reads are written under the path once, and the rest reads them there.

    scored, bad: the reads; matrix: where misplaced reads go, and unmapped those without a place; accuracy: by indel
    length, with its summary and its smoothed percentages; templates, covered and outside as in indel_accuracy(). With
    the genotype of a sample, variants count on its copies alone. A width of None is a hundredth of the contigs.
    """
    spark = alignments.sparkSession
    width = R.matrix_width(contig, width) if contig is not None else width
    write_scored(R.score_alignments(alignments, window), f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored").withColumn("chrom", F.col("chrom").cast("bigint"))
    write_scored(R.bad_reads(scored), f"{path}/bad")
    bad = spark.read.schema(scored.schema).parquet(f"{path}/bad")
    R.indel_accuracy_table(scored, variant, genotype, most).coalesce(1).write.parquet(f"{path}/indel_accuracy")  # a row for each length
    found = R.parts_of_accuracy(spark.read.parquet(f"{path}/indel_accuracy"))
    accuracy = found["reads"]
    return {"scored": scored, "bad": bad, "matrix": R.misalignment_matrix(bad, width), "unmapped": R.unmapped_by_bin(bad, width), "accuracy": accuracy, "summary": R.accuracy_summary(accuracy, found["outside"]), "smoothed": R.median_smooth(accuracy, smooth), "templates": found["templates"], "covered": found["covered"], "outside": found["outside"]}
