"""FASTA text as tables of chunks, read by lines: no record is ever one value."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators.sequence import contig_stats, is_chunked

#: Bases that lines are gathered to before they leave the task that read them.
SEGMENT = 1 << 16


def _gathered(batches):
    """Lines of one block of a file after the other, as segments: (file, block, record, head, at, bases).

    record counts the headers of the block, 0 is what goes on from the block before; at is a segment's place in its
    record's part of the block. A header makes a row of its own, with no bases.
    """
    block, record, at, held, size, out = None, 0, 0, [], 0, []

    def flush() -> None:
        nonlocal at, held, size
        if held:
            out.append((*block, record, None, at, "".join(held)))
            at, held, size = at + size, [], 0

    def rows() -> pa.RecordBatch:
        nonlocal out
        file, start, rec, head, place, bases = zip(*out, strict=True)
        out = []
        return pa.RecordBatch.from_pydict({"file": pa.array(file, pa.string()), "block": pa.array(start, pa.int64()), "record": pa.array(rec, pa.int64()), "head": pa.array(head, pa.string()), "at": pa.array(place, pa.int64()), "bases": pa.array(bases, pa.string())})

    for batch in batches:
        files, starts = (batch[c].to_pylist() for c in ("file", "block"))
        for file, start, line in zip(files, starts, batch["value"].to_pylist(), strict=True):
            if (file, start) != block:
                if block is not None:
                    flush()
                block, record, at = (file, start), 0, 0
            if line[:1] == ">":
                flush()
                record, at = record + 1, 0
                out.append((*block, record, line[1:].rstrip("\r"), 0, ""))
                continue
            line = line.strip()
            held.append(line)
            size += len(line)
            if size >= SEGMENT:
                flush()
        if len(out) > 64:
            yield rows()
    if block is not None:
        flush()
    if out:
        yield rows()


def read_lines(spark: SparkSession, path: str, by_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, segments) of FASTA text, plain or gz: records(chrom, seq_id), segments(chrom, start, bases) with their places.

    Records are numbered from 1 in the order of files and lines, or by_name: by the number in chrN.fa. Splits of a file are
    read apart: each counts its headers and the bases after the last one, and only these counts, a row for each split, are
    summed in order. Lines before the first header of a file are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    segments = lines.mapInArrow(_gathered, "file string, block bigint, record bigint, head string, at bigint, bases string")
    n = F.length("bases").cast("bigint")
    last = F.max("record")
    each = segments.groupBy("file", "block", "record").agg(F.sum(n).alias("n"))
    splits = each.groupBy("file", "block").agg(last.alias("heads"), F.sum("n").alias("n"), F.max_by("n", "record").alias("tail"))
    whole = Window.partitionBy("file").orderBy("block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("n").over(before), F.lit(0))
    splits = splits.withColumn("t", total).withColumn("seen", F.coalesce(F.sum("heads").over(before), F.lit(0)))
    # where the record that is open at a split began, counted from the start of the file
    opened = F.last(F.when(F.col("heads") > 0, F.col("t") + F.col("n") - F.col("tail")), ignorenulls=True).over(before)
    splits = splits.withColumn("carry", F.col("t") - F.coalesce(opened, F.lit(0)))
    if by_name:
        first = splits.select("file").distinct().withColumn("f0", F.regexp_extract("file", r"chr(\d+)\.fa[^/]*$", 1).cast("bigint") - 1)
    else:
        files = splits.groupBy("file").agg(F.sum("heads").alias("h"))
        first = files.select("file", F.coalesce(F.sum("h").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("f0"))  # a row for each file
    places = splits.join(first, "file").select("file", "block", (F.col("f0") + F.col("seen")).alias("base"), "seen", "carry")
    placed = segments.join(places, ["file", "block"]).where("seen + record > 0").withColumn("chrom", F.col("base") + F.col("record"))
    records = placed.where("head is not null").select("chrom", F.col("head").alias("seq_id"))
    start = F.col("at") + F.when(F.col("record") == 0, F.col("carry")).otherwise(0)
    return records, placed.where(n > 0).select("chrom", start.cast("bigint").alias("start"), X.normalize_bases(F.col("bases")).alias("bases"))


def chunks_of(segments: DataFrame, width: int) -> DataFrame:
    """(chrom, chunk_no, start, bases): segments cut at multiples of the width and put together there, a few for each chunk."""
    end = F.col("start") + F.length("bases") - 1
    each = segments.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"start div {width}"), F.floor(end / width))))
    at = F.greatest(F.col("start"), F.col("chunk_no") * width)
    piece = F.expr(f"substring(bases, cast(greatest(chunk_no * {width} - start, 0) + 1 as int), cast((chunk_no + 1) * {width} - greatest(start, chunk_no * {width}) as int))")
    got = each.select("chrom", "chunk_no", F.struct(at.alias("at"), piece.alias("b")).alias("p")).groupBy("chrom", "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return got.select("chrom", "chunk_no", (F.col("chunk_no") * width).alias("start"), F.array_join(F.transform("p", lambda x: x["b"]), "").alias("bases"))


def contigs_of(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chrom, seq_id, seq_len, seq_md5) of all records, also of empty ones."""
    stats = contig_stats(chunks.withColumnRenamed("chrom", "seq_no")).withColumnRenamed("seq_no", "chrom")
    none = F.md5(F.lit("").cast("binary"))
    return records.join(stats, "chrom", "left").select("chrom", "seq_id", F.coalesce("seq_len", F.lit(0)).cast("bigint").alias("seq_len"), F.coalesce("seq_md5", none).alias("seq_md5"))


def read_fasta_chunks(spark: SparkSession, path: str, chroms: list[int] | None = None, chunk: int = 1 << 16, by_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contig, chunks): contig(chrom, seq_id, seq_len, seq_md5) of all records, and chunks(chrom, chunk_no, start, bases) of those asked for, all of them by default."""
    records, segments = read_lines(spark, path, by_name)
    every = chunks_of(segments, chunk)
    wanted = every if chroms is None else chunks_of(segments.where(F.col("chrom").isin(chroms)), chunk)
    return contigs_of(records, every), wanted


def write_fasta_split(seqs: DataFrame, path: str) -> None:
    """A folder for each chromosome under path/fasta, upper-cased, and the index of all (id, length, md5) under path/index.

    seqs: whole sequences (chrom, seq_id, seq), or chunks (chrom, seq_id, chunk_no, bases), each a line; the files of a
    chromosome are in order.
    """
    if not is_chunked(seqs):
        seqs = seqs.select("chrom", "seq_id", F.lit(0).cast("bigint").alias("chunk_no"), F.col("seq").alias("bases"))
    up = seqs.select("chrom", "seq_id", "chunk_no", F.upper("bases").alias("bases"))
    head = up.groupBy("chrom", "seq_id").agg(F.lit(-1).cast("bigint").alias("chunk_no")).select("chrom", "chunk_no", F.concat(F.lit(">"), "seq_id").alias("value"))
    lines = head.unionByName(up.select("chrom", "chunk_no", F.col("bases").alias("value")))
    lines.repartitionByRange("chrom", "chunk_no").sortWithinPartitions("chrom", "chunk_no").select("chrom", "value").write.partitionBy("chrom").text(f"{path}/fasta")
    names = up.select("chrom", "seq_id").distinct()
    stats = contig_stats(up.select(F.col("chrom").alias("seq_no"), "chunk_no", "bases"))
    names.join(stats, names["chrom"] == stats["seq_no"]).select("seq_id", "seq_len", "seq_md5").write.csv(f"{path}/index", sep="\t")
