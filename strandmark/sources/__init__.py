"""Text formats as tables, and back: SAM, FASTA, VCF, FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import functions as X
from ..operators.reads import serialise
from .fasta import chunks_of, contigs_of, read_fasta_chunks, read_lines, write_fasta_split
from .results import read_accuracy, read_run_list, read_times, report_of_runs, write_accuracy

__all__ = [
    "chunks_of", "contigs_of", "read_accuracy", "read_contig_index", "read_fasta", "read_fasta_chunks", "read_fasta_dir", "read_lines", "read_run_list", "read_sam", "read_sam_contigs", "read_scored", "read_scored_sam", "read_times", "read_vcf", "read_vcf_contigs",
    "report_of_runs", "tables_to_vcf", "vcf_samples", "vcf_to_tables", "with_ref_ids", "write_accuracy", "write_fasta_split", "write_fastq", "write_scored", "write_scored_sam", "write_sorted", "write_vcf",
]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text; places become 0-based, and the reference its name. tags: the optional fields, each with its type letter and its text."""
    f = F.split("value", "\t")
    flag = f[1].cast("int")
    bit = lambda n: flag.bitwiseAND(n) != 0
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.length("value") > 0))
    return lines.select(
        f[0].alias("qname"), flag.alias("flag"), f[2].alias("rname"), (f[3].cast("bigint") - 1).alias("apos"), f[4].cast("bigint").alias("mapq"), f[5].alias("acigar"),
        f[6].alias("rnext"), (f[7].cast("bigint") - 1).alias("pnext"), f[9].alias("seq"), f[10].alias("qual"),
        bit(1).alias("is_paired"), F.when(bit(64) | ~bit(1), 1).otherwise(0).cast("bigint").alias("is_read1"), bit(16).alias("is_reverse"),
        F.when(bit(256), 1).otherwise(0).cast("bigint").alias("is_secondary"), F.when(bit(4), 1).otherwise(0).cast("bigint").alias("is_unmapped"), _tags(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0)))).alias("tags"),
    )


def _tags(fields: Column) -> Column:
    """Optional fields TAG:TYPE:VALUE as a map from tag to (type, value); of a tag given twice, the first; what has another form is left out."""
    whole = F.filter(fields, lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    pair = F.transform(whole, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.struct(F.substring(x, 4, 1).alias("type"), F.substring(x, 6, 1 << 30).alias("value")).alias("v")))
    first = F.filter(pair, lambda x, i: F.array_position(F.transform(pair, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"])))


def int_tag(name: str) -> Column:
    """The whole number in a tag; null if it is missing or of another type."""
    tag = F.try_element_at("tags", F.lit(name))
    return F.when(tag["type"] == "i", tag["value"].try_cast("bigint"))


def text_tag(name: str) -> Column:
    """The text in a tag; null if it is missing or of another type."""
    tag = F.try_element_at("tags", F.lit(name))
    return F.when(tag["type"] == "Z", tag["value"])


#: Tags of scored reads, with the columns that they hold.
SCORE_TAGS = {"Zc": "cpy", "ZE": "read_stop", "Ze": "mate_stop", "Xf": "xf", "YR": "chrom_ok", "YP": "pos_ok", "YC": "cigar_ok", "XR": "a_chrom", "XP": "a_pos", "XC": "a_cigar"}


def read_scored_sam(spark: SparkSession, path: str) -> DataFrame:
    """Scored reads of a SAM text whose tags hold the scores, at their true places: what compare_runs() and the matrices take.

    xf 0 is misplaced, 1 right, 2 unmapped. chrom counts from 1 in the order of the file's contigs.
    """
    rows = with_ref_ids(read_sam(spark, path), read_sam_contigs(spark, path))
    flags = [F.coalesce(int_tag(t) == 1, F.lit(True)).alias(c) for t, c in SCORE_TAGS.items() if t in ("YR", "YP", "YC")]
    numbers = [int_tag(t).alias(c) for t, c in SCORE_TAGS.items() if t in ("Zc", "ZE", "Ze", "Xf", "XR", "XP")]
    out = rows.select("qname", "is_read1", "is_paired", (F.col("ref_id") + 1).alias("chrom"), F.col("apos").alias("pos"), F.col("acigar").alias("cigar"), "mapq", *numbers, *flags, text_tag("XC").alias("a_cigar"), "seq", "qual")
    return out.withColumn("is_unmapped", F.when(F.col("xf") == 2, 1).otherwise(0).cast("bigint")).withColumn("is_misaligned", F.col("xf") == 0)


def write_scored_sam(scored: DataFrame, contigs: DataFrame, path: str) -> None:
    """SAM text of scored reads at their true places, with SCORE_TAGS; read_scored_sam() takes it back. contigs(ref_id, seq_id, seq_len)."""
    ids = contigs.select((F.col("ref_id") + 1).cast("bigint").alias("chrom"), F.col("seq_id").alias("_name"))
    bits = F.when(F.col("is_paired"), F.when(F.col("is_read1") == 1, 65).otherwise(129)).otherwise(0)
    kind = dict(scored.dtypes)
    of = lambda c: F.col(c).cast("int") if kind[c] == "boolean" else F.col(c)
    tags = [F.concat(F.lit(f"{t}:{'Z' if t == 'XC' else 'i'}:"), of(c).cast("string")) for t, c in SCORE_TAGS.items()]
    text = lambda c: F.coalesce(F.col(c), F.lit("*")) if c in kind else F.lit("*")
    line = F.concat_ws("\t", "qname", bits.cast("string"), "_name", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), text("seq"), text("qual"), *tags)
    body = scored.join(ids, "chrom").select("chrom", "pos", line.alias("value"))
    head = contigs.select(F.lit(-1).cast("bigint").alias("chrom"), F.col("ref_id").cast("bigint").alias("pos"), F.concat(F.lit("@SQ\tSN:"), "seq_id", F.lit("\tLN:"), F.col("seq_len").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "value").select("value").write.text(path)


def read_sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, seq_id, seq_len) of the @SQ lines, numbered from 0 in their order."""
    sq = spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).withColumn("line", F.monotonically_increasing_id())
    order = F.row_number().over(Window.orderBy("line")) - 1  # a row for each contig
    return sq.select(order.cast("bigint").alias("ref_id"), F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("seq_id"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("seq_len"))


def with_ref_ids(alignments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments with the number of their contig (ref_id), and of their mate's (next_ref_id); -1 for none. The form that score_alignments() takes."""
    ids = contigs.select("seq_id", F.col("ref_id").cast("bigint").alias("ref_id"))
    mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    out = alignments.join(ids.withColumnRenamed("seq_id", "rname"), "rname", "left").withColumn("_m", mate)
    out = out.join(ids.select(F.col("seq_id").alias("_m"), F.col("ref_id").alias("next_ref_id")), "_m", "left").drop("_m")
    return out.fillna(-1, ["ref_id", "next_ref_id"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq) of each record, read a record at a time; letters folded to ACGTN. A record begins at a > that begins a line."""
    record = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    return record.select(*_record())


def _record() -> list:
    head = F.regexp_extract("value", r"^>?([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return [head.alias("seq_id"), X.normalize_bases(body).alias("seq")]


def read_vcf_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq_id, seq_len, seq_md5) of the ##contig lines, numbered from 1 in their order."""
    head = spark.read.text(path).where(F.startswith("value", F.lit("##contig=<"))).withColumn("line", F.monotonically_increasing_id())
    of = lambda key, what: F.nullif(F.regexp_extract("value", rf"[<,]{key}=({what})", 1), F.lit(""))
    chrom = F.row_number().over(Window.orderBy("line"))  # a row for each contig
    return head.select(chrom.cast("bigint").alias("chrom"), of("ID", "[^,>]+").alias("seq_id"), of("length", r"\d+").cast("bigint").alias("seq_len"), of("md5", "[^,>]+").alias("seq_md5"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Names of the sample columns, from the one header line."""
    line = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).first()
    return line["value"].rstrip("\r").split("\t")[9:] if line else []


def _alleles(spark: SparkSession, path: str, column: int) -> DataFrame:
    """An allele a row, with the genotype gt that the sample of the column has of it."""
    f = F.split("value", "\t")
    body = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    sample = F.when(F.size(f) > 9 + column, f[9 + column])
    rows = body.select(f[0].alias("seq_id"), (f[1].cast("bigint") - 1).alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), F.regexp_extract(f[7], r"(?:^|;)AF=([^;]+)", 1).alias("af"), X.parse_gt(sample).alias("g"))
    each = rows.select("seq_id", "pos", "ref", "af", "g", F.posexplode("alts").alias("k", "alt")).where((F.col("alt") != ".") & ~X.is_imprecise(F.col("alt")) & ~X.is_imprecise(F.col("ref")))
    af = F.try_element_at(F.split("af", ","), F.col("k") + 1).try_cast("double")
    return each.withColumn("stop", F.col("pos") + F.length("ref")).withColumn("p", af).withColumn("gt", X.allele_gt(F.col("g.h0"), F.col("g.h1"), F.col("k") + 1).cast("bigint"))


def read_vcf(spark: SparkSession, path: str, sample_column: int = 0) -> tuple[DataFrame, DataFrame]:
    """(variant, genotype) of VCF text by seq_id: an allele a row; without genotype columns all are homozygous."""
    each = _alleles(spark, path, sample_column)
    return each.select("seq_id", "pos", "stop", "ref", "alt"), each.where("gt is not null").select("seq_id", "pos", "ref", "alt", "gt")


def vcf_to_tables(spark: SparkSession, path: str, sample: str | None = None, master_is_sample: bool = False, contigs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(contig, variant, genotype, unknown) of VCF text.

    contig(chrom, seq_id, seq_len, seq_md5) is that of the header unless given. variant(chrom, v_id, pos, stop, ref, alt, p)
    is numbered by place in each chromosome; with master_is_sample it has only what the sample has. genotype(sample,
    chrom, v_id, gt) is of the named sample (an error if the file hasn't got it), else of the first, else of 'anon'.
    unknown(seq_id, n) counts alleles on contigs that aren't listed; they are in no other table. Repeated alleles are one.
    """
    names = vcf_samples(spark, path)
    if sample is not None and sample not in names:
        raise ValueError(f"{path} has no sample {sample}")
    column = names.index(sample) if sample is not None else 0
    contig = read_vcf_contigs(spark, path) if contigs is None else contigs
    found = _alleles(spark, path, column).join(contig.select("chrom", "seq_id"), "seq_id", "left")
    unknown = found.where("chrom is null").groupBy("seq_id").agg(F.count("*").alias("n"))
    each = found.where("chrom is not null").groupBy("chrom", "pos", "stop", "ref", "alt").agg(F.max("p").alias("p"), F.max("gt").alias("gt"))
    if master_is_sample:
        each = each.where("gt is not null")
    each = serialise(each, ["pos", "ref", "alt"], X.bin_of("pos", 1 << 20), ("chrom",), "v_id")
    genotype = each.where("gt is not null").select(F.lit(sample or (names[0] if names else "anon")).alias("sample"), "chrom", "v_id", "gt")
    return contig, each.select("chrom", "v_id", "pos", "stop", "ref", "alt", "p"), genotype, unknown


def tables_to_vcf(contig: DataFrame, variant: DataFrame, genotype: DataFrame | None, path: str) -> None:
    """One VCF text in part files that are in order: the header with its contigs, then the lines by chromosome and place.

    With a genotype, which is of one sample, its alleles have GT; without one, all variants have AF. Contig ids end at their
    first space. vcf_to_tables() and `cat part-*` read the folder as one file.
    """
    names = [r["sample"] for r in genotype.select("sample").distinct().limit(2).collect()] if genotype is not None else []
    if len(names) > 1:
        raise ValueError("a VCF of more than one sample is not written")
    gt = genotype is not None
    own = contig.select("chrom", F.split("seq_id", " ")[0].alias("name"), *(c for c in ("seq_len", "seq_md5") if c in contig.columns))
    rows = variant.join(genotype.select("chrom", "v_id", "gt"), ["chrom", "v_id"]) if gt else variant
    last = [F.lit("GT"), X.gt_string(F.col("gt"))] if gt else []
    info = F.lit(".") if gt else F.concat(F.lit("AF="), F.col("p").cast("string"))
    line = F.concat_ws("\t", "name", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", F.lit("100"), F.lit("PASS"), F.coalesce(info, F.lit(".")), *last)
    body = rows.join(own.select("chrom", "name"), "chrom").select(F.col("chrom").cast("bigint").alias("chrom"), F.col("pos").cast("bigint").alias("pos"), line.alias("value"))
    kind = '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">' if gt else '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">'
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", names[0] if names else "anon"] if gt else [])]
    head = contig.sparkSession.createDataFrame([(-3, 0, "##fileformat=VCFv4.1"), (-1, 0, kind), (0, 0, "\t".join(columns))], "chrom long, pos long, value string")
    more = [F.concat(F.lit(f",{k}="), F.col(c).cast("string")) for k, c in (("length", "seq_len"), ("md5", "seq_md5")) if c in own.columns]
    listed = own.select(F.lit(-2).cast("bigint").alias("chrom"), F.col("chrom").cast("bigint").alias("pos"), F.concat(F.lit("##contig=<ID="), "name", *(F.coalesce(m, F.lit("")) for m in more), F.lit(">")).alias("value"))
    every = head.unionByName(listed).unionByName(body)
    every.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "value").select("value").write.text(path)


def write_vcf(variant: DataFrame, path: str) -> None:
    """tables_to_vcf() of (seq_id, pos, ref, alt, gt), whose contigs are those that it names, in the order of their ids."""
    ids = variant.select("seq_id").distinct()
    contig = ids.select(F.row_number().over(Window.orderBy("seq_id")).cast("bigint").alias("chrom"), "seq_id")  # a row for each contig
    rows = variant.join(contig, "seq_id").withColumn("v_id", F.xxhash64("pos", "ref", "alt"))
    tables_to_vcf(contig, rows.select("chrom", "v_id", "pos", "ref", "alt"), rows.select(F.lit("sample").alias("sample"), "chrom", "v_id", "gt").distinct(), path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four-line records of (qname, mate, seq)."""
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname", F.lit("/"), F.col("mate").cast("string")), "seq", F.lit("+"), F.repeat(F.lit("~"), F.length("seq"))).alias("value")).write.text(path)


def write_sorted(df: DataFrame, path: str, by: tuple = ("chrom", "pos")) -> None:
    """Parquet in the order of the columns over all files, so that a range of places is in few of them; no shared order is kept on the driver."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)


def write_scored(scored: DataFrame, path: str, condensed: bool = True) -> None:
    """Scored reads by chromosome and place; condensed leaves out seq and qual."""
    out = scored.drop("seq", "qual") if condensed else scored
    out.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Reads of write_scored(), with chrom as a number again. A chromosome asked for is a folder, and a range of places skips row groups by their statistics."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField("chrom", LongType()) if f.name == "chrom" else f for f in found])).parquet(path)


def read_fasta_dir(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq_id, seq) of a folder of chrN.fa files."""
    record = spark.read.option("lineSep", "\n>").text(f"{path}/chr*.fa").where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_name").alias("name"))
    return record.select(F.regexp_extract("name", r"chr(\d+)\.fa$", 1).cast("bigint").alias("chrom"), *_record())


def read_contig_index(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq_len, seq_md5) of a tab-separated index."""
    return spark.read.csv(path, sep="\t", schema="seq_id string, seq_len long, seq_md5 string")
