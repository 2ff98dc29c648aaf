"""Results of many runs: their lists, times and accuracies as files, and the report on all of them."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import run_report

#: Parts of an accuracy table by their keys in a JSON file, and the columns of a list of runs.
KEYS = {"reads": "reads_within_feature", "templates": "templates_within_feature_but_read_outside", "covered": "indel_count", "outside": "fully_outside_features"}
RUN_LIST = ("indel_anal", "time", "mis_plot", "indel_plot", "tool", "graph", "sample", "read_set")


def write_accuracy(table: DataFrame, path: str) -> None:
    """indel_accuracy_table() as one JSON object in the folder: lengths with their counts in order, and the counts of reads away from variants."""
    whole = table.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "x", "correct", "total"))).alias("all"))  # a row for each length and part
    of = lambda part, *cols: F.transform(F.filter("all", lambda r: r["part"] == part), lambda r: F.array(*(r[c] for c in cols)))
    rows = [of(p, "x", "total") if p == "covered" else of(p, "x", "correct", "total") for p in ("reads", "templates", "covered")]
    out = [r.alias(KEYS[p]) for r, p in zip(rows, ("reads", "templates", "covered"), strict=True)] + [F.element_at(of("outside", "correct", "total"), 1).alias(KEYS["outside"])]
    whole.select(F.to_json(F.struct(*out)).alias("value")).write.text(path)


def read_accuracy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, part, x, correct, total) of accuracies in JSON files, or folders of such: what write_accuracy() was given, by file."""
    lists = {p: "array<array<bigint>>" for p in ("reads", "templates", "covered")} | {"outside": "array<bigint>"}
    schema = ", ".join(f"{KEYS[p]} {kind}" for p, kind in lists.items())
    raw = spark.read.schema(schema).option("multiLine", "true").json(paths).select(F.col("_metadata.file_path").alias("file"), *(F.col(KEYS[p]).alias(p) for p in lists))
    row = lambda part, x, correct, total: F.struct(F.lit(part).alias("part"), x.cast("bigint").alias("x"), correct.alias("correct"), total.alias("total"))
    three = lambda p: F.transform(F.coalesce(p, F.array().cast("array<array<bigint>>")), lambda r: row(p, r[0], r[1], r[2]))
    covered = F.transform(F.coalesce("covered", F.array().cast("array<array<bigint>>")), lambda r: row("covered", r[0], r[1], r[1]))
    outside = F.array(row("outside", F.lit(None), F.col("outside")[0], F.col("outside")[1]))
    return raw.select("file", F.explode(F.concat(three("reads"), three("templates"), covered, outside)).alias("o")).select("file", "o.*")


def read_times(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, seconds) of what the time command has written: its line real."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"^real\s+([0-9.]+)\s*$", 1).alias("s"))
    return lines.where("s <> ''").groupBy("file").agg(F.max(F.col("s").cast("double")).alias("seconds"))


def read_run_list(spark: SparkSession, path: str) -> DataFrame:
    """(run, indel_anal, time, mis_plot, indel_plot, tool, graph, sample, read_set): a row for each run of a CSV list; run is its line's hash."""
    text = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    if tuple(text.columns) != RUN_LIST:
        raise ValueError(f"{path} should have the columns {', '.join(RUN_LIST)}")
    return text.select(F.substring(F.md5(F.concat_ws("|", *RUN_LIST).cast("binary")), 1, 12).alias("run"), *RUN_LIST)


def report_of_runs(spark: SparkSession, path: str) -> DataFrame:
    """The report on all runs of a list: its columns, the percentages away from variants, on SNPs and on four bands of lengths, and the seconds taken.

    Files of the list are sought beside it unless their paths are whole. The list, not the results, is gathered.
    """
    runs = read_run_list(spark, path)
    rows = runs.collect()  # a row for each run that was listed by hand
    base = posixpath.dirname(path)
    at = lambda f: f if "://" in f or f.startswith("/") else posixpath.join(base, f)
    # files come back under their whole addresses; those end as the list has them
    named = spark.createDataFrame([(r["run"], at(r["indel_anal"]), at(r["time"])) for r in rows], "run string, anal string, clock string")
    ends = lambda file, own: F.endswith(file, F.regexp_replace(own, "^[a-z0-9]+:/*", "/"))
    files = list(dict.fromkeys(at(r["indel_anal"]) for r in rows))
    found = read_accuracy(spark, files)
    acc = F.broadcast(named).join(found, ends(F.regexp_replace("file", "/part-[^/]*$", ""), F.col("anal")) | ends(F.col("file"), F.col("anal")))
    times = F.broadcast(named).join(read_times(spark, list(dict.fromkeys(at(r["time"]) for r in rows))), ends(F.col("file"), F.col("clock"))).select("run", "seconds")
    by_run = lambda part: acc.where(F.col("part") == part)
    return run_report(runs, by_run("reads").select("run", "x", "correct", "total"), by_run("outside").select("run", "correct", "total")).join(times, "run", "left")
