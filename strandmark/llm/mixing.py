"""Mixing sources to target weights.

Words are summed by source; a source's rate is its target over its size. Each document is taken floor(rate)
times, and once more where a hash of its id and text falls below the fraction. Targets stop at MOST times the source's
size; the excess goes to the others by weight until none is above. Only sums by source are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, small, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: str = "text"):
    """Runs of anything but ASCII white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): sources by code point, null last, weigh `weights`, repeating.

    A level is sought that gives each source level * weight, or its cap if that is less; in the order of cap over
    weight, the capped ones come first, so running sums over the sources find it without a loop.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(every) - 1) % len(weights)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.col("level") * F.col("w") < F.col("cap")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("w"))).alias("target"))


def uniform(*cols: str):
    """A number from 0 to below 1 by the hash of the columns."""
    text = F.concat_ws("|", F.lit(SEED), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


ADDED = ("size", "source_size", "target", "copies")


def _mixed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with what mix() adds, and the columns that hold it, whose names docs doesn't have."""
    of, *names = free(docs, "mix_of", *(f"mix_{c}" for c in ADDED))
    size, source_size, target, copies = names
    by = written(targets(docs.select("source", n_words().alias("size"))).withColumnsRenamed({"source": of, "source_size": source_size, "target": target}), "targets")
    out = docs.withColumn(size, n_words()).join(small(by), F.col("source").eqNullSafe(F.col(of))).drop(of)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    return out.withColumn(copies, (F.floor(rate) + F.when(uniform("doc_id", "text") < rate - F.floor(rate), 1).otherwise(0)).cast("int")), dict(zip(ADDED, names, strict=True))


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row); other columns stay.

    A column of docs that has one of these four names gives way to it. A null text has size 0; a null source is a source
    of its own, after the others. Rows of one id are drawn apart if their texts differ; rows that repeat both are taken alike. A source of size 0 has target 0
    and is not taken. Empty table: no rows.
    """
    out, names = _mixed(docs)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    return out.select(*kept, *(F.col(n).alias(c) for c, n in names.items()))


def emitted(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, numbered from 1 in a column copy.

    All columns of docs stay as they are, but for one named copy, which gives way. Nulls, repeated rows and an empty
    table as in mix(): a row without words is taken as often as its source's rate says.
    """
    out, names = _mixed(docs)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"]
    return out.where(F.col(names["copies"]) > 0).select(*kept, F.explode(F.sequence(F.lit(1), F.col(names["copies"]))).alias("copy"))
