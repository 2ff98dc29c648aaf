"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one group of documents holds, about; memory of a task follows it, not the input.
BLOCK_BYTES = 12 << 20
#: Text bytes that numpy works on at once.
SLICE_BYTES = 1 << 19
_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application inside the one that driver and executors share, spark.checkpoint.dir.

    Where the session names none, a local master gets one of its own; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    key = spark.sparkContext.applicationId
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _FALLBACK.setdefault(key, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return f"{found.rstrip('/')}/strandmark/{key}"


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has written to the shared folder; call it when results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: For jobs that write a table: shuffle files go when the job ends, not when the driver collects garbage, and Python workers get batches of a few MB of text.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, **WRITING):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing needs any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows, and bytes of their JSON, of a table that is broadcast; a larger one is joined by shuffle.
MOST_ROWS, MOST_BYTES = 300_000, 24 << 20


def small(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if its rows and bytes, measured here, are few enough."""
    if df.count() > MOST_ROWS:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= MOST_BYTES else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """Memory that nothing in this worker uses goes back to the system: workers live on between tasks and groups."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def portions(batches, rows: int = 512):
    """The batches in pieces of so many rows, so that a task holds few texts as Python objects at once; memory is given back at their end."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch
    given_back()


def released(table: pa.Table) -> pa.Table:
    """The same table, after memory that the group before has left unused went back to the system."""
    given_back()
    return table


def text_size(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


#: Quantiles of the ids that blocks are cut by, and blocks that one id may be dealt to.
QUANTILES, PARTS = 256, 1 << 24


def blocked(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """rows with a block number, and how many blocks there are, about; blocks are of about block_bytes of text.

    A block's rank is its number over PARTS, and ranks rise with doc_id. Ids are put into cells: each of QUANTILES
    quantiles of the ids alone, and what lies between two of them in steps of equal width. Only cells, not rows, are
    summed in order and gathered until a block is full. A cell of one id, or of null ids, that is larger than a block is
    dealt by text to blocks of the same rank. So neither a far outlier nor a frequent id makes a large block.
    """
    size = F.octet_length("text")
    lo, hi, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.sum(size)).first()
    n = max(1, (total or 0) // block_bytes)
    if n == 1:
        return rows.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(PARTS)).otherwise(F.lit(0)).cast("long")), 1
    k = min(QUANTILES, 4 * n)
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)).first()[0] or []))
    edges = [lo, *cuts, hi] if lo is not None else []
    steps = max(1, 4 * n // k)
    below = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    start = F.element_at(F.lit(edges or [0]).cast("array<bigint>"), below + 1)
    width = F.element_at(F.lit([(b - a) // steps + 1 for a, b in zip(edges, edges[1:], strict=False)] or [1]).cast("array<bigint>"), below + 1)
    alone = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    at = F.when(F.col("doc_id").isNull(), F.lit(2 * len(cuts) + 2)).when(alone, 2 * below + 1).otherwise(2 * below)
    step = F.when(F.col("doc_id").isNull() | alone, F.lit(0)).otherwise(F.floor((F.col("doc_id") - start) / width))
    cell = F.struct(at.cast("int").alias("at"), step.cast("long").alias("step"))
    sizes = rows.select(cell.alias("cell"), size.alias("size")).groupBy("cell").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.floor(before / block_bytes)
    heavy = (F.col("cell.at") % 2 == 1) & (F.col("size") > block_bytes)
    last = F.col("cell.at") == 2 * len(cuts) + 2  # null ids rank after all others
    rank = F.when(last, F.lit(2 * n + 4)).otherwise(2 * whole + F.when(heavy, 1).otherwise(0))
    parts = F.when(heavy | last, F.greatest(F.lit(1), F.ceil(F.col("size") / block_bytes))).otherwise(1)
    places = written(sizes.select("cell", (rank * PARTS).cast("long").alias("first"), parts.cast("int").alias("parts")), "cells")
    dealt = rows.withColumn("cell", cell).join(small(places), "cell")
    return dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("text"), F.col("parts"))).drop("cell", "first", "parts"), n


def block_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def sliced(sizes, limit: int = SLICE_BYTES):
    """(from, to) of runs of items whose sizes sum to about the limit; an item alone may be larger."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64; a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULT = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, np.ndarray] = {}


def powers(n: int, base: int = MULT) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have
    return have


INVERSE = pow(MULT, -1, 1 << 64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (value+1) * MULT**i before each place, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, alike wherever they stand; made from prefix_hash()."""
    x = (prefix[end] - prefix[start]) * powers(len(prefix), INVERSE)[start]
    return mix64(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def binary_list(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def int_list(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return column.fill_null(null).combine_chunks().to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy()
