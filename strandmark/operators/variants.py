"""Variant and genotype tables: sweeps, merges, spectra, sampling, nearest variants, haplotype coordinates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from .reads import overlap_join, serialise
from .sequence import STRETCH, along
from .tables import settled


def sample_variants(variant: DataFrame, genotype: DataFrame) -> DataFrame:
    return variant.join(genotype, "v_id")


def copy_variants(sampled: DataFrame, copy: int) -> DataFrame:
    return sampled.where(F.col("gt").isin(copy, 2))


def sample_names(genotype: DataFrame) -> DataFrame:
    return genotype.select("sample").distinct()


def first_samples(genotype: DataFrame, n: int) -> DataFrame:
    """The first n names in order."""
    return sample_names(genotype).orderBy("sample").limit(n)


def contigs_with_variants(contig: DataFrame, variant: DataFrame) -> DataFrame:
    return contig.join(variant.select("chrom"), "chrom", "left_semi")


def concat_variants(lists: list[DataFrame]) -> DataFrame:
    """Variant lists of several sources, one after the other, with new serial numbers by place."""
    cols = ["chrom", "pos", "stop", "ref", "alt", "p"]
    every = reduce(DataFrame.unionByName, (d.select(*cols, F.lit(k).alias("source"), F.col("v_id").alias("own_id")) for k, d in enumerate(lists)))
    order = ["pos", "ref", "alt", "source", "own_id"]
    return serialise(every, order, X.bin_of("pos", STRETCH), ("chrom",), "v_id")


def _chain(pos: np.ndarray, stop: np.ndarray, slack: int) -> np.ndarray:
    """For each row in order, the next row that may be kept after it; len(pos) for none."""
    return np.maximum(np.searchsorted(pos, stop + slack, side="right"), np.arange(1, len(pos) + 1))


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("pos", "ascending"), ("v_id", "ascending")])


def clusters(df: DataFrame, by: list[str], slack: int, width: int = STRETCH) -> DataFrame:
    """df with begins and ends: whether a row lies beyond (by more than slack) all that come before it in the order of (pos, v_id), and whether all that come after lie beyond it.

    What begins and ends is alone in its cluster. The furthest stop so far is found inside stretches, and carried over from
    those before by a row for each.
    """
    rows = df.withColumn("_b", X.bin_of("pos", width))
    names = {c: f"_k_{i}" for i, c in enumerate((*by, "_b"))}
    every = Window.partitionBy(*by).orderBy("_b")
    sums = rows.groupBy(*by, "_b").agg(F.max("stop").alias("s"), F.min("pos").alias("p"))
    sums = sums.select(*(F.col(c).alias(n) for c, n in names.items()), F.max("s").over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("_far"), F.min("p").over(every.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    own = Window.partitionBy(*by, "_b").orderBy("pos", "v_id")
    near = rows.withColumn("_s", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_p", F.lead("pos").over(own))
    near = near.join(sums, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    far, after = F.greatest("_s", "_far"), F.coalesce("_p", "_next")
    beyond = lambda pos, stop: F.coalesce(pos > stop + slack, F.lit(True))
    # the next row begins a cluster if it is beyond this row and all before it
    near = near.withColumn("begins", beyond(F.col("pos"), far)).withColumn("ends", beyond(after, F.greatest("stop", far)))
    return near.drop("_b", "_s", "_p", "_far", "_next", *names.values())


def sweep(df: DataFrame, by: list[str], slack: int, width: int = STRETCH) -> DataFrame:
    """Greedy sweep in order of (pos, v_id): a row is kept if pos > stop + slack of the last one kept. Columns by, pos, stop, v_id.

    A row that is alone in its cluster is kept, and what comes after a cluster doesn't depend on it; so only clusters of
    several rows are walked.
    """
    marked = settled(clusters(df.select(*by, "pos", "stop", "v_id"), by, slack, width))
    alone = F.col("begins") & F.col("ends")
    cols = [*by, "pos", "stop", "v_id"]
    return marked.where(alone).select(*cols).unionByName(_walked(marked.where(~alone).select(*cols), by, slack, width))


def _walked(df: DataFrame, by: list[str], slack: int, width: int) -> DataFrame:
    """The sweep over clusters of several rows.

    Chromosomes are cut into stretches. What a stretch does depends only on the stop of the last row kept before it, so
    a first pass gives for each stretch the stop it ends with, by where its first kept row lies (few numbers, as chains
    from different rows soon meet); these are followed from stretch to stretch, and a second pass keeps the rows.
    """
    rows = df.select(*by, "pos", "stop", "v_id", X.bin_of("pos", width).alias("_b"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)

    def ends(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        pos, stop = t["pos"].to_numpy(), t["stop"].to_numpy()
        step, end = _chain(pos, stop, slack).tolist(), stop.tolist()
        for i in range(len(end) - 1, -1, -1):
            if step[i] < len(end):
                end[i] = end[step[i]]
        end = np.array(end)
        last = np.flatnonzero(np.append(end[1:] != end[:-1], True))  # the last row of each run of equal ends
        out = {c: t[c].slice(0, 1) for c in (*by, "_b")}
        return pa.table(out | {"upto": pa.array([pos[last].tolist()], pa.list_(pa.int64())), "end": pa.array([end[last].tolist()], pa.list_(pa.int64()))})

    def follow(t: pa.Table) -> pa.Table:
        t = t.sort_by("_b")
        at, before = None, []
        for upto, end in zip(t["upto"].to_pylist(), t["end"].to_pylist(), strict=True):
            before.append(at)
            k = 0 if at is None else int(np.searchsorted(np.array(upto), at + slack, side="right"))
            at = end[k] if k < len(end) else at
        return pa.table({c: t[c] for c in (*by, "_b")} | {"before": pa.array(before, pa.int64())})

    def keep(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        pos, stop, before = t["pos"].to_numpy(), t["stop"].to_numpy(), t["before"][0].as_py()
        step = _chain(pos, stop, slack)
        i = 0 if before is None else int(np.searchsorted(pos, before + slack, side="right"))
        kept = []
        while i < len(pos):
            kept.append(i)
            i = int(step[i])
        return t.select([*by, "pos", "stop", "v_id"]).take(pa.array(kept, pa.int64()))

    sums = rows.groupBy(*by, "_b").applyInArrow(ends, f"{kinds}, _b bigint, upto array<bigint>, end array<bigint>")
    start = sums.groupBy(*by).applyInArrow(follow, f"{kinds}, _b bigint, before bigint")
    names = {c: f"_k_{i}" for i, c in enumerate((*by, "_b"))}
    start = start.withColumnsRenamed(names)
    both = rows.join(start, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]).drop(*names.values())
    return both.groupBy(*by, "_b").applyInArrow(keep, f"{kinds}, pos bigint, stop bigint, v_id bigint")


def remove_collisions(df: DataFrame, by: list[str]) -> DataFrame:
    """Keeps the first, and skips what begins at or before the stop of the last one kept."""
    return sweep(df, by, 0)


def min_spacing(df: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Skips what begins less than gap after the stop of the last one kept."""
    return sweep(df, by, gap - 1)


def merge_diploid(copies: DataFrame, by: list[str], filter_multi_allele: bool = False) -> DataFrame:
    """(by, pos, v_id, gt) from (by, copy, pos, v_id) with a row for each copy and pos at most."""
    side = lambda k: F.max(F.when(F.col("copy") == k, F.col("v_id")))
    g = copies.groupBy(*by, "pos").agg(side(0).alias("z0"), side(1).alias("z1"))
    two = F.col("z0").isNotNull() & F.col("z1").isNotNull() & (F.col("z0") != F.col("z1"))
    if filter_multi_allele:
        g = g.where(~two)
    row = lambda v, gt: F.struct(v.alias("v_id"), F.lit(gt).cast("bigint").alias("gt"))
    out = F.when(F.col("z0") == F.col("z1"), F.array(row(F.col("z0"), 2))).when(two, F.array(row(F.col("z0"), 0), row(F.col("z1"), 1))).when(F.col("z0").isNotNull(), F.array(row(F.col("z0"), 0))).otherwise(F.array(row(F.col("z1"), 1)))
    return g.select(*by, "pos", F.explode(out).alias("o")).select(*by, "pos", "o.v_id", "o.gt")


def nearest_variant(v1: DataFrame, v2: DataFrame, width: int = STRETCH) -> DataFrame:
    """v1 with the nearest v2 of its chromosome: distance and indel length; the later one at equal distance.

    Neighbours are sought inside stretches of a chromosome; beyond their ends, each stretch knows the last v2 before
    and the first one after it.
    """
    last = v2.groupBy("chrom", "pos").agg(F.max_by("x", "v_id").alias("x2")).select("chrom", "pos", F.lit(None).cast("bigint").alias("v_id"), F.struct(F.col("pos").alias("p2"), "x2").alias("n"), F.lit(0).alias("side"))
    both = v1.select("chrom", "pos", "v_id", F.lit(None).cast("struct<p2:bigint,x2:bigint>").alias("n"), F.lit(1).alias("side")).unionByName(last).withColumn("_b", X.bin_of("pos", width))
    ends = both.groupBy("chrom", "_b").agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    every = Window.partitionBy("chrom").orderBy("_b")
    before = F.last("hi", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("lo", ignorenulls=True).over(every.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("chrom", "_b", before.alias("before"), after.alias("after"))
    w = Window.partitionBy("chrom", "_b").orderBy("pos", "side")
    down = Window.partitionBy("chrom", "_b").orderBy(F.desc("pos"), F.desc("side"))
    near = both.withColumn("lo", F.last("n", ignorenulls=True).over(w)).withColumn("hi", F.last("n", ignorenulls=True).over(down)).where("side = 1")
    near = near.join(ends, ["chrom", "_b"]).withColumn("lo", F.coalesce("lo", "before")).withColumn("hi", F.coalesce("hi", "after"))
    d0, d1 = F.col("pos") - F.col("lo.p2"), F.col("hi.p2") - F.col("pos")
    pick = F.when(F.col("lo").isNull() | (d1 <= d0), F.col("hi")).otherwise(F.col("lo"))
    return near.withColumn("m", pick).select("v_id", "chrom", "pos", F.abs(F.col("pos") - F.col("m.p2")).alias("dist"), F.col("m.x2").alias("length"))


def _levels(spark: SparkSession, spectrum) -> DataFrame:
    """(i, p, f) of a spectrum: pairs of level and share in their order, or a table (p, f) in the order of p."""
    if isinstance(spectrum, DataFrame):
        return spectrum.select((F.row_number().over(Window.orderBy("p")) - 1).alias("i"), "p", "f")  # a row for each level
    return spark.createDataFrame([(i, float(p), float(f)) for i, (p, f) in enumerate(spectrum)], "i int, p double, f double")


def rebalance_spectrum(variant: DataFrame, spectrum) -> DataFrame:
    """Levels of p handed out in blocks of int(f*n+0.5) in the order of p; rows past the last block keep theirs.

    spectrum: pairs (level, share), or a table (p, f) of any length. Blocks are ranges of ranks, and a rank finds its
    own by an interval join.
    """
    sizes = variant.groupBy("chrom").agg(F.count("*").alias("_all"))
    levels = _levels(variant.sparkSession, spectrum).select("i", F.col("p").alias("_level"), F.col("f").alias("_f"))
    size = F.floor(F.col("_f") * F.col("_all") + 0.5)
    blocks = sizes.join(F.broadcast(levels), how="cross").withColumn("_n", size)  # a row for each chromosome and level
    end = F.sum("_n").over(Window.partitionBy("chrom").orderBy("i"))
    cut = blocks.select("chrom", (end - F.col("_n")).alias("f_start"), (end - 1).alias("f_stop"), "_level")
    # a last block, without a level, takes what is left, so that every rank has one block
    rest = blocks.groupBy("chrom", "_all").agg(F.sum("_n").alias("_n")).select("chrom", F.col("_n").alias("f_start"), (F.col("_all") - 1).alias("f_stop"), F.lit(None).cast("double").alias("_level"))
    ranked = serialise(variant, ["v_id"], F.struct("p", X.bin_of("v_id", STRETCH)), ("chrom",), "_rank")
    met = overlap_join(ranked, cut.unionByName(rest).where("f_stop >= f_start"), "_rank", "_rank")
    return met.withColumn("p_new", F.coalesce("_level", "p")).drop("_rank", "_level", "f_start", "f_stop")


def waypoints(variant: DataFrame, by: list[str], width: int = STRETCH) -> DataFrame:
    """Anchors between reference and haplotype for each variant of a copy; summed along stretches of a haplotype."""
    w = along(variant.withColumn("delta", X.indel_length()), tuple(by), "delta", ("pos", "v_id"), width).withColumn("alt_pos", F.col("pos") + F.col("_shift"))
    indel = F.col("delta") != 0
    return w.select(*by, "v_id", F.when(indel, F.col("pos") + F.length("ref")).otherwise(F.col("pos")).cast("bigint").alias("ref_pos"), F.when(indel, F.col("alt_pos") + 1).otherwise(F.col("alt_pos")).alias("alt_pos"), "delta")


def assign_v_id(variant: DataFrame) -> DataFrame:
    """Serial numbers from 0 by place, for each chromosome."""
    return serialise(variant, ["pos", "ref", "alt", "v_id"], X.bin_of("pos", STRETCH), ("chrom",), "new_id")


def indel_histogram(variant: DataFrame, most: int = 50, genotype: DataFrame | None = None, sample=None) -> DataFrame:
    """(x, n) for every length from -most to most; with genotype and sample, of what that sample has, each variant once."""
    if sample is not None:
        variant = variant.join(genotype.where(F.col("sample") == sample).select("v_id").distinct(), "v_id", "left_semi")
    got = variant.groupBy(X.indel_length().alias("x")).agg(F.count("*").alias("n"))
    return variant.sparkSession.range(-most, most + 1).select(F.col("id").alias("x")).join(got, "x", "left").select("x", F.coalesce("n", F.lit(0)).alias("n"))


def discovery_curve(variant: DataFrame, sizes: list[int]) -> DataFrame:
    """Expected share of the variants that n samples show."""
    each = variant.select("p", F.explode(F.array(*map(F.lit, sizes)).cast("array<bigint>")).alias("n"))
    return each.groupBy("n").agg(F.avg(1 - F.pow(1 - F.col("p"), F.col("n"))).alias("share"))


def variant_counts(variant: DataFrame, genotype: DataFrame, samples: list | None = None) -> DataFrame:
    """Variants by chromosome, of all and of each sample, with a total row (chrom null). Without samples, of the first ten in order."""
    if samples is None:
        samples = [r["sample"] for r in first_samples(genotype, 10).collect()]
    marks = genotype.where(F.col("sample").isin(samples)).groupBy("v_id").pivot("sample", samples).agg(F.count(F.lit(1)))
    rows = variant.join(marks, "v_id", "left")
    return rows.rollup("chrom").agg(F.count("*").alias("population"), *(F.coalesce(F.sum(F.col(f"`{s}`")), F.lit(0)).alias(f"s{s}") for s in samples))


def unique_and_total(genotype: DataFrame) -> DataFrame:
    """(unique_variants, total_variants): variants that some sample has, and how many all samples have together."""
    return genotype.agg(F.countDistinct("v_id").alias("unique_variants"), F.count("*").alias("total_variants"))


def weighted_sample(variant: DataFrame, seed: int, samples: int, draws: int = 2) -> DataFrame:
    """Each row kept with its own probability, in each draw of each sample, by the hash of its key."""
    each = variant.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)).cast("array<bigint>"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)).cast("array<bigint>")))
    return each.where(X.hash_uniform(F.lit(seed), F.col("sample"), F.col("copy"), F.col("chrom"), F.col("v_id")) < F.col("p"))


def cap_rows(df: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """At most n rows of each group, by hash order."""
    w = Window.partitionBy(*by).orderBy(X.hash_uniform(F.lit(seed), F.col("v_id")), "v_id")
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def variant_windows(variant: DataFrame, contig: DataFrame, w: int) -> DataFrame:
    return variant.join(contig, "chrom").select("v_id", "chrom", F.greatest(F.col("pos") - w, F.lit(0)).alias("start"), F.least(F.col("pos") + w, F.col("seq_len")).alias("end"))


def flag_multiallelic(copies: DataFrame, by: list[str]) -> DataFrame:
    """Places where the two copies have different variants; (by, copy, pos, v_id) as for merge_diploid."""
    side = lambda k: F.max(F.when(F.col("copy") == k, F.col("v_id")))
    return copies.groupBy(*by, "pos").agg(side(0).alias("z0"), side(1).alias("z1")).where("z0 <> z1")


def spectrum_histogram(variant: DataFrame, spectrum=None) -> DataFrame:
    """(level, actual, ideal) by levels of p; bins end half way to the next level, the last one includes its end.

    spectrum: pairs (level, share), or a table (p, f); by default eleven levels from 0 to the largest p, without shares
    (ideal null). The levels, not the variants, are gathered; variants find their bin by a search among its edges.
    """
    spark = variant.sparkSession
    if spectrum is None:
        most = variant.agg(F.max("p")).first()[0] or 0.0
        pairs = [(i * most / 10, None) for i in range(11)]
    else:
        pairs = [(r["p"], r["f"]) for r in _levels(spark, spectrum).orderBy("i").collect()]
    levels = [p for p, _ in pairs]
    half = [(b - a) / 2 for a, b in zip(levels, levels[1:], strict=False)] or [0.5]
    edges = [0.0, *(p + h for p, h in zip(levels[:-1], half, strict=False)), levels[-1] + half[-1]]
    total = variant.agg(F.count("*").alias("total"))
    every = spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(pairs)], "i int, level double, share double")
    cuts = sorted(set(edges))
    if len(cuts) < 3:  # one bin, or none with a width
        inside = F.col("p").between(cuts[0], cuts[-1])
        got = variant.where(inside).select(F.lit(float(len(edges) - 2)).alias("bin"))
    else:
        from pyspark.ml.feature import Bucketizer

        found = Bucketizer(splits=cuts, inputCol="p", outputCol="bin").transform(variant.select(F.col("p").cast("double").alias("p")).where(F.col("p").between(cuts[0], cuts[-1])))
        place = {float(k): float(max(i for i, e in enumerate(edges[:-1]) if e == cuts[k])) for k in range(len(cuts) - 1)}
        got = found.select("bin") if len(cuts) == len(edges) else found.replace(place, subset=["bin"]).select("bin")
    n = got.groupBy(F.col("bin").cast("int").alias("i")).agg(F.count("*").alias("n"))
    return every.join(n, "i", "left").join(F.broadcast(total), how="cross").select("level", F.coalesce("n", F.lit(0)).alias("actual"), (F.col("share") * F.col("total")).alias("ideal"))


def force_homozygous(variant: DataFrame, seed: int, samples: int) -> DataFrame:
    """weighted_sample() whose second draw is the first one again: (v_id, sample, gt 2)."""
    each = variant.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)).cast("array<bigint>")))
    return each.where(X.hash_uniform(F.lit(seed), F.col("sample"), F.col("chrom"), F.col("v_id")) < F.col("p")).withColumn("gt", F.lit(2).cast("bigint"))


def nested_samples(variant: DataFrame, p_vx: float, p_vn: list[float], seed: int) -> DataFrame:
    """(name, copy, chrom, v_id): cohorts v0, v1, ... each within the next, and vx, that meets all of them in what it shares with v0.

    vx takes the first int(n * p_vx) rows of each chromosome and copy in hash order.
    """
    u = lambda salt: X.hash_uniform(F.lit(seed), F.lit(salt), F.col("copy"), F.col("chrom"), F.col("v_id"))
    each = variant.select("chrom", "v_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("copy")).withColumn("rank_u", u("vx")).withColumn("u", u("v"))
    ranked = serialise(each, ["rank_u", "v_id"], F.floor(F.col("rank_u") * 1024), ("chrom", "copy"), "rank")
    sizes = variant.groupBy("chrom").agg(F.count("*").alias("n"))
    marked = ranked.join(sizes, "chrom").withColumn("in_vx", F.col("rank") < F.floor(F.col("n") * F.lit(p_vx)))
    usable = ~(F.col("in_vx") & (F.col("u") >= p_vn[0]))
    names = F.array(F.when(F.col("in_vx"), F.lit("vx")), *(F.when(usable & (F.col("u") < p), F.lit(f"v{k}")) for k, p in enumerate(p_vn)))
    return marked.select(F.explode(F.array_compact(names)).alias("name"), "copy", "chrom", "v_id")


def sample_n(df: DataFrame, n: int, seed: int, key: str = "v_id") -> DataFrame:
    """n rows by hash order, or all if there are fewer."""
    return df.orderBy(X.hash_uniform(F.lit(seed), F.col(key)), key).limit(n)


def diploid_samples(variant: DataFrame, seed: int, samples: int) -> DataFrame:
    """(sample, chrom, pos, v_id, gt) of drawn samples: both copies drawn, freed of collisions and merged."""
    drawn = weighted_sample(variant, seed, samples).select("sample", "copy", "chrom", "pos", "stop", "v_id")
    return merge_diploid(remove_collisions(drawn, ["sample", "copy", "chrom"]), ["sample", "chrom"])
