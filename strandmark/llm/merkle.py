"""Merkle dataset manifest: a hash tree over rows for each value of a column, one tree over their roots, and proofs by octopus multiproofs.

Rows are ranked in each tree by a sort over ranges, so no tree is ever in one task. Nodes grow HEIGHT levels at a time, from
runs of 2**HEIGHT neighbours. A run is a leaf partition: it finds the least set of coordinates that its leaves' proofs need
and that don't follow from the leaves themselves, fetches those nodes in one join, derives the interior nodes that its
proofs share, and reads each leaf's own proof from them.

Fixed results: a tree of one leaf has that leaf as root. A null value of the tree's column is a tree of its own, ahead of
all others; null keys come first in a tree; rows with the same key are ordered by their digests, and rows that are alike
get proofs of their own. Null fields are '-', empty ones '0:'. Empty tables have no rows. Columns other than those named are
never touched, so none can clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Levels of a tree that are built, and leaves (as a power of two) that are proved, in one group.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree over roots; the others are '' for null, or '=' and the value.
TOP = "^"


def digest_of(**fields: Column) -> Column:
    """The lowercase hex sha256 of fields, in their order: '-' if null, else the count of UTF-8 bytes, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields.values())).cast("binary"), 256)


def leaf_of(**instead: Column) -> Column:
    """digest_of() the fields of a document, some of them replaced."""
    return digest_of(**{k: instead.get(k, F.col(k)) for k in FIELDS})


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.when(x["left"], F.concat(x["digest"], acc)).otherwise(F.concat(acc, x["digest"])).cast("binary"), 256))


def depth(n: int) -> int:
    return (n - 1).bit_length()


def octopus(wanted, n: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes that prove the wanted leaves of a tree of n: siblings on their ways up that neither they nor each other give."""
    out, at = [], sorted(set(wanted))
    for level in range(depth(n)):
        have, size = set(at), -(-n >> level)
        out += [(level, i ^ 1) for i in at if i ^ 1 not in have and i ^ 1 < size]
        at = sorted({i >> 1 for i in at})
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with their place idx in their tree and its size n; and (tree, n). The sort is over ranges, and only ranges are summed in order."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [tree, *order, "_tie"]
    kept = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), "ranked")
    part = F.shiftright("_at", 33)
    spans = kept.groupBy(tree, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    spans = written(spans, "spans")
    w = Window.partitionBy(tree)  # a row for each range that the tree meets
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n")), "places")
    placed = kept.withColumn("_part", part).join(small(spans), [tree, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_part", "_shift"), spans.select(tree, "n").distinct()


def _subtree(base: int):
    """The nodes of the next HEIGHT levels over one run of neighbours on level base."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        tree, n = t["tree"][0].as_py(), t["n"][0].as_py()
        at, row = t["idx"][0].as_py(), t["digest"].to_pylist()
        out: list[tuple] = []
        for level in range(base + 1, min(base + HEIGHT, depth(n)) + 1):
            row, at = [_sha("".join(row[i : i + 2])) for i in range(0, len(row), 2)], at >> 1
            out += [(level, at + i, x) for i, x in enumerate(row)]
        levels, places, digests = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "level": pa.array(levels, pa.int32()), "idx": pa.array(places, pa.int64()), "n": pa.array([n] * len(out), pa.int64()), "digest": pa.array(digests, pa.string())})

    return build


def _grown(leaves: DataFrame) -> DataFrame:
    """All nodes above leaves(tree, n, idx, digest), as (tree, level, idx, n, digest)."""
    deepest = depth(leaves.agg(F.max("n")).first()[0] or 1)
    rows, found = leaves.select("tree", "n", "idx", "digest"), None
    for base in range(0, deepest, HEIGHT):
        run = F.shiftright("idx", HEIGHT).alias("run")
        made = written(rows.select("*", run).groupBy("tree", "run").applyInArrow(_subtree(base), "tree string, level int, idx bigint, n bigint, digest string"), "nodes")
        found = made if found is None else found.unionByName(made)
        rows = made.where(F.col("level") == base + HEIGHT).select("tree", "n", "idx", "digest")
    none = rows.limit(0).select("tree", F.lit(0).alias("level"), "idx", "n", "digest")
    return none if found is None else found


def _roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of the roots."""
    alone = leaves.where("n = 1").select("tree", "digest")
    # a node is a root if it is alone on its level, and no level below it has just one
    top = nodes.where("idx = 0 and n > pow(2, level - 1) and n <= pow(2, level)").select("tree", "digest")
    return alone.unionByName(top)


def manifest(rows: DataFrame, by: str = "lang", key: str = "doc_id", digest: str = "leaf", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes) of rows, whose digests are hex text.

    leaves(tree, idx, n, rank, trees, digest, key, keep...): each row with its place in its tree of n leaves, and that tree's
    place among all trees. nodes(tree, level, idx, digest): all nodes, leaves (level 0) and those of the tree over roots too.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")).alias("tree")
    read = written(rows.select(tree, F.col(key), F.col(digest).alias("digest"), *keep), "leaves")
    leaves, sizes = _ranked(read, "tree", [key, "digest"])
    trees, _ = _ranked(sizes.select(F.lit(TOP).alias("top"), F.col("tree").alias("name")), "top", ["name"])
    trees = written(trees.select(F.col("name").alias("tree"), F.col("idx").alias("rank"), F.col("n").alias("trees")), "trees")
    leaves = written(leaves.join(small(trees), "tree"), "leaves")
    nodes = _grown(leaves)
    tops = _roots(leaves, nodes).join(small(trees), "tree").select(F.lit(TOP).alias("tree"), F.col("trees").alias("n"), F.col("rank").alias("idx"), "digest")
    tops = written(tops, "roots")
    cols = ["tree", F.col("level").cast("int").alias("level"), "idx", "digest"]
    every = nodes.select(*cols).unionByName(_grown(tops).select(*cols))
    for base in (leaves, tops):
        every = every.unionByName(base.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    return leaves, every


def _missing(t: pa.Table) -> pa.Table:
    """The coordinates that one leaf partition lacks, in its own tree and in the one over roots."""
    first = {c: t[c][0].as_py() for c in ("tree", "run", "n", "rank", "trees")}
    need = [(first["tree"], *x) for x in octopus(t["idx"].to_pylist(), first["n"])] + [(TOP, *x) for x in octopus([first["rank"]], first["trees"])]
    of = lambda k, kind: pa.array([x[k] for x in need], kind)
    return pa.table({"tree": pa.array([first["tree"]] * len(need), pa.string()), "run": pa.array([first["run"]] * len(need), pa.int64()), "in_tree": of(0, pa.string()), "level": of(1, pa.int32()), "at": of(2, pa.int64())})


def _climb(have: dict, wanted: list[int], n: int) -> str:
    """Adds what the nodes at hand give, up to the root."""
    at = sorted(set(wanted))
    for level in range(depth(n)):
        size = -(-n >> level)
        at = sorted({i >> 1 for i in at})
        for i in at:
            have[level + 1, i] = _sha(have[level, 2 * i] + (have[level, 2 * i + 1] if 2 * i + 1 < size else ""))
    return have[depth(n), 0]


def _proof(have: dict, i: int, n: int) -> list[dict]:
    out = []
    for level in range(depth(n)):
        out.append({"left": bool(i & 1), "digest": have[level, i ^ 1] if i ^ 1 < -(-n >> level) else ""})
        i >>= 1
    return out


def proofs(wanted: DataFrame, nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The wanted leaves of manifest(), any of them, with subroot, root and proof, an array of (left, digest) from leaf to root.

    left: the sibling stands left of it; digest: the sibling, '' where a node is alone in its run. folded() follows a proof.
    """
    runs = wanted.withColumn("run", F.shiftright("idx", HEIGHT))
    ask = written(runs.select("tree", "run", "idx", "n", "rank", "trees").groupBy("tree", "run").applyInArrow(_missing, "tree string, run bigint, in_tree string, level int, at bigint"), "asked")
    known = nodes.select(F.col("tree").alias("in_tree"), "level", F.col("idx").alias("at"), F.col("digest").alias("found"))
    got = known.join(small(ask), ["in_tree", "level", "at"])
    types = dict(wanted.dtypes)
    cols = ["tree", *keep]

    def expand(t: pa.Table, fetched: pa.Table) -> pa.Table:
        n, rank, trees = (t[c][0].as_py() for c in ("n", "rank", "trees"))
        tree, at = t["tree"][0].as_py(), t["idx"].to_pylist()
        own, top = {(0, i): x for i, x in zip(at, t["digest"].to_pylist(), strict=True)}, {}
        for name, level, i, x in zip(*(fetched[c].to_pylist() for c in ("in_tree", "level", "at", "found")), strict=True):
            (top if name == TOP and tree != TOP else own)[level, i] = x
        subroot = top[0, rank] = _climb(own, at, n)
        root, above = _climb(top, [rank], trees), _proof(top, rank, trees)
        rest = {"subroot": pa.array([subroot] * len(at)), "root": pa.array([root] * len(at)), "proof": pa.array([_proof(own, i, n) + above for i in at], pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())])))}
        return pa.table({c: t[c] for c in (*cols, "idx", "digest")} | rest)

    kinds = ", ".join(f"`{c}` {types[c]}" for c in (*cols, "idx", "digest"))
    each = runs.groupBy("tree", "run").cogroup(got.groupBy("tree", "run"))
    return each.applyInArrow(expand, f"{kinds}, subroot string, root string, proof array<struct<left:boolean,digest:string>>")


def checked(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, claimed, folded_root, verified) of all documents: each against its proof, with n_chars one higher where tampered.

    claimed is the leaf of what was tampered with, else the leaf itself; folded_root is what it gives with the proof.
    """
    one_more = F.when(tampered, F.try_add(F.col("n_chars"), F.lit(1))).otherwise(F.col("n_chars"))
    rows = docs.select("doc_id", "lang", leaf_of().alias("leaf"), F.when(tampered, leaf_of(n_chars=one_more)).alias("claimed"))
    leaves, nodes = manifest(rows, keep=("claimed",))
    found = proofs(leaves, nodes, keep=("doc_id", "claimed"))
    found = found.withColumn("claimed", F.coalesce("claimed", "digest"))
    found = found.withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "claimed", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
