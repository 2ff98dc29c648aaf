"""Near-duplicate classes by BagMinHash.

A document is the multiset of its word shingles. Every shingle owns Poisson processes on a hierarchy of
weight intervals (0,1], (1,2], (2,4], (4,8], ...; the rate of each is its length, and a point lies in one of
the discrete weights of its interval and belongs to one component of the signature. A document takes the
points at weights up to its count, and keeps the earliest of each component: two documents agree in a
component with a probability equal to their weighted Jaccard similarity. Points later than what can still
matter are never made.

Documents with equal texts are one node throughout. Signatures are banded; nodes that share a band are in one
bucket. Every two nodes of a bucket are, in the end, in one class, or known to be less alike than `least`:

* Each node is held against the first member of each of its buckets by their signatures, a byte a component; the
  most alike of these is verified on the multisets of the texts. What is verified makes classes.
* In buckets that still hold several classes, the signatures of all pairs across classes are compared, tile by tile in
  a large bucket, where the largest class isn't compared within itself. Pairs that agree in ALIKE components make
  families of classes; of these, a task returns no more than join what was apart.
* A family of more than one class is verified across its classes, tile by tile: a task has two tiles of texts, counts
  all overlaps by products of incidence matrices, and returns no more links than join what was apart.

So pairs of a large group are never listed, and whole texts move only within families. What a group costs grows with
the square of the part that isn't in one class, over TEXTS bytes a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_of, forget, free, mix64, portions, prefix_hash, released, sliced, span_hash, written

WIDTH, LEAST = 5, 0.8
#: Text bytes whose signatures are made at once.
SLICE = 1 << 18
#: 32 bands of 5: two documents of similarity 0.8 miss each other with a probability of 3e-6.
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Components in which two nodes agree before their texts are compared: 0.8 of 160 less six standard deviations, so a pair of 0.8 is passed over with a probability of 2e-8.
ALIKE = 98
#: A bucket of more members is compared by tiles, of TILE members; smaller ones are compared many in a task.
WHOLE, TILE = 64, 1024
#: Members of small buckets that a task compares, about.
MEMBERS = 2_000
#: Edges whose components a task finds by itself.
EDGES = 200_000
#: Text bytes of a tile of a family, about, and shingles that are counted at once.
TEXTS, COLUMNS = 1 << 20, 8192
G1, G2, G3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of WIDTH words, A-Z lower-cased; a text of fewer words, but not none, is one shingle."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(firsts, start, side="right") - 1
    words = span_hash(prefix_hash(data), start, end)
    count = np.bincount(doc, minlength=len(texts))
    mixed = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        mixed = mixed * G1 + words[k : len(words) - WIDTH + 1 + k] if len(mixed) else mixed
    whole = doc[: len(mixed)] == doc[WIDTH - 1 :] if len(mixed) else np.zeros(0, bool)
    docs, hashes = [doc[: len(mixed)][whole]], [mix64(mixed[whole])]
    begin = np.cumsum(count) - count
    for d in np.flatnonzero((count > 0) & (count < WIDTH)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[begin[d] : begin[d] + count[d]]:
                h = h * G1 + w
        docs.append(np.array([d]))
        hashes.append(mix64(np.array([h + np.uint64(count[d])], np.uint64)))
    return np.concatenate(docs), np.concatenate(hashes)


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles, by document and hash."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n rows of SIZE earliest times; infinite where a document has no shingle."""
    sig = np.full((n, SIZE), np.inf)
    total = np.bincount(doc, weights=count, minlength=n)
    until = np.where(total > 0, SIZE / np.maximum(total, 1) * (np.log(SIZE) + 4), 0.0)
    todo = total > 0
    while todo.any():
        low, high, level = 0, 1, 0
        sel = todo[doc]
        d0, h0, c0 = doc[sel], h[sel], count[sel]
        while len(h0):
            seed = mix64(h0 ^ (np.uint64((level + 1) * int(G3) & 0xFFFFFFFFFFFFFFFF)))
            _points(sig, d0, seed, c0, until, low, high, level)
            low, high, level = high, high * 2, level + 1
            deep = c0 > low
            d0, h0, c0 = d0[deep], h0[deep], c0[deep]
        todo &= ~np.isfinite(sig).all(axis=1)
        until = np.where(todo, until * 2, until)
    return sig


def _points(sig, doc, seed, count, until, low, high, level) -> None:
    """Takes in the points of one weight interval (low, high] of the elements, up to each document's time."""
    flat, rate, done, block = sig.ravel(), float(high - low), 0, 3
    at = np.zeros(len(doc))
    while len(doc):
        r = np.arange(done, done + block, dtype=np.uint64)
        u = mix64(seed[:, None] + (r + np.uint64(1))[None, :] * G2)
        gap = -np.log(((u >> np.uint64(24)).astype(float) + 0.5) * (1.0 / (1 << 40))) / rate
        gap[:, 0] += at
        t = np.cumsum(gap, axis=1)
        ok = t <= until[doc][:, None]
        if level > 1:
            weight = low + 1 + (mix64(u ^ G3) % np.uint64(high - low)).astype(np.int64)
            take = ok & (weight <= count[:, None])
        else:
            take = ok
        part = ((u & np.uint64(0xFFFFFF)) * np.uint64(SIZE)) >> np.uint64(24)
        where = doc[:, None] * SIZE + part.astype(np.int64)
        np.minimum.at(flat, where[take], t[take])
        go = ok[:, -1]
        doc, seed, count, at = doc[go], seed[go], count[go], t[go, -1]
        done, block = done + block, min(64, 8 * (1 + done // 4))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64) * G3, (len(sig), 1))
    for k in range(ROWS):
        key = mix64(key * G1 + bits[:, :, k])
    return key.view(np.int64)


def _sketch(batches):
    for batch in portions(batches):
        texts = batch["text"].to_pylist()
        for a, b in sliced([len(t) for t in texts], SLICE):
            doc, h, count = bags(texts[a:b])
            sig = signatures(doc, h, count, b - a)
            some = np.bincount(doc, minlength=b - a) > 0
            keys = band_keys(sig)[some].ravel()
            offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            short = (mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch["node"].slice(a, b - a), batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)), pa.array([x.tobytes() for x in short], pa.binary())],
                ["node", "doc_id", "bands", "sig"],
            )


def _agree(batches):
    """Pairs of signatures that agree in ALIKE components at least, with the number of these."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint8).reshape(-1, SIZE) for k in ("sa", "sb"))
        n = (x == y).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(n.astype(np.int32))], ["a", "b", "agree"]).filter(pa.array(n >= ALIKE))


class Classes:
    """Disjoint sets over the classes that a task sees, and the pairs that joined two of them."""

    def __init__(self, root: np.ndarray):
        self.names, self.of = np.unique(root, return_inverse=True)
        self.up = list(range(len(self.names)))
        self.left = len(self.names) - 1
        self.pairs: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> None:
        """Takes in pairs of rows that are alike; of equal pairs of classes only the first matters."""
        a, b = self.of[i], self.of[j]
        first = np.unique(np.minimum(a, b) * len(self.names) + np.maximum(a, b), return_index=True)[1]
        for k in first[a[first] != b[first]].tolist():
            x, y = self.find(int(a[k])), self.find(int(b[k]))
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.left -= 1
                self.pairs.append((int(ids[i[k]]), int(ids[j[k]])))


def _joined(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})


def _agreeing(ids: np.ndarray, root: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    classes = Classes(root)
    for k in range(0, len(ids), 64):
        if classes.left:
            n = (sig[k : k + 64, None, :] == sig[None, :, :]).sum(axis=2)
            i, j = np.nonzero(n >= ALIKE)
            classes.join(i + k, j, ids)
    return classes.pairs


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, SIZE)


def _buckets(rows: pa.Table) -> pa.Table:
    """Pairs of signatures that join classes, in each of many small buckets."""
    rows = rows.sort_by([("key", "ascending"), ("id", "ascending")])
    key, ids, root = (rows[k].to_numpy() for k in ("key", "id", "root"))
    sig = _signatures(rows)
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    return _joined([p for a, b in zip(cut[:-1], cut[1:], strict=True) for p in _agreeing(ids[a:b], root[a:b], sig[a:b])])


def _tiles(rows: pa.Table) -> pa.Table:
    """Pairs of signatures that join classes, of two tiles of a bucket or of one."""
    rows = rows.sort_by("id")
    return _joined(_agreeing(rows["id"].to_numpy(), rows["root"].to_numpy(), _signatures(rows)))


def _verify_tiles(least: float):
    def links(rows: pa.Table) -> pa.Table:
        """Pairs of alike texts that join classes, of two tiles of a family or of one."""
        rows = rows.sort_by("id")
        ids, classes = rows["id"].to_numpy(), Classes(rows["root"].to_numpy())
        if classes.left:
            i, j = np.nonzero(np.triu(similarities(rows["text"].to_pylist()) >= least, 1))
            classes.join(i, j, ids)
        return released(_joined(classes.pairs))

    return links


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted hashes, counts)."""
    at = np.minimum(np.searchsorted(x[0], y[0]), max(0, len(x[0]) - 1))
    both = x[0][at] == y[0] if len(x[0]) else np.zeros(len(y[0]), bool)
    shared = np.minimum(x[1][at[both]], y[1][both]).sum() if len(x[0]) else 0
    total = x[1].sum() + y[1].sum() - shared
    return float(shared / total) if total else 1.0


def _verify(least: float):
    def verify(batches):
        """Pairs of texts that are alike."""
        for batch in portions(batches):
            ta, tb = batch["ta"].to_pylist(), batch["tb"].to_pylist()
            sim = np.zeros(len(ta))
            for a, b in sliced([len(x) + len(y) for x, y in zip(ta, tb, strict=True)]):
                doc, h, count = bags(ta[a:b] + tb[a:b])
                cut = np.searchsorted(doc, np.arange(2 * (b - a) + 1))
                for i in range(b - a):
                    x, y = (slice(cut[k], cut[k + 1]) for k in (i, i + b - a))
                    sim[a + i] = similarity((h[x], count[x]), (h[y], count[y]))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(sim >= least))

    return verify


def similarities(texts: list[bytes]) -> np.ndarray:
    """Weighted Jaccard of all pairs of a tile's texts. A shingle that occurs k times is k elements of a set, so overlaps are products of 0/1 matrices."""
    doc, h, count = [], [], []
    for a, b in sliced([len(t) for t in texts]):
        d, x, c = bags(texts[a:b])
        doc.append(d + a)
        h.append(x)
        count.append(c)
    doc, h, count = (np.concatenate(x) for x in (doc, h, count))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, h = np.repeat(doc, count), mix64(np.repeat(h, count) + nth.astype(np.uint64) * G3)
    size = np.bincount(doc, minlength=len(texts)).astype(np.float32)
    order = np.argsort(h)
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    element = np.cumsum(new) - 1
    shared = np.bincount(element)[element] > 1 if len(h) else new
    doc, element = doc[shared], element[shared]
    element = np.unique(element, return_inverse=True)[1]
    overlap = np.zeros((len(texts), len(texts)), np.float32)
    for c in range(0, int(element.max()) + 1 if len(element) else 0, COLUMNS):
        own = slice(*np.searchsorted(element, [c, c + COLUMNS]))
        m = np.zeros((len(texts), COLUMNS), np.float32)
        m[doc[own], element[own] - c] = 1
        overlap += m @ m.T
    return overlap / np.maximum(size[:, None] + size[None, :] - overlap, 1)


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of these edges that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    below = label < np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def _contracted(batches):
    """Edges of a task as stars, EDGES at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def stars():
        a, b = (np.concatenate([x[k].to_numpy(zero_copy_only=False) for x in held]) for k in ("a", "b"))
        return pa.record_batch([pa.array(c) for c in joined_up(a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes of edges(a, b).

    Tasks first make stars of the edges that they hold, a bounded number at a time; where all edges fit one task, that is
    all. Otherwise large and small stars alternate over all edges; each round is a table in the shared folder, and its size
    is all that the driver sees. Minima are joined back rather than neighbours gathered, so a hub has no list of them.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(low, "a")
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def contracted(df: DataFrame, tasks: int) -> DataFrame:
        return written(df.select("a", "b").coalesce(tasks).mapInArrow(_contracted, "a long, b long"), "edges")

    n = edges.count()
    now = contracted(edges, -(-n // EDGES) or 1)
    if n > EDGES:
        seen = None
        while (found := mark(now)) != seen:
            after = written(star(star(now, True), False), "edges")
            forget(now)
            now, seen = after, found
    # every node now hangs on its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _placed(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, node, root) of every row: its text's hash and what names its class."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", _node())
    sketches = rows.select("node", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_sketch, "node binary, doc_id long, bands array<long>, sig binary")
    sketches = written(sketches, "sketches")
    nodes = sketches.where(F.size("bands") > 0).dropDuplicates(["node"]).select(F.monotonically_increasing_id().alias("id"), "node", "bands", "sig")
    nodes = written(nodes, "nodes")  # ids are those of the table
    sig = nodes.select("id", "sig")

    each = nodes.select("id", F.explode("bands").alias("key"))
    hubs = each.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    members = written(each.join(hubs, "key"), "members")

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long, agree int")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(_verify(least), "a long, b long"), "links")

    def rooted(df: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
        """df with the root of the class of its column name; a node without links is its own."""
        return df.join(roots.select(F.col("node").alias(name), F.col("root").alias("_r")), name, "left").withColumn(root, F.coalesce("_r", name)).drop("_r")

    stars = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    best = alike(stars).groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"))
    best = written(best, "best")
    wanted = nodes.select("id", "node").join(members.select("id").distinct(), "id", "left_semi")
    texts = rows.select("node", F.col("text").cast("binary").alias("text")).dropDuplicates(["node"]).join(wanted, "node").select("id", "text")
    texts = written(texts, "texts")
    links = verified(best)
    roots = components(links)

    # buckets of several classes
    placed = rooted(members.select("key", "id"), roots, "id", "root")
    open_ = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1").select("key", "n")
    apart = written(placed.join(open_, "key"), "apart")
    few, many = apart.where(F.col("n") <= WHOLE), apart.where(F.col("n") > WHOLE)
    groups = max(1, few.count() // MEMBERS)
    pairs = few.join(sig, "id").select("key", "id", "root", "sig", block_of(groups, "key").alias("g")).groupBy("g").applyInArrow(_buckets, "a long, b long")
    if not many.isEmpty():
        pairs = pairs.unionByName(tiled(many.select("key", "id", "root", F.lit(1).alias("size")), TILE).join(sig, "id").groupBy("key", "i", "j").applyInArrow(_tiles, "a long, b long"))
    pairs = written(pairs, "pairs")

    # families of several classes
    family = components(links.unionByName(pairs)).select(F.col("node").alias("id"), F.col("root").alias("key"))
    member = rooted(family, roots, "id", "root")
    open_ = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    member = written(member.join(open_, "key").join(texts.select("id", F.octet_length("text").alias("size")), "id"), "families")
    more = written(tiled(member, TEXTS).join(texts, "id").groupBy("key", "i", "j").applyInArrow(_verify_tiles(least), "a long, b long"), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    names = nodes.select(F.col("id").alias("own"), F.col("node").alias("name")).join(roots, F.col("own") == F.col("node")).select("name", "root")
    names = written(names, "names")
    forget(nodes, members, best, texts, links, apart, pairs, member, more, roots)
    named = sketches.select("doc_id", "node").join(names.withColumnRenamed("name", "node"), "node", "left")
    return named.select("doc_id", "node", F.coalesce(F.unhex(F.lpad(F.hex("root"), 16, "0")), "node").alias("root"))


def tiled(members: DataFrame, most: int) -> DataFrame:
    """(key, id, root, i, j): members(key, id, root, size) of each key for every two tiles that have to meet, tiles of about `most` by size.

    The largest class of a key has tiles of its own, which don't meet each other.
    """
    sizes = members.groupBy("key", "root").agg(F.sum("size").alias("m"))
    big = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("big"), F.sum("m").alias("n"))
    big = big.select("key", F.col("big.root").alias("big"), F.ceil(F.col("big.m") / most).cast("int").alias("tb"), F.ceil((F.col("n") - F.col("big.m")) / most).cast("int").alias("to"))
    main = F.col("root") == F.col("big")
    spot = F.when(main, F.pmod(F.xxhash64("id"), F.col("tb"))).otherwise(F.col("tb") + F.pmod(F.xxhash64("id"), F.col("to"))).cast("int")
    dealt = members.join(big, "key").select("key", "id", "root", spot.alias("tile"), F.explode(F.sequence(F.when(main, F.col("tb")).otherwise(0), F.col("tb") + F.col("to") - 1)).alias("other"))
    return dealt.select("key", "id", "root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and class_size for every row of docs(doc_id, text).

    Two texts are linked if the weighted Jaccard similarity of their shingle multisets is at least `least` (0.8 or
    more; signatures are cut for that); a class is what links connect. Texts of fewer than five words are one shingle;
    texts without words are only like equal texts, and a null text is an empty one. Repeated rows are members each. A
    null doc_id has the class of its text; a class of null ids alone has a null class_id. Empty table: no rows. Other
    columns are not read.
    """
    if least < LEAST:
        raise ValueError("bands and ALIKE are made for a similarity of 0.8 or more")
    placed = written(_placed(docs, least), "placed")
    sums = written(placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return placed.join(sums, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate class; columns stay.

    It is the row of the least doc_id that the class has, of the least text hash among its texts. Rows of one id in
    different classes are apart, so each class keeps its own; a class of rows without an id keeps one of these. Of
    rows that repeat both id and text the one stays whose other columns come first as JSON.
    """
    sums = _placed(docs, LEAST).groupBy("root", "doc_id", "node").agg(F.count("*").alias("n"))
    kept = sums.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "node", "n")).alias("m"))
    of, at, n, null = free(docs, "kept_id", "kept_node", "kept_n", "kept_null")
    kept = written(kept.select(F.col("m.doc_id").alias(of), F.col("m.node").alias(at), F.col("m.n").alias(n)), "kept")
    own = F.col("doc_id").eqNullSafe(F.col(of)) & (_node() == F.col(at))
    many = kept.where(F.col(n) > 1)
    if many.isEmpty():
        return docs.join(kept, own, "left_semi")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(F.col("text").isNull().alias(null), *rest))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = docs.join(many, own).groupBy(of, at).agg(F.min_by(whole, order).alias("m")).select("m.*")
    return docs.join(kept.where(F.col(n) == 1), own, "left_semi").unionByName(first)
