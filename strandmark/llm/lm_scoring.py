"""Language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z), cut into words at ASCII white space, and written as its words with one
space between them and one line feed as the end; the model gives the probability of those bytes. Every
byte is eight binary choices. Each choice has a context tree of its own over the last `depth` bytes; each
node of it keeps a Krichevsky-Trofimov estimate, and the context-tree weights mix the estimates of all
depths. The tree is learnt from the training rows and then held fixed, so a text's probability does not
depend on the other texts that are scored.

How the work is dealt: documents go to blocks of bounded size by a hash of id and text. A block sends its
distinct words and distinct (context, byte) pairs with their counts, sorted and packed by part, never its
tokens. Words are summed in the part of their hash; pairs are worked up and down the context tree in the
part of their nearest three bytes; and each block gets back the numbers of its own words and pairs. Nothing
is broadcast. There are as many parts as blocks, so what a task holds follows the block, not the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, binary_list, block_of, counted, forget, int_list, mix64, released, sliced, summed, text_size, written

END = b"\n"
SPLIT = 3  # context bytes that a part of the tree shares; the nodes of that depth and above are few, and Spark sums them
MOST_PARTS = 1 << 15
PACKED = "block int, part int, grams boolean, keys binary, numbers binary, tokens long, kinds long"
SENT = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("grams", pa.bool_()), ("keys", pa.binary()), ("numbers", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=0))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.int64))


def packed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SENT)], schema=SENT)


def gram_keys(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every byte of the bodies, nearest context byte first, the byte itself last; and each body's first place."""
    pad = END * 8
    raw = pad + pad.join(bodies)
    data = np.frombuffer(raw, np.uint8)
    past = np.ndarray((len(data) - 8,), "<u8", raw, 0, (1,))  # the eight bytes before each place, the nearest one highest
    keys = (((past >> np.uint64(8 * (8 - depth))) << np.uint64(8)) | data[8:]).view(np.int64)
    sizes = np.array([len(x) for x in bodies], np.int64)
    starts = (np.cumsum(sizes + 8) - sizes - 8).tolist()
    return np.concatenate([keys[s : s + n] for s, n in zip(starts, sizes.tolist(), strict=True)]), np.cumsum(sizes) - sizes


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def parts_of(grams: np.ndarray, depth: int, parts: int) -> np.ndarray:
    near = grams >> (8 * (depth - SPLIT + 1))
    return (mix64(near.astype(np.uint64)) % np.uint64(parts)).astype(np.uint16)


def count_block(rows: pa.Table, depth: int, parts: int) -> pa.Table:
    """Distinct words and grams of a block with their counts in its training rows, packed by part."""
    block = rows["block"][0].as_py()
    texts, train = binary_list(rows["text"]), int_list(rows["train"])
    words: Counter = Counter()
    other: set = set()
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in sliced([len(x) for x in texts]):
        bodies: tuple[list[bytes], list[bytes]] = ([], [])
        for i in range(a, b):
            w = words_of(texts[i])
            if train[i]:
                words.update(w)
                words[END] += 1
            else:
                other.update(w)
                other.add(END)
            bodies[int(train[i])].append(b" ".join(w) + END)
        for kind in (0, 1):
            if bodies[kind]:
                keys, n = counted(gram_keys(bodies[kind], depth)[0])
                pieces.append((keys, n * kind))
        if len(pieces) > 8:
            pieces = [summed(np.concatenate([x for x, _ in pieces]), np.concatenate([x for _, x in pieces]))]
    keys, n = summed(np.concatenate([x for x, _ in pieces]), np.concatenate([x for _, x in pieces]))
    out = []
    dealt: dict[int, list[bytes]] = {}
    for w in other:
        words.setdefault(w, 0)
    for w in words:
        dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
    for part, own in dealt.items():
        own.sort()
        out.append((block, part, False, zstandard.compress(b" ".join(own), 1), pack(np.array([words[w] for w in own], np.uint32)), None, None))
    part = parts_of(keys, depth, parts)
    order = np.argsort(part, kind="stable")
    keys, n, part = keys[order], n[order].astype(np.uint32), part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(first, np.append(first[1:], len(part)), strict=True):
        out.append((block, int(part[a]), True, pack_keys(keys[a:b]), pack(n[a:b]), None, None))
    return packed(out)


def sum_words(rows: pa.Table) -> pa.Table:
    """For each block of a part: the whole counts of its words; and a row of no block with the part's tokens and distinct training words."""
    part = rows["part"][0].as_py()
    total: Counter = Counter()
    each = []
    for block, keys, n in zip(rows["block"].to_pylist(), rows["keys"].to_pylist(), rows["numbers"].to_pylist(), strict=True):
        own = zstandard.decompress(keys).split(b" ")
        each.append((block, keys, own))
        for w, c in zip(own, unpack(n, np.uint32).tolist(), strict=True):
            total[w] += c
    get = total.get
    out = [(block, part, False, keys, pack(np.fromiter(map(get, own), np.uint64, len(own))), None, None) for block, keys, own in each]
    return packed([*out, (None, part, False, None, None, sum(total.values()), sum(c > 0 for c in total.values()))])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after a shift of eight."""
    low = np.ones_like(x)
    for k in range(8):
        low *= x + k
    z = x + 8.0
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


class Levels:
    """The context trees of the grams of one part: for each depth its nodes (context, partial byte) in order."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.keys, self.zeros, self.ones, self.inverse = depth, {}, {}, {}, None
        for d in range(depth, SPLIT - 1, -1):
            if d == depth:
                rows, m = grams, n
            else:
                rows, m = summed(((grams >> (8 * (depth - d + 1))) << 8) | (grams & 255), n)
            context, byte = rows >> 8, rows & 255
            nodes, ones, zeros, where = [], [], [], []
            for j in range(8):
                node = (context << 8) | ((256 | byte) >> (8 - j))
                new = np.concatenate(([True], node[1:] != node[:-1]))
                first = np.flatnonzero(new)
                bit = (byte >> (7 - j)) & 1
                nodes.append(node[first])
                ones.append(np.add.reduceat(m * bit, first))
                zeros.append(np.add.reduceat(m * (1 - bit), first))
                where.append(np.cumsum(new) - 1)
            order = np.argsort(np.concatenate(nodes), kind="stable")
            self.keys[d], self.ones[d], self.zeros[d] = (np.concatenate(x)[order] for x in (nodes, ones, zeros))
            if d == depth:
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                offsets = np.cumsum([0, *(len(x) for x in nodes)])
                self.inverse = [place[w + offsets[j]] for j, w in enumerate(where)]

    def parents(self, d: int) -> np.ndarray:
        """Where each node of depth d has its parent among those of depth d-1."""
        key = self.keys[d]
        return np.searchsorted(self.keys[d - 1], ((key >> 16) << 8) | (key & 255))

    def weigh(self) -> None:
        """log_w: ln of each node's weighted probability; weight: what its own estimate has in the mixture."""
        self.log_w, self.weight, below = {}, {}, None
        for d in range(self.depth, SPLIT - 1, -1):
            own = log_kt(self.zeros[d], self.ones[d])
            if d == self.depth:
                self.log_w[d], self.weight[d] = own, np.ones(len(own))
            else:
                below = np.bincount(self.parents(d + 1), weights=self.log_w[d + 1], minlength=len(own))
                self.weight[d] = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
                self.log_w[d] = np.logaddexp(own, below) - np.log(2)

    def predict(self, grams: np.ndarray, top_one: np.ndarray, top_rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's probability. top_*: for the nodes of depth SPLIT, what the shallower ones mix to a one, and what they leave."""
        one, rest = top_one, top_rest
        for d in range(SPLIT, self.depth + 1):
            if d > SPLIT:
                up = self.parents(d)
                one, rest = one[up], rest[up]
            kt = (self.ones[d] + 0.5) / (self.ones[d] + self.zeros[d] + 1.0)
            one = one + rest * self.weight[d] * kt
            rest = rest * (1 - self.weight[d])
        total = np.zeros(len(grams))
        for j, at in enumerate(self.inverse):
            p = one[at]
            total += np.log10(np.where((grams >> (7 - j)) & 1, p, 1 - p))
        return total


NODES = pa.schema([("part", pa.int32()), ("context", pa.int64()), ("node", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("log_w", pa.float64())])


def _tree(rows: pa.Table, depth: int) -> tuple[Levels, np.ndarray, list[np.ndarray]]:
    """The weighed trees of a part, its distinct grams, and each block's."""
    each = [unpack_keys(k) for k in rows["keys"].to_pylist()]
    grams, n = summed(np.concatenate(each), np.concatenate([unpack(x, np.uint32) for x in rows["numbers"].to_pylist()]).astype(np.int64))
    tree = Levels(grams, n, depth)
    tree.weigh()
    return tree, grams, each


def part_nodes(rows: pa.Table, depth: int) -> pa.Table:
    """Depth-SPLIT nodes of a part."""
    tree, _, _ = _tree(rows, depth)
    key = tree.keys[SPLIT]
    part = np.full(len(key), rows["part"][0].as_py(), np.int32)
    return pa.table([pa.array(part), pa.array(key >> 8), pa.array((key & 255).astype(np.int32)), pa.array(tree.zeros[SPLIT]), pa.array(tree.ones[SPLIT]), pa.array(tree.log_w[SPLIT])], schema=NODES)


def part_answers(rows: pa.Table, top: pa.Table, depth: int) -> pa.Table:
    """For each block of a part: log10 probabilities of its grams."""
    if not rows.num_rows:
        return SENT.empty_table()
    tree, grams, each = _tree(rows, depth)
    key = (int_list(top["context"]) << 8) | int_list(top["node"])
    order = np.argsort(key, kind="stable")
    if not np.array_equal(key[order], tree.keys[SPLIT]):
        raise ValueError("the shallow part of the context tree has other nodes than the deep part")
    log_p = tree.predict(grams, top["one"].to_numpy()[order], top["rest"].to_numpy()[order]).astype(np.float32)
    part = rows["part"][0].as_py()
    out = [(block, part, True, keys, pack(log_p[np.searchsorted(grams, own)]), None, None) for block, keys, own in zip(rows["block"].to_pylist(), rows["keys"].to_pylist(), each, strict=True)]
    return packed(out)


SCORES = pa.schema([("doc_id", pa.int64()), ("train", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def summed_up(bodies: list[bytes], depth: int, grams: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Sum of log_p over the grams of each of up to 256 bodies. Keys are sorted with the number of their body, as looking them up in order is several times faster."""
    keys, starts = gram_keys(bodies, depth)
    of = np.repeat(np.arange(len(bodies), dtype=np.uint64), np.diff(np.append(starts, len(keys))))
    keys = np.sort((keys.view(np.uint64) << np.uint64(8)) | of)
    of = (keys & np.uint64(255)).astype(np.int64)
    keys = (keys >> np.uint64(8)).view(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    found = log_p[np.searchsorted(grams, keys[first])]
    return np.bincount(of, weights=np.repeat(found, np.diff(np.append(first, len(keys)))), minlength=len(bodies))


def score_block(rows: pa.Table, answers: pa.Table, depth: int) -> pa.Table:
    if not rows.num_rows:
        return SCORES.empty_table()
    texts, train = binary_list(rows["text"]), int_list(rows["train"])
    known: dict[bytes, int] = {}
    said = answers.filter(pc.invert(answers["grams"]))
    for keys, n in zip(said["keys"].to_pylist(), said["numbers"].to_pylist(), strict=True):
        known.update(zip(zstandard.decompress(keys).split(b" "), unpack(n, np.uint64).tolist(), strict=True))
    said = answers.filter(answers["grams"])
    grams = np.concatenate([unpack_keys(k) for k in said["keys"].to_pylist()])
    log_p = np.concatenate([unpack(x, np.float32) for x in said["numbers"].to_pylist()]).astype(float)
    order = np.argsort(grams)
    grams, log_p = grams[order], log_p[order]
    n_tokens, n_known, known_log, score, n_bytes = (np.zeros(len(texts)) for _ in range(5))
    get = known.__getitem__
    end = known[END]
    for a, b in sliced([len(x) for x in texts]):
        bodies, counts, firsts = [], [], []
        for i in range(a, b):
            w = words_of(texts[i])
            bodies.append(b" ".join(w) + END)
            firsts.append(len(counts))
            counts += map(get, w)
            counts.append(end)
        c = np.array(counts, float)
        n_tokens[a:b] = np.diff(np.append(firsts, len(c)))
        n_known[a:b] = np.add.reduceat((c > 0).astype(float), firsts)
        known_log[a:b] = np.add.reduceat(np.log10(c + 1), firsts)
        n_bytes[a:b] = [len(x) for x in bodies]
        for c in range(0, len(bodies), 256):
            own = bodies[c : c + 256]
            score[a + c : a + c + len(own)] = summed_up(own, depth, grams, log_p)
    return pa.table([rows["doc_id"], pa.array(train.astype(np.int32)), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(known_log), pa.array(score), pa.array(n_bytes.astype(np.int64))], schema=SCORES)


def _shallow(nodes: DataFrame) -> DataFrame:
    """For each node of depth SPLIT: what the depths above it mix to a one, and what they leave. At most 256**SPLIT * 255 rows."""

    def lg(x: Column) -> Column:
        low = F.lit(1.0)
        for k in range(8):
            low = low * (x + k)
        z = x + 8.0
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - F.log(low)

    def kt(z: str = "zeros", o: str = "ones") -> Column:
        return lg(F.col(z) + 0.5) + lg(F.col(o) + 0.5) - lg(F.col(z) + F.col(o) + 1.0) - 1.1447298858494002

    levels, below = {}, nodes
    for d in range(SPLIT - 1, -1, -1):
        own = below.groupBy(F.expr("shiftright(context, 8)").alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        own = own.withColumn("own", kt())
        own = own.withColumn("log_w", F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - F.log(F.lit(2.0)))
        own = own.withColumn("weight", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("below") - F.col("own"))))))
        levels[d] = below = own
    out = None
    for d in range(SPLIT):
        own = levels[d].select("context", "node", "weight", ((F.col("ones") + 0.5) / (F.col("ones") + F.col("zeros") + 1.0)).alias("kt"))
        if out is None:
            out = own.select("context", "node", (F.col("weight") * F.col("kt")).alias("one"), (1 - F.col("weight")).alias("rest"))
        else:
            up = out.withColumnRenamed("context", "up")
            out = own.withColumn("up", F.expr("shiftright(context, 8)")).join(up, ["up", "node"]).select("context", "node", (F.col("one") + F.col("rest") * F.col("weight") * F.col("kt")).alias("one"), (F.col("rest") * (1 - F.col("weight"))).alias("rest"))
    up = out.withColumnRenamed("context", "up")
    return nodes.select("part", "context", "node", F.expr("shiftright(context, 8)").alias("up")).join(up, ["up", "node"]).select("part", "context", "node", "one", "rest")


def score_documents(docs: DataFrame, held_out: Column, depth: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every row of docs(doc_id, text) with a model of the rows where held_out is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte: the code length
    over the bytes of the text as it was scored, its end included. A null text counts as empty and an empty text is its end alone; a null held_out
    counts as false. Repeated rows are scored each. No training rows: the estimates are those of an empty
    tree. Columns other than these two are not read.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    n = max(1, -(-text_size(docs) // block_bytes))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.when(held_out, 0).otherwise(1).alias("train"), block_of(n, "doc_id", "text").alias("block"))
    parts = min(n, MOST_PARTS)
    sent = written(rows.select("block", "train", "text").groupBy("block").applyInArrow(lambda t: released(count_block(t, depth, parts)), PACKED), "lm-sent")
    words = sent.where(~F.col("grams")).groupBy("part").applyInArrow(sum_words, PACKED)
    grams = sent.where("grams").groupBy("part")
    nodes = written(grams.applyInArrow(lambda t: released(part_nodes(t, depth)), "part int, context long, node int, zeros long, ones long, log_w double"), "lm-nodes")
    log_p = grams.cogroup(_shallow(nodes).groupBy("part")).applyInArrow(lambda a, b: released(part_answers(a, b, depth)), PACKED)
    answers = written(words.unionByName(log_p), "lm-answers")
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    train_tokens, kinds = total["tokens"] or 0, total["kinds"] or 0
    answers = answers.where("block is not null").select("block", "grams", "keys", "numbers")
    forget(sent, nodes)
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: released(score_block(a, b, depth)), "doc_id long, train int, n_tokens long, n_known long, known_log double, score double, n_bytes long")
    return scored.select(
        "doc_id",
        (F.col("train") == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + kinds + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
