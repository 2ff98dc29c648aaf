"""Removal of repeated byte strings by equality classes of hashed windows, a bucket of hashes at a time.

This takes the place of a blockwise suffix sort: suffixes matter to their first LENGTH bytes only, so they get classes of
equal prefixes, by 80-bit names, and no total order. COVER is a difference cover modulo PERIOD: for any two
places there is a shift below PERIOD that takes both to cover residues. So two equal strings of LENGTH bytes
have, at one common shift, two cover samples with equal strings of LENGTH - PERIOD + 1 bytes. The samples are
named first; a suffix can only tie with another over LENGTH bytes if a sample in its reach has a name
that occurs again, and only such suffixes are named themselves. Names go to buckets by their leading bits;
one bucket at a time is sorted, and each tie is given the first block that it occurs in.

Copies of a whole text go first, by a digest. The other documents are dealt to blocks of bounded size in the order of their ids (blocked()). A block sends packed sorted names,
each once, so a string that every document has costs one name a block; a bucket answers with one bit a
name, in the same order. Texts go no further than to their block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, binary_list, blocked, int_list, prefix_hash, released, sliced, small, span_hash, written

LENGTH, PERIOD = 50, 31
#: A perfect difference set modulo 31; fixed values.
COVER = (0, 1, 3, 8, 12, 18)
SAMPLE = LENGTH - PERIOD + 1
BLOCK = 8 << 20
#: Names of samples keep so many bits besides their bucket: a name of 2**20 in a bucket is taken for another with 1e-6, and then is sorted in vain.
SAMPLE_BITS = 40

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
_TILED = [np.tile(_IN_COVER, 4096)]


def _cover(n: int) -> np.ndarray:
    """Which of the first n places of a text are cover samples."""
    if n > len(_TILED[0]):
        _TILED[0] = np.tile(_IN_COVER, n // PERIOD + 1)
    return _TILED[0][:n]


def _slices(texts: list[bytes]):
    """(first text, texts, bytes, place of each text, place of each byte in its text, bytes left from it on) of bounded runs."""
    for a, b in sliced([len(t) for t in texts]):
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        sizes = np.array([len(t) for t in texts[a:b]], np.int64)
        starts = np.cumsum(sizes) - sizes
        within = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
        yield a, b, data, starts, sizes, within, np.repeat(sizes.astype(np.int32), sizes) - within


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the hashes."""
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


def sample_names(texts: list[bytes], n: int) -> tuple[list[tuple], np.ndarray]:
    """For each slice: its slice, prefix hashes and places of cover samples; and the names of all samples, with the bucket above SAMPLE_BITS bits."""
    out, names = [], []
    for part in _slices(texts):
        data, sizes, left = part[2], part[4], part[6]
        cover = np.concatenate([_cover(k) for k in sizes.tolist()]) if len(sizes) else np.zeros(0, bool)
        at = np.flatnonzero(cover & (left >= SAMPLE))
        prefix = prefix_hash(data)
        h = span_hash(prefix, at, at + SAMPLE)
        out.append((part, prefix, at))
        names.append((bucket_of(h, n) << np.uint64(SAMPLE_BITS)) | (h & np.uint64((1 << SAMPLE_BITS) - 1)))
    return out, np.concatenate(names) if names else np.zeros(0, np.uint64)


SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("names", pa.binary())])


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(bucket))


def send_samples(rows: pa.Table, n: int) -> pa.Table:
    """The block's sample names by bucket: five bytes each, once, or twice if the block has it more than once."""
    block = rows["block"][0].as_py()
    names = np.sort(sample_names(binary_list(rows["text"]), n)[1])
    keep = np.ones(len(names), bool)
    keep[2:] = (names[2:] != names[1:-1]) | (names[2:] != names[:-2])
    names = names[keep]
    bucket = names >> np.uint64(SAMPLE_BITS)
    low, high = names.astype(np.uint32), ((names >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
    first, last = _cuts(bucket)
    blobs = [low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(first, last, strict=True)]
    return pa.table([pa.array(np.full(len(first), block, np.int64)), pa.array(bucket[first].astype(np.int32)), pa.array(blobs, pa.binary())], schema=SENT)


def repeated_samples(rows: pa.Table) -> pa.Table:
    """For each block of a bucket: a bit for each of its distinct names, set if the name occurs more than once anywhere."""
    own = []
    for blob in binary_list(rows["names"]):
        k = len(blob) // 5
        own.append(np.frombuffer(blob, np.uint32, k).astype(np.uint64) | (np.frombuffer(blob, np.uint8, k, 4 * k).astype(np.uint64) << np.uint64(32)))
    every = np.sort(np.concatenate(own))
    again = every[1:][every[1:] == every[:-1]]
    bits = []
    for names in own:
        names = names[np.concatenate(([True], names[1:] != names[:-1]))]
        at = np.minimum(np.searchsorted(again, names), max(0, len(again) - 1))
        bits.append(np.packbits(again[at] == names if len(again) else np.zeros(len(names), bool)).tobytes())
    return pa.table([rows["block"], rows["bucket"], pa.array(bits, pa.binary())], schema=SENT)


def _bits(answers: pa.Table, buckets: np.ndarray) -> np.ndarray:
    """The answered bits in the order of the names sent, whose buckets are given."""
    said = dict(zip(answers["bucket"].to_pylist(), answers["names"].to_pylist(), strict=True))
    first, last = _cuts(buckets)
    parts = [np.unpackbits(np.frombuffer(said[int(buckets[a])], np.uint8))[: b - a] for a, b in zip(first, last, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


class Suffixes:
    """The suffixes of a block that may tie: text, place in it, and 80-bit names of their prefixes."""

    def __init__(self, texts: list[bytes], answers: pa.Table, n: int):
        slices, names = sample_names(texts, n)
        order = np.argsort(names)
        names = names[order]
        new = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.zeros(0, bool)
        bits = _bits(answers, names[new] >> np.uint64(SAMPLE_BITS))
        repeated = np.empty(len(names), bool)
        repeated[order] = bits[np.cumsum(new) - 1]
        text, place, h1, h2, done = [], [], [], [], 0
        for (a, b, data, _, sizes, within, left), prefix, at in slices:
            hit = at[repeated[done : done + len(at)]]
            done += len(at)
            reach = np.zeros(len(data) + PERIOD + 1, np.int32)
            reach[hit + 1] = 1
            np.cumsum(reach, out=reach)
            i = np.flatnonzero((reach[PERIOD : PERIOD + len(data)] > reach[: len(data)]) & (left >= LENGTH))
            # a sample in reach is of the same text, as the text goes on for LENGTH bytes
            text.append(np.repeat(np.arange(a, b, dtype=np.int32), sizes)[i])
            place.append(within[i])
            h1.append(span_hash(prefix, i, i + LENGTH))
            # a second name, of the first half: two prefixes have to agree in both
            h2.append((span_hash(prefix, i, i + LENGTH // 2) >> np.uint64(48)).astype(np.uint16))
        self.text, self.place, self.h1, self.h2 = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((text, np.int32), (place, np.int32), (h1, np.uint64), (h2, np.uint16)))
        order = np.argsort(self.h1)
        self.text, self.place, self.h1, self.h2 = self.text[order], self.place[order], self.h1[order], self.h2[order]
        same = self.h1[1:] == self.h1[:-1]
        if (same & (self.h2[1:] != self.h2[:-1])).any():
            order = np.lexsort((self.text, self.h2, self.h1))
            self.text, self.place, self.h1, self.h2 = self.text[order], self.place[order], self.h1[order], self.h2[order]
        self.new = np.concatenate(([True], (self.h1[1:] != self.h1[:-1]) | (self.h2[1:] != self.h2[:-1]))) if len(self.h1) else np.zeros(0, bool)
        self.group = np.cumsum(self.new) - 1
        self.names, self.more = self.h1[self.new], self.h2[self.new]
        self.buckets = bucket_of(self.names, n)


def send_suffixes(rows: pa.Table, answers: pa.Table, n: int) -> pa.Table:
    if not rows.num_rows:
        return SENT.empty_table()
    block = rows["block"][0].as_py()
    s = Suffixes(_in_order(rows)[1], answers, n)
    first, last = _cuts(s.buckets)
    blobs = [zstandard.compress(np.diff(s.names[a:b], prepend=np.uint64(0)).tobytes() + s.more[a:b].tobytes(), 1) for a, b in zip(first, last, strict=True)]
    return pa.table([pa.array(np.full(len(first), block, np.int64)), pa.array(s.buckets[first].astype(np.int32)), pa.array(blobs, pa.binary())], schema=SENT)


def earlier_suffixes(rows: pa.Table) -> pa.Table:
    """Sorts one bucket. For each block: a bit for each of its names, set if a block of a lower rank has it."""
    h1, h2, of = [], [], []
    blocks = int_list(rows["block"])
    for block, blob in zip(blocks, binary_list(rows["names"]), strict=True):
        blob = zstandard.decompress(blob)
        k = len(blob) // 10
        h1.append(np.cumsum(np.frombuffer(blob, np.uint64, k), dtype=np.uint64))
        h2.append(np.frombuffer(blob, np.uint16, k, 8 * k))
        of.append(np.full(k, block // PARTS, np.int64))
    sizes = [len(x) for x in h1]
    h1, h2, of = (np.concatenate(x) for x in (h1, h2, of))
    order = np.lexsort((of, h2, h1))
    x, y = h1[order], h2[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    rank = of[order]
    tied = np.zeros(len(order), bool)
    tied[order] = rank > rank[np.flatnonzero(new)[np.cumsum(new) - 1]]
    bits = [np.packbits(t).tobytes() for t in np.split(tied, np.cumsum(sizes)[:-1])]
    return pa.table([rows["block"], rows["bucket"], pa.array(bits, pa.binary())], schema=SENT)


def _in_order(rows: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Rows of a block in an order that doesn't depend on how they came: where each is, texts, ids (the greatest for null)."""
    ids = int_list(rows["doc_id"], np.iinfo(np.int64).max)
    texts = binary_list(rows["text"])
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return np.array(order, np.int64), [texts[i] for i in order], ids[order]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove(rows: pa.Table, answers: pa.Table, n: int, digest: bool) -> pa.Table:
    if not rows.num_rows:
        return RESULT.empty_table()
    at, texts, ids = _in_order(rows)
    s = Suffixes(texts, answers.filter(pc.equal(answers["kind"], 0)), n)
    earlier = _bits(answers.filter(pc.equal(answers["kind"], 1)), s.buckets)
    if len(s.h1):
        first = np.flatnonzero(s.new)
        least = np.minimum.reduceat(ids[s.text], first)
        hit = earlier[s.group] | (ids[s.text] > least[s.group])
        text, place = s.text[hit], s.place[hit]
        order = np.argsort(text, kind="stable")
        text, place = text[order], place[order]
    else:
        text = place = np.zeros(0, np.int32)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    removed, spans, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        if cut[i] < cut[i + 1]:
            p = place[cut[i] : cut[i + 1]]
            edge = np.zeros(len(t) + 1, np.int32)
            edge[p] += 1
            edge[p + LENGTH] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed[i] = gone.sum()
            spans[i] = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            t = np.frombuffer(t, np.uint8)[~gone].tobytes()
        kept.append(hashlib.sha256(t).hexdigest().encode() if digest else t)
    return pa.table([rows["doc_id"].take(pa.array(at)), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], schema=RESULT)


def remove_repeats(docs: DataFrame, digest: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """Removes from each text of docs(doc_id, text) every byte covered by a string of 50 bytes that starts in a text with a smaller id too.

    Returns doc_id, n_bytes, n_removed, n_spans and kept: the remaining bytes, or their SHA-256 as hex if digest. Texts
    are their UTF-8 bytes, null is empty; strings are those of the input, whatever is removed. Rows of one id don't
    remove from each other; a null id counts as greater than all. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    every = rows.select("doc_id", F.md5("text").alias("of"), F.octet_length("text").cast("long").alias("n_bytes"))
    least = every.groupBy("of").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    copies = written(every.join(least, "of").where(f"n_bytes >= {LENGTH} and (doc_id is null or least < doc_id)").select("doc_id", "of", "n_bytes"), "copies")
    first = small(copies.select(F.col("doc_id").alias("id2"), "of").distinct())
    rows = rows.withColumn("of2", F.md5("text")).join(first, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("of2") == F.col("of")), "left_anti").select("doc_id", "text")
    rows, n = blocked(rows, block_bytes)
    kind = "block long, bucket int, names binary"
    by_block = rows.groupBy("block")
    sent = by_block.applyInArrow(lambda t: released(send_samples(t, n)), kind)
    samples = written(sent.groupBy("bucket").applyInArrow(lambda t: released(repeated_samples(t)), kind), "samples")
    sent = by_block.cogroup(samples.groupBy("block")).applyInArrow(lambda a, b: released(send_suffixes(a, b, n)), kind)
    suffixes = written(sent.groupBy("bucket").applyInArrow(lambda t: released(earlier_suffixes(t)), kind), "suffixes")
    answers = samples.withColumn("kind", F.lit(0)).unionByName(suffixes.withColumn("kind", F.lit(1)))
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: released(remove(a, b, n, digest)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(hashlib.sha256(b"").hexdigest().encode() if digest else b"")
    return out.unionByName(copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("kept")))
