"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of an LZ78 dictionary (each phrase is the longest known one and one more
code point). The phrase set is hashed, and the smallest hashes are the fingerprint: the bottom-k sketch of
the set. The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets, which is
high for texts that compress each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PARTS, blocked, prefix_hash, small, span_hash, written

#: Hashes that a fingerprint keeps; eight hex digits each.
KEPT = 128
#: Text bytes of a range of ids; tasks read their range as a stream, so this sets parallel work, not memory.
RANGE_BYTES = 4 << 20


def _grow(node: dict, root: dict, chars: str, at: int, ends: list, made: list) -> dict:
    """Parses on from a node of the phrase trie; ends gets where phrases end, made what was added."""
    for ch in chars:
        at += 1
        below = node.get(ch)
        if below is None:
            node[ch] = {}
            made.append((node, ch))
            ends.append(at)
            node = root
        else:
            node = below
    return node


def phrase_ends(text: str, keep: int, tail: str) -> tuple[list, list]:
    """Phrase ends of text, and of its first `keep` code points with tail behind them; their common part is parsed once."""
    root: dict = {}
    head: list = []
    node = _grow(root, root, text[:keep], 0, head, [])
    own, undo = list(head), []
    _grow(node, root, text[keep:], keep, own, undo)
    for above, ch in reversed(undo):
        del above[ch]
    _grow(node, root, tail, keep, head, [])
    return own, head


def fingerprint(text: str, ends: list) -> str:
    """The smallest hashes of the phrases, in order, as hex; empty for an empty text."""
    if not ends:
        return ""
    end = np.array(ends)
    start = np.concatenate(([0], end[:-1]))
    h = span_hash(prefix_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)), start, end)
    if len(h) > KEPT:
        h = np.partition(h, KEPT - 1)[:KEPT]
    return (np.sort(h) >> np.uint64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two phrase sets, 0 to 1; exact for sets of up to KEPT phrases. Two empty ones are alike."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    low = sorted(x | y)[:KEPT]
    return sum(1 for h in low if h in x and h in y) / len(low)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def stream(batches):
    """Rows of ranges of ids, each in order, and the first row of the next range last (extra)."""
    held, rows = None, []

    def done(now, following):
        doc_id, text, own, _ = now
        n = len(text)
        keep = n - n // 2
        tail = following[1][: n // 2]
        ends, edited_ends = phrase_ends(text, keep, tail)
        own = fingerprint(text, ends)
        edited = text[:keep] + tail
        edited_fp = own if edited == text else fingerprint(edited, edited_ends)
        return [doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, edited_fp, likeness(own, edited_fp), None]

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], RESULT.field(i).type) for i in range(len(RESULT))], schema=RESULT)

    waiting = None  # a result whose near_next needs the fingerprint of the row after it
    for batch in batches:
        for doc_id, text, extra in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["extra"].to_pylist(), strict=True):
            now = (doc_id, text, None, extra)
            if held is not None:
                out = done(held, now)
                if waiting is not None:
                    waiting[6] = likeness(waiting[3], out[3])
                    rows.append(waiting)
                waiting = out
            held = now
            if extra:
                ends, _ = phrase_ends(text, len(text), "")
                waiting[6] = likeness(waiting[3], fingerprint(text, ends))
                rows.append(waiting)
                held = waiting = None
        if len(rows) >= 512:
            yield flushed()
            rows = []
    if rows:
        yield flushed()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of each text with its second half replaced by the next document's first.

    The next document is the next by descending doc_id, the first one after the last; a document alone is its
    own next. A null text is empty, and an empty text has the empty fingerprint. A null doc_id comes last;
    rows that repeat an id follow each other by descending text. Empty table: no rows. Other columns are not read.
    Ids are dealt to ranges of about RANGE_BYTES of text; of each range, one row travels to the one above, too. All rows
    of one id are in one range, which a task reads as a stream.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = blocked(rows, RANGE_BYTES)[0].withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.expr(f"block div {PARTS}"))).drop("block")
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))
    up, every = Window.orderBy("range"), Window.partitionBy()  # a row for each range
    heads = heads.withColumns({"place": F.row_number().over(up) - 1, "above": (F.row_number().over(up) % F.count("*").over(every)).cast("int")})
    heads = written(heads, "ranges")
    dealt = rows.join(small(heads), "range").select("doc_id", "text", "head", "place", "above")
    first = dealt.where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("doc_id", "above").agg(F.max("text").alias("text"))
    both = dealt.select("doc_id", "text", "place", F.lit(False).alias("extra")).unionByName(first.select("doc_id", "text", F.col("above").alias("place"), F.lit(True).alias("extra")))
    # a task takes as many ranges as the session's partitions leave it, one after the other; the extra row ends each
    both = both.repartition("place").sortWithinPartitions("place", "extra", F.desc_nulls_last("doc_id"), F.desc("text"))
    return both.select("doc_id", "text", "extra").mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
