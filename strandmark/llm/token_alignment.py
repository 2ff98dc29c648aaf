"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, by diagonal run skipping.

Both vocabularies cut the same bytes; where a token of each ends, a group ends. As long as tokens meet one to one, the arrays
of ends agree at a fixed shift of their indices: slices of doubling length are compared at that shift, and a stretch is
jumped in steps that grow with it. Where they differ, the group is walked end by end, and the shift is set anew.

How often a pair of ids is linked is counted over all documents. Tasks write, for each document, the pairs that it links,
and for each block of documents the pairs that occur in it with the number of documents; only pairs of blocks meet in
shuffles, whose number follows the vocabularies rather than the tokens. A text is held whole by one task.

Null and empty texts, and texts that one vocabulary can't give back byte for byte, have no tokens: counts of 0 and ''.
Repeated rows count as documents of their own. Columns other than doc_id and text are never touched.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SLICE_BYTES, portions, released, sliced, small, summed, written

#: Fixed value: how the vocabulary of A cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a group that are listed one by one; in larger groups, distinct ids are paired with their counts.
LISTED = 4096
_LOADED: dict[tuple[str, str], Pair] = {}


class Pair:
    """Two vocabularies: a byte-level BPE as JSON (A), and a BPE of pieces (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            table = json.load(f)
        special = {x["id"] for x in table["added_tokens"]}
        ranks = {bytes(map(BYTE_OF.__getitem__, word)): i for word, i in table["model"]["vocab"].items() if i not in special}
        merges = table["model"]["merges"]
        made = [table["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path_a}: ids don't follow the order of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(max(ranks.values()), *special, 0) + 1)
        for word, i in ranks.items():
            self.bytes_a[i] = word
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names_a = np.array([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"], object)
        self.names_b = np.array([f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"], object)

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text with a space before it; none where the bytes don't come back."""
        asked = [x or "" for x in texts]
        out = []
        for text, a, b in zip(asked, self.a.encode_ordinary_batch([" " + x for x in asked], num_threads=1), self.b.encode(asked, num_threads=1), strict=True):
            whole = (" " + text).encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes are their own letters, the others follow from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTE_OF = _byte_letters()


def loaded(path_a: str, path_b: str) -> Pair:
    """The vocabularies, once in each worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def irregular(ends_a: list[int], ends_b: list[int]) -> tuple[int, list[tuple[int, int, int]]]:
    """How many groups there are, and (group, tokens of A, tokens of B) of those that aren't one to one.

    ends: byte offsets at which tokens end, ascending, with the same last one.
    """
    i = j = group = 0
    n, out = len(ends_a), []
    while i < n:
        start, width = i, 1
        while (run := ends_a[i : i + width]) and run == ends_b[j : j + width]:
            i, j, width = i + len(run), j + len(run), 2 * width
        width //= 2
        while width and i < n:
            if ends_a[i : i + width] == ends_b[j : j + width]:
                i, j = i + width, j + width
            width //= 2
        group += i - start
        if i < n:
            p, q = i, j
            a, b = ends_a[i], ends_b[j]
            while a != b:
                if a < b:
                    i += 1
                    a = ends_a[i]
                else:
                    j += 1
                    b = ends_b[j]
            i, j = i + 1, j + 1
            out.append((group, i - p, j - q))
            group += 1
    return group, out


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these sizes: which item each place is of, and its place in it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def aligned(pair: Pair, texts: list[str | None]) -> dict:
    """Counts, group strings and linked pairs of some texts: n_a, n_b, n_groups, n_links, groups by text; at, keys, times by text and pair (at: the text)."""
    ids = pair.encode(texts)
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for x in ids for i in x[k]), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
    # texts one after the other are as one text: tokens of both end where a text ends
    total, odd = irregular(np.cumsum(pair.size_a[a]).tolist(), np.cumsum(pair.size_b[b]).tolist())
    of_a, of_b = np.ones(total, np.int64), np.ones(total, np.int64)
    if odd:
        g, p, q = np.array(odd).T
        of_a[g], of_b[g] = p, q
    links, last_a, last_b = of_a * of_b, np.cumsum(of_a), np.cumsum(of_b)
    ends = np.concatenate(([0], np.searchsorted(last_a, np.cumsum(n_a), side="right")))
    ends[1:][n_a.cumsum() == 0] = 0
    sums = np.concatenate(([0], np.cumsum(links)))
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))

    width = len(pair.bytes_b)
    span = width * len(pair.bytes_a)
    few = links <= LISTED
    group, k = _spread(np.where(few, links, 0))
    key = a[(last_a - of_a)[group] + k // of_b[group]] * width + b[(last_b - of_b)[group] + k % of_b[group]]
    keys, times = [text_of[group] * span + key], [np.ones(len(key), np.int64)]
    for g in np.flatnonzero(~few):
        (x, nx), (y, ny) = (np.unique(v[e[g] - o[g] : e[g]], return_counts=True) for v, e, o in ((a, last_a, of_a), (b, last_b, of_b)))
        keys.append(text_of[g] * span + (x[:, None] * width + y).ravel())
        times.append((nx[:, None] * ny).ravel())
    keys, times = summed(np.concatenate(keys), np.concatenate(times))

    names = np.empty(len(a) + len(b), object)
    first = np.cumsum(of_a + of_b) - of_a - of_b
    for ids_, of, shift, table in ((a, of_a, 0, pair.names_a), (b, of_b, of_a, pair.names_b)):
        group, k = _spread(of)
        names[(first + shift)[group] + k] = table[2 * ids_ + (k == of[group] - 1)]
    cuts = np.concatenate(([0], np.cumsum(n_a + n_b)))
    groups = ["".join(names[s:e].tolist())[:-1] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(ends), "n_links": sums[ends[1:]] - sums[ends[:-1]], "groups": groups, "at": keys // span, "keys": keys % span, "times": times}


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))


def links(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A table of documents (whole) and blocks (not whole), with the pairs that they link: a * size of B + b.

    times: for a document, how many links each pair has; for a block, how many of its documents hold it. groups: a1,a2|b1;...,
    or its sha256 with digest.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, whole boolean, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, keys array<bigint>, times array<bigint>"

    def run(batches):
        pair, task = loaded(path_a, path_b), TaskContext.get().partitionId()
        number, held, seen, ids = 0, 0, [], None

        def block() -> pa.RecordBatch:
            keys, times = summed(np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen]))
            one = {"block": [task << 32 | number], "whole": [False], "doc_id": pa.nulls(1, ids), **{c: pa.nulls(1, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.nulls(1, pa.string())}
            size = np.array([len(keys)])
            return pa.RecordBatch.from_pydict(one | {"keys": _lists(keys, size), "times": _lists(times, size)})

        for batch in portions(batches):
            ids = batch.schema.field("doc_id").type
            for s, e in sliced(pc.binary_length(batch["text"]).fill_null(0).to_pylist(), SLICE_BYTES):
                part = batch.slice(s, e - s)
                texts = part["text"].to_pylist()
                got = aligned(pair, texts)
                names = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in got["groups"]] if digest else got["groups"]
                sizes = np.bincount(got["at"], minlength=len(texts))
                seen.append(summed(got["keys"], np.ones(len(got["keys"]), np.int64)))
                yield pa.RecordBatch.from_pydict({
                    "block": np.full(len(texts), task << 32 | number), "whole": np.full(len(texts), True), "doc_id": part["doc_id"],
                    **{c: got[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.array(names, pa.string()), "keys": _lists(got["keys"], sizes), "times": _lists(got["times"], sizes),
                })
                held += sum(len(x) for x in texts if x)
                if held >= block_bytes:
                    yield block()
                    number, held, seen = number + 1, 0, []
        if seen:
            yield block()

    return written(docs.select("doc_id", "text").mapInArrow(run, schema), "links")


def pair_counts(found: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, n, best) of each linked pair, of links(): the documents that hold it, and whether no other pair of its id of A has more."""
    width = len(loaded(path_a, path_b).bytes_b)
    each = found.where("not whole").select(F.explode(F.arrays_zip("keys", "times")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.times").alias("n"))
    counts = written(each.groupBy("key").agg(F.sum("n").alias("n")), "counts").withColumn("a", F.expr(f"key div {width}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A at most
    return counts.join(small(written(most, "most")), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def vocabulary_map(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n, best): ids of A and B that are linked in n documents; best marks those of an id of A with most documents."""
    width = len(loaded(path_a, path_b).bytes_b)
    return pair_counts(links(docs, path_a, path_b, digest=True), path_a, path_b).select(F.expr(f"key div {width}").alias("a"), F.expr(f"key % {width}").alias("b"), "n", "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document.

    n_best: links whose pair has the most documents among those of its id of A; count_sum: the documents of the pairs, over links.
    """
    found = links(docs, path_a, path_b, digest, block_bytes)
    counts = written(pair_counts(found, path_a, path_b), "pairs")
    asked = found.where("not whole").select(F.col("block").alias("of"), F.explode("keys").alias("key"))
    answers = asked.join(small(counts), "key")

    def look_up(rows: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(table["key"].to_numpy())
        key, n, best = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("key", "n", "best"))
        lists = rows["keys"].combine_chunks()
        at = np.searchsorted(key, lists.flatten().to_numpy())
        times = rows["times"].combine_chunks().flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends])
        out = {c: rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return released(pa.table(out | {"n_best": pa.array(total(times * best[at]), pa.int64()), "count_sum": pa.array(total(times * n[at]), pa.int64()), "groups": rows["groups"]}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = found.where("whole").drop("whole").groupBy("block").cogroup(answers.groupBy("of"))
    return each.applyInArrow(look_up, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
