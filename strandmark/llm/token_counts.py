"""Token counts that follow edits.

A document's pre-tokens stand in segments, and a tree over the segments holds the sums of their characters
and tokens. An edit re-encodes only the pre-tokens that it touches, two before them (the pattern looks
ahead by no more), and those behind it until a boundary falls on an old one; then the sums on the path to
the root are updated.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Pre-tokens that a segment is built with, and those beyond which it is split.
SEGMENT, LARGEST = 32, 256
#: The published pre-token pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000
#: Documents whose trees a task holds at once.
PORTION = 256
_CODERS: dict[str, Coder] = {}


class Coder:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in _CODERS:
            _CODERS[path] = cls(path)
        return _CODERS[path]

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.coder.encode_ordinary(piece))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


class Counted:
    """A text with its token count under edits."""

    def __init__(self, text: str, coder: Coder):
        self.coder, self.recoded = coder, 0
        self._build(coder.pieces(text))

    @classmethod
    def kept(cls, segments: list[dict], coder: Coder) -> Counted:
        """The tree of stored segments: nothing is cut or encoded again."""
        self = cls.__new__(cls)
        self.coder, self.recoded, self.segments = coder, 0, []
        for s in segments:
            text, at, pieces = s["text"], 0, []
            for n in array("I", s["lengths"]):
                pieces.append(text[at : at + n])
                at += n
            self.segments.append(pieces)
        self._sum([s["tokens"] for s in segments])
        return self

    def stored(self) -> list[dict]:
        """The segments in order: text, packed lengths of its pre-tokens, tokens."""
        return [{"text": "".join(s), "lengths": array("I", map(len, s)).tobytes(), "tokens": self.tokens[self.leaves + i]} for i, s in enumerate(self.segments)]

    def _build(self, pieces: list[str]) -> None:
        self.segments = [pieces[i : i + SEGMENT] for i in range(0, len(pieces), SEGMENT)] or [[]]
        self._sum([sum(map(self.coder.count, s)) for s in self.segments])

    def _split(self, s: int) -> None:
        """Cuts a segment that has grown too large into new ones; the others keep their sums."""
        own, n = self.segments[s], len(self.segments)
        chars, tokens = self.chars[self.leaves : self.leaves + n], self.tokens[self.leaves : self.leaves + n]
        new = [own[i : i + SEGMENT] for i in range(0, len(own), SEGMENT)]
        self.segments[s : s + 1] = new
        chars[s : s + 1] = [sum(map(len, x)) for x in new]
        tokens[s : s + 1] = [sum(map(self.coder.count, x)) for x in new]
        self.recoded += len(own)
        self._sum(tokens, chars)

    def _sum(self, tokens: list[int], chars: list[int] | None = None) -> None:
        self.leaves = 1 << (len(self.segments) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, s in enumerate(self.segments):
            self.chars[self.leaves + i] = chars[i] if chars else sum(map(len, s))
            self.tokens[self.leaves + i] = tokens[i]
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for s in self.segments for p in s)

    def _place(self, at: int) -> tuple[int, int, int]:
        """Segment, pre-token in it, and where that starts, of the character at a position before the end."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        s = node - self.leaves
        for k, p in enumerate(self.segments[s]):
            if at < start + len(p):
                return s, k, start
            start += len(p)
        raise AssertionError("the sums don't match the segments")

    def _back(self, s: int, k: int) -> tuple[int, int] | None:
        while True:
            if k > 0:
                return s, k - 1
            if s == 0:
                return None
            s -= 1
            k = len(self.segments[s])

    def _set(self, s: int, pieces: list[str], delta_chars: int, delta_tokens: int) -> None:
        self.segments[s] = pieces
        node = self.leaves + s
        while node:
            self.chars[node] += delta_chars
            self.tokens[node] += delta_tokens
            node //= 2

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop; positions beyond the text are its end."""
        n = self.n_chars
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        if start == stop and not new:
            return
        if n == 0:
            self._build(pieces := self.coder.pieces(new))
            self.recoded += len(pieces)
            return
        s, k, begin = self._place(min(start, n - 1))
        for _ in range(2):
            if (back := self._back(s, k)) is None:
                break
            s, k = back
            begin -= len(self.segments[s][k])
        # old pre-tokens from (s, k) on, read as far as needed
        old: list[str] = []
        ends: list[int] = []  # old places where they end
        to_s, to_k, at = s, k, begin

        def read(least: int) -> bool:
            """Reads pre-tokens until `least` more are there; false at the end of the text."""
            nonlocal to_s, to_k, at
            while least and to_s < len(self.segments):
                if to_k >= len(self.segments[to_s]):
                    to_s, to_k = to_s + 1, 0
                    continue
                p = self.segments[to_s][to_k]
                to_k += 1
                at += len(p)
                old.append(p)
                ends.append(at)
                least -= 1
            return not least

        more = read(1)
        while more and at < stop:
            more = read(1)
        step = 4
        shift = len(new) - (stop - start)
        while True:
            more = read(step)
            step *= 2
            whole = "".join(old)
            whole = whole[: start - begin] + new + whole[stop - begin :]
            pieces = self.coder.pieces(whole)
            if at == n:
                used, fresh = len(old), pieces
                break
            olds = {e + shift: i for i, e in enumerate(ends) if e >= stop}
            pos, found = begin, None
            limit = begin + len(whole) - 2
            for i, p in enumerate(pieces):
                pos += len(p)
                if pos > limit:
                    break
                if pos in olds and pos >= start + len(new):
                    found = (olds[pos] + 1, pieces[: i + 1])
                    break
            if found:
                used, fresh = found
                break
        self.recoded += len(fresh)
        count = self.coder.count
        left = used  # old pre-tokens to take out, from (s, k) on
        seg, place, first = s, k, True
        while left or first:
            have = self.segments[seg]
            gone = have[place : place + left]
            left -= len(gone)
            put = fresh if first else []
            self._set(seg, have[:place] + put + have[place + len(gone) :], sum(map(len, put)) - sum(map(len, gone)), sum(map(count, put)) - sum(map(count, gone)))
            first, seg, place = False, seg + 1, 0
        if len(self.segments[s]) > LARGEST:
            self._split(s)


SEGMENTS = "array<struct<text:string,lengths:binary,tokens:bigint>>"
COUNTS = "n_chars long, n_tokens long, n_edits long, n_recoded long, edited_chars long, edited_tokens long, edited_sha256 string"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("lengths", pa.binary()), ("tokens", pa.int64())]))
_EDITED = pa.schema([("doc_id", pa.int64()), ("segments", _SEGMENTS), *((c, pa.int64()) for c in ("n_chars", "n_tokens", "n_edits", "n_recoded", "edited_chars", "edited_tokens")), ("edited_sha256", pa.string())])


def segment_trees(docs: DataFrame, path: str, carry: tuple = ()) -> DataFrame:
    """(doc_id, segments) of docs(doc_id, text): the table that is kept for each document, from which edits start.

    A segment has its text, the packed lengths of its pre-tokens and its tokens; sums over them are made when read. path: a
    vocabulary file of byte-level ranks, at the same place on every executor. Columns named in carry come along. A null
    text is empty and has one empty segment; repeated rows stay; other columns are not read; an empty table gives no rows.
    No shuffle.
    """
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))

    def rows(batches):
        coder = Coder.of(path)
        for part in portions(batches, PORTION):
            trees = pa.array([Counted(t, coder).stored() for t in part["text"].to_pylist()], _SEGMENTS)
            yield pa.record_batch([part["doc_id"], *(part[c] for c in carry), trees], names=["doc_id", *carry, "segments"])

    return docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rows, f"{kinds}, segments {SEGMENTS}")


def edit_trees(trees: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """trees(doc_id, segments, edits) after their edits, in their order, with the counts before and after; without the segments if keep is false.

    edits: array of (start, stop, text), places by code point in the text as the edits before have left it; places beyond the
    text are its end, and a null place or text counts as 0 or empty. Only pre-tokens that an edit touches, and a few
    around it (n_recoded), are cut and encoded again. Null edits are none; null segments are an empty text; repeated rows
    are edited each. The result has the form of segment_trees() and can be edited again. No shuffle.
    """

    fields = [f for f in _EDITED if keep or f.name != "segments"]
    kinds = f"doc_id long, segments {SEGMENTS}, {COUNTS}" if keep else f"doc_id long, {COUNTS}"

    def rows(batches):
        coder = Coder.of(path)
        for part in portions(batches, PORTION):
            out = []
            for doc_id, segments, edits in zip(*(part[c].to_pylist() for c in ("doc_id", "segments", "edits")), strict=True):
                tree = Counted.kept(segments, coder) if segments else Counted("", coder)
                before = (tree.n_chars, tree.n_tokens)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                out.append((doc_id, *([tree.stored()] if keep else []), *before, len(edits or []), tree.recoded, tree.n_chars, tree.n_tokens, hashlib.sha256(tree.text.encode()).hexdigest()))
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    return trees.select("doc_id", "segments", "edits").mapInArrow(rows, kinds)


def count_edits(docs: DataFrame, path: str) -> DataFrame:
    """Token counts of docs(doc_id, text, edits) before and after its edits: edit_trees() of segment_trees(), without the segments.

    The trees of this call aren't kept; write segment_trees() to keep them. Nulls, empty texts and repeated rows as there.
    """
    return edit_trees(segment_trees(docs, path, ("edits",)), path, keep=False)


def sample_edits(text: str = "text"):
    """Three edits of every text, by its own words: its first ten characters come in a third down, twenty go from its middle, and its end is turned into its beginning."""
    t, n = F.col(text), F.length(text)

    def edit(a, b, s):
        return F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), s.alias("text"))

    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(edit(third, third, F.substring(t, 1, 10)), edit(half, half + 20, F.lit("")), edit(n - 15, n, F.concat(F.lit(" "), F.substring(t, 1, 5))))
