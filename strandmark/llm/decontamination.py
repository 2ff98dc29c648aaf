"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Benchmark texts are cut into windows of words. The frequencies of the benchmark's terms in the training texts
say which terms of a window are the rarest; the index stores the postings (text, position) of those anchor
terms. Posting lists are intersected with their offsets taken off, so that equal starts meet; what is left is
compared word by word with the text. Every text is read by a narrow scan: no text is shuffled unless more texts
have candidates than may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, small, written

WINDOW = 10
#: Terms of a window whose posting lists are intersected, rarest first.
ANCHORS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words: runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, n, items): distinct windows of `size` words, or whole shorter texts, with the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.concat_ws(" ", "words").alias("window"), F.size("words").alias("n"), "items")


def anchors_of(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """(term, window, offset, bit, needed): the rarest terms of each window; terms that no text has come first."""
    terms = windows.select("window", "n", F.posexplode(F.split("window", " ")).alias("offset", "term"))
    ranked = terms.join(frequency, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("count", F.lit(0)), "offset")))
    needed = F.expr(f"shiftleft(1, least({ANCHORS}, n))") - 1
    return ranked.where(F.col("rank") <= ANCHORS).select("term", "window", "n", "offset", F.expr("shiftleft(1, rank - 1)").alias("bit"), needed.alias("needed"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, a hash that tells texts of one id apart, and the words."""
    return docs.select("doc_id", F.xxhash64("text").alias("of"), words_of("text").alias("words"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in all texts of the terms that occur."""
    return docs.select(F.explode(words_of("text")).alias("term")).join(small(terms), "term", "left_semi").groupBy("term").count()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (doc_id, of, position, term) of the given terms."""
    each = keyed(docs).select("doc_id", "of", F.posexplode("words").alias("position", "term"))
    return each.join(small(terms), "term", "left_semi").select("doc_id", "of", "position", "term")


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, of, window, start) where all anchor terms of the window stand at their offsets."""
    met = index.join(small(anchors), "term").withColumn("start", F.col("position") - F.col("offset")).where("start >= 0")
    found = met.groupBy("doc_id", "of", "window", "start").agg(F.bit_or("bit").alias("bits"), F.first("needed").alias("needed"), F.first("n").alias("n"))
    return found.where("bits = needed").drop("bits", "needed")


def _prepared(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    windows = written(windows_of(benchmark, size), "windows")
    terms = windows.select(F.explode(F.split("window", " ")).alias("term")).distinct()
    frequency = written(frequencies(docs, terms), "frequency")
    anchors = written(anchors_of(windows, frequency), "anchors")
    index = written(postings(docs, anchors.select("term").join(frequency, "term", "left_semi").distinct()), "postings")
    return windows, anchors, index


def names_of(docs: DataFrame) -> list[str]:
    """Names for what is added to docs, none of which it has."""
    return free(docs, "found", "found_id", "found_same", "found_words", "n_words", "matches")


def _matched(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """docs with n_words and matches (window, start, n, items), in the columns that names_of() gives."""
    found_, id_, same_, words_, n_words_, matches_ = names_of(docs)
    windows, anchors, index = _prepared(docs, benchmark, size)
    found = candidates(index, anchors).join(windows.select("window", "items"), "window")
    by_text = written(found.groupBy("doc_id", "of").agg(F.collect_list(F.struct("window", "start", "n", "items")).alias(found_)), "candidates")
    by_text = by_text.withColumnsRenamed({"doc_id": id_, "of": same_})
    # words are cut after the join: if it has to be a shuffle, that moves the text alone
    joined = docs.join(small(by_text), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(same_)), "left").withColumn(words_, words_of("text"))
    exact = F.filter(F.coalesce(found_, F.array()), lambda c: F.concat_ws(" ", F.slice(F.col(words_), c["start"] + 1, c["n"])) == c["window"])
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.size(words_).cast("long").alias(n_words_), exact.alias(matches_))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """For every row of docs(doc_id, text): doc_id, n_words, matches (window, start, n, items), of exact phrases.

    A null text or one without words matches nothing; benchmark rows without words have no windows; a null item_id
    takes part in hits but names no item. Repeated rows are answered each; a null doc_id stays; other columns are not
    read. Without documents there are no rows, without benchmark there are no matches.
    """
    return _matched(docs.select("doc_id", "text"), benchmark, size).select("doc_id", "n_words", "matches")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows that have a match; columns stay. Nulls and empty tables as in phrase_matches()."""
    matches = names_of(docs)[-1]
    return _matched(docs, benchmark, size).where(F.size(matches) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int, size: int = WINDOW) -> DataFrame:
    """(doc_id, window, start, items): places where all words of a window, each as often as it has it, stand within its length and `slop` more words, in any order.

    A place begins with one of the window's words. The index says where anchor terms are close enough; there the words of
    the text decide. Rows are distinct. Nulls, empty texts and empty tables as in phrase_matches().
    """
    windows, anchors, index = _prepared(docs, benchmark, size)
    met = index.join(small(anchors), "term")
    near = Window.partitionBy("doc_id", "of", "window").orderBy("position").rangeBetween(0, size + slop - 1)
    found = met.withColumn("bits", F.bit_or("bit").over(near)).where("bits = needed").select("doc_id", "of", "window", "position", "n").distinct()
    by_text = written(found.groupBy("doc_id", "of").agg(F.collect_list(F.struct("window", "position", "n")).alias("found")).withColumnsRenamed({"doc_id": "found_id", "of": "same"}), "near")
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64("text") == F.col("same"))
    placed = docs.select("doc_id", "text").join(small(by_text), same).select("doc_id", words_of("text").alias("words"), F.explode("found").alias("f"))
    placed = placed.select("doc_id", "words", "f.window", (F.col("f.n") + slop).alias("span"), F.split("f.window", " ").alias("asked"), F.explode(F.expr(f"sequence(greatest(0, f.position - f.n - {slop} + 1), f.position)")).alias("start"))
    here = F.slice("words", F.col("start") + 1, F.col("span"))
    times = lambda row, w: F.size(F.filter(row, lambda x: x == w))
    whole = F.forall(F.array_distinct("asked"), lambda w: times(F.col("here"), w) >= times(F.col("asked"), w))
    placed = placed.withColumn("here", here).where(F.array_contains("asked", F.element_at("here", 1)) & whole).select("doc_id", "window", F.col("start").cast("int").alias("start")).distinct()
    return placed.join(windows.select("window", "items"), "window").select("doc_id", "window", "start", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any match), n_items, items_sha256, contaminated for every row of docs."""
    hits = phrase_matches(docs, benchmark, size)
    places = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["n"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return hits.select("doc_id", "n_words", F.size(places).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
