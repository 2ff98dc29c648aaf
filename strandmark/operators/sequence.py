"""Sequences: k-mers, GC windows, haplotypes. Tables are of whole sequences (seq_no, seq), or of chunks (seq_no, chunk_no, start, bases) in the order of chunk_no."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from .reads import overlap_join

#: Bases that positions are counted in at once: finding a place in a string takes time with its distance from the start.
PART = 128
#: Most rows of a table of k-mers that is sent to every task; letters that sequences are folded to.
FEW, LETTERS = 400_000, 5
#: Bases of a haplotype whose variants are ordered in one task.
STRETCH = 1 << 20


def parts(seqs: DataFrame, width: int, more: int = 0) -> DataFrame:
    """(seq_no, length, c, part): consecutive parts of the width, each with the next bases after it."""
    pattern = f"(?s)(?=(.{{1,{width + more}}})).{{1,{width}}}"
    cut = F.regexp_extract_all("seq", F.lit(pattern), 1)
    return seqs.where(F.length("seq") > 0).select("seq_no", F.length("seq").alias("length"), F.posexplode(cut).alias("c", "part"))


def is_chunked(seqs: DataFrame) -> bool:
    return "bases" in seqs.columns


def with_next(chunks: DataFrame, more: int) -> DataFrame:
    """chunks with the more bases that follow each one (next), out of as many later chunks as that takes; fewer at the end.

    Every chunk sends its first bases back to those before it, so no window runs over a sequence. All chunks but the last
    of a sequence have the same width.
    """
    width = chunks.groupBy("seq_no").agg(F.max(F.length("bases")).alias("_w"))
    back = chunks.join(width, "seq_no").select("seq_no", F.col("chunk_no").alias("_c"), "bases", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.lit(more) / F.greatest("_w", F.lit(1)))).cast("int"))).alias("_j"))
    back = back.select("seq_no", (F.col("_c") - F.col("_j")).alias("chunk_no"), F.struct("_j", F.substring("bases", 1, more).alias("b")).alias("p")).where("chunk_no >= 0")
    tails = back.groupBy("seq_no", "chunk_no").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["b"]), ""), 1, more).alias("next"))
    return chunks.join(tails, ["seq_no", "chunk_no"], "left").withColumn("next", F.coalesce("next", F.lit("")))


def cut_up(seqs: DataFrame, width: int, more: int = 0) -> DataFrame:
    """(seq_no, at, n, part): consecutive parts of n bases, of the width at most, from place at on, each with the next bases after it.

    Of whole sequences or of chunks; parts of a chunk begin anew at its start.
    """
    if not is_chunked(seqs):
        return parts(seqs, width, more).select("seq_no", (F.col("c").cast("bigint") * width).alias("at"), F.expr(f"least({width}, length - c * {width})").cast("int").alias("n"), "part")
    rows = with_next(seqs, more) if more else seqs.withColumn("next", F.lit(""))
    pattern = f"(?s)(?=(.{{1,{width + more}}})).{{1,{width}}}"
    cut = F.regexp_extract_all(F.concat("bases", "next"), F.lit(pattern), 1)
    each = rows.select("seq_no", "start", F.length("bases").alias("_own"), F.posexplode(cut).alias("c", "part")).where(F.col("c") * width < F.col("_own"))
    return each.select("seq_no", (F.col("start") + F.col("c") * width).cast("bigint").alias("at"), F.expr(f"least({width}, _own - c * {width})").cast("int").alias("n"), "part")


def lengths(seqs: DataFrame) -> DataFrame:
    """(seq_no, length)."""
    if is_chunked(seqs):
        return seqs.groupBy("seq_no").agg(F.sum(F.length("bases")).cast("bigint").alias("length"))
    return seqs.select("seq_no", F.length("seq").cast("bigint").alias("length"))


def kmers(seqs: DataFrame, k: int, step: int = 1, include_last: bool = True) -> DataFrame:
    """(seq_no, at, kmer): a row for each k-mer at every step bases, also across the borders of chunks; without include_last, not the one that ends a sequence."""
    if not include_last and not is_chunked(seqs):
        seqs = seqs.withColumn("seq", F.expr("substring(seq, 1, length(seq) - 1)"))
    cut = cut_up(seqs, step * max(1, PART // step), k - 1)
    first = F.pmod(-F.col("at"), F.lit(step)).cast("int")  # a chunk may begin between two steps
    last = F.least(F.length("part") - k, F.col("n") - 1)
    if not include_last and is_chunked(seqs):
        cut = cut.join(lengths(seqs), "seq_no")  # by parts, before they are k-mers
        last = F.least(last, (F.col("length") - k - 1 - F.col("at")).cast("int"))
    each = cut.where(last >= first).select("seq_no", "at", "part", F.explode(F.sequence(first, last, F.lit(step))).alias("i"))
    return each.select("seq_no", (F.col("at") + F.col("i")).alias("at"), F.expr(f"substring(part, i + 1, {k})").alias("kmer"))


def counted(own: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """own with n of its k-mers. A table that the letters keep small goes to every task, so the k-mers of all sequences are not shuffled."""
    return own.join(F.broadcast(table) if LETTERS**k <= FEW else table, "kmer", "left")


def kmer_count(seqs: DataFrame, k: int, include_last: bool = True) -> DataFrame:
    """(kmer, n) over all places; without include_last, those that end a sequence are left out."""
    every = cut_up(seqs, PART, k - 1).select(F.explode(F.regexp_extract_all("part", F.lit(f"(?s)(?=(.{{{k}}}))."), 1)).alias("kmer"))
    got = every.groupBy("kmer").agg(F.count("*").alias("n"))
    if include_last:
        return got
    end = kmers(seqs, k).join(lengths(seqs), "seq_no").where(F.col("at") == F.col("length") - k) if is_chunked(seqs) else seqs.where(F.length("seq") >= k).select(F.right("seq", F.lit(k)).alias("kmer"))
    less = end.select("kmer", F.lit(-1).cast("bigint").alias("n"))
    return got.unionByName(less).groupBy("kmer").agg(F.sum("n").alias("n")).where("n > 0")


def kmer_mean_score(seqs: DataFrame, table: DataFrame, k: int, include_last: bool = True) -> DataFrame:
    """(seq_no, score): mean count of each sequence's k-mers, without include_last but for the one at its end; unseen ones count one. Null where there are none."""
    got = counted(kmers(seqs, k, include_last=include_last), table, k).groupBy("seq_no").agg(F.avg(F.coalesce("n", F.lit(1))).alias("score"))
    return seqs.select("seq_no").distinct().join(got, "seq_no", "left")


def gc_windows(seqs: DataFrame, window: int) -> DataFrame:
    """(seq_no, bin, gc) of windows of a sequence; those that lie over several chunks are summed from their pieces."""
    if not is_chunked(seqs):
        return parts(seqs, window).select("seq_no", F.col("c").cast("bigint").alias("bin"), X.gc_fraction(F.col("part"), window).alias("gc"))
    # a chunk that begins inside a window is filled up to the window's start, so that its parts are windows
    filled = seqs.withColumn("_first", F.expr(f"start div {window}")).withColumn("seq", F.concat(F.repeat(F.lit("-"), F.expr(f"cast(start % {window} as int)")), "bases"))
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{window}}}"), 0)
    each = filled.where(F.length("bases") > 0).select("seq_no", "_first", F.posexplode(cut).alias("c", "part"))
    n = (F.length("part") - F.length(F.translate("part", "GC", ""))).alias("gc")
    return each.select("seq_no", (F.col("_first") + F.col("c")).cast("bigint").alias("bin"), n).groupBy("seq_no", "bin").agg((F.sum("gc") / float(window)).alias("gc"))


def contig_stats(seqs: DataFrame) -> DataFrame:
    """(seq_no, seq_len, seq_md5). The chunks of a sequence pass through md5 in their order, in batches; none is put together."""
    if not is_chunked(seqs):
        return seqs.select("seq_no", F.length("seq").cast("bigint").alias("seq_len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))
    kind = seqs.schema["seq_no"].dataType.simpleString()

    def digest(batches):
        now, of, size = None, None, 0

        def row(ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"seq_no": pa.array([now], ids), "seq_len": pa.array([size], pa.int64()), "seq_md5": pa.array([of.hexdigest()])})

        ids = None
        for batch in batches:
            ids = batch.schema.field("seq_no").type
            for name, bases in zip(batch["seq_no"].to_pylist(), batch["bases"].to_pylist(), strict=True):
                if of is None or name != now:
                    if of is not None:
                        yield row(ids)
                    now, of, size = name, hashlib.md5(), 0
                of.update(bases.encode())
                size += len(bases)
        if of is not None:
            yield row(ids)

    ordered = seqs.select("seq_no", "chunk_no", "bases").repartition("seq_no").sortWithinPartitions("seq_no", "chunk_no").select("seq_no", "bases")
    return ordered.mapInArrow(digest, f"seq_no {kind}, seq_len bigint, seq_md5 string")


def chunked(seqs: DataFrame, width: int) -> DataFrame:
    """(seq_no, chunk_no, start, bases): the sequences in pieces of the width, so that joins never move a whole one."""
    return parts(seqs, width).select("seq_no", F.col("c").cast("bigint").alias("chunk_no"), (F.col("c").cast("bigint") * width).alias("start"), F.col("part").alias("bases"))


def spans_on_sequence(spans: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """(key columns, at, piece) of the bases under [pos, stop) of each span, a row for each chunk that it touches."""
    touched = spans.where("stop > pos").withColumn("chunk_no", F.explode(F.expr(f"sequence(pos div {width}, (stop - 1) div {width})")))
    both = touched.join(chunks.select("seq_no", "chunk_no", "bases"), ["seq_no", "chunk_no"])
    lo, hi = F.greatest(F.col("pos"), F.col("chunk_no") * width), F.least(F.col("stop"), F.col("chunk_no") * width + F.length("bases"))
    both = both.withColumn("at", lo).withColumn("n", hi - lo).where("n > 0")
    return both.withColumn("piece", F.expr(f"substring(bases, cast(at - chunk_no * {width} + 1 as int), cast(n as int))")).drop("bases", "n", "chunk_no")


def legal_variants(variant: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Variants that lie on their sequence as a whole and on no N."""
    got = spans_on_sequence(variant.select("v_id", "seq_no", "pos", "stop"), chunks, width).groupBy("v_id").agg(F.sum(F.length("piece")).alias("n"), F.bool_or(F.contains("piece", F.lit("N"))).alias("has_n"))
    return variant.join(got, "v_id").where(~F.col("has_n") & (F.col("n") == F.col("stop") - F.col("pos"))).drop("n", "has_n")


def kmer_score(seqs: DataFrame, table: DataFrame, k: int, step: int) -> DataFrame:
    """(seq_no, at, score): at every step bases, the count of the k-mer there; unseen ones, and those that the end cuts, count one."""
    cut = cut_up(seqs, step * max(1, PART // step), k - 1).join(lengths(seqs), "seq_no")
    first = F.pmod(-F.col("at"), F.lit(step))
    last = F.least(F.col("n").cast("bigint") - 1, F.expr(f"(length div {step}) * {step} - 1 - at"))
    cut = cut.where(last >= first).select("seq_no", "at", "part", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))).alias("i"))
    cut = cut.select("seq_no", (F.col("at") + F.col("i")).alias("at"), F.expr(f"substring(part, cast(i + 1 as int), {k})").alias("kmer"))
    return counted(cut, table, k).select("seq_no", "at", F.coalesce("n", F.lit(1)).alias("score"))


def gc_with_coverage(gc: DataFrame, coverage: DataFrame) -> DataFrame:
    """GC windows with reads counted in them; sequences without reads are left out, windows without reads have 0."""
    some = coverage.select("seq_no").distinct()
    return gc.join(some, "seq_no", "left_semi").join(coverage, ["seq_no", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def along(variant: DataFrame, by: tuple, grown: str, order: tuple, width: int = STRETCH) -> DataFrame:
    """variant with _shift, how much those before it have grown the sequence, and _from, where the last of them stops (0 for none).

    Summed inside stretches of a sequence; each stretch knows what those before it come to. So only a row for each stretch
    is ordered over a whole sequence.
    """
    rows = variant.withColumn("_b", X.bin_of("pos", width))
    sums = rows.groupBy(*by, "_b").agg(F.sum(grown).alias("g"), F.max_by("stop", F.struct(*order)).alias("s"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"_k_{i}" for i, c in enumerate((*by, "_b"))}
    before = sums.select(*(F.col(c).alias(n) for c, n in names.items()), F.sum("g").over(w).alias("_g"), F.last("s").over(w).alias("_s"))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    own = Window.partitionBy(*by, "_b").orderBy(*order)
    near = rows.withColumn("_shift", F.coalesce(F.sum(grown).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_from", F.lag("stop").over(own))
    near = near.join(before, same).withColumn("_shift", F.col("_shift") + F.coalesce("_g", F.lit(0))).withColumn("_from", F.coalesce("_from", "_s", F.lit(0)).cast("bigint"))
    return near.drop("_b", "_g", "_s", *names.values())


def applied(variant: DataFrame, by: tuple = ("seq_no",), width: int = STRETCH) -> DataFrame:
    """variant(by, pos, stop, alt) of one copy, free of collisions, with the place of each allele on the haplotype (alt_start), and where the sequence before it begins (from, alt_from)."""
    v = along(variant.withColumn("_grown", F.length("alt") - (F.col("stop") - F.col("pos"))), by, "_grown", ("pos",), width)
    v = v.withColumn("from", F.col("_from")).withColumn("alt_start", F.col("pos") + F.col("_shift")).withColumn("alt_from", F.col("_from") + F.col("_shift"))
    return v.drop("_grown", "_shift", "_from")


def ended(variant: DataFrame, sizes: DataFrame, by: tuple) -> DataFrame:
    """variant and, for each sequence of sizes(by, length), a row of no bases at its end, so that what follows the last variant is what lies before that row."""
    end = sizes.select(*by, F.col("length").cast("bigint").alias("pos"), F.col("length").cast("bigint").alias("stop"), *(F.lit("").alias(c) for c in ("ref", "alt") if c in variant.columns))
    return variant.select(end.columns).unionByName(end)


def consensus_pieces(seqs: DataFrame, variant: DataFrame, width: int = 1 << 16, stretch: int = STRETCH) -> DataFrame:
    """(seq_no, alt_start, piece): the sequence of a copy with its variants applied, in pieces.

    variant(seq_no, pos, stop, alt) of one copy, free of collisions. What lies between them is cut from chunks of the
    sequence, so no join moves a whole one; places come from the variants alone. seqs: whole, or chunks of the width.
    """
    size = lengths(seqs)
    v = applied(ended(variant.select("seq_no", "pos", "stop", "alt"), size, ("seq_no",)), width=stretch)
    spans = v.select("seq_no", F.col("from").alias("pos"), F.col("pos").alias("stop"), "alt_from", F.col("from").alias("start"))
    cut = spans_on_sequence(spans, seqs if is_chunked(seqs) else chunked(seqs, width), width).select("seq_no", (F.col("alt_from") + F.col("at") - F.col("start")).alias("alt_start"), "piece")
    alleles = v.where(F.length("alt") > 0).select("seq_no", "alt_start", F.col("alt").alias("piece"))
    none = size.where("length = 0").select("seq_no", F.lit(0).cast("bigint").alias("alt_start"), F.lit("").alias("piece"))
    return cut.unionByName(alleles).unionByName(none)


def typed_pieces(contig: DataFrame, variant: DataFrame, by: tuple = ("seq_no",), stretch: int = STRETCH) -> DataFrame:
    """(by, f_start, f_stop, ref_pos, op, n): how a haplotype is made of the reference, as closed intervals of its own places.

    '=' follows the reference from ref_pos, X is a replaced base, I has no place on the reference and ref_pos is what
    follows it; D stands at the first place after it, with its length n. contig(by, seq_len); variant as for
    consensus_pieces(), with ref. Equal first bases of an indel count as '='.
    """
    v = applied(ended(variant, contig.withColumnRenamed("seq_len", "length"), by), by, stretch).withColumn("r", F.length("ref")).withColumn("a", F.length("alt"))
    grown = F.greatest(F.col("a") - F.col("r"), F.lit(0))
    kept = F.least("r", "a")
    piece = lambda start, n, ref, op: F.struct(start.cast("bigint").alias("f_start"), (start + n - 1).cast("bigint").alias("f_stop"), ref.cast("bigint").alias("ref_pos"), F.lit(op).alias("op"), F.when(F.lit(op) == "D", F.col("r") - F.col("a")).otherwise(n).cast("bigint").alias("n"))
    s, pos, same = F.col("alt_start"), F.col("pos"), (F.col("r") == F.col("a")) & (F.col("r") > 0)
    out = F.array(
        piece(F.col("alt_from"), pos - F.col("from"), F.col("from"), "="),
        F.when(same, piece(s, F.lit(1), pos, "X")),
        F.when(same, piece(s + 1, F.col("r") - 1, pos + 1, "=")).otherwise(piece(s, kept, pos, "=")),
        F.when(F.col("a") > F.col("r"), piece(s + kept, grown, pos + F.col("r"), "I")),
        F.when(F.col("a") < F.col("r"), piece(s + kept, F.lit(1), pos + F.col("r"), "D")),
    )
    return v.select(*by, F.explode(F.array_compact(out)).alias("q")).select(*by, "q.*").where("n > 0")


def lift_to_reference(intervals: DataFrame, pieces: DataFrame, by: tuple = ("seq_no",)) -> DataFrame:
    """intervals(by, id, start, rlen) of a haplotype with their pos and CIGAR on the reference.

    pos is the first base with a place there. An insertion at either end of an interval is S, one that fills it nS; a
    deletion counts between two bases of the interval only. An interval must lie on the haplotype.
    """
    q = intervals.withColumn("end", F.col("start") + F.col("rlen") - 1)
    met = overlap_join(q, pieces, "start", "end", by=by).where("op <> 'D' or start < f_start")
    n = F.when(F.col("op") == "D", F.col("n")).otherwise(F.least("f_stop", "end") - F.greatest("f_start", "start") + 1)
    cut = (F.col("f_start") <= F.col("start")) | (F.col("f_stop") >= F.col("end"))
    op = F.when((F.col("op") == "I") & cut, "S").otherwise(F.col("op"))
    at = F.when(F.col("op") == "I", F.col("ref_pos")).otherwise(F.col("ref_pos") + F.greatest(F.col("start") - F.col("f_start"), F.lit(0)))
    # in order; a deletion comes before the bases that follow it
    part = F.struct("f_start", (F.col("op") != "D").alias("later"), n.alias("n"), op.alias("op"), at.alias("at"))
    rows = met.groupBy(*by, "id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a row for each variant under one interval
    kind = "array<struct<n:bigint,op:string>>"
    top = lambda acc: F.try_element_at(acc, F.lit(-1))
    step = lambda x: F.struct(x["n"].alias("n"), x["op"].alias("op"))
    merged = F.aggregate(
        "parts",
        F.array().cast(kind),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["op"] == "=") & (top(acc)["op"] == "="), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((top(acc)["n"] + x["n"]).alias("n"), x["op"].alias("op"))))).otherwise(F.concat(acc, F.array(step(x)))),
    )
    first = F.element_at(F.filter("parts", lambda x: x["op"] != "D"), 1)["at"]
    return rows.select(*by, "id", first.alias("pos"), F.array_join(F.transform(merged, lambda x: F.concat(x["n"].cast("string"), x["op"])), "").alias("cigar"))


def consensus(pieces: DataFrame) -> DataFrame:
    """(seq_no, seq) of the pieces, in their order."""
    return pieces.groupBy("seq_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt_start", "piece"))), lambda x: x["piece"]), "").alias("seq"))
