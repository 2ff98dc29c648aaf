"""Column expressions of the alignment, variant and sequence operators; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a sequence is folded to.
FOLD_FROM, FOLD_TO = "actgURYSWKMBDHVn", "ACTGTNNNNNNNNNNN"


WHOLE = (r"-?\d+", r"-?\d+", r"-?\d+")
MATE = (r"-?\d+", r"-?\d+", r"-?\d+", r"[^|]*")


def qname_is_whole(qname: str = "qname", is_paired: Column | None = None) -> Column:
    """Whether a name has the right number of fields, with integers where they belong."""
    single, double = ("^" + r"\|".join(WHOLE + MATE * k) + "$" for k in (1, 2))
    return F.col(qname).rlike(double) if is_paired is None else F.when(is_paired, F.col(qname).rlike(double)).otherwise(F.col(qname).rlike(single))


def qname_fields(qname: str = "qname", is_paired: Column | None = None, is_read1: str = "is_read1") -> dict[str, Column]:
    """Truth in a whole name: the read's own and its mate's; an unpaired read's mate has 0 and ''."""
    paired = F.lit(True) if is_paired is None else is_paired
    first = F.col(is_read1).cast("int") == 1
    own_first = first if is_paired is None else ~paired | first

    parts = F.split(F.col(qname), r"\|")  # alike in every field, so it is worked out once

    def part(k) -> Column:
        return F.get(parts, k - 1 if isinstance(k, Column) else F.lit(k - 1))

    def n(k) -> Column:
        return part(k).try_cast("bigint")

    def side(k: int, own: bool) -> Column:
        return F.when(own_first if own else ~own_first, k).otherwise(k + 4)

    def mate(c: Column, none) -> Column:
        return c if is_paired is None else F.when(paired, c).otherwise(none)

    serial = n(1) * 10 + F.when(first, 0).otherwise(1)
    return {
        "read_serial": serial if is_paired is None else F.when(paired, serial).otherwise(n(1)), "chrom": n(2), "cpy": n(3),
        "ro": n(side(4, True)), "pos": n(side(5, True)), "rlen": n(side(6, True)), "cigar": part(side(7, True)),
        "ro_m": mate(n(side(4, False)), 0), "pos_m": mate(n(side(5, False)), 0), "rlen_m": mate(n(side(6, False)), 0), "cigar_m": mate(part(side(7, False)), ""),
    }


def decode_qname(qname: str = "qname", is_paired: Column | None = None, is_read1: str = "is_read1") -> Column:
    """Truth in a read's name, as a struct; null where the number of fields or an integer is wrong."""
    fields = qname_fields(qname, is_paired, is_read1)
    return F.when(qname_is_whole(qname, is_paired), F.struct(*(v.alias(k) for k, v in fields.items())))


def cigar_ops(cigar: Column) -> Column:
    """Array of (n, op)."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), 1).alias("n"), F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), 2).alias("op")),
        lambda x: F.struct(x["n"].cast("bigint").alias("n"), x["op"].alias("op")),
    )


def old_style_cigar(cigar: Column) -> Column:
    """'=' becomes M; where there is an X it becomes M too, and neighbouring runs of M are merged."""
    kind = "struct<n:bigint,op:string>"
    as_m = F.transform(cigar_ops(cigar), lambda x: F.struct(x["n"].alias("n"), F.when(x["op"].isin("=", "X"), "M").otherwise(x["op"]).alias("op")))
    merged = F.aggregate(
        as_m,
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == "M") & (x["op"] == "M"),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((F.try_element_at(acc, F.lit(-1))["n"] + x["n"]).alias("n"), x["op"].alias("op")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.contains(cigar, F.lit("X")), F.array_join(F.transform(merged, lambda x: F.concat(x["n"].cast("string"), x["op"])), "")).otherwise(F.translate(cigar, "=", "M"))


def pos_is_correct(a_pos: Column, pos: Column, cigar: Column, window: int = 0) -> Column:
    """Aligned within the window of where the read's first matching base belongs; deletions before it shift that."""
    lead = F.regexp_extract(cigar, r"^((?:\d+[^\d=MX])*)\d+[=MX]", 1)
    skip = F.aggregate(F.regexp_extract_all(lead, F.lit(r"(\d+)D"), 1), F.lit(0).cast("bigint"), lambda acc, n: acc + n.cast("bigint"))
    plain = F.abs(a_pos - pos) <= window
    begins = cigar.rlike(r"^(\d+[=MX]|\d+[SI]$)")
    return F.when(begins, plain).when(cigar.rlike(r"^(?:\d+[^\d=MX])*\d+[=MX]"), F.abs(a_pos - pos - skip) <= window).otherwise(False)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCGN", "TAGCN"))


def fix_strand(seq: Column, qual: Column, is_reverse: Column, ro: Column) -> tuple[Column, Column]:
    """seq and qual as they are on the strand of the truth: turned where the read's strand is another one."""
    turn = is_reverse.cast("int") != ro.cast("int")
    return F.when(turn, reverse_complement(seq)).otherwise(seq), F.when(turn, F.reverse(qual)).otherwise(qual)


def encode_qname(*cols) -> Column:
    return F.concat_ws("|", *(c.cast("string") for c in cols))


def indel_length(ref: str = "ref", alt: str = "alt") -> Column:
    return (F.length(alt) - F.length(ref)).cast("bigint")


def has_variant_cigar(cigar: Column) -> Column:
    return cigar.rlike("[ISDX]")


def parse_gt(sample: Column) -> Column:
    """(h0, h1) of a genotype field: phased or not, haploid counts as both, '.' as none, no field as 1|1."""
    gt = F.split(sample, ":")[0]
    parts = F.when(F.contains(gt, F.lit("|")), F.split(gt, "\\|")).otherwise(F.split(gt, "/"))
    h0 = parts[0].try_cast("int")
    h1 = F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]).try_cast("int")
    none = F.struct(F.lit(0).alias("h0"), F.lit(0).alias("h1"))
    return F.when(sample.isNull(), F.struct(F.lit(1).alias("h0"), F.lit(1).alias("h1"))).when(F.contains(gt, F.lit(".")), none).otherwise(F.struct(h0.alias("h0"), h1.alias("h1")))


def allele_gt(h0: Column, h1: Column, n: Column) -> Column:
    return F.when((h0 == n) & (h1 == n), 2).when(h1 == n, 1).when(h0 == n, 0)


def is_imprecise(allele: Column) -> Column:
    return allele.rlike("[<>:\\[\\]]")


def clip_index(x: Column, most: int) -> Column:
    return F.least(F.greatest(x, F.lit(-most)), F.lit(most)).cast("bigint")


def normalize_bases(seq: Column) -> Column:
    return F.translate(seq, FOLD_FROM, FOLD_TO)


def gc_fraction(seq: Column, window: int) -> Column:
    """Share of G and C in a nominal window, also for a shorter last one."""
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / float(window)


def gt_string(gt: Column) -> Column:
    return F.element_at(F.array(F.lit("1|0"), F.lit("0|1"), F.lit("1|1")), (gt + 1).cast("int"))


def bin_of(pos: str, width: int) -> Column:
    return F.expr(f"{pos} div {width}")


def hash_uniform(*cols) -> Column:
    """0 to below 1, the same under any partitioning."""
    text = F.concat_ws("|", *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / 4294967296.0
