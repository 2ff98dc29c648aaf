"""Templates of ordinary alignments: put together by name, place and flags; no truth is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from .reads import serialise
from .tables import settled

#: Bits of a SAM flag.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, READ1, SECONDARY, SUPPLEMENTARY = 1, 4, 8, 16, 64, 256, 2048


def has_flag(bits: int, flag: str = "flag") -> Column:
    """Whether any of the bits is set."""
    return F.col(flag).bitwiseAND(F.lit(bits)) != 0


def as_sequenced(seq: Column, flag: str = "flag") -> Column:
    """The bases as they were read: those of a read on the reverse strand are stored as their complement."""
    return F.when(has_flag(REVERSE, flag), X.reverse_complement(seq)).otherwise(seq)


def templates(alignments: DataFrame, min_mapq: int = 0, width: int = 10000) -> DataFrame:
    """(serial, qname, r0, r1): a row for each template of alignments(qname, flag, ref_id, next_ref_id, apos, pnext, mapq, acigar, seq).

    Primary rows count that are mapped with min_mapq at least and have bases. Two rows are mates if they have one name, are on one
    chromosome, name each other's place, and one is read 1 and the other is not; where several fit, the first read 1
    goes with the first other one, by bases and CIGAR, so a name may be that of many templates, and a read without a
    mate that fits makes none. Unpaired reads are templates of their own, and are never brought together by name. serial numbers the templates by
    chromosome, place and name. qname says where the reads lie, as decode_qname() takes it; r0 is read 1, r1 its mate or
    null: (ro, pos, rlen, cigar, seq), with bases as they were read.
    """
    paired, has_bases = has_flag(PAIRED), (F.length("seq") > 0) & (F.col("seq") != "*")
    rows = alignments.where(~has_flag(UNMAPPED | SECONDARY | SUPPLEMENTARY) & (F.col("mapq") >= min_mapq)).where(~paired | (~has_flag(MATE_UNMAPPED) & (F.col("ref_id") == F.col("next_ref_id"))))
    # a template's two places are part of its key, so that a name that many templates share is not one group; an unpaired read is in a group that its own bases and place make
    own = F.when(~paired, F.xxhash64("seq", "acigar", "flag"))
    rows = rows.select(F.col("qname").alias("name"), "flag", "ref_id", "apos", "acigar", "seq", F.least("apos", "pnext").alias("_lo"), F.greatest("apos", "pnext").alias("_hi"), (F.col("apos") <= F.col("pnext")).alias("_left"), (F.col("apos") == F.col("pnext")).alias("_same"), own.alias("_own"))
    key = ["name", "ref_id", "_lo", "_hi", "_own"]
    # the hash of the key goes first, as rows are then sorted by a number; bases are looked at behind the shuffle, where they are there and needn't be made for each use
    rows = rows.withColumn("_h", F.xxhash64(*key)).repartition("_h")
    key = ["_h", *key]
    ro = F.when(has_flag(REVERSE), 1).otherwise(0)
    read = F.struct(ro.alias("ro"), F.col("apos").alias("pos"), F.length("seq").alias("rlen"), F.col("acigar").alias("cigar"), as_sequenced(F.col("seq")).alias("seq"))
    # of two reads at different places, read 1 may be either; both orders of a name at the same places are templates apart
    first = ~paired | has_flag(READ1)
    turned = F.when(F.col("_same"), F.lit(True)).otherwise(F.col("_first") == F.col("_left"))
    # what has no bases is a kind of its own, neither read 1 nor its mate: a filter would be pushed down below the shuffle
    rows = rows.select(*key, first.alias("_first"), "_left", "_same", has_bases.alias("_whole"), read.alias("r")).withColumn("_turn", turned)
    order = Window.partitionBy(*key, "_turn", "_first", "_whole").orderBy("r.seq", "r.cigar", "r.ro")
    side = lambda first: F.max(F.when(F.col("_whole") & (F.col("_first") == first), F.col("r")))
    both = rows.withColumn("_k", F.row_number().over(order)).groupBy(*key, "_turn", "_k").agg(side(True).alias("r0"), side(False).alias("r1")).where("r0 is not null and (r1 is not null or _own is not null)")
    every = settled(both.select("ref_id", "name", "r0", "r1", F.col("r0.pos").alias("_p")))
    numbered = serialise(every, ["_p", "name", "r1.pos", "r0", "r1"], F.struct("ref_id", X.bin_of("_p", width)))
    fields = lambda r: [F.col(f"{r}.{c}") for c in ("ro", "pos", "rlen", "cigar")]  # noqa: E731  what is null is left out of the name
    return numbered.select("serial", X.encode_qname(F.col("serial"), F.col("ref_id") + 1, F.lit(0), *fields("r0"), *fields("r1")).alias("qname"), "r0", "r1")


def templates_fastq(alignments: DataFrame, min_mapq: int = 0) -> DataFrame:
    """(qname, mate, seq) of templates(), for write_fastq(): a truth read set out of any aligner's output."""
    reads = templates(alignments, min_mapq).select("qname", F.posexplode(F.array("r0", "r1")).alias("k", "r")).where("r is not null")
    return reads.select("qname", (F.col("k") + 1).alias("mate"), F.col("r.seq").alias("seq"))
