"""Further queries: regions, neighbours, spectra, cohorts, pieces of sequences, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import reads as R
from ..operators import sequence as Q
from ..operators import variants as V
from ..operators.tables import settled
from .registry import BOTH, FEATS, HITS, PCT, S1, both_runs, feats, greedy, query, scored, view, with_

#: Width of the chunks that sequences are cut into.
CHUNK = 500
#: Spectrum of the histogram, as (level, share).
SPECTRUM = [(0.1, 0.4), (0.3, 0.3), (0.5, 0.2), (0.9, 0.1)]

UNIFORM = "('0x'||substr(md5(concat_ws('|',{})),1,8))::bigint/4294967296.0"
C2 = "c as (select sample, 0 copy, chrom, pos, min(v.v_id) v_id from fx_variant v join fx_genotype g on v.v_id=g.v_id where gt in (0,2) group by all union all select sample, 1, chrom, pos, min(v.v_id) from fx_variant v join fx_genotype g on v.v_id=g.v_id where gt in (1,2) group by all)"
HITS2 = "hits2 as (select s.*, f.x, f.v_id from scored2_x s join feats f on s.chrom=f.chrom and s.pos <= f.f_stop and s.read_stop >= f.f_start)"
RUNS = ("runs as (select 'a' run, x, xf from hits union all select 'b', x, xf from hits2)", "racc as (select run, x, sum(case when xf=1 then 1 else 0 end) correct, count(*) total from runs group by run, x)")


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Genotypes of both copies by stretches of 5000 bases, so that copies meet at a place."""
    s = V.sample_variants(view(spark, d, "fx_variant"), view(spark, d, "fx_genotype")).withColumn("pos", X.bin_of("pos", 5000))
    one = [V.copy_variants(s, k).groupBy("sample", "chrom", "pos").agg(F.min("v_id").alias("v_id")).withColumn("copy", F.lit(k)) for k in (0, 1)]
    return one[0].unionByName(one[1])


def run_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """(run, x, correct, total) of both runs; lengths without reads have no row."""
    runs = R.attach_runs({k: R.accuracy_of_features(scored(spark, d, i), feats(spark, d)).select("x", "correct", "total") for i, k in ((1, "a"), (2, "b"))})
    return runs.where("total > 0").groupBy("run", "x").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("p6_region_by_fraction", with_("fx_variant", "fx_contig") + "select v_id, v.chrom, pos from fx_variant v join fx_contig c on v.chrom=c.chrom where (v.chrom=2 and pos between 0.25*seq_len and 0.5*seq_len) or v.chrom=3")
def _(spark, d):
    return R.region_by_fraction(view(spark, d, "fx_variant"), view(spark, d, "fx_contig"), [(2, 0.5, 0.25), (3,)]).select("v_id", "chrom", "pos")


@query("p9_legal_variants", with_("fx_site", "fx_seq") + "select v_id, seq_no, pos, stop from fx_site v join fx_seq s using (seq_no) where stop<=length(seq) and not contains(substr(seq, (pos+1)::int, (stop-pos)::int), 'N')")
def _(spark, d):
    chunks = Q.chunked(view(spark, d, "fx_seq"), CHUNK)
    return Q.legal_variants(view(spark, d, "fx_site"), chunks, CHUNK).select("v_id", "seq_no", "pos", "stop")


@query("j10_variants_on_sequence", with_("fx_site", "fx_seq") + "select v_id, substr(seq, (pos+1)::int, (stop-pos)::int) span from fx_site v join fx_seq s using (seq_no) where pos<length(seq)")
def _(spark, d):
    pieces = Q.spans_on_sequence(view(spark, d, "fx_site").select("v_id", "seq_no", "pos", "stop"), Q.chunked(view(spark, d, "fx_seq"), CHUNK), CHUNK)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")  # a piece for each chunk under one variant
    return pieces.groupBy("v_id").agg(whole.alias("span"))


@query("p10_flag_multiallelic", with_("fx_variant", "fx_genotype", extra=(C2.replace(", pos,", ", pos//5000 pos,").replace("group by all", "group by sample, chrom, pos//5000"),)) + "select * from (select sample, chrom, pos, max(case when copy=0 then v_id end) z0, max(case when copy=1 then v_id end) z1 from c group by all) where z0<>z1")
def _(spark, d):
    return V.flag_multiallelic(copies(spark, d), ["sample", "chrom"])


@query("j11_check_same_reference", with_("fx_contig", "fx_variant") + "select count(*)=0 same from fx_contig a full join (select chrom, max(stop) seq_len from fx_variant group by chrom) b on a.chrom=b.chrom where a.seq_len is distinct from b.seq_len")
def _(spark, d):
    seen = view(spark, d, "fx_variant").groupBy("chrom").agg(F.max("stop").alias("seq_len"))
    return R.check_same_reference(view(spark, d, "fx_contig"), seen)


@query("j12_pairwise_runs", with_("fx_align", "fx_variant", extra=(*BOTH, FEATS, HITS, HITS2, *RUNS)) + "select a.run run_1, b.run run_2, a.x, round(b.correct*100.0::double/b.total - a.correct*100.0::double/a.total, 6) diff from racc a join racc b on a.x=b.x and a.run<b.run")
def _(spark, d):
    return rounded(R.pairwise_runs(run_accuracy(spark, d)), "diff")


@query("a26_run_report", with_("fx_align", "fx_variant", extra=(*BOTH, FEATS, HITS, HITS2, *RUNS)) + f"select run, count(distinct x) lengths, round(avg(case when x=0 then {PCT} end),6) snp, round(avg(case when x<=-20 then {PCT} end),6) del_long, round(avg(case when x>-20 and x<0 then {PCT} end),6) del_short, round(avg(case when x>0 and x<20 then {PCT} end),6) ins_short, round(avg(case when x>=20 then {PCT} end),6) ins_long from racc group by run")
def _(spark, d):
    a = run_accuracy(spark, d)
    runs = a.groupBy("run").agg(F.countDistinct("x").alias("lengths"))
    return rounded(R.run_report(runs, a), "snp", "del_long", "del_short", "ins_short", "ins_long")


GC = "g as (select seq_no, bin, substr(seq, (bin*100+1)::int, 100) w from fx_seq, lateral (select unnest(range(0, (length(seq)-1)//100+1)) bin) where length(seq)>0)"


@query("j13_gc_with_coverage", with_("fx_seq", "fx_site", extra=(GC, "n as (select seq_no, pos//100 bin, count(*) n from fx_site group by all)")) + "select g.seq_no, g.bin::bigint bin, (length(w)-length(translate(w,'GC','')))/100.0::double gc, coalesce(n,0)::bigint n from g left join n on g.seq_no=n.seq_no and g.bin=n.bin where g.seq_no in (select seq_no from n)")
def _(spark, d):
    n = view(spark, d, "fx_site").groupBy("seq_no", X.bin_of("pos", 100).alias("bin")).agg(F.count("*").alias("n"))
    return Q.gc_with_coverage(Q.gc_windows(view(spark, d, "fx_seq"), 100), n)


@query("j14_reads_near_variants", with_("fx_align", "fx_variant", "fx_contig", extra=(S1, "w as (select v.chrom, greatest(pos-60,0) b, least(pos+60, seq_len) e from fx_variant v join fx_contig c on v.chrom=c.chrom)")) + "select read_serial, chrom, pos from scored_x s where exists (select 1 from w where w.chrom=s.chrom and s.pos<=w.e and s.read_stop>=w.b)")
def _(spark, d):
    return R.reads_near_variants(scored(spark, d), V.variant_windows(view(spark, d, "fx_variant"), view(spark, d, "fx_contig"), 60)).select("read_serial", "chrom", "pos")


NEAR = ("i as (select chrom, pos, arg_max(x, v_id) x from (select v_id, chrom, pos, length(alt)-length(ref) x from fx_variant) where x>0 group by chrom, pos)", "m as (select a.v_id, abs(a.pos-i.pos) dist, i.x length, row_number() over (partition by a.v_id order by abs(a.pos-i.pos), i.pos desc) rn from fx_variant a join i on a.chrom=i.chrom where length(a.alt)<=length(a.ref))")


@query("a6_accuracy_by_indel_and_neighbour", with_("fx_align", "fx_variant", extra=(S1, FEATS, HITS, *NEAR)) + "select greatest(least(x,20),-20)::bigint x1, greatest(least(length,20),-20)::bigint x2, least(dist,200)::bigint dist, sum(case when xf=1 then 1 else 0 end)::bigint correct, count(*) total from hits join m on hits.v_id=m.v_id and rn=1 group by 1,2,3")
def _(spark, d):
    v = view(spark, d, "fx_variant").withColumn("x", X.indel_length())
    near = V.nearest_variant(v.where("x <= 0"), v.where("x > 0"))
    return R.accuracy_by_neighbour(R.accuracy_of_features(scored(spark, d), feats(spark, d)), near, 20, 200)


@query("a10_histogram2d", with_("fx_align", extra=(S1,)) + "select least(((chrom-1)*1000000+pos)*100//5000000, 99) bx, least((a_chrom*1000000+a_pos)*100//5000000, 99) \"by\", count(*) n from scored_x where is_misaligned and (chrom-1)*1000000+pos between 0 and 5000000 and a_chrom*1000000+a_pos between 0 and 5000000 group by 1,2")
def _(spark, d):
    contig = view(spark, d, "fx_contig").select("chrom", "seq_len")
    bad = scored(spark, d).where("is_misaligned").select("chrom", "pos", (F.col("a_chrom") + 1).alias("ac"), "a_pos")
    both = R.linear_pos(bad, contig).withColumnRenamed("linear", "lx").select("lx", F.col("ac").alias("chrom"), F.col("a_pos").alias("pos"))
    return R.histogram2d(R.linear_pos(both, contig), "lx", "linear", contig.agg(F.sum("seq_len")).first()[0])


@query("a15_spectrum_histogram", with_("fx_variant") + "select level::double as level, (select count(*) from fx_variant where p>=lo and (p<hi or (p=hi and level=0.9))) actual, round(share*(select count(*) from fx_variant), 6)::double ideal from (values (0.1,0.4,0.0::double,0.2::double),(0.3,0.3,0.2,0.4),(0.5,0.2,0.4,0.7),(0.9,0.1,0.7,1.1)) t(level,share,lo,hi)")
def _(spark, d):
    return rounded(V.spectrum_histogram(view(spark, d, "fx_variant"), SPECTRUM), "ideal")


@query("a18_kmer_score", with_("fx_seq", extra=("k as (select substr(seq, i::int, 6) kmer, count(*) n from fx_seq, lateral (select unnest(range(1, length(seq)-4)) i) where length(seq)>=6 group by 1)", "s as (select seq_no, i*50 as at, substr(seq, (i*50+1)::int, 6) kmer from fx_seq, lateral (select unnest(range(0, length(seq)//50)) i))")) + "select seq_no, s.at::bigint as at, coalesce(n,1)::bigint score from s left join k on s.kmer=k.kmer")
def _(spark, d):
    s = view(spark, d, "fx_seq")
    return Q.kmer_score(s, Q.kmer_count(s, 6), 6, 50)


@query("a22_mean_coverage", with_("fx_truth", "fx_contig") + "select round((select sum(rl)*2 from fx_truth)/(select sum(seq_len) from fx_contig)::double, 9) coverage")
def _(spark, d):
    return rounded(R.mean_coverage(scored(spark, d), view(spark, d, "fx_contig")), "coverage", n=9)


@query("g9_serialise", with_("fx_align", extra=(S1,)) + "select read_serial, row_number() over (order by chrom, pos, read_serial)-1 serial from scored_x")
def _(spark, d):
    return R.serialise(scored(spark, d).select("read_serial", "chrom", "pos"), ["pos", "read_serial"], F.struct("chrom", X.bin_of("pos", 10000))).select("read_serial", "serial")


@query("m2_force_homozygous", with_("fx_variant") + f"select s.sample::bigint sample, v_id, 2::bigint gt from fx_variant cross join (select unnest(range(1,4)) sample) s where {UNIFORM.format("'7',s.sample::varchar,chrom::varchar,v_id::varchar")} < p")
def _(spark, d):
    return V.force_homozygous(view(spark, d, "fx_variant"), 7, 3).select("sample", "v_id", "gt")


M4 = ("e as (select chrom, v_id, copy::bigint copy, " + UNIFORM.format("'5','vx',copy::varchar,chrom::varchar,v_id::varchar") + " r, " + UNIFORM.format("'5','v',copy::varchar,chrom::varchar,v_id::varchar") + " u, from fx_variant cross join (select unnest(range(0,2)) copy))", "k as (select *, row_number() over (partition by chrom, copy order by r, v_id)-1 < floor(count(*) over (partition by chrom, copy)*0.2::double) in_vx from e)")


@query("m4_nested_samples", with_("fx_variant", extra=M4) + "select 'vx' as name, copy, chrom, v_id from k where in_vx" + "".join(f" union all select 'v{i}', copy, chrom, v_id from k where u<{p} and not (in_vx and u>=0.1)" for i, p in enumerate((0.1, 0.5, 0.9))))
def _(spark, d):
    return V.nested_samples(view(spark, d, "fx_variant"), 0.2, [0.1, 0.5, 0.9], 5)


@query("m5_sample_n", with_("fx_variant") + f"select v_id, chrom, pos from fx_variant order by {UNIFORM.format("'11',v_id::varchar")}, v_id limit 50")
def _(spark, d):
    return V.sample_n(view(spark, d, "fx_variant"), 50, 11).select("v_id", "chrom", "pos")


@query("c6_compare_two_runs", with_("fx_align", extra=(*BOTH, "j as (select b1.read_serial r1, b2.read_serial r2, b1.a_chrom=b2.a_chrom and b1.a_pos=b2.a_pos and b1.a_cigar=b2.a_cigar same from b1 full join b2 on b1.read_serial=b2.read_serial)")) + "select count(*) filter (r1 is not null and r2 is not null and same) joint_identical, count(*) filter (r1 is not null and r2 is not null and not same) joint_different, count(*) filter (r2 is null) b1, count(*) filter (r1 is null) b2 from j")
def _(spark, d):
    contig = view(spark, d, "fx_contig")
    return R.counts_on_same_reference(R.compare_attached(both_runs(view(spark, d, "fx_align")), 1, 2), contig, contig)


@query("c2_truth_fastq_names", with_("fx_align", extra=(
    "a as (select cast(split_part(qname,'|',1) as bigint) rs, is_read1, ref_id, apos, acigar, split_part(qname,'|',case when is_read1=1 then 4 else 8 end) ro from fx_align where is_unmapped=0 and mapq>=20)",
    "t as (select x.rs, x.ref_id c, x.apos p, concat_ws('|', x.ro, x.apos::varchar, '100', x.acigar) h0, concat_ws('|', y.ro, y.apos::varchar, '100', y.acigar) h1 from a x join a y on x.rs=y.rs and x.is_read1=1 and y.is_read1=0)",
    "n as (select *, row_number() over (order by c, p, rs)-1 serial from t)",
)) + "select serial, concat_ws('|', serial::varchar, (c+1)::varchar, '0', h0, h1) qname from n")
def _(spark, d):
    return R.truth_names(R.filter_mapped(scored(spark, d), 20))


def c5(spark: SparkSession, d: str) -> DataFrame:
    """Diploid genotypes of drawn samples; the sweep is checked against a loop in the tests."""
    return V.diploid_samples(view(spark, d, "fx_variant"), 7, 3)


LEGAL = "legal as (select v_id, seq_no, pos, stop, alt from fx_site v join fx_seq s using (seq_no) where stop<=length(seq) and not contains(substr(seq, (pos+1)::int, (stop-pos)::int), 'N'))"


def haplotype(spark: SparkSession, d: str) -> DataFrame:
    """Legal, collision-free variants of every sequence, as a table: what follows goes over them more than once."""
    legal = settled(Q.legal_variants(view(spark, d, "fx_site"), Q.chunked(view(spark, d, "fx_seq"), CHUNK), CHUNK))
    return settled(V.remove_collisions(legal.select("seq_no", "pos", "stop", "v_id"), ["seq_no"]).join(legal.select("v_id", "ref", "alt"), "v_id"))


@query("g5_consensus", with_("fx_site", "fx_seq", extra=(
    LEGAL, greedy("legal", "seq_no", 0),
    "a as (select k.*, alt, lag(k.stop, 1, 0) over (partition by k.seq_no order by k.pos) f from kept k join legal l on k.v_id=l.v_id)",
    "b as (select seq_no, string_agg(substr(seq, (f+1)::int, (pos-f)::int) || alt, '' order by pos) body, max(stop) f from a join fx_seq using (seq_no) group by seq_no)",
)).replace("with ", "with recursive ", 1) + "select s.seq_no, length(h)::bigint hap_len, md5(h) hap_md5 from (select s.seq_no, coalesce(body, '') || substr(seq, (coalesce(f, 0)+1)::int) h from fx_seq s left join b on s.seq_no=b.seq_no) s")
def _(spark, d):
    whole = Q.consensus(Q.consensus_pieces(view(spark, d, "fx_seq"), haplotype(spark, d)))
    return whole.select("seq_no", F.length("seq").cast("bigint").alias("hap_len"), F.md5(F.col("seq").cast("binary")).alias("hap_md5"))


#: Every base of a haplotype, in order, with its place and whether it is the reference's, another or an inserted one; then reads over these, base by base.
LIFTED = (
    LEGAL.replace("stop, alt from", "stop, ref, alt from"), greedy("legal", "seq_no", 0),
    "a as (select k.seq_no, k.pos, k.stop, l.ref, l.alt, lag(k.stop, 1, 0) over (partition by k.seq_no order by k.pos) f from kept k join legal l on k.v_id=l.v_id)",
    "e as (select s.seq_no, length(seq)::bigint pos, coalesce(max(a.stop), 0) f from fx_seq s left join a on s.seq_no=a.seq_no group by s.seq_no, length(seq))",
    "bases as (select seq_no, pos o, 0 part, p k, p place, '=' op from a, lateral (select unnest(range(f, pos)) p) union all select seq_no, pos, 1, k, case when k < length(ref) then pos + k else pos + length(ref) end, case when length(ref) = length(alt) and k = 0 then 'X' when k < length(ref) then '=' else 'I' end from a, lateral (select unnest(range(0, length(alt))) k) union all select seq_no, pos, 2, p, p, '=' from e, lateral (select unnest(range(f, pos)) p))",
    "h as (select seq_no, place, op, row_number() over (partition by seq_no order by o, part, k) - 1 i, count(*) over (partition by seq_no) n from bases)",
    "r as (select seq_no, s as start, place, op, i from h, lateral (select unnest([i // 40 * 40, i // 40 * 40 - 40]) s) where s >= 0 and i < s + 60 and s + 60 <= n)",
    "w as (select *, max(case when op <> 'I' then place end) over (partition by seq_no, start order by i rows between unbounded preceding and 1 preceding) before, lag(op) over (partition by seq_no, start order by i) prev from r)",
    "q as (select *, case when op <> 'I' and before is not null and place > before + 1 then place - before - 1 end d from w)",
    "g as (select *, sum(case when prev is null or prev <> op or d is not null or op = 'X' then 1 else 0 end) over (partition by seq_no, start order by i rows unbounded preceding) run from q)",
    "t as (select seq_no, start, run, any_value(op) op, count(*) n, max(d) d, min(i) i, arg_min(place, i) place from g group by seq_no, start, run)",
    "u as (select *, max(run) over (partition by seq_no, start) last from t)",
)


@query("g6_lift_to_reference", with_("fx_site", "fx_seq", extra=LIFTED).replace("with ", "with recursive ", 1) + "select seq_no, start id, arg_min(place, run)::bigint pos, string_agg(coalesce(d || 'D', '') || n || case when op = 'I' and (run = 1 or run = last) then 'S' else op end, '' order by run) cigar from u group by seq_no, start")
def g6(spark: SparkSession, d: str) -> DataFrame:
    """Where reads of 60 bases, one at every 40 of each haplotype, lie on the reference."""
    contig = view(spark, d, "fx_seq").select("seq_no", F.length("seq").cast("bigint").alias("seq_len"))
    kept = haplotype(spark, d)
    grown = kept.groupBy("seq_no").agg(F.sum(F.length("alt") - F.length("ref")).alias("g"))
    ends = contig.join(grown, "seq_no", "left").select("seq_no", (F.col("seq_len") + F.coalesce("g", F.lit(0)) - 60).alias("last")).where("last >= 0")
    reads = ends.select("seq_no", F.explode(F.expr("sequence(0L, last, 40L)")).alias("start")).select("seq_no", "start", F.col("start").alias("id"), F.lit(60).cast("bigint").alias("rlen"))
    return Q.lift_to_reference(reads, Q.typed_pieces(contig, kept))


@query("f6_fix_strand", with_("fx_seq") + "select seq_no, md5(case when seq_no % 2 <> (seq_no % 3)//2 then reverse(translate(seq,'ATCGN','TAGCN')) else seq end) seq, md5(case when seq_no % 2 <> (seq_no % 3)//2 then reverse(translate(seq,'ACGTN','vwxyz')) else translate(seq,'ACGTN','vwxyz') end) qual from fx_seq")
def _(spark, d):
    seq, qual = X.fix_strand(F.col("seq"), F.translate("seq", "ACGTN", "vwxyz"), F.expr("seq_no % 2"), F.expr("(seq_no % 3) div 2"))
    return view(spark, d, "fx_seq").select("seq_no", F.md5(seq.cast("binary")).alias("seq"), F.md5(qual.cast("binary")).alias("qual"))


@query("p2_to_truth_coordinates", with_("fx_align", extra=(S1, "ro as (select cast(split_part(qname,'|',1) as bigint)*10 + case when is_read1=1 then 0 else 1 end read_serial, split_part(qname,'|',case when is_read1=1 then 4 else 8 end)='1' is_reverse from fx_align)")) + "select s.read_serial, chrom-1 ref_id, pos apos, '100=' acigar, pos_m pnext, is_reverse, not is_reverse mate_is_reverse, a_chrom, a_pos, is_unmapped was_unmapped from scored_x s join ro using (read_serial)")
def _(spark, d):
    return R.to_truth_coordinates(scored(spark, d)).select("read_serial", "ref_id", "apos", "acigar", "pnext", "is_reverse", "mate_is_reverse", "a_chrom", "a_pos", "was_unmapped")


@query("p1_score_unpaired", with_("fx_single") + "select split_part(qname,'|',1)::bigint read_serial, split_part(qname,'|',5)::bigint pos, 0::bigint pos_m, split_part(qname,'|',7) cigar, (apos = split_part(qname,'|',5)::bigint)::int::bigint xf, split_part(qname,'|',7) <> '5I95=' cigar_ok, not (apos = split_part(qname,'|',5)::bigint and split_part(qname,'|',7) <> '5I95=') is_misaligned from fx_single where is_secondary=0 and split_part(qname,'|',5)<>'none'")
def _(spark, d):
    s = R.score_alignments(view(spark, d, "fx_single"), cigar_errors=True)
    return s.select("read_serial", "pos", F.col("pos_m").cast("bigint").alias("pos_m"), "cigar", "xf", "cigar_ok", "is_misaligned")


@query("a25_sample_names", with_("fx_genotype") + "select distinct sample from fx_genotype")
def _(spark, d):
    return V.sample_names(view(spark, d, "fx_genotype"))


@query("o4_first_samples", with_("fx_genotype") + "select distinct sample from fx_genotype order by sample limit 10")
def _(spark, d):
    return V.first_samples(view(spark, d, "fx_genotype"), 10)


@query("a25_contigs_with_variants", with_("fx_contig", "fx_variant") + "select * from fx_contig where chrom in (select chrom from fx_variant)")
def _(spark, d):
    return V.contigs_with_variants(view(spark, d, "fx_contig"), view(spark, d, "fx_variant"))


@query("o3_concat_variants", with_("fx_variant", "fx_site", extra=("e as (select 0 source, v_id own_id, chrom, pos, ref, alt from fx_variant union all select 1, v_id, seq_no % 5 + 1, pos, ref, alt from fx_site)",)) + "select source, own_id, chrom, pos, row_number() over (partition by chrom order by pos, ref, alt, source, own_id)-1 v_id from e")
def _(spark, d):
    site = view(spark, d, "fx_site").withColumn("chrom", F.expr("seq_no % 5 + 1")).withColumn("p", F.lit(0.0))
    return V.concat_variants([view(spark, d, "fx_variant"), site]).select("source", "own_id", "chrom", "pos", "v_id")


@query("a2_templates_per_feature", with_("fx_align", "fx_variant", extra=(S1, FEATS, HITS, "mates as (select f.v_id, s.xf from scored_x s join feats f on s.chrom=f.chrom and s.pos_m <= f.f_stop and s.mate_stop >= f.f_start where s.read_serial not in (select read_serial from hits))")) + "select f.v_id, f.x, count(*) filter (xf=1) correct, count(xf) total from feats f left join mates m on f.v_id=m.v_id group by f.v_id, f.x")
def _(spark, d):
    return R.templates_per_feature(scored(spark, d), feats(spark, d)).select("v_id", "x", "correct", "total")


COPIES = (
    "featsc as (select f.*, c.cpy from feats f join fx_genotype g on f.v_id=g.v_id and g.sample=1 join (select unnest([0,1])::bigint cpy) c on g.gt=2 or g.gt=c.cpy)",
    "hitsc as (select s.read_serial, s.xf, f.x, f.v_id, f.cpy from scored_x s join featsc f on s.chrom=f.chrom and s.cpy=f.cpy and s.pos <= f.f_stop and s.read_stop >= f.f_start)",
    "matec as (select s.read_serial, s.xf, f.x from scored_x s join featsc f on s.chrom=f.chrom and s.cpy=f.cpy and s.pos_m <= f.f_stop and s.mate_stop >= f.f_start)",
    "tplc as (select * from matec where read_serial not in (select read_serial from hitsc))",
)
BY_X = "select '{0}' part, r.x, count(*) filter (xf=1) correct, count(xf) total from (select unnest(range(-20,21)) x) r left join {1} h on r.x=h.x group by r.x"


@query("c1_indel_accuracy", with_("fx_align", "fx_variant", "fx_genotype", extra=(S1, FEATS, *COPIES)) + f"{BY_X.format('reads', 'hitsc')} union all {BY_X.format('templates', 'tplc')} union all select 'covered', x, n, n from (select x, count(*) n from (select distinct x, v_id, cpy from hitsc) group by x) union all select 'outside', null, count(*) filter (xf=1), count(*) from scored_x where read_serial not in (select read_serial from hitsc union all select read_serial from matec)")
def _(spark, d):
    g = view(spark, d, "fx_genotype").where("sample = 1")
    return R.indel_accuracy_table(scored(spark, d), view(spark, d, "fx_variant"), g, 20)


@query("j1_reads_over_copies", with_("fx_align", "fx_variant", "fx_genotype", extra=(S1, FEATS, *COPIES)) + "select read_serial, v_id, cpy, x, xf from hitsc")
def _(spark, d):
    f = R.features_of_copies(view(spark, d, "fx_variant"), view(spark, d, "fx_genotype").where("sample = 1"))
    return R.reads_over_features(scored(spark, d), f, ("chrom", "cpy")).select("read_serial", "v_id", "cpy", "x", "xf")


@query("a12_run_matrix_of_chrom", with_("fx_align", extra=(*BOTH, "runs as (select 'a' run, read_serial from b1 where chrom=2 union all select 'b', read_serial from b2 where chrom=2)")) + "select x.run r, y.run c, 'intersect' kind, count(*) n from runs x join runs y on x.read_serial=y.read_serial and x.run<=y.run group by 1,2 union all select x.run, y.run, 'diff', count(*) from runs x cross join (select distinct run from runs) y where not exists (select 1 from runs z where z.run=y.run and z.read_serial=x.read_serial) group by 1,2")
def _(spark, d):
    return R.run_matrix(R.attach_runs({k: R.bad_reads(scored(spark, d, i)).select(*R.READ, "chrom", "cigar") for i, k in ((1, "a"), (2, "b"))}), chrom=2)


@query("a8_default_bins", with_("fx_align", extra=(S1,)) + "select chrom c_chrom, pos//50000 c_bin, count(*) n from scored_x where is_unmapped=1 group by all")
def _(spark, d):
    return R.unmapped_by_bin(R.bad_reads(scored(spark, d)), R.matrix_width(view(spark, d, "fx_contig")))


BASES = "translate(substr(repeat(md5(concat(qname, is_read1::varchar)), 4), 1, 100), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query("c2_truth_fastq", with_("fx_align", extra=(
    f"a as (select cast(split_part(qname,'|',1) as bigint) rs, is_read1, ref_id, apos, acigar, split_part(qname,'|',case when is_read1=1 then 4 else 8 end) ro, {BASES} seq from fx_align where is_unmapped=0 and mapq>=20)",
    "t as (select x.rs, x.ref_id c, x.apos p, x.seq s0, y.seq s1, concat_ws('|', x.ro, x.apos::varchar, '100', x.acigar) h0, concat_ws('|', y.ro, y.apos::varchar, '100', y.acigar) h1 from a x join a y on x.rs=y.rs and x.is_read1=1 and y.is_read1=0)",
    "n as (select *, concat_ws('|', (row_number() over (order by c, p, rs)-1)::varchar, (c+1)::varchar, '0', h0, h1) qname from t)",
)) + "select qname, 1 mate, s0 seq from n union all select qname, 2, s1 from n")
def _(spark, d):
    bases = F.translate(F.substring(F.repeat(F.md5(F.concat("qname", F.col("is_read1").cast("string")).cast("binary")), 4), 1, 100), "0123456789abcdef", "ACGTACGTACGTACGT")
    return R.truth_fastq(R.filter_mapped(R.score_alignments(view(spark, d, "fx_align").withColumn("seq", bases)), 20))


PLAIN = {"c5_diploid_samples": c5}
