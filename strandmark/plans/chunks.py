"""Queries over ordinary alignments, tables of chunks, defaults and single functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import reads as R
from ..operators import sequence as Q
from ..operators import templates as T
from ..operators import variants as V
from .more import GC, HITS2, RUNS, rounded
from .registry import ACC, BOTH, FEATS, HITS, PCT, S1, query, scored, view, with_

#: Width of the chunks; windows and k-mers lie across their borders.
CHUNK = 333


def chunks(spark, d):
    return Q.chunked(view(spark, d, "fx_seq"), CHUNK)


KEPT = "k as (select *, flag & 1 = 1 paired, flag & 64 <> 0 fst, (flag & 16) // 16 ro, case when flag & 16 <> 0 then reverse(translate(seq, 'ATCGN', 'TAGCN')) else seq end own from fx_sam where flag & (4 + 256 + 2048) = 0 and mapq >= 20)"
MATES = (
    KEPT,
    "o as (select *, row_number() over (partition by qname, ref_id, apos, pnext, fst order by own, acigar, ro) n from k where paired and flag & 8 = 0 and ref_id = next_ref_id)",
    "t as (select a.ref_id c, a.apos p, a.qname nm, a.ro ro0, b.ro ro1, b.apos p1, a.acigar c0, b.acigar c1, a.own s0, b.own s1 from o a join o b on a.fst and not b.fst and a.qname = b.qname and a.ref_id = b.ref_id and a.apos = b.pnext and a.pnext = b.apos and a.n = b.n union all select ref_id, apos, qname, ro, null, null, acigar, null, own, null from k where not paired)",
    "m as (select *, row_number() over (order by c, p, nm, p1 nulls first, ro0, c0, s0, ro1, c1, s1) - 1 serial from t)",
    "q as (select *, concat_ws('|', serial::varchar, (c + 1)::varchar, '0', ro0::varchar, p::varchar, '100', c0) || case when s1 is null then '' else '|' || concat_ws('|', ro1::varchar, p1::varchar, '100', c1) end qname from m)",
)


@query("c2_truth_fastq_of_names", with_("fx_sam", extra=MATES) + "select qname, 1 mate, s0 seq from q union all select qname, 2, s1 from q where s1 is not null")
def _(spark, d):
    return T.templates_fastq(view(spark, d, "fx_sam"), 20)


@query("j9_templates_of_names", with_("fx_sam", extra=MATES) + "select serial, c0 cigar_0, c1 cigar_1, p pos_0, p1 pos_1 from q")
def _(spark, d):
    t = T.templates(view(spark, d, "fx_sam"), 20)
    return t.select("serial", F.col("r0.cigar").alias("cigar_0"), F.col("r1.cigar").alias("cigar_1"), F.col("r0.pos").alias("pos_0"), F.col("r1.pos").alias("pos_1"))


KMERS = "select substr(seq, i::int, 6) kmer, count(*) n from fx_seq, lateral (select unnest(range(1, length(seq)-4)) i) where length(seq)>=6 group by 1"


@query("a17_kmer_count_of_chunks", with_("fx_seq") + KMERS)
def _(spark, d):
    return Q.kmer_count(chunks(spark, d), 6)


@query("a17_kmer_count_but_last", with_("fx_seq") + KMERS.replace("length(seq)-4", "length(seq)-5"))
def _(spark, d):
    return Q.kmer_count(view(spark, d, "fx_seq"), 6, include_last=False)


@query("a18_kmer_score_of_chunks", with_("fx_seq", extra=(f"k as ({KMERS})", "s as (select seq_no, i*50 as at, substr(seq, (i*50+1)::int, 6) kmer from fx_seq, lateral (select unnest(range(0, length(seq)//50)) i))")) + "select seq_no, s.at::bigint as at, coalesce(n,1)::bigint score from s left join k on s.kmer=k.kmer")
def _(spark, d):
    c = chunks(spark, d)
    return Q.kmer_score(c, Q.kmer_count(c, 6), 6, 50)


@query("a19_kmer_mean_score", with_("fx_seq", extra=(f"k as materialized ({KMERS})", "s as (select seq_no, substr(seq, i::int, 6) kmer from fx_seq, lateral (select unnest(range(1, length(seq)-5)) i) where length(seq)>=7)", "m as (select seq_no, avg(coalesce(n,1)) v from s left join k on s.kmer=k.kmer group by seq_no)")) + "select f.seq_no, round(v, 6) score from fx_seq f left join m on f.seq_no=m.seq_no")
def _(spark, d):
    s = view(spark, d, "fx_seq")
    return rounded(Q.kmer_mean_score(s, Q.kmer_count(s, 6), 6, include_last=False), "score")


@query("a20_gc_windows_of_chunks", with_("fx_seq", extra=(GC,)) + "select seq_no, bin::bigint bin, (length(w)-length(translate(w,'GC','')))/100.0::double gc from g")
def _(spark, d):
    return Q.gc_windows(chunks(spark, d), 100)


@query("a13_contig_stats_of_chunks", with_("fx_seq") + "select seq_no, length(seq) seq_len, md5(seq) seq_md5 from fx_seq where length(seq) > 0")
def _(spark, d):
    return Q.contig_stats(chunks(spark, d))


@query("a1_alignment_summary", with_("fx_align", extra=(S1,)) + "select (select count(*) from fx_align) total, count(*) filter (is_misaligned or is_unmapped=1) bad, round(count(*) filter (is_misaligned or is_unmapped=1)*100.0::double/(select count(*) from fx_align), 6) pct from scored_x")
def _(spark, d):
    align = view(spark, d, "fx_align")
    return rounded(R.alignment_summary(align, R.score_alignments(align)).withColumn("pct", F.col("pct").cast("double")), "pct")


OUTSIDE = "outs as (select '{0}' run, count(*) filter (xf=1) c, count(*) n from {1} s where not exists (select 1 from feats f where f.chrom=s.chrom and s.pos<=f.f_stop and s.read_stop>=f.f_start) and not exists (select 1 from feats f where f.chrom=s.chrom and s.pos_m<=f.f_stop and s.mate_stop>=f.f_start))"
BANDS = f"round(avg(case when x=0 then {PCT} end),6) snp, round(avg(case when x<=-20 then {PCT} end),6) del_long, round(avg(case when x>-20 and x<0 then {PCT} end),6) del_short, round(avg(case when x>0 and x<20 then {PCT} end),6) ins_short, round(avg(case when x>=20 then {PCT} end),6) ins_long"


@query("a7_summary_with_ref", with_("fx_align", "fx_variant", extra=(S1, FEATS, HITS, ACC, OUTSIDE.format("a", "scored_x"))) + f"select (select round(c*100.0::double/n, 6) from outs) as ref, {BANDS} from acc")
def _(spark, d):
    found = R.indel_accuracy(scored(spark, d), view(spark, d, "fx_variant"), most=20)
    s = R.accuracy_summary(found["reads"], found["outside"])
    return rounded(s, *s.columns)


@query("a26_run_report_with_ref", with_("fx_align", "fx_variant", extra=(*BOTH, FEATS, HITS, HITS2, *RUNS, OUTSIDE.format("a", "scored_x"), OUTSIDE.format("b", "scored2_x").replace("outs as", "outs2 as"))) + f"select run, case run when 'a' then 'bwa' else 'other' end tool, (select round(c*100.0::double/n, 6) from (select * from outs union all select * from outs2) o where o.run=racc.run) as ref, {BANDS} from racc where abs(x)<=20 group by run")
def _(spark, d):
    parts = {k: R.indel_accuracy(scored(spark, d, i), view(spark, d, "fx_variant"), most=20) for i, k in ((1, "a"), (2, "b"))}
    runs = spark.createDataFrame([("a", "bwa"), ("b", "other")], "run string, tool string")
    report = R.run_report(runs, R.attach_runs({k: p["reads"] for k, p in parts.items()}), R.attach_runs({k: p["outside"] for k, p in parts.items()}))
    return rounded(report, "ref", "snp", "del_long", "del_short", "ins_short", "ins_long")


@query("j7_run_diff_of_chrom", with_("fx_align", extra=BOTH) + "select read_serial from b1 where chrom=2 and read_serial not in (select read_serial from b2)")
def _(spark, d):
    return R.run_diff(R.bad_reads(scored(spark, d)), R.bad_reads(scored(spark, d, 2)), chrom=2).select("read_serial")


@query("j8_run_intersect_of_variants", with_("fx_single", extra=(
    "s as (select split_part(qname,'|',1)::bigint read_serial, split_part(qname,'|',2)::bigint chrom, split_part(qname,'|',7) cigar, apos <> split_part(qname,'|',5)::bigint bad from fx_single where is_secondary=0 and split_part(qname,'|',5)<>'none')",
)) + "select read_serial from s where bad and chrom=3 and regexp_matches(cigar, '[ISDX]') and read_serial % 2 = 0")
def _(spark, d):
    bad = R.bad_reads(R.score_alignments(view(spark, d, "fx_single")))
    return R.run_intersect(bad, bad.where("read_serial % 2 = 0"), chrom=3, variants_only=True).select("read_serial")


@query("a11_aligned_density", with_("fx_align", extra=(S1,)) + "select a_chrom+1 chrom, a_pos//10000 bin, round(count(*)/(sum(count(*)) over (partition by a_chrom)*10000.0::double), 12) density from scored_x where a_chrom>=0 group by a_chrom, a_pos//10000")
def _(spark, d):
    return R.read_density(scored(spark, d), view(spark, d, "fx_contig").drop("seq_id"), source=False).withColumn("density", F.round("density", 12))


@query("a14_default_samples", with_("fx_variant", "fx_genotype") + "select chrom, count(*) population, " + ", ".join(f"count(*) filter (v_id in (select v_id from fx_genotype where sample={k})) s{k}" for k in range(10)) + " from fx_variant group by rollup(chrom)")
def _(spark, d):
    return V.variant_counts(view(spark, d, "fx_variant"), view(spark, d, "fx_genotype"))


@query("a15_default_levels", with_("fx_variant", extra=("m as (select max(p) m from fx_variant)", "e as (select i, i*m/10 as level, case when i=0 then 0 when i=10 then 9*m/10 + (9*m/10-8*m/10)/2 else (i-1)*m/10 + (i*m/10-(i-1)*m/10)/2 end lo, i*m/10 + (case when i=10 then i*m/10-(i-1)*m/10 else (i+1)*m/10-i*m/10 end)/2 hi from m, (select unnest(range(0, 11)) i))")) + "select round(level, 9)::double as level, (select count(*) from fx_variant where p>=lo and (p<hi or i=10)) actual, null::double ideal from e")
def _(spark, d):
    return rounded(V.spectrum_histogram(view(spark, d, "fx_variant")), "level", n=9)


@query("a16_indel_histogram_of_sample", with_("fx_variant", "fx_genotype") + "select r.x, coalesce(n,0)::bigint n from (select unnest(range(-50,51)) x) r left join (select length(alt)-length(ref) x, count(*) n from fx_variant where v_id in (select v_id from fx_genotype where sample=3) group by 1) h on r.x=h.x")
def _(spark, d):
    return V.indel_histogram(view(spark, d, "fx_variant"), 50, view(spark, d, "fx_genotype"), 3)


LEVELS = "lv as (select i, (i + 1) / 2000.0::double as level, 0.0009::double f from (select unnest(range(0, 1000)) i))"


@query("g3_rebalance_by_levels", with_("fx_variant", extra=(LEVELS, "r as (select *, row_number() over (partition by chrom order by p, v_id) - 1 rk, count(*) over (partition by chrom) n from fx_variant)", "b as (select chrom, i, level, sum(floor(f*n+0.5)) over (partition by chrom order by i) e, floor(f*n+0.5) z from lv cross join (select chrom, count(*) n from fx_variant group by chrom))")) + "select r.v_id, coalesce(b.level, r.p)::double p_new from r left join b on r.chrom=b.chrom and r.rk >= e - z and r.rk < e")
def _(spark, d):
    levels = spark.range(1000).select(((F.col("id") + 1) / 2000.0).alias("p"), F.lit(0.0009).alias("f"))
    return V.rebalance_spectrum(view(spark, d, "fx_variant"), levels).select("v_id", "p_new")


@query("f9_has_variant_cigar", with_("fx_single") + "select split_part(qname,'|',7) cigar, regexp_matches(split_part(qname,'|',7), '[ISDX]') has_variant, count(*) n from fx_single group by all")
def _(spark, d):
    cigar = F.split_part("qname", F.lit("|"), F.lit(7))
    return view(spark, d, "fx_single").groupBy(cigar.alias("cigar"), X.has_variant_cigar(cigar).alias("has_variant")).agg(F.count("*").alias("n"))


FIELD = "case when l_linenumber = 1 then '.' when l_linenumber = 2 then cast(l_partkey % 3 as string) when l_linenumber = 3 then './1' when l_linenumber = 4 then concat(cast(l_partkey % 3 as string), '/', cast(l_suppkey % 3 as string)) when l_linenumber = 5 then null else concat(cast(l_partkey % 3 as string), '|', cast(l_suppkey % 3 as string), ':35') end"
PHASES = "h as (select field, case when field is null then 1 when contains(g, '.') then 0 else regexp_extract(g, '^(\\d+)', 1)::int end h0, case when field is null then 1 when contains(g, '.') then 0 else regexp_extract(g, '(\\d+)$', 1)::int end h1 from (select field, split_part(field, ':', 1) g from f))"


@query("f10_f11_genotype_fields", f"with f as (select {FIELD} field from lineitem), {PHASES} select field, h0, h1, case when h0=1 and h1=1 then 2 when h1=1 then 1 when h0=1 then 0 end gt_1, case when h0=2 and h1=2 then 2 when h1=2 then 1 when h0=2 then 0 end gt_2, count(*) n from h group by all")
def _(spark, d):
    g = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr(FIELD).alias("field")).withColumn("g", X.parse_gt(F.col("field"))).select("field", "g.*")
    allele = lambda n: X.allele_gt(F.col("h0"), F.col("h1"), F.lit(n))
    return g.groupBy("field", "h0", "h1", allele(1).alias("gt_1"), allele(2).alias("gt_2")).agg(F.count("*").alias("n"))


ALLELE = "case when p_size % 7 = 0 then '<DEL>' when p_size % 7 = 1 then 'A[2:10[' when p_size % 7 = 2 then 'chr1:5' else concat('AC', cast(p_size % 3 as string)) end"


@query("f12_is_imprecise", f"select p_partkey v_id, regexp_matches({ALLELE}, '[<>:\\[\\]]') imprecise from part")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").alias("v_id"), X.is_imprecise(F.expr(ALLELE)).alias("imprecise"))


@query("f14_normalize_bases", "select doc_id, md5(translate(text, 'actgURYSWKMBDHVn', 'ACTGTNNNNNNNNNNN')) folded from documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(X.normalize_bases(F.col("text")).cast("binary")).alias("folded"))


@query("f16_gt_string", with_("fx_genotype") + "select sample, v_id, (['1|0', '0|1', '1|1'])[(gt+1)::int] gt from fx_genotype")
def _(spark, d):
    return view(spark, d, "fx_genotype").select("sample", "v_id", X.gt_string(F.col("gt")).alias("gt"))
