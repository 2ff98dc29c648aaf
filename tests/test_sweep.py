"""Sums over intervals that meet, without pairs, against a plain look at all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandmark.operators import reads as R


@pytest.mark.parametrize("span", [4, 12])
def test_met_sums_are_those_of_all_pairs(spark, monkeypatch, span):
    monkeypatch.setattr(R, "SPAN", span)
    rng = random.Random(span)
    spot = lambda: rng.choice((rng.randint(-60, 60), rng.randint(-9000, 9000)))
    one = lambda k: (k, rng.choice((1, 2, None)), (p := spot()), rng.choice((p + rng.randint(0, 40), p + 5000, p - 3, None)))
    rows, others = [one(k % 90) for k in range(120)], [(*one(k), rng.randint(1, 5)) for k in range(150)]
    rows += rows[:7]  # rows that are alike
    feats, reads = spark.createDataFrame(rows, "v_id long, chrom long, a long, b long"), spark.createDataFrame(others, "id long, chrom long, s long, e long, w long")

    def sums(c, a, b):
        met = [w for _, d, s, e, w in others if None not in (c, a, b, d, s, e) and c == d and a <= b and s <= e and s <= b and e >= a]
        return sum(met), len(met)

    got = R.met_sums(feats, reads.withColumn("n", F.lit(1)), ("w", "n"), {"": ("a", "b"), "next_": ("a + 100", "b + 100")}, ("s", "e"))
    up = lambda x: None if x is None else x + 100
    want = [(k, c, a, b, *sums(c, a, b), *sums(c, up(a), up(b))) for k, c, a, b in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_no_pairs_are_made(spark, sf_dir):
    from strandmark.plans import queries

    for name in ("a4_accuracy_by_indel_length", "a26_run_report", "j12_pairwise_runs", "a6_accuracy_by_indel_and_neighbour", "g7_median_smooth", "a7_accuracy_summary", "a2_accuracy_per_feature", "a5_indel_count_covered"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "read_stop" not in "".join(line for line in plan.splitlines() if "Join" in line), name


def test_outside_goes_by_places_not_by_serials(spark, sf_dir, tmp_path):
    """Reads of one serial number at several places count each for itself, in the query as in its SQL."""
    import duckdb

    from strandmark import plans

    for t in ("lineitem", "part"):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "lineitem":
            rows = rows.crossJoin(spark.range(6).withColumnRenamed("id", "i")).withColumn("l_partkey", F.expr("l_partkey + i * 200")).drop("i")
        rows.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(plans.oracle_sql()["j3_a3_accuracy_outside"]).fetchall()
    assert [tuple(r) for r in plans.queries()["j3_a3_accuracy_outside"](spark, str(tmp_path)).collect()] == want


@pytest.mark.parametrize("parts, outside", [(120000, False), (40, True)])
def test_outside_of_features_that_leave_no_read(spark, sf_dir, tmp_path, parts, outside):
    """Where features lie so close that no read is outside, the sum over none is null, as the SQL has it."""
    import duckdb

    from strandmark import plans

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey < 40").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(0, parts, 1, 1).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(plans.oracle_sql()["j3_a3_accuracy_outside"]).fetchall()
    assert [tuple(r) for r in plans.queries()["j3_a3_accuracy_outside"](spark, str(tmp_path)).collect()] == want
    assert (want[0][1] > 0) is outside and (want[0][0] is None) is not outside


def test_mean_scores_do_not_shuffle_kmers(spark, sf_dir):
    """Only the table of k-mers and sums of a sequence are shuffled; the k-mer at the end is left out before there are rows."""
    from strandmark.operators import sequence as Q

    seqs = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACGT"), (3, "ACG"), (4, "")], "seq_no long, seq string")
    for rows in (seqs, Q.chunked(seqs, 3)):
        table = Q.kmer_count(rows, 4)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            got = Q.kmer_mean_score(rows, table, 4, include_last=False)
            plan = got._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "hashpartitioning(kmer" not in "".join(line for line in plan.splitlines() if "kmer" in line and "seq_no" in line) and "BroadcastHashJoin [kmer" in plan
        found = {r["seq_no"]: r["score"] for r in got.collect()}
        # ACGT is there three times, CGTA, GTAC, TACG and so on: of the first sequence all but its last k-mer count
        text = "ACGTACGTAC"
        n = lambda w: sum(s[i : i + 4] == w for s in (text, "ACGT") for i in range(len(s) - 3))
        assert found[1] == sum(n(text[i : i + 4]) for i in range(6)) / 6 and found[2] is None and found[3] is None


def test_templates_look_at_alignments_once(spark, sf_dir):
    """One shuffle of the alignments, before their bases are used, and the rows that are numbered come from a table."""
    from strandmark.operators import templates as T
    from strandmark.plans.registry import view

    sam = view(spark, sf_dir, "fx_sam")
    plan = T.templates(sam, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "md5" not in plan and plan.count("strandmark-tables") + plan.count("Relation") >= 2


def test_templates_keep_rows_without_bases_and_alike_rows_apart(spark):
    from strandmark.operators import templates as T

    row = lambda name, flag, at, mate, seq, chrom=0, cigar="4M": (name, flag, chrom, chrom, at, mate, 60, cigar, seq)
    rows = [row("u", 0, 5, -1, "ACGT")] * 3 + [row("u", 16, 5, -1, "ACGT"), row("u", 0, 5, -1, "*"), row("u", 0, 5, -1, ""), row("u", 0, 5, -1, None)]
    # bases of one read 1 are missing: the other one has the mate
    rows += [row("p", 1 + 64, 9, 20, "*"), row("p", 1 + 64, 9, 20, "TTTT"), row("p", 1 + 128 + 16, 20, 9, "AACC"), row("p", 1 + 64, 9, 30, "GGGG")]
    sam = spark.createDataFrame(rows, "qname string, flag long, ref_id long, next_ref_id long, apos long, pnext long, mapq long, acigar string, seq string")
    got = [(r["serial"], r["r0"]["seq"], r["r0"]["ro"], r["r1"] and r["r1"]["seq"]) for r in T.templates(sam).orderBy("serial").collect()]
    assert got == [(0, "ACGT", 0, None), (1, "ACGT", 0, None), (2, "ACGT", 0, None), (3, "ACGT", 1, None), (4, "TTTT", 0, "GGTT")]
