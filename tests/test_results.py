"""Files of results, reports on lists of runs, and reads of a stream over features."""

import json

from pyspark.sql import functions as F

from strandmark import sources
from strandmark.operators import reads as R
from strandmark.plans.registry import both_runs, feats, queries, scored, second_run, view


def test_accuracy_files(spark, sf_dir, tmp_path):
    table = R.indel_accuracy_table(scored(spark, sf_dir), view(spark, sf_dir, "fx_variant"), most=20).cache()
    sources.write_accuracy(table, str(tmp_path / "a"))
    back = sources.read_accuracy(spark, [str(tmp_path / "a")])
    assert sorted(map(str, map(tuple, back.select("part", "x", "correct", "total").collect()))) == sorted(map(str, map(tuple, table.select("part", "x", "correct", "total").collect())))
    text = json.loads("".join(f.read_text() for f in (tmp_path / "a").glob("part-*")))
    assert [r[0] for r in text["reads_within_feature"]] == list(range(-20, 21)) and len(text["fully_outside_features"]) == 2


def test_report_of_runs(spark, tmp_path):
    rows = {"a.json": ([30, 40], [[-25, 1, 2], [-3, 1, 4], [0, 9, 10], [5, 0, 0], [30, 2, 2]]), "b.json": ([0, 0], [[0, 1, 2]])}
    for name, (outside, reads) in rows.items():
        (tmp_path / name).write_text(json.dumps({"fully_outside_features": outside, "reads_within_feature": reads, "templates_within_feature_but_read_outside": [], "indel_count": [[0, 3]]}, indent=1))
    (tmp_path / "a.time").write_text("noise\nreal         12.50\nuser         3.00\nsys          1.00\n")
    (tmp_path / "b.time").write_text("real 7\nuser 1\nsys 1\n")
    (tmp_path / "runs.csv").write_text("indel_anal, time, mis_plot, indel_plot, tool, graph, sample, read_set\na.json, a.time, m.png, i.png, bwa, linear, s1, r1\nb.json, b.time, m.png, i.png, other, graph, s1, r1\n")
    got = {r["tool"]: r for r in sources.report_of_runs(spark, str(tmp_path / "runs.csv")).collect()}
    a, b = got["bwa"], got["other"]
    assert (a["ref"], a["snp"], a["del_long"], a["del_short"], a["ins_short"], a["ins_long"], a["seconds"], a["graph"]) == (75.0, 90.0, 50.0, 25.0, None, 100.0, 12.5, "linear")
    assert (b["ref"], b["snp"], b["del_long"], b["seconds"]) == (None, 50.0, None, 7.0)
    (tmp_path / "bad.csv").write_text("tool\nx\n")
    try:
        sources.read_run_list(spark, str(tmp_path / "bad.csv"))
    except ValueError:
        pass
    else:
        raise AssertionError("a list with other columns was taken")


def test_a_stream_of_reads_meets_features(spark, sf_dir, tmp_path):
    """No job runs while overlap_join() is planned, so reads may be a stream."""
    scored(spark, sf_dir).limit(4000).repartition(4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.overlap_join(stream, feats(spark, sf_dir)).select("read_serial", "v_id").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    want = R.overlap_join(batch, feats(spark, sf_dir)).select("read_serial", "v_id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect())) != []


def test_heavy_bins_leave_no_large_group(spark):
    """Half of all reads on one place: dealt over salts, no group that is joined has more rows than it should."""
    reads = spark.range(8000).select(F.lit(1).alias("chrom"), F.when(F.col("id") % 2 == 0, 150).otherwise(F.col("id") * 50).alias("pos")).withColumn("read_stop", F.col("pos") + 20)
    dealt, _, key = R.dealt(reads.withColumn("bin", F.expr("pos div 400")), feats_of(spark), ("chrom", "bin"), 100)
    sizes = [r["count"] for r in dealt.groupBy(*key).count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 8000 and sum(n > 50 for n in sizes) >= 30


def feats_of(spark):
    return spark.createDataFrame([(1, 0, 5)], "chrom int, bin long, v_id long")


def test_reads_are_decoded_once_for_overlaps(spark, sf_dir):
    """No filter that the join infers goes down to the names of reads, where it would decode them once more."""
    plan = R.overlap_join(scored(spark, sf_dir), feats(spark, sf_dir)).select("read_serial", "v_id")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(try_cast" not in plan and "isnotnull((try_cast" not in plan


def test_bins_of_many_features(spark):
    """More features in a bin than an array takes, long ones, unknown chromosomes and empty ends: the pairs of a plain join."""
    reads = spark.range(300).selectExpr("if(id % 50 = 0, null, id % 3) chrom", "if(id % 60 = 1, null, id * 7 % 1000) pos", "id * 7 % 1000 + 90 read_stop", "id read_serial")
    many = spark.range(5000).selectExpr("if(id % 70 = 0, null, cast(id % 3 as int)) chrom", "if(id < 4000, 100 + id % 40, id * 37 % 1000) f_start", "if(id % 90 = 2, null, if(id % 500 = 0, 2000000, if(id < 4000, 100 + id % 40, id * 37 % 1000) + id % 20)) f_stop", "id v_id")
    want = reads.join(many, (reads.chrom == many.chrom) & (reads.pos <= many.f_stop) & (reads.read_stop >= many.f_start)).select("read_serial", "v_id")
    got = R.overlap_join(reads, many)
    assert got.columns == ["chrom", "pos", "read_stop", "read_serial", "f_start", "f_stop", "v_id"]
    assert sorted(map(tuple, got.select("read_serial", "v_id").collect())) == sorted(map(tuple, want.collect())) != []
    sizes = [r["n"] for r in R.packed(many.where("chrom = 1").withColumn("bin", F.lit(0)), ["chrom", "bin"]).selectExpr("size(_feats) n").collect()]
    assert sum(sizes) == many.where("chrom = 1").count() and max(sizes) == R.PACK and len(sizes) == 2


def test_two_runs_are_one_pass(spark, sf_dir):
    """Both runs come of one pass over the alignments, with names decoded once, and are what two passes give."""
    align = view(spark, sf_dir, "fx_align")
    runs = both_runs(align)
    for k, a in ((1, align), (2, second_run(align))):
        want = R.bad_reads(R.score_alignments(a))
        assert sorted(map(str, map(tuple, runs.where(F.col("run") == k).select(want.columns).collect()))) == sorted(map(str, map(tuple, want.collect())))
    kinds = R.compare_runs(*(runs.where(F.col("run") == k) for k in (1, 2)))
    got = R.compare_attached(runs.withColumn("run", F.when(F.col("run") == 1, "x").otherwise("y")).unionByName(runs.withColumn("run", F.lit("z"))), "x", "y")
    assert got.columns == kinds.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, kinds.collect())))
    plan = queries()["j4_compare_runs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "split(concat_ws" not in plan


def test_many_reads_over_features(spark):
    """Nulls, long features, intervals that end before they start, arrays that are far away, either join: the pairs of a plain join, in order, and rows of wide bins only where long features are."""
    reads = spark.range(3000).selectExpr("if(id % 50 = 0, null, id % 3) chrom", "if(id % 60 = 1, null, hash(id) & 65535) pos", "(hash(id) & 65535) + if(id % 40 = 3, 3000, if(id % 70 = 5, -30, 90)) read_stop", "id read_serial").repartition(3)
    f = spark.range(4000).selectExpr("if(id % 70 = 0, null, id % 3) chrom", "if(id % 90 = 2, null, hash(-id) & 65535) f_start", "(hash(-id) & 65535) + if(id % 500 = 4, 700000, if(id % 80 = 6, -20, id % 21)) f_stop", "id v_id", "id % 7 x")
    want = reads.join(f, (reads.chrom == f.chrom) & (reads.pos <= f.f_stop) & (reads.read_stop >= f.f_start)).select("read_serial", "v_id", "read_stop")
    want = sorted(map(tuple, want.collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (before, "-1"):
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            got = R.reads_over_features(reads, f)
            assert got.columns == ["chrom", "pos", "read_stop", "read_serial", "f_start", "f_stop", "v_id", "x"] and got.schema["read_stop"].dataType == reads.schema["read_stop"].dataType
            rows = got.select("read_serial", "v_id", "read_stop", "chrom", "pos", F.spark_partition_id().alias("part")).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sorted((r["read_serial"], r["v_id"], r["read_stop"]) for r in rows) == want != []
        if most == before:  # neighbours lie together
            assert all((a["chrom"], a["pos"]) <= (b["chrom"], b["pos"]) for a, b in zip(rows, rows[1:], strict=False) if a["part"] == b["part"])


def test_reads_have_wide_bins_only_where_long_features_are(spark):
    reads = spark.range(100).selectExpr("id % 2 chrom", "id * 20000 pos", "id * 20000 + 100 read_stop", "id")
    binned = reads.withColumn("bin", F.explode(F.expr("array(pos div 400, -1 - pos div 102400)")))
    narrow = "bin between pos div 400 and read_stop div 400"
    longs = spark.createDataFrame([(1, -3), (1, -3), (0, -20), (None, -1)], "chrom long, bin long")
    got = R.where_long(binned, longs, narrow)
    wide = sorted((r["chrom"], r["bin"]) for r in got.where("bin < 0").collect())
    assert got.columns == binned.columns and got.where("bin >= 0").count() == 100
    assert set(wide) == {(1, -3), (0, -20)} and len(wide) == binned.join(longs.distinct(), ["chrom", "bin"]).count()


def test_reads_over_features_shuffle_little(spark, sf_dir):
    """No column that the view derives is shuffled for its window; rows of reads in wide bins meet what long features there are before the one join that shuffles them."""
    truth = view(spark, sf_dir, "fx_truth")._jdf.queryExecution().executedPlan().toString()
    assert truth.count("Exchange") == 1
    below = truth[truth.index("Exchange") :]
    assert "AS pos" not in below and "AS chrom" not in below
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = queries()["j1_reads_over_features"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "isnotnull(try_cast" not in plan and "isnotnull((try_cast" not in plan
    assert plan.count("SortMergeJoin") == 1 and plan.index("SortMergeJoin") < plan.index("_long")
