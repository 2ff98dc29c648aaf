"""Brute-force checks and goldens of what SQL doesn't express, and of the FASTA folders."""

from collections import defaultdict

from pyspark.sql import functions as F

from strandmark import sources
from strandmark.operators import reads as R
from strandmark.operators import sequence as Q
from strandmark.operators import variants as V


def haplotype(seq, variants):
    """(text, for each base of it: its place and whether it is '=', X or I) by walking over the reference."""
    text, where, at = "", [], 0
    for pos, ref, alt in sorted(variants):
        where += [(k, "=") for k in range(at, pos)]
        text += seq[at:pos] + alt
        kept = min(len(ref), len(alt))
        where += [(pos + k, "X" if len(ref) == len(alt) and k == 0 else "=") for k in range(kept)]
        where += [(pos + len(ref), "I")] * (len(alt) - kept)
        at = pos + len(ref)
    return text + seq[at:], where + [(k, "=") for k in range(at, len(seq))]


def lifted(where, start, n):
    """POS and CIGAR of the bases start..start+n of a haplotype, base by base."""
    own = where[start : start + n]
    ops = []
    for k, (place, op) in enumerate(own):
        before = [p for p, o in own[:k] if o != "I"]
        if op != "I" and k and place > max([p for p, _ in own[:k]]) and own[k - 1][1] != "I" and before and place > before[-1] + 1:
            ops.append((place - before[-1] - 1, "D"))
        if ops and ops[-1][1] == op and op in "=I":
            ops[-1] = (ops[-1][0] + 1, op)
        else:
            ops.append((1, op))
    for end in (0, -1):
        if ops[end][1] == "I":
            ops[end] = (ops[end][0], "S")
    return own[0][0], "".join(f"{k}{op}" for k, op in ops)


def random_haplotypes():
    import random

    rng = random.Random(11)
    for i in range(6):
        seq = "".join(rng.choice("ACGT") for _ in range(400))
        at, vs = 3 * (i % 2), []
        while at < 380:
            kind = rng.choice("SID")
            ref = seq[at : at + (rng.randint(2, 6) if kind == "D" else 1)]
            alt = ref[0] + "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) if kind == "I" else ref[0] if kind == "D" else "ACGT"[("ACGT".index(ref) + 1) % 4]
            vs.append((at, ref, alt))
            at += len(ref) + rng.randint(1, 25)
        yield i, seq, vs


def test_consensus_and_lifting(spark):
    cases = [*random_haplotypes(), (6, "ACGT", []), (7, "", [])]
    seqs = spark.createDataFrame([(i, s) for i, s, _ in cases], "seq_no long, seq string")
    v = spark.createDataFrame([(i, p, p + len(r), r, a) for i, _, vs in cases for p, r, a in vs], "seq_no long, pos long, stop long, ref string, alt string")
    want = {i: haplotype(s, vs) for i, s, vs in cases}
    pieces = Q.consensus_pieces(seqs, v, 64)
    assert {r["seq_no"]: r["seq"] for r in Q.consensus(pieces).collect()} == {i: t for i, (t, _) in want.items()}
    for r in pieces.collect():
        assert want[r["seq_no"]][0][r["alt_start"] :].startswith(r["piece"])
    reads = [(i, k, k, 12) for i, (t, _) in want.items() for k in range(0, len(t) - 11)]
    q = spark.createDataFrame(reads, "seq_no long, id long, start long, rlen long")
    contig = seqs.select("seq_no", F.length("seq").cast("bigint").alias("seq_len"))
    got = {(r["seq_no"], r["id"]): (r["pos"], r["cigar"]) for r in Q.lift_to_reference(q, Q.typed_pieces(contig, v)).collect()}
    assert got == {(i, k): lifted(want[i][1], k, 12) for i, k, _, _ in reads}


def test_kmer_mean_score(spark):
    seqs = spark.createDataFrame([(1, "AAAC"), (2, "GG")], "seq_no long, seq string")
    table = spark.createDataFrame([("AA", 5)], "kmer string, n long")
    assert {r["seq_no"]: r["score"] for r in Q.kmer_mean_score(seqs, table, 2).collect()} == {1: 11 / 3, 2: 1.0}


def test_alignment_summary(spark):
    alignments = spark.range(8)
    scored = spark.createDataFrame([(True, 0), (False, 1), (False, 0)], "is_misaligned boolean, is_unmapped int")
    assert tuple(R.alignment_summary(alignments, scored).first()) == (8, 2, 25.0)


def test_long_features(spark):
    reads = spark.range(400).select(F.lit(1).alias("chrom"), (F.col("id") * 1013 % 300000).alias("pos"), (F.col("id") * 1013 % 300000 + 100).alias("read_stop"), F.col("id").alias("read_serial"))
    feats = spark.range(60).select(F.lit(1).alias("chrom"), (F.col("id") * 7001 % 290000).alias("f_start"), (F.col("id") * 7001 % 290000 + F.pow(F.lit(3), F.col("id") % 11).cast("bigint")).alias("f_stop"), F.col("id").alias("v_id"))
    want = reads.join(feats, (reads.pos <= feats.f_stop) & (reads.read_stop >= feats.f_start))
    got = R.overlap_join(reads, feats)
    assert sorted((r["read_serial"], r["v_id"]) for r in got.collect()) == sorted((r["read_serial"], r["v_id"]) for r in want.collect())


def test_sweeps_over_stretches(spark):
    import random

    rng = random.Random(9)
    rows = [(c, p, p + n, i) for i, (c, p, n) in enumerate((rng.randint(0, 1), rng.randint(0, 3000), rng.choice((1, 3, 40, 700))) for _ in range(500))]
    df = spark.createDataFrame(rows, "chrom long, pos long, stop long, v_id long")
    for slack in (0, 6):
        want, last = set(), {}
        for c, p, e, i in sorted(rows, key=lambda r: (r[1], r[3])):
            if c not in last or p > last[c] + slack:
                want.add(i)
                last[c] = e
        for width in (50, 1 << 20):
            assert {r["v_id"] for r in V.sweep(df, ["chrom"], slack, width).collect()} == want


def test_nearest_over_stretches(spark):
    import random

    rng = random.Random(2)
    a = [(i, rng.randint(0, 1), rng.randint(0, 5000)) for i in range(200)]
    b = [(i, rng.randint(0, 2), rng.randint(0, 5000), rng.randint(1, 9)) for i in range(60)]
    v1 = spark.createDataFrame(a, "v_id long, chrom long, pos long")
    v2 = spark.createDataFrame(b, "v_id long, chrom long, pos long, x long")
    want = {}
    for i, c, p in a:
        near = max((-abs(q - p), q, k, x) for k, d, q, x in b if d == c)
        want[i] = (-near[0], near[3])
    for width in (100, 1 << 20):
        assert {r["v_id"]: (r["dist"], r["length"]) for r in V.nearest_variant(v1, v2, width).collect()} == want


def test_matrix_width(spark):
    import pytest

    contig = spark.createDataFrame([(1, 1000), (2, 500)], "chrom long, seq_len long")
    assert R.matrix_width(contig) == 15
    with pytest.raises(ValueError):
        R.matrix_width(spark.createDataFrame([(1, 10**6)], "chrom long, seq_len long"), 10)
    assert R.matrix_width(spark.createDataFrame([(1, 10**6)], "chrom long, seq_len long"), 10, force=True) == 10


def test_run_matrix_filters(spark):
    rows = [("a", 1, 1, "5="), ("a", 2, 1, "2=1X2="), ("b", 2, 1, "2=1X2="), ("b", 3, 2, "5=")]
    runs = spark.createDataFrame(rows, "run string, read_serial long, chrom long, cigar string")
    got = lambda **k: {(r["r"], r["c"], r["kind"]): r["n"] for r in R.run_matrix(runs, **k).collect()}
    assert got(variants_only=True) == {("a", "a", "intersect"): 1, ("a", "b", "intersect"): 1, ("b", "b", "intersect"): 1}
    assert got(chrom=2) == {("b", "b", "intersect"): 1}


def test_kmers_over_parts(spark):
    rows = [(i, "".join("ACGTN"[(i * k * k + k // 3) % 5] for k in range(n))) for i, n in enumerate((0, 1, 5, 6, 1023, 1024, 1025, 3100))]
    seqs = spark.createDataFrame(rows, "seq_no long, seq string")
    for k, step in ((6, 1), (6, 50), (3, 2000)):
        want = sorted((i, at, s[at : at + k]) for i, s in rows for at in range(0, len(s) - k + 1, step))
        assert sorted(map(tuple, Q.kmers(seqs, k, step).select("seq_no", "at", "kmer").collect())) == want
        count = defaultdict(int)
        for i, s in rows:
            for at in range(len(s) - k + 1):
                count[s[at : at + k]] += 1
        want = sorted((i, j * step, count.get(s[j * step : j * step + k], 1)) for i, s in rows for j in range(len(s) // step))
        assert sorted(map(tuple, Q.kmer_score(seqs, Q.kmer_count(seqs, k), k, step).select("seq_no", "at", "score").collect())) == want
    gc = {(r["seq_no"], r["bin"]): r["gc"] for r in Q.gc_windows(seqs, 100).collect()}
    assert gc == {(i, b): (s[b * 100 : b * 100 + 100].count("G") + s[b * 100 : b * 100 + 100].count("C")) / 100 for i, s in rows for b in range((len(s) + 99) // 100)}


def test_serialise(spark):
    df = spark.range(300).select(F.pmod(F.xxhash64("id"), F.lit(90)).alias("pos"), F.col("id").alias("v_id"))
    got = [r["serial"] for r in R.serialise(df, ["pos", "v_id"], F.expr("pos div 7")).orderBy("pos", "v_id").collect()]
    assert got == list(range(300))


def variants(spark):
    return spark.range(400).select((F.col("id") % 2).alias("chrom"), (F.col("id") * 37 % 1500).alias("pos"), (F.col("id") * 37 % 1500 + 1 + F.col("id") % 9).alias("stop"), F.col("id").alias("v_id"), F.lit(0.4).alias("p"))


def test_nested_samples(spark):
    sets = defaultdict(set)
    for r in V.nested_samples(variants(spark), 0.25, [0.1, 0.5, 0.9], 3).collect():
        sets[r["name"]].add((r["copy"], r["chrom"], r["v_id"]))
    assert sets["v0"] < sets["v1"] < sets["v2"] and len(sets["vx"]) == 4 * 50
    assert sets["vx"] & sets["v2"] == sets["vx"] & sets["v0"]


def test_diploid_samples(spark):
    drawn = V.weighted_sample(variants(spark), 5, 2).collect()
    want = defaultdict(lambda: [None, None])
    for key in {(r["sample"], r["copy"], r["chrom"]) for r in drawn}:
        last = None
        for r in sorted((r for r in drawn if (r["sample"], r["copy"], r["chrom"]) == key), key=lambda r: (r["pos"], r["v_id"])):
            if last is None or r["pos"] > last:
                want[key[0], key[2], r["pos"]][key[1]] = r["v_id"]
                last = r["stop"]
    rows = set()
    for (s, c, p), (a, b) in want.items():
        rows |= {(s, c, p, a, 2)} if a == b else {(s, c, p, v, k) for k, v in enumerate((a, b)) if v is not None}
    assert {tuple(r) for r in V.diploid_samples(variants(spark), 5, 2).select("sample", "chrom", "pos", "v_id", "gt").collect()} == rows


def test_fasta_folders(spark, tmp_path):
    for i, s in ((1, "ACgt\nNA"), (2, "GG")):
        (tmp_path / f"chr{i}.fa").write_text(f">c{i}\n{s}\n")
    seqs = sources.read_fasta_dir(spark, str(tmp_path))
    assert sorted(map(tuple, seqs.collect())) == [(1, "c1", "ACGTNA"), (2, "c2", "GG")]
    sources.write_fasta_split(seqs, str(tmp_path / "out"))
    index = sources.read_contig_index(spark, str(tmp_path / "out/index"))
    assert sorted((r["seq_id"], r["seq_len"]) for r in index.collect()) == [("c1", 6), ("c2", 2)]
    assert sorted(map(tuple, sources.read_fasta(spark, str(tmp_path / "out/fasta/chrom=1")).collect())) == [("c1", "ACGTNA")]


def test_full_report(spark, sf_dir, tmp_path):
    from strandmark.operators.report import full_report
    from strandmark.plans import queries
    from strandmark.plans.registry import view

    got = full_report(view(spark, sf_dir, "fx_align"), view(spark, sf_dir, "fx_variant"), str(tmp_path))
    for name, query in (("matrix", "a8_misalignment_matrix"), ("accuracy", "a4_accuracy_by_indel_length"), ("smoothed", "g7_median_smooth"), ("outside", "j3_a3_accuracy_outside")):
        want = queries()[query](spark, sf_dir)
        own = got[name].withColumn("smooth", F.round("smooth", 6)) if name == "smoothed" else got[name]
        assert sorted(map(tuple, own.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got["bad"].count() == queries()["p3_bad_reads"](spark, sf_dir).count()
