"""Ordinary alignments, chunk tables, FASTA by lines, stretches, layouts and tags against loops."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandmark import sources
from strandmark.operators import reads as R
from strandmark.operators import sequence as Q
from strandmark.operators import templates as T
from strandmark.operators import variants as V

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def random_sam(rng):
    lines, where = ["@SQ\tSN:a\tLN:1000", "@SQ\tSN:b\tLN:900"], "ab"
    for i in range(150):
        name, flag1, flag2 = f"frag {rng.randint(0, 60)}", 64, 128
        places = [rng.randint(1, 20) * 10, rng.randint(1, 20) * 10]
        chroms = [rng.choice(where), None]
        chroms[1] = chroms[0] if rng.random() < 0.8 else rng.choice(where)
        seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(3, 8))) for _ in range(2)]
        back = [rng.random() < 0.5, rng.random() < 0.5]
        if i % 9 == 0:
            lines.append("\t".join(map(str, (name, 16 * back[0], chroms[0], places[0], rng.randint(0, 60), f"{len(seqs[0])}M", "*", 0, 0, seqs[0], "*"))))
            continue
        unmapped = rng.random() < 0.1
        for k, flag in enumerate((flag1, flag2)):
            bits = 1 + flag + 16 * back[k] + 32 * back[1 - k] + (4 if unmapped and k else 0) + (8 if unmapped and not k else 0)
            rnext = "=" if chroms[0] == chroms[1] else chroms[1 - k]
            row = (name, bits, chroms[k], places[k], rng.randint(0, 60), f"{len(seqs[k])}M", rnext, places[1 - k], 0, seqs[k], "*")
            lines.append("\t".join(map(str, row)))
            if rng.random() < 0.1:
                lines.append("\t".join(map(str, (name, bits + rng.choice((256, 2048)), *row[2:]))))
    return lines


def templates_by_hand(lines, least):
    found, waiting = [], defaultdict(lambda: ([], []))
    for line in lines:
        if line[0] == "@":
            continue
        name, flag, chrom, pos, mapq, cigar, rnext, pnext, _, seq, _ = line.split("\t")
        flag, pos, pnext = int(flag), int(pos) - 1, int(pnext) - 1
        if flag & (4 + 256 + 2048) or int(mapq) < least:
            continue
        read = (1 if flag & 16 else 0, pos, len(seq), cigar, seq.translate(COMPLEMENT)[::-1] if flag & 16 else seq)
        if not flag & 1:
            found.append((chrom, name, read, None))
        elif not flag & 8 and rnext in ("=", chrom):
            first = bool(flag & 64)
            waiting[name, chrom, *((pos, pnext) if first else (pnext, pos))][0 if first else 1].append(read)
    for (name, chrom, *_), (a, b) in waiting.items():
        found += [(chrom, name, x, y) for x, y in zip(*(sorted(v, key=lambda r: (r[4], r[3], r[0])) for v in (a, b)), strict=False)]
    found.sort(key=lambda t: (t[0], t[2][1], t[1], -1 if t[3] is None else t[3][1], t[2], t[3] or ()))
    out = []
    for serial, (chrom, _, a, b) in enumerate(found):
        fields = [serial, "ab".index(chrom) + 1, 0, *a[:4], *(b[:4] if b else ())]
        name = "|".join(map(str, fields))
        out += [(name, k + 1, r[4]) for k, r in enumerate((a, b)) if r]
    return out


def test_truth_fastq_of_ordinary_names(spark, tmp_path):
    lines = random_sam(random.Random(5))
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    reads = sources.with_ref_ids(sources.read_sam(spark, str(tmp_path / "a.sam")), sources.read_sam_contigs(spark, str(tmp_path / "a.sam")))
    for least in (0, 25):
        got = T.templates_fastq(reads, least)
        want = templates_by_hand(lines, least)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({n for n, _, _ in want}) > 30 and any(n.count("|") == 6 for n, _, _ in want)
    sources.write_fastq(got, str(tmp_path / "fq"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "fq")).collect()]
    assert Counter(text[0::4]) == Counter(f"@{n}/{m}" for n, m, _ in want) and Counter(text[1::4]) == Counter(s for *_, s in want)
    # names decode again, as truth
    assert got.where("qname not rlike '^[0-9]+[|]'").count() == 0


def random_sequences(rng, sizes):
    return [(i, "".join(rng.choice("ACGTN") for _ in range(n))) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("width", [1, 4, 7, 50, 1000])
def test_chunks_are_as_whole_sequences(spark, width):
    rows = random_sequences(random.Random(1), (1, 5, 6, 7, 49, 50, 51, 260))
    seqs = spark.createDataFrame(rows, "seq_no long, seq string")
    chunks = Q.chunked(seqs, width)
    same = lambda a, b: sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))
    for k, step in ((6, 1), (6, 5), (3, 40)):
        assert same(Q.kmers(chunks, k, step), Q.kmers(seqs, k, step))
        table = Q.kmer_count(seqs, k)
        assert same(Q.kmer_count(chunks, k), table) and same(Q.kmer_score(chunks, table, k, step), Q.kmer_score(seqs, table, k, step))
    count = Counter(s[i : i + 6] for _, s in rows for i in range(len(s) - 6))
    for t in (seqs, chunks):
        assert {r["kmer"]: r["n"] for r in Q.kmer_count(t, 6, include_last=False).collect()} == dict(count)
        mean = {r["seq_no"]: r["score"] for r in Q.kmer_mean_score(t, Q.kmer_count(seqs, 6), 6, include_last=False).collect()}
        every = Counter(s[i : i + 6] for _, s in rows for i in range(len(s) - 5))
        for i, s in rows:
            own = [every[s[j : j + 6]] for j in range(len(s) - 6)]
            assert mean[i] == (pytest.approx(sum(own) / len(own)) if own else None)
    for window in (1, 8, 100):
        assert same(Q.gc_windows(chunks, window), Q.gc_windows(seqs, window))
    assert same(Q.contig_stats(chunks), Q.contig_stats(seqs))


FASTA = ">c1 with > in it\r\nACtg\r\nRN\r\n\r\n>c2\n>c3\nGG\nggT\nA" + "C" * 30 + "\n" + "acgt\n" * 40


def records_by_hand(text):
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([line[1:].rstrip("\r"), ""])
        elif out:
            out[-1][1] += line.strip()
    fold = str.maketrans("actgURYSWKMBDHVn", "ACTGTNNNNNNNNNNN")
    return [(i + 1, name, s.translate(fold)) for i, (name, s) in enumerate(out)]


@pytest.mark.parametrize("split", [16, 37, 1 << 20])
def test_fasta_by_lines(spark, tmp_path, split):
    (tmp_path / "a.fa").write_bytes(FASTA.encode())
    with gzip.open(tmp_path / "a.fa.gz", "wb") as f:
        f.write(FASTA.encode())
    want = records_by_hand(FASTA)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for name in ("a.fa", "a.fa.gz"):
            contig, chunks = sources.read_fasta_chunks(spark, str(tmp_path / name), chunk=7)
            assert sorted(map(tuple, contig.collect())) == [(i, n, len(s), hashlib.md5(s.encode()).hexdigest()) for i, n, s in want]
            assert sorted(map(tuple, chunks.collect())) == [(i, k, 7 * k, s[7 * k : 7 * k + 7]) for i, _, s in want for k in range(-(-len(s) // 7))]
        some = sources.read_fasta_chunks(spark, str(tmp_path / "a.fa"), [1], 1000)[1]
        assert [tuple(r) for r in some.collect()] == [(1, 0, 0, "ACTGNN")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fasta_folders_by_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, s in ((10, "ACgt\nNA\n"), (2, "GG\n" * 50)):
        (tmp_path / f"in/chr{i}.fa").write_text(f">c{i}\n{s}")
    contig, chunks = sources.read_fasta_chunks(spark, str(tmp_path / "in"), chunk=8, by_name=True)
    rows = sorted((r["chrom"], r["seq_id"], r["seq_len"]) for r in contig.collect())
    assert rows == [(2, "c2", 100), (10, "c10", 6)]
    sources.write_fasta_split(chunks.join(contig, "chrom"), str(tmp_path / "out"))
    index = {r["seq_id"]: (r["seq_len"], r["seq_md5"]) for r in sources.read_contig_index(spark, str(tmp_path / "out/index")).collect()}
    assert index == {r["seq_id"]: (r["seq_len"], r["seq_md5"]) for r in contig.collect()}
    text = "".join(f.read_text() for f in sorted((tmp_path / "out/fasta/chrom=2").glob("part-*")))
    assert text.startswith(">c2\n") and text.replace("\n", "") == ">c2" + "G" * 100


def test_kmers_of_a_fasta(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(1000))
    (tmp_path / "x.fa").write_text(">x\n" + "\n".join(text[i : i + 60] for i in range(0, 1000, 60)) + "\n")
    chunks = sources.read_fasta_chunks(spark, str(tmp_path / "x.fa"), chunk=64)[1].withColumnRenamed("chrom", "seq_no")
    assert {r["kmer"]: r["n"] for r in Q.kmer_count(chunks, 10).collect()} == Counter(text[i : i + 10] for i in range(991))


def test_haplotypes_by_stretches(spark):
    rng = random.Random(7)
    rows, at = [], 0
    while at < 4000:
        ref = "A" * rng.randint(1, 5)
        rows.append((rng.randint(0, 1), at, at + len(ref), ref, "C" * rng.randint(1, 6), len(rows)))
        at += rng.randint(1, 60) + len(ref)
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    v = spark.createDataFrame(rows, "seq_no long, pos long, stop long, ref string, alt string, v_id long")
    want, shift, last = {}, Counter(), Counter()
    for s, pos, stop, ref, alt, i in rows:
        want[i] = (pos + shift[s], last[s], last[s] + shift[s])
        shift[s] += len(alt) - len(ref)
        last[s] = stop
    for width in (30, 500, 1 << 20):
        got = Q.applied(v, ("seq_no",), width)
        assert {r["v_id"]: (r["alt_start"], r["from"], r["alt_from"]) for r in got.collect()} == want
        points = V.waypoints(v, ["seq_no"], width).collect()
        assert {r["v_id"]: r["alt_pos"] - (1 if r["delta"] else 0) for r in points} == {i: x[0] for i, x in want.items()}


def test_single_rows_are_not_walked(spark):
    rows = [(c, p, p + n, i) for i, (c, p, n) in enumerate([(None, 5, 3), (None, 6, 1), (None, 100, 2), (1, 1, 1), (1, 50, 400), (1, 60, 1), (1, 470, 2), (1, 900, 1)])]
    df = spark.createDataFrame(rows, "chrom long, pos long, stop long, v_id long")
    for width in (10, 64, 1 << 20):
        marks = {r["v_id"]: r["begins"] and r["ends"] for r in V.clusters(df, ["chrom"], 0, width).collect()}
        assert marks == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}
        assert {r["v_id"] for r in V.sweep(df, ["chrom"], 0, width).collect()} == {0, 2, 3, 4, 6, 7}


def scored_rows(spark, rows):
    cols = "qname string, is_read1 long, is_paired boolean, read_serial long, chrom long, cpy long, pos long, read_stop long, pos_m long, mate_stop long, xf long, a_chrom long, a_pos long, a_cigar string"
    return spark.createDataFrame(rows, cols)


def test_one_pass_is_as_three_joins(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        pos, mate = (rng.choice((500, rng.randint(0, 90_000))) for _ in range(2))
        paired = rng.random() < 0.8
        rows.append((f"q{i}", i % 2, paired, rng.randint(0, 300), rng.randint(1, 2), rng.randint(0, 1), pos, pos + 100, mate if paired else 0, mate + 100 if paired else 0, rng.randint(0, 2), 0, 0, "x"))
    feats = [(k, rng.randint(1, 2), (p := rng.randint(0, 90_000)), p + rng.choice((1, 5, 40, 9000)), rng.randint(-3, 3)) for k in range(60)]
    scored, f = scored_rows(spark, rows), spark.createDataFrame(feats, "v_id long, chrom long, f_start long, f_stop long, x long")
    per, outside = defaultdict(lambda: [0, 0]), [0, 0]
    for *_, paired, _s, c, _c, a, b, p, q, xf, _1, _2, _3 in rows:
        own = [k for k, d, s, e, _ in feats if d == c and a <= e and b >= s]
        mate = [k for k, d, s, e, _ in feats if paired and d == c and p <= e and q >= s]
        for k in own or mate:
            per[0 if own else 1, k][0] += xf == 1
            per[0 if own else 1, k][1] += 1
        if not own and not mate:
            outside[0] += xf == 1
            outside[1] += 1
    got = R.classes_of_reads(scored, f).collect()
    assert {(r["class"], r["v_id"]): [r["correct"], r["total"]] for r in got if r["class"] < 2} == dict(per)
    assert [sum(r[c] for r in got if r["class"] == 2) for c in ("correct", "total")] == outside
    assert R.reads_outside_features(scored, f).count() == outside[1]
    assert Counter(r["v_id"] for r in R.templates_over_features(scored, f).collect()) == {k: n for (c, k), (_, n) in per.items() if c == 1}


def test_outside_tells_paired_and_unpaired_reads_apart(spark):
    rows = [("a", 1, True, 20, 1, 0, 100, 200, 300, 400, 1, 0, 100, "x"), ("b", 1, False, 20, 1, 0, 5000, 5100, 0, 0, 1, 0, 5000, "x")]
    feats = spark.createDataFrame([(1, 1, 5050, 5051, 0)], "v_id long, chrom long, f_start long, f_stop long, x long")
    assert [r["qname"] for r in R.reads_outside_features(scored_rows(spark, rows), feats).collect()] == ["a"]


def test_heavy_bins_are_dealt(spark):
    reads = spark.range(20_000).select(F.lit(1).alias("chrom"), F.when(F.col("id") % 2 == 0, 100 + F.col("id") % 30).otherwise(F.col("id") * 40).alias("pos"), F.col("id").alias("read_serial"))
    reads = reads.withColumn("read_stop", F.col("pos") + 20)
    feats = spark.range(900).select(F.lit(1).alias("chrom"), (F.col("id") * 877).alias("f_start"), (F.col("id") * 877 + 3).alias("f_stop"), F.col("id").alias("v_id"))
    want = sorted(map(tuple, R.overlap_join(reads, feats).select("read_serial", "v_id").collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, v in zip(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"), ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        got = R.overlap_join(reads, feats, heavy=200)
        assert sorted(map(tuple, got.select("read_serial", "v_id").collect())) == want
        # rows of reads by what they are joined on: no bin and salt has many more than heavy ones
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and plan.count("SortMergeJoin") == 3
    finally:
        for k, v in zip(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"), before, strict=True):
            spark.conf.set(k, v)


def test_a_run_against_itself(spark):
    rows = [("a", 1, True, 10, 1, 0, 5, 9, 7, 9, 0, 0, 3, "4M"), ("a", 1, True, 10, 1, 0, 5, 9, 7, 9, 0, 0, 30, "2M"), ("a", 0, True, 11, 1, 0, 5, 9, 7, 9, 2, -1, None, None), ("b", 1, True, 20, 1, 0, 5, 9, 7, 9, 0, 0, 8, "4M")]
    bad = scored_rows(spark, rows)
    assert Counter(r["kind"] for r in R.compare_runs(bad, bad).collect()) == {"identical": 4}
    less = scored_rows(spark, rows[1:])
    assert Counter(r["kind"] for r in R.compare_runs(bad, less).collect()) == {"identical": 2, "different": 1, "only_1": 1}
    assert R.run_diff(bad, less).count() == 1 and R.run_intersect(bad, less).count() == 3 and R.run_diff(bad, bad).count() == 0
    got = {(r["r"], r["c"], r["kind"]): r["n"] for r in R.run_matrix(R.attach_runs({"x": bad, "y": less})).collect()}
    assert got == {("x", "x", "intersect"): 4, ("x", "y", "intersect"): 3, ("y", "y", "intersect"): 3, ("x", "y", "diff"): 1}
    contig, other = (spark.createDataFrame([(1, n)], "chrom long, seq_len long") for n in (10, 11))
    assert tuple(R.compare_two_runs(bad, less, contig, contig).first()) == (2, 1, 1, 0) and R.compare_two_runs(bad, less, contig, other).count() == 0


def test_written_layout_is_pruned(spark, sf_dir, tmp_path):
    from strandmark.plans.registry import view

    scored = R.score_alignments(view(spark, sf_dir, "fx_align"))
    sources.write_scored(scored, str(tmp_path / "s"))
    back = sources.read_scored(spark, str(tmp_path / "s"))
    some = R.reads_in_region(back, 2, 100_000, 50_000)
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(chrom" in scan and "PushedFilters: [IsNotNull(pos), GreaterThan(pos,100000), LessThan(pos,150000)]" in scan
    assert some.count() == R.reads_in_region(scored, 2, 100_000, 50_000).count() > 0
    cell = R.misalignment_cell(back, 1, (0, 500_000), 2, (0, 600_000))
    assert "PartitionFilters: [isnotnull(chrom" in cell._jdf.queryExecution().executedPlan().toString()


def test_tags(spark, tmp_path):
    (tmp_path / "t.sam").write_text("@SQ\tSN:a\tLN:9\nq\t0\ta\t3\t60\t2M\t*\t0\t0\tAC\tII\tXf:i:0\tXC:Z:1M:1S\tXf:i:7\tbad\tBC:B:c,1,2\tZZ:Z:\nr\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    rows = {r["qname"]: r["tags"] for r in sources.read_sam(spark, str(tmp_path / "t.sam")).collect()}
    assert {k: tuple(v) for k, v in rows["q"].items()} == {"Xf": ("i", "0"), "XC": ("Z", "1M:1S"), "BC": ("B", "c,1,2"), "ZZ": ("Z", "")} and rows["r"] == {}


def test_scored_sam_round_trip(spark, sf_dir, tmp_path):
    from strandmark.plans.registry import second_run, view

    align = view(spark, sf_dir, "fx_align").limit(2000).cache()
    contigs = spark.createDataFrame([(i, f"chr{i + 1}", 1_000_000) for i in range(5)], "ref_id long, seq_id string, seq_len long")
    runs = []
    for k, a in enumerate((align, second_run(align))):
        bad = R.bad_reads(R.score_alignments(a))
        sources.write_scored_sam(bad, contigs, str(tmp_path / f"bad{k}"))
        back = sources.read_scored_sam(spark, str(tmp_path / f"bad{k}"))
        cols = ["qname", "is_read1", "is_paired", "chrom", "pos", "cigar", "mapq", "cpy", "read_stop", "mate_stop", "xf", "chrom_ok", "pos_ok", "a_chrom", "a_pos", "a_cigar", "is_unmapped", "is_misaligned"]
        assert sorted(map(str, map(tuple, back.select(cols).collect()))) == sorted(map(str, map(tuple, bad.select(cols).collect())))
        runs.append((bad, back))
    count = lambda i: tuple(R.run_counts(R.compare_runs(runs[0][i], runs[1][i])).first())
    assert count(0) == count(1) and sum(count(0)) > 100


def test_spectra_of_many_levels(spark):
    rng = random.Random(6)
    rows = [(1 + i % 2, i, rng.random()) for i in range(700)]
    v = spark.createDataFrame(rows, "chrom long, v_id long, p double")
    levels = [((k + 1) / 1001, 0.9 / 1000) for k in range(1000)]
    got = {r["level"]: r["actual"] for r in V.spectrum_histogram(v, spark.createDataFrame(levels, "p double, f double")).collect()}
    edges = [0.0, *((a[0] + (b[0] - a[0]) / 2) for a, b in zip(levels, levels[1:], strict=False))]
    want = Counter(max(i for i, e in enumerate(edges) if e <= p) for _, _, p in rows if p <= levels[-1][0] + (levels[-1][0] - levels[-2][0]) / 2)
    assert len(got) == 1000 and [got[p] for p, _ in levels] == [want[i] for i in range(1000)]
    few = [(0.2, 0.5), (0.4, 0.3), (0.9, 0.1)]
    new = {r["v_id"]: r["p_new"] for r in V.rebalance_spectrum(v, few).collect()}
    for c in (1, 2):
        own = sorted((p, i) for d, i, p in rows if d == c)
        blocks = [p for p, f in few for _ in range(int(f * len(own) + 0.5))]
        assert [new[i] for _, i in own] == blocks + [p for p, _ in own[len(blocks) :]]
    assert [r["level"] for r in V.spectrum_histogram(v.withColumn("p", F.lit(0.5))).orderBy("level").collect()] == [i * 0.5 / 10 for i in range(11)]
    assert V.spectrum_histogram(v.limit(0)).agg(F.sum("actual")).first()[0] == 0


def test_defaults(spark):
    v = spark.createDataFrame([(1, i, "A", "AC" if i % 2 else "A") for i in range(20)], "chrom long, v_id long, ref string, alt string")
    g = spark.createDataFrame([(s, i, 0) for s in range(12) for i in range(s + 1)], "sample long, v_id long, gt long")
    got = V.variant_counts(v, g).where("chrom = 1").first().asDict()
    assert got == {"chrom": 1, "population": 20} | {f"s{s}": s + 1 for s in range(10)}
    assert {r["x"]: r["n"] for r in V.indel_histogram(v, 1, g, 4).collect()} == {-1: 0, 0: 3, 1: 2}


def test_consensus_of_chunks(spark):
    rng = random.Random(12)
    rows = random_sequences(rng, (1, 64, 65, 700))
    variants = [(i, p, p + n, s[p : p + n], "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9)))) for i, s in rows for p in range(0, len(s) - 6, 23) for n in (rng.randint(1, 5),)]
    seqs = spark.createDataFrame(rows, "seq_no long, seq string")
    v = spark.createDataFrame(variants, "seq_no long, pos long, stop long, ref string, alt string")
    whole = {r["seq_no"]: r["seq"] for r in Q.consensus(Q.consensus_pieces(seqs, v, 64)).collect()}
    assert {r["seq_no"]: r["seq"] for r in Q.consensus(Q.consensus_pieces(Q.chunked(seqs, 64), v, 64, stretch=50)).collect()} == whole
    for i, s in rows:
        text, at = "", 0
        for _, pos, stop, _, alt in sorted(x for x in variants if x[0] == i):
            text += s[at:pos] + alt
            at = stop
        assert whole[i] == text + s[at:]


def test_reads_are_counted_once(spark, sf_dir):
    """On a feature, mate on a feature, or outside: the classes have every read once, however the rows are dealt."""
    from strandmark.plans.registry import feats, scored

    s, f = scored(spark, sf_dir), feats(spark, sf_dir)
    hit = R.overlap_join(s, f).select("read_serial").distinct()
    mate = R.templates_over_features(s, f).select("read_serial").distinct()
    out = R.reads_outside_features(s, f).select("read_serial")
    assert hit.unionAll(mate).unionAll(out).distinct().count() == hit.count() + mate.count() + out.count() == s.count()
    plain = s.join(f, (s["chrom"] == f["chrom"]) & (s["pos"] <= f["f_stop"]) & (s["read_stop"] >= f["f_start"])).select("read_serial", "v_id")
    for n in (1, 13):
        assert sorted(map(tuple, R.overlap_join(s.repartition(n), f.repartition(n)).select("read_serial", "v_id").collect())) == sorted(map(tuple, plain.collect()))
