"""Goldens and brute-force checks of the alignment and variant operators."""

import random
import re

from pyspark.sql import functions as F

from strandmark import functions as X
from strandmark import sources
from strandmark.operators import variants as V


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_old_style_cigar(spark):
    def by_hand(cigar):
        """Without an X, '=' is another letter for M; with one, both are M, and what meets is one run."""
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)(\D)", cigar)]
        if "X" not in cigar:
            return "".join(f"{n}{'M' if op == '=' else op}" for n, op in ops)
        out = []
        for n, op in ((n, "M" if op in "=X" else op) for n, op in ops):
            if out and out[-1][1] == op == "M":
                out[-1][0] += n
            else:
                out.append([n, op])
        return "".join(f"{n}{op}" for n, op in out)

    rng = random.Random(1)
    cigars = ["".join(f"{rng.randint(1, 40)}{rng.choice(kinds)}" for _ in range(rng.randint(1, 9))) for kinds in ("=X", "=XIDS", "=IDS", "MX=", "=") for _ in range(40)]
    got = {r["c"]: r["o"] for r in spark.createDataFrame([(c,) for c in cigars], "c string").select("c", X.old_style_cigar(F.col("c")).alias("o")).collect()}
    assert got == {c: by_hand(c) for c in cigars}


def test_pos_is_correct(spark):
    for a, p, c, w, want in [(31, 31, "80S", 0, True), (34, 31, "80S", 0, False), (34, 31, "80S", 3, True), (12, 10, "2D50M", 0, True), (10, 10, "2D50M", 0, False), (13, 10, "5S2D50M", 1, True), (10, 10, "5S2D", 0, False), (10, 10, "50M", 0, True)]:
        assert one(spark, X.pos_is_correct(F.lit(a), F.lit(p), F.lit(c), w)) is want


def test_decode_qname(spark):
    rows = [("8|2|1|0|41|50|50=|1|90|50|30=1D20=", 1), ("8|2|1|0|41|50|50=|1|90|50|30=1D20=", 0), ("8|2|1|0|x|50|50=|1|90|50|9=", 1), ("8|2", 1)]
    got = [r["t"] for r in spark.createDataFrame(rows, "qname string, is_read1 int").select(X.decode_qname().alias("t")).collect()]
    assert (got[0]["read_serial"], got[0]["pos"], got[0]["cigar"], got[0]["pos_m"]) == (80, 41, "50=", 90)
    assert (got[1]["read_serial"], got[1]["pos"], got[1]["cigar"], got[1]["pos_m"]) == (81, 90, "30=1D20=", 41)
    assert got[2] is None and got[3] is None


def test_genotypes(spark):
    rows = [("0|1:9",), ("1/0",), (".",), ("1",), (None,)]
    got = [tuple(r["g"]) for r in spark.createDataFrame(rows, "s string").select(X.parse_gt(F.col("s")).alias("g")).collect()]
    assert got == [(0, 1), (1, 0), (0, 0), (1, 1), (1, 1)]


def test_sweeps(spark):
    rng = random.Random(4)
    rows = [(1, p, p + n, i) for i, (p, n) in enumerate((rng.randint(0, 900), rng.randint(1, 30)) for _ in range(120))]
    df = spark.createDataFrame(rows, "chrom long, pos long, stop long, v_id long")

    def loop(skip):
        last, kept = None, []
        for _, pos, stop, i in sorted(rows, key=lambda r: (r[1], r[3])):
            if last is None or not skip(pos, last):
                kept.append(i)
                last = stop
        return sorted(kept)

    assert sorted(r["v_id"] for r in V.remove_collisions(df, ["chrom"]).collect()) == loop(lambda p, s: p <= s)
    assert sorted(r["v_id"] for r in V.min_spacing(df, ["chrom"], 7).collect()) == loop(lambda p, s: p - s < 7)


def test_diploid(spark):
    rng = random.Random(2)
    copies = [(k, pos, v) for k in (0, 1) for pos in range(60) if rng.random() < 0.6 for v in (2 * pos + (rng.random() < 0.3),)]
    df = spark.createDataFrame(copies, "copy int, pos long, v_id long").withColumn("chrom", F.lit(1))
    for drop in (False, True):
        want = []
        for pos in range(60):
            a, b = (next((v for c, p, v in copies if (c, p) == (k, pos)), None) for k in (0, 1))
            if a is not None and a == b:
                want.append((pos, a, 2))
            elif not (drop and a is not None and b is not None):
                want += [(pos, v, k) for k, v in enumerate((a, b)) if v is not None]
        assert sorted((r["pos"], r["v_id"], r["gt"]) for r in V.merge_diploid(df, ["chrom"], drop).collect()) == sorted(want)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 x\nACtg\nRN\n>c2\nGG\n")
    assert sorted(map(tuple, sources.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("c1 x", "ACTGNN"), ("c2", "GG")]
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:6\nq\t67\tc1\t3\t60\t2M\t=\t5\t0\tAC\t~~\n")
    assert tuple(sources.read_sam(spark, str(tmp_path / "a.sam")).select("qname", "apos", "is_read1", "is_paired").first()) == ("q", 2, 1, True)
    assert tuple(sources.read_sam_contigs(spark, str(tmp_path / "a.sam")).first()) == (0, "c1", 6)
    v = spark.createDataFrame([("c1", 4, "A", "T", 1), ("c1", 9, "AC", "A", 2)], "seq_id string, pos long, ref string, alt string, gt long")
    sources.write_vcf(v, str(tmp_path / "v"))
    assert sorted(map(tuple, sources.read_vcf(spark, str(tmp_path / "v"))[1].collect())) == sorted(map(tuple, v.collect()))


def test_fasta_chunks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 with > in it\nACtg\nRN\n>c2\nGG\n>c3\n")
    contig, chunks = sources.read_fasta_chunks(spark, str(tmp_path / "a.fa"), [1, 3], 4)
    assert [(r["chrom"], r["seq_id"], r["seq_len"]) for r in contig.orderBy("chrom").collect()] == [(1, "c1 with > in it", 6), (2, "c2", 2), (3, "c3", 0)]
    assert sorted(map(tuple, chunks.collect())) == [(1, 0, 0, "ACTG"), (1, 1, 4, "NN")]


def test_fastq(spark, tmp_path):
    sources.write_fastq(spark.createDataFrame([("q1", 2, "ACG")], "qname string, mate int, seq string"), str(tmp_path / "q"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "q")).collect()] == ["@q1/2", "ACG", "+", "~~~"]


VCF = """##fileformat=VCFv4.1
##contig=<ID=a,length=100,md5=x1>
##contig=<ID=b,length=50>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
b\t9\t.\tA\tC\t100\tPASS\tAF=0.25\tGT\t0/1\t1|1
a\t20\t.\tAC\tA,ACT\t100\tPASS\tAF=0.5,0.1\tGT:DP\t1|2:7\t0|0:3
a\t5\t.\tG\t<DEL>\t100\tPASS\t.\tGT\t1|1\t1|1
a\t7\t.\tG\t.\t100\tPASS\t.\tGT\t1|1\t1|1
z\t7\t.\tG\tT\t100\tPASS\t.\tGT\t1|1\t1|1
"""


def test_vcf_tables(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    contig, variant, genotype, unknown = sources.vcf_to_tables(spark, str(tmp_path / "a.vcf"), "s1")
    assert sorted(map(tuple, contig.collect())) == [(1, "a", 100, "x1"), (2, "b", 50, None)]
    want = [(1, 0, 19, 21, "AC", "A", 0.5), (1, 1, 19, 21, "AC", "ACT", 0.1), (2, 0, 8, 9, "A", "C", 0.25)]
    assert sorted(map(tuple, variant.collect())) == want
    assert sorted(map(tuple, genotype.collect())) == [("s1", 1, 0, 0), ("s1", 1, 1, 1), ("s1", 2, 0, 1)]
    assert list(map(tuple, unknown.collect())) == [("z", 1)]
    only = sources.vcf_to_tables(spark, str(tmp_path / "a.vcf"), "s2", master_is_sample=True)
    assert [r["alt"] for r in only[1].collect()] == ["C"]
    import pytest

    with pytest.raises(ValueError):
        sources.vcf_to_tables(spark, str(tmp_path / "a.vcf"), "s3")
    for gt, name in ((genotype, "with"), (None, "without")):
        sources.tables_to_vcf(contig, variant, gt, str(tmp_path / name))
        text = "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        (tmp_path / f"{name}.vcf").write_text(text)
        assert text.startswith("##fileformat=VCFv4.1\n##contig=<ID=a,length=100,md5=x1>\n##contig=<ID=b,length=50>\n")
        again = sources.vcf_to_tables(spark, str(tmp_path / f"{name}.vcf"))
        assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, contig.collect()))
        assert sorted(r[:6] for r in map(tuple, again[1].collect())) == [r[:6] for r in want]
        if gt is None:
            assert sorted(r["p"] for r in again[1].collect()) == [0.1, 0.25, 0.5] and "AF=0.25" in text
        else:
            assert sorted(map(tuple, again[2].collect())) == sorted(map(tuple, gt.collect()))


SAM = """@HD\tVN:1.4
@SQ\tSN:a\tLN:100
@SQ\tSN:b\tLN:50
1|1|0|0|10|4|4=|1|30|4|4=\t67\ta\t11\t60\t4M\t=\t31\t0\tACGT\tIIII
1|1|0|0|10|4|4=|1|30|4|4=\t131\ta\t31\t60\t4M\t=\t11\t0\tACGT\tIIII
2|2|0|0|8|4|4=\t0\ta\t9\t60\t4M\t*\t0\t0\tACGT\tIIII
3|2|1|1|7|4|4=\t0\tb\t8\t60\t4M\t*\t0\t0\tAACG\tabcd
4|1|1|1|18|4|4=\t0\tb\t8\t60\t4M\t*\t0\t0\tAACG\tabcd
5|1|1|1|18|4|4=\t4\t*\t0\t0\t*\t*\t0\t0\tAACG\tabcd
6|1|1\t0\tb\t8\t60\t4M\t*\t0\t0\tAACG\tabcd
"""


def test_files_to_report(spark, tmp_path):
    from strandmark.operators import reads as R
    from strandmark.operators.report import full_report

    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.vcf").write_text(VCF)
    contigs = sources.read_sam_contigs(spark, str(tmp_path / "a.sam"))
    reads = sources.with_ref_ids(sources.read_sam(spark, str(tmp_path / "a.sam")), contigs)
    scored = R.score_alignments(reads)
    assert {(r["read_serial"], r["is_paired"], r["xf"]) for r in scored.collect()} == {(10, True, 1), (11, True, 1), (2, False, 0), (3, False, 1), (4, False, 0), (5, False, 2)}
    truth = {r["read_serial"]: r for r in R.to_truth_coordinates(scored).collect()}
    assert (truth[4]["ref_id"], truth[4]["apos"], truth[4]["acigar"], truth[4]["seq"], truth[4]["qual"], truth[4]["is_reverse"]) == (0, 18, "4=", "CGTT", "dcba", True)
    assert (truth[3]["seq"], truth[3]["a_chrom"], truth[2]["seq"]) == ("AACG", 1, "ACGT")
    contig, variant, genotype, _ = sources.vcf_to_tables(spark, str(tmp_path / "a.vcf"), "s1")
    # ids of variants count from 0 in each chromosome: over all of them, chromosome and id name one
    key = (F.col("chrom") * 1000 + F.col("v_id")).alias("v_id")
    variant, genotype = variant.withColumn("v_id", key), genotype.select("sample", key, "gt")
    got = full_report(reads, variant, str(tmp_path / "all"), contig=contig, width=None)
    assert {r["x"]: (r["correct"], r["total"]) for r in got["accuracy"].where("total > 0").collect()} == {0: (1, 2), -1: (0, 2), 1: (0, 2)}
    assert tuple(got["outside"].first()) == (2, 2) and got["bad"].count() == 3
    assert [r["n"] for r in got["unmapped"].collect()] == [1]
    own = full_report(reads, variant, str(tmp_path / "own"), genotype=genotype, contig=contig, width=None)
    # s1 has the insertion on copy 1 and the deletion on copy 0; reads 4 and 5 are of copy 1, read 2 is of copy 0 and 3 of copy 1
    assert {r["x"]: (r["correct"], r["total"]) for r in own["accuracy"].where("total > 0").collect()} == {0: (1, 1), 1: (0, 2)}
    assert {r["x"]: r["n"] for r in own["covered"].collect()} == {0: 1, 1: 1}


def test_write_sorted(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 7 % 5).alias("chrom"), (F.col("id") * 7919 % 100003).alias("pos"))
    sources.write_sorted(df, str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("part-*"))
    rows = [tuple(r) for f in files for r in spark.read.parquet(str(f)).select("chrom", "pos").collect()]
    assert rows == sorted(map(tuple, df.collect()))


def test_scoring_a_stream(spark, sf_dir, tmp_path):
    """score_alignments() and bad_reads() keep no state: new files give the rows that they give in a batch."""
    from strandmark.operators import reads as R
    from strandmark.plans.registry import view

    align = view(spark, sf_dir, "fx_align").limit(3000)
    align.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.bad_reads(R.score_alignments(stream)).select("read_serial", "a_pos").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    want = R.bad_reads(R.score_alignments(batch)).select("read_serial", "a_pos")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
