"""The pipeline's stages against plain versions, and the discriminant and the likeness of fingerprints by hand."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmark.llm import common, fingerprints, mixing, pii, quality

from .test_operators import ODD, WORD, classes_by_hand, contamination_by_hand, crc, key, targets_by_hand


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quality_by_hand(rows, marks):
    """{(doc_id, text): score}: class means and covariances by plain sums, shrunk, with inverses and determinants."""
    y = {}
    for i, q in marks:
        if i is not None and q in (0, 1):
            y[i] = max(q, y.get(i, 0))
    x = {r: np.array(quality.statistics((r[1] or "").encode())) for r in rows}
    own = {k: np.array([x[r] for r in rows if r[0] is not None and crc(r[0]) % 5 and y.get(r[0]) == k]) for k in (0, 1)}
    n = {k: len(v) for k, v in own.items()}
    mean = {k: v.mean(axis=0) for k, v in own.items()}
    cov = {k: (v - mean[k]).T @ (v - mean[k]) / n[k] for k, v in own.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    spread = np.trace(pooled) / len(pooled)
    log_p = {}
    for k in (0, 1):
        c = 0.95 * (0.9 * cov[k] + 0.1 * pooled) + 0.05 * spread * np.eye(len(pooled))
        log_p[k] = {r: math.log((n[k] + 1) / (n[0] + n[1] + 2)) - 0.5 * (np.linalg.slogdet(c)[1] + (v - mean[k]) @ np.linalg.inv(c) @ (v - mean[k])) for r, v in x.items()}
    return {r: 1 / (1 + math.exp(min(500, log_p[0][r] - log_p[1][r]))) for r in rows}


def test_quality_by_hand(spark, sf_dir, docs):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = quality_by_hand(rows, [(r["doc_id"], r["quality"]) for r in marks.collect()])
    by_id = {i: s for (i, _), s in want.items()}
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - by_id[r["doc_id"]]) < 1e-6 and r["held_out"] == (crc(r["doc_id"]) % 5 == 0)


def test_stages(spark, sf_dir, docs):
    """Each stage on what the one before has kept."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    marks = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = quality_by_hand(list(rows.items()), marks)
    kept = sorted(i for i, t in rows.items() if score[(i, t)] >= quality.CUT)
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns and sorted(r["doc_id"] for r in good.collect()) == kept
    classes = classes_by_hand([(i, rows[i]) for i in kept])
    kept = sorted({c for _, c, _ in classes})
    one = stage["near_dedup"](spark, good, sf_dir)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == kept
    kept = [i for i, _, hit, *_ in contamination_by_hand([(i, rows[i]) for i in kept], items) if not hit]
    clean = stage["decontamination"](spark, one, sf_dir)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(kept)
    safe = stage["pii"](spark, clean, sf_dir)
    got = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert safe.columns == docs.columns and sorted(got) == sorted(kept)
    for i in kept:
        assert got[i] == pii.masked(rows[i], pii.find(rows[i])) and not [s for s in pii.find(got[i]) if s[1] < 4]
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = Counter()
    for i in kept:
        sizes[source[i]] += len(WORD.findall(got[i]))
    target = targets_by_hand(sizes)
    last = stage["mixing"](spark, safe, sf_dir)
    taken = Counter(r["doc_id"] for r in last.collect())
    for i in kept:
        rate = target[source[i]] / sizes[source[i]] if sizes[source[i]] else 0
        u = int(hashlib.md5(f"mix-1|{i}|{got[i]}".encode()).hexdigest()[:12], 16) / 2**48
        assert taken[i] == math.floor(rate) + (u < rate - math.floor(rate))
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, last.collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, repeated rows, and columns with names that stages use themselves: rows come through with all columns."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, copies string, score string, node string, root string, id string, x string"
    odd = spark.createDataFrame([(*r, *"abcdefgh") for r in ODD], cols)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.columns == (odd.columns if name != "mixing" else [*odd.columns, "copy"])
        rows = out.collect()
        assert all(r["x"] == "h" and r["root"] == "f" and r["target"] == "b" for r in rows)
        if name in ("pii", "decontamination"):
            assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(((r[0], r[1]) for r in ODD), key=key)
        if name == "near_dedup":
            assert len({r["text"] or "" for r in rows}) == len(rows)
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_likeness_by_hand(spark, docs):
    """near_edited and near_next from whole phrase sets of the same hashes, the smallest ones compared."""

    def phrases(t):
        known, w = set(), ""
        for ch in t:
            w += ch
            if w not in known:
                known.add(w)
                w = ""
        return known

    def smallest(t):
        hashes = []
        for p in phrases(t):
            data = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            hashes.append(int(common.span_hash(common.prefix_hash(data), np.array([0]), np.array([len(data)]))[0]))
        return [h >> 32 for h in sorted(hashes)[: fingerprints.KEPT]]

    def near(a, b):
        if a == b:
            return 1.0
        low = sorted(set(a) | set(b))[: fingerprints.KEPT]
        return sum(h in a and h in b for h in low) / len(low)

    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)[:40]
    some = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(some).collect()}
    prints = {i: smallest(t) for i, t in rows}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)]
        n = len(t)
        edited = smallest(t[: n - n // 2] + after[1][: n // 2])
        r = got[i]
        assert r["fingerprint"] == "".join(f"{h:08x}" for h in prints[i])
        assert abs(r["near_edited"] - near(prints[i], edited)) < 1e-12 and abs(r["near_next"] - near(prints[i], prints[after[0]])) < 1e-12


def test_mixing_hash_is_stated():
    assert mixing.SEED == "mix-1"
