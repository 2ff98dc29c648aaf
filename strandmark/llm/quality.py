"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance; covariances are shrunk towards the pooled one and towards a
multiple of the identity. The score is the logistic of the difference of the classes' log densities and
priors; densities come from Mahalanobis distances with Cholesky factors that are made once. Moments are
summed by Spark over all labelled rows; only they come to the driver.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, written

POOLED, IDENTITY = 0.1, 0.05
CUT = 0.3
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.isspace() and _i < 128 else 2 if "a" <= _c <= "z" else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else 5 if _c in ".,;:'\"()-" else 6 if _c in "!?" else 7 if _c == "|" else 8 if _i < 128 else 0
STATISTICS = ("length", "word_length", "capitals", "digits", "points", "shouts", "bars", "symbols", "lines", "distinct", "repeated", "marked", "long", "capital_words")
D = len(STATISTICS)
MARKED = re.compile(rb"[^\x80-\xffA-Za-z0-9.,;:'\"()\s-]")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, square roots of shares."""
    if not text:
        return [0.0] * D
    n = len(text)
    kind = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    words = text.split()
    m = max(1, len(words))
    letters = max(1, int(kind[0] + kind[2] + kind[3]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(c - 1 for c in Counter(lines).values())
    distinct = len(set(words)) / m
    marked = sum(1 for w in words if MARKED.search(w)) / m
    upper = sum(1 for w in words if len(w) > 1 and w[:2].isupper()) / m
    long_ = sum(1 for w in words if len(w) > 20) / m
    shares = [kind[3] / letters, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n, kind[8] / n, len(lines) / m, distinct, again / max(1, len(lines)), marked, long_, upper]
    return [float(np.log1p(len(words))), float(np.log1p(n / m)), *(float(np.sqrt(s)) for s in shares)]


def _statistics(batches):
    for batch in portions(batches):
        x = [statistics(t or b"") for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs(doc_id, text); null texts are empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>")


class Model:
    """Means, Cholesky factors and priors of the two classes."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        """n: rows of each class; sums: 2 x D; squares: 2 x D x D sums of products."""
        n = np.maximum(n, 0)
        self.prior = np.log((n + 1) / (n.sum() + 2))
        self.mean = sums / np.maximum(n, 1)[:, None]
        cov = [squares[k] / max(n[k], 1) - np.outer(self.mean[k], self.mean[k]) for k in (0, 1)]
        pooled = sum(n[k] * cov[k] for k in (0, 1)) / max(n.sum(), 1)
        spread = max(float(np.trace(pooled)) / D, 1e-3)
        self.factor, self.log_det = [], []
        for k in (0, 1):
            own = (1 - POOLED) * cov[k] + POOLED * pooled if n[k] > 1 else pooled
            own = (1 - IDENTITY) * own + IDENTITY * spread * np.eye(D)
            low = np.linalg.cholesky(own)
            self.factor.append(np.linalg.inv(low))
            self.log_det.append(2 * float(np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        log_p = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            log_p.append(self.prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(log_p[0] - log_p[1], -500, 500)))


def fit(table: DataFrame, labels: DataFrame, train: Column) -> Model:
    """Learns from the rows of statistics_table() that have a label and where train is true.

    labels(doc_id, quality): an id with two labels counts as the higher; null ids and labels teach nothing. Without
    labels of a class, its distribution is the pooled one.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = table.where(train).join(marks, "doc_id").select("y", "x")

    def partial(batches):
        n, sums = np.zeros(2), np.zeros((2, D + D * D))
        for batch in batches:
            y = batch["y"].to_numpy(zero_copy_only=False)
            x = np.array(batch["x"].to_pylist(), float).reshape(-1, D)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                sums[k] += np.concatenate([own.sum(axis=0), (own.T @ own).ravel()])
        width = D + D * D + 1
        yield pa.record_batch([pa.array(np.repeat([0, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width), 2).astype(np.int32)), pa.array(np.column_stack([n, sums]).ravel())], names=["y", "i", "v"])

    said = rows.mapInArrow(partial, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + D + D * D) rows
    all_ = np.zeros((2, 1 + D + D * D))
    for r in said:
        all_[r["y"], r["i"]] = r["v"]
    return Model(all_[:, 0], all_[:, 1 : 1 + D], all_[:, 1 + D :].reshape(2, D, D))


def scored(table: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of statistics_table()."""

    def rows(batches):
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    return table.mapInArrow(rows, "doc_id long, score double")


def training_row() -> Column:
    """Labels may be learnt from where this holds; a null id has no label."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text).

    A null text is empty; an empty text has statistics of nought and a score. Repeated rows are scored each; a null id is
    not held out; other columns are not read; an empty table gives no rows.
    """
    table = written(statistics_table(docs), "statistics")
    model = fit(table, labels, training_row())
    return scored(table, model).select("doc_id", F.coalesce(~training_row(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; columns stay. Texts are read twice and not shuffled.

    A null text is judged as an empty one and stays null; repeated rows and null ids are judged each; an empty table stays empty.
    """
    model = fit(statistics_table(docs), labels, training_row())
    at = docs.columns.index("text")

    def rows(batches):
        for batch in portions(batches):
            x = np.array([statistics((t or "").encode()) for t in batch.column(at).to_pylist()], float).reshape(-1, D)
            yield batch.filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(rows, docs.schema)
