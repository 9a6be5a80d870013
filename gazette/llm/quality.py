"""Quality scores by Bradley-Terry ranking of document pairs.

Each labelled good document is held against labelled bad ones; logistic loss on the difference of their
features gives weights, so that a weighted sum of features ranks documents. The cut is a quantile of the
training scores: the share of bad rows among the labels. Scores are the logistic of the distance to it.

The weights are fitted on a bounded sample: at most ``max_labels`` labelled rows, those of the least hash of
their id (of texts that repeat an id, one), and ``pairs_each`` partners for each row of the rarer label. Features read whole texts.

Defined cases: null text is empty; labels other than 0 and 1 or without an id are ignored; where one label is
missing all scores are the share of the other (0.5 without any); every row gets a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import doc_crc, table

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"#*$%&<>^~=_{}[]\\@", b"|", b".", b",;:", b"\n", bytes(range(128, 256)), b" \t\r", b"'\"()-/"), 1):
    _CLASS[list(_chars)] = _i
_SHARES = 12


def features(text: bytes) -> list[float]:
    """Shares of character classes, lengths, and repetition of words and lines."""
    n = max(len(text), 1)
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_SHARES) if text else np.zeros(_SHARES)
    shares = counts[:_SHARES] / n
    words = text.split()
    k = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = len(set(words)) / k
    long = sum(map(len, words)) / k
    same = 1 - len(set(lines)) / max(len(lines), 1)
    return [*shares, *np.log1p(50 * shares), np.log1p(len(words)), np.log1p(long), kinds, kinds * np.log1p(len(words)), same, float(len(words) < 20)]


WIDTH = 2 * _SHARES + 6


class Model:
    """Standardised linear score, cut and base rate."""

    def __init__(self, mean, scale, weights, cut: float, base: float | None = None):
        self.mean, self.scale, self.weights, self.cut, self.base = mean, scale, weights, cut, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale * self.weights).sum(1)  # row by row, so that equal texts score alike in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -500, 500)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs_each: int = 8, ridge: float = 1e-3, steps: int = 30) -> Model:
    """Newton steps on the logistic loss of preference pairs (one of label 1 over one of label 0)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    scale[scale < 1e-9] = 1
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(WIDTH), 0.0, base=len(good) / len(x) if len(x) else 0.5)
    rng = np.random.default_rng(7)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    one = np.repeat(few, max(pairs_each, -(-len(many) // len(few))))
    other = np.resize(rng.permutation(many), len(one))
    sign = 1.0 if few is good else -1.0
    z = (x - mean) / scale
    d = sign * (z[one] - z[other])
    w = np.zeros(WIDTH)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    q = len(bad) / (len(good) + len(bad))
    ordered = np.sort(raw)
    k = min(max(int(round(q * len(ordered))), 1), len(ordered) - 1)
    return Model(mean, scale, w, float((ordered[k - 1] + ordered[k]) / 2))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, pairs_each: int = 8) -> Model:
    """labels: doc_id and quality; only those given are learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__y"))
    chosen = usable.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_labels)  # at most max_labels small rows, so a broadcast is bounded
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # of rows that repeat a doc_id and label the one of the least features, so that there are as many as labels
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    return bradley_terry(np.array([r["x"] for r in found]).reshape(len(found), WIDTH), np.array([r["y"] for r in found], int), pairs_each)


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        x = [features(t) for t in texts.to_pylist()]
        return pa.array(model.score(np.array(x).reshape(len(x), WIDTH)), pa.float64())

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(doc_crc(labels["doc_id"]) % 3 != 1))
    out = docs.select("doc_id", (doc_crc(docs["doc_id"]) % 3 == 1).alias("held_out"), score(docs["text"], model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


SQL: dict[str, str] = {}
