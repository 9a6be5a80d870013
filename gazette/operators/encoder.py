"""A trained user encoder: additive attention over a history's vectors, fitted by distributed gradient descent.

weights = softmax(v . tanh(W h + b)) over the history, user = unit weighted sum, score = user . candidate; the loss is the
cross-entropy of an impression's first clicked candidate among its candidates. Each epoch sends the parameters out, every partition
sums its gradient over Arrow batches, partial gradients are added up in a tree, and the driver holds parameters alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.impressions import history_rows
from gazette.operators.reuse import reused


@dataclass
class Encoder:
    """w: (width, dimension), b and v: (width); losses: the mean loss before each step."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, dimension: int, width: int, seed: int = 42) -> Encoder:
        """Uniform within the square root of 1 / inputs, the same for a seed."""
        rng = np.random.default_rng(seed)
        a, c = dimension**-0.5, width**-0.5
        return cls(rng.uniform(-a, a, (width, dimension)), rng.uniform(-a, a, width), rng.uniform(-c, c, width))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w.ravel(), self.b, self.v])

    def of(self, flat: np.ndarray) -> Encoder:
        n, m = self.w.size, len(self.b)
        return Encoder(flat[:n].reshape(self.w.shape), flat[n : n + m], flat[n + m :], self.losses)


def packed(cand: DataFrame, histories: DataFrame, vectors: DataFrame) -> DataFrame:
    """A row for each impression: hist (vectors of its history one after another, latest first; those without one left out), and in the order of
    positions cands (vectors one after another, of those that have one), has (whether they have), labels, pos. Lists are as long as the history's cap and the pool."""
    flat = lambda xs: F.flatten(F.transform(xs, lambda x: x["vec"]))
    vec = vectors.where("vec IS NOT NULL").select("article_id", "vec")
    h = history_rows(histories).join(vec, "article_id").groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("back", "vec"))).alias("hs")).select("impression_id", flat(F.col("hs")).alias("hist"))
    c = cand.join(vec, "article_id", "left").groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "vec"))).alias("cs"))
    c = c.select("impression_id", flat(F.filter("cs", lambda x: x["vec"].isNotNull())).alias("cands"), F.transform("cs", lambda x: x["vec"].isNotNull()).alias("has"), F.transform("cs", lambda x: x["label"].cast("int")).alias("labels"), F.transform("cs", lambda x: x["pos"]).alias("pos"))
    none = F.array().cast(h.schema["hist"].dataType)
    return c.join(h, "impression_id", "left").withColumn("hist", F.coalesce("hist", none))


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and where each row begins (with the end)."""
    col = batch.column(name)
    sizes = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]


def training_examples(cand: DataFrame, histories: DataFrame, vectors: DataFrame, most: int = 50) -> DataFrame:
    """impression_id, hist, cands, target (which of cands is the first clicked one). Of each impression the first `most` candidates count;
    impressions without a history's vector, or whose first clicked candidate has none, teach nothing and are left out."""
    rows = packed(cand.where(F.col("pos") <= most), histories, vectors).withColumn("first", F.array_position("labels", 1))
    at = lambda n: F.size(F.filter(F.slice("has", F.lit(1), n), lambda x: x))
    rows = rows.where("first > 0 AND size(hist) > 0").where(F.element_at("has", F.col("first").cast("int")))
    return rows.select("impression_id", "hist", "cands", (at(F.col("first").cast("int")) - 1).alias("target"))


def _encode(e: Encoder, h: np.ndarray, starts: np.ndarray):
    """Weights, activations and unnormed user vectors of histories that begin at starts."""
    z = np.tanh(h @ e.w.T + e.b)
    s = z @ e.v
    n = np.diff(np.r_[starts, len(h)])
    a = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    a /= np.repeat(np.add.reduceat(a, starts), n)
    return a, z, np.add.reduceat(a[:, None] * h, starts, axis=0), n


def gradient(e: Encoder, h: np.ndarray, h_starts: np.ndarray, c: np.ndarray, c_starts: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of losses of some examples and of their gradients. h, c: vectors of all histories and of all candidates; starts: where an example's begin."""
    a, z, u, hn = _encode(e, h, h_starts)
    norm = np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    unit = u / norm
    cn = np.diff(np.r_[c_starts, len(c)])
    logit = np.einsum("ij,ij->i", c, np.repeat(unit, cn, axis=0))
    top = np.maximum.reduceat(logit, c_starts)
    p = np.exp(logit - np.repeat(top, cn))
    total = np.add.reduceat(p, c_starts)
    hit = c_starts + target
    loss = float((np.log(total) + top - logit[hit]).sum())
    p /= np.repeat(total, cn)
    p[hit] -= 1
    d_unit = np.add.reduceat(p[:, None] * c, c_starts, axis=0)
    d_u = (d_unit - unit * np.einsum("ij,ij->i", d_unit, unit)[:, None]) / norm
    d_a = np.einsum("ij,ij->i", h, np.repeat(d_u, hn, axis=0))
    d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, h_starts), hn))
    d_pre = d_s[:, None] * e.v * (1 - z * z)
    return loss, np.concatenate([(d_pre.T @ h).ravel(), d_pre.sum(0), z.T @ d_s])


_PART = "part long, n long, loss double, grad binary"


def _added(t: pa.Table, key: int) -> pa.Table:
    """Partial sums added in the order of their parts, so that a sum does not depend on which came first."""
    t = t.sort_by("part")
    grad = np.zeros(len(t.column("grad")[0].as_py()) // 8)
    for g in t.column("grad"):
        grad += np.frombuffer(g.as_py())
    return pa.table({"part": [key], "n": [sum(t.column("n").to_pylist())], "loss": [math.fsum(t.column("loss").to_pylist())], "grad": pa.array([grad.tobytes()], pa.binary())})


def summed_gradient(examples: DataFrame, e: Encoder, fan_in: int = 64) -> tuple[int, float, np.ndarray]:
    """The number of examples, the sum of their losses and of their gradients: a partial sum for each partition, then a tree whose nodes add fan_in of them."""
    sent = examples.sparkSession.sparkContext.broadcast(e)
    dimension = e.w.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, loss, grad = 0, 0.0, np.zeros(len(sent.value.flat()))
        for b in batches:
            if b.num_rows:
                (h, ho), (c, co) = lists(b, "hist"), lists(b, "cands")
                more, g = gradient(sent.value, h.reshape(-1, dimension).astype(np.float64), ho[:-1] // dimension, c.reshape(-1, dimension).astype(np.float64), co[:-1] // dimension, b.column("target").to_numpy())
                n, loss, grad = n + b.num_rows, loss + more, grad + g
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["part", "n", "loss", "grad"])

    parts = examples.select("hist", "cands", "target").mapInArrow(part, _PART)
    left = examples.rdd.getNumPartitions()
    while left > fan_in:
        left = -(-left // fan_in)
        parts = parts.groupBy((F.col("part") % left).alias("node")).applyInArrow(lambda key, t: _added(t, key[0].as_py()), _PART)
    rows = sorted(parts.collect(), key=lambda r: r.part)  # fan_in rows at most, of the size of the parameters
    sent.unpersist()
    grad = np.zeros(len(e.flat()))
    for r in rows:
        grad += np.frombuffer(bytes(r.grad))
    return sum(r.n for r in rows), math.fsum(r.loss for r in rows), grad


def train(examples: DataFrame, dimension: int, width: int = 16, epochs: int = 12, rate: float = 0.05, seed: int = 42, decay: float = 1e-5, fan_in: int = 64) -> Encoder:
    """An encoder by full-batch descent with moments (Adam), gradients cut at norm 1, a rate that falls to a tenth by a cosine. No examples: as it started."""
    examples = reused(examples, "attention-examples")
    e = Encoder.start(dimension, width, seed)
    m, s = np.zeros(len(e.flat())), np.zeros(len(e.flat()))
    for step in range(1, epochs + 1):
        n, loss, g = summed_gradient(examples, e, fan_in)
        if not n:
            break
        e.losses.append(loss / n)
        flat = e.flat()
        g = g / n + decay * flat
        g /= max(1.0, float(np.linalg.norm(g)))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        now = rate * (0.1 + 0.9 * (1 + math.cos(math.pi * (step - 1) / epochs)) / 2)
        e = e.of(flat - now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8))
    return e


def encoded_users(histories: DataFrame, vectors: DataFrame, e: Encoder) -> DataFrame:
    """impression_id, u: the unit vector that an encoder makes of each history with a vector."""
    sent = histories.sparkSession.sparkContext.broadcast(e)
    dimension = e.w.shape[1]
    vec = vectors.where("vec IS NOT NULL").select("article_id", "vec")
    rows = history_rows(histories).join(vec, "article_id").groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("back", "vec"))).alias("hs"))
    rows = rows.select("impression_id", F.flatten(F.transform("hs", lambda x: x["vec"])).alias("hist"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h, starts = lists(b, "hist")
                u = _encode(sent.value, h.reshape(-1, dimension).astype(np.float64), starts[:-1] // dimension)[2]
                u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column("impression_id"), pa.ListArray.from_arrays(np.arange(0, u.size + 1, dimension, dtype=np.int32), u.ravel())], ["impression_id", "u"])

    kind = histories.schema["impression_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"impression_id {kind}, u array<double>")
