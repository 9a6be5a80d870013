"""Parameter sweeps: every setting of a grid evaluated in one pass over the impressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators import metrics as M
from gazette.operators.encoder import lists, packed
from gazette.operators.scoring import TINY

CAPS, DECAYS = [5, 10, 15, 20, 30, 50], [0.7, 0.8, 0.85, 0.9, 0.95, 1.0]


def folded_users(h: np.ndarray, caps: list[int], decays: list[float]) -> np.ndarray:
    """Unit user vectors, a row for each cap and decay, of a history's vectors, latest first.

    Each click is folded once: running sums under each decay, of which every cap takes the one where it ends.
    """
    if not len(h):
        return np.zeros((len(caps) * len(decays), h.shape[1]))
    n = min(max(caps), len(h))
    weight = np.array(decays)[None, :] ** np.arange(n)[:, None]
    run = np.cumsum(weight[:, :, None] * h[:n, None, :], axis=0)
    u = np.concatenate([run[min(c, n) - 1] for c in caps])
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return u / np.where(norm == 0, 1, norm)


def list_metrics(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A row (auc, mrr, ndcg5, ndcg10) for each row of scores over the candidates in the order of positions; ties go by position, in AUC they count half."""
    n, clicks = len(labels), int(labels.sum())
    out = np.zeros((len(scores), 4))
    out[:, 0] = 0.5
    if not clicks:
        return out
    hit = labels[np.argsort(-scores, axis=1, kind="stable")]
    out[:, 1] = 1 / (hit.argmax(1) + 1)
    gain = 1 / np.log2(np.arange(n) + 2)
    for i, k in ((2, 5), (3, 10)):
        out[:, i] = hit[:, :k] @ gain[:k] / gain[: min(clicks, k)].sum()
    if clicks < n:
        for row, s in enumerate(scores):
            lose = np.sort(s[labels == 0])
            won = s[labels == 1]
            out[row, 0] = (np.searchsorted(lose, won, "left") + np.searchsorted(lose, won, "right")).sum() / (2 * clicks * (n - clicks))
    return out


def user_vector_sweep(cand: DataFrame, histories: DataFrame, vectors: DataFrame, dimension: int, caps: list[int] = CAPS, decays: list[float] = DECAYS) -> DataFrame:
    """cap, decay, n_impressions and the means of auc, mrr, ndcg5, ndcg10 of the cosine ranking under every cap of the history and decay by place.

    histories must reach back as far as the largest cap. Places count the clicks that have a vector. Impressions without a history keep all
    scores 0, and count; every setting has the same impressions. A task adds its impressions up, so a row for each setting and task is shuffled.
    """
    grid = [(c, d) for c in caps for d in decays]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(grid), 4)), 0
        for b in batches:
            (h, ho), (c, co), (has, lo), (labels, _) = (lists(b, x) for x in ("hist", "cands", "has", "labels"))
            h, c, has, labels = h.reshape(-1, dimension).astype(np.float64), c.reshape(-1, dimension).astype(np.float64), has.astype(bool), labels.astype(np.int64)
            ho, co = ho // dimension, co // dimension
            for i in range(b.num_rows):
                mine = slice(lo[i], lo[i + 1])
                scores = np.zeros((len(grid), lo[i + 1] - lo[i]))
                scores[:, has[mine]] = folded_users(h[ho[i] : ho[i + 1]], caps, decays) @ c[co[i] : co[i + 1]].T
                total += list_metrics(np.round(scores + TINY, 6), labels[mine])
            n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in grid]), pa.array([x for _, x in grid]), pa.array([n] * len(grid)), *[pa.array(total[:, i].copy()) for i in range(4)]], ["cap", "decay", "n", *M.METRICS])

    sums = packed(cand, histories, vectors).select("hist", "cands", "has", "labels").mapInArrow(run, "cap long, decay double, n long, auc double, mrr double, ndcg5 double, ndcg10 double")
    return sums.groupBy("cap", "decay").agg(F.sum("n").alias("n_impressions"), *[F.round(F.sum(m) / F.sum("n"), 6).alias(m) for m in M.METRICS])


def share_sweep(scored: DataFrame, one: str, other: str, shares: list[float], name: str = "beta") -> DataFrame:
    """name, n_impressions, means of auc, mrr, ndcg5, ndcg10, best: the blends share * minmax(one) + (1 - share) * minmax(other) for every share.

    scored has both scores once; the grid is a handful of rows that each candidate is multiplied by. best marks the share with the largest mean AUC, the smallest of equal ones.
    """
    from gazette.operators.scoring import minmax

    both = scored.select("impression_id", "pos", "label", minmax(F.col(one)).alias("a"), minmax(F.col(other)).alias("b"))
    s = both.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias(name))
    s = s.withColumn("score", F.round(F.col(name) * F.col("a") + (1 - F.col(name)) * F.col("b") + TINY, 6))
    by = ["impression_id", name]
    means = M.mean_of(M.per_impression(M.ranked_within(s, *by), by=by), M.METRICS, name)
    top = means.agg(F.max_by(name, F.struct("auc", -F.col(name))).alias("__top"))
    return means.join(F.broadcast(top)).withColumn("best", F.col(name) == F.col("__top")).drop("__top")
