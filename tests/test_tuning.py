"""Sweeps and the trained encoder against single runs and plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.operators import encoder as E
from gazette.operators import impressions as I
from gazette.operators import metrics as M
from gazette.operators import scoring as S
from gazette.operators import sweeps as W
from gazette.plans import tuning

SF = "/root/testdata/sf0.001"


def some_examples(rng, n, d):
    rows = []
    for _ in range(n):
        c = rng.integers(1, 7)
        rows.append((rng.standard_normal((rng.integers(1, 9), d)), rng.standard_normal((c, d)), int(rng.integers(0, c))))
    return rows


def plain_loss(e, rows):
    """Impression by impression, straight from the definition."""
    total = 0.0
    for h, c, t in rows:
        s = np.tanh(h @ e.w.T + e.b) @ e.v
        a = np.exp(s) / np.exp(s).sum()
        u = a @ h
        x = c @ (u / np.linalg.norm(u))
        total += np.log(np.exp(x).sum()) - x[t]
    return total


def stacked(rows):
    starts = lambda xs: np.r_[0, np.cumsum([len(x) for x in xs])[:-1]]
    h, c = [r[0] for r in rows], [r[1] for r in rows]
    return np.concatenate(h), starts(h), np.concatenate(c), starts(c), np.array([r[2] for r in rows])


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    e, rows = E.Encoder.start(5, 3), some_examples(rng, 20, 5)
    loss, g = E.gradient(e, *stacked(rows))
    assert loss == pytest.approx(plain_loss(e, rows))
    flat = e.flat()
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert g[i] == pytest.approx((plain_loss(e.of(flat + step), rows) - plain_loss(e.of(flat - step), rows)) / 2e-6, abs=1e-5)


def frame(spark, rows, parts):
    data = [(h.ravel().tolist(), c.ravel().tolist(), t) for h, c, t in rows]
    return spark.createDataFrame(data, "hist array<double>, cands array<double>, target int").repartition(parts)


def test_sums_over_partitions_and_trees(spark):
    rng = np.random.default_rng(2)
    e, rows = E.Encoder.start(4, 2), some_examples(rng, 60, 4)
    loss, g = E.gradient(e, *stacked(rows))
    for parts, fan_in in ((1, 64), (5, 64), (12, 3)):  # the last: a tree of two levels
        n, total, grad = E.summed_gradient(frame(spark, rows, parts), e, fan_in)
        assert n == 60 and total == pytest.approx(loss) and np.allclose(grad, g)


def test_training_finds_what_matters(spark):
    """Only the first coordinate of a history item tells whether it counts: the loss falls, and scores get better than those of the mean."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        h = rng.standard_normal((8, 6)) * [0, 1, 1, 1, 1, 1]
        h[0, 0] = 2.0
        c = rng.standard_normal((5, 6)) * [0, 1, 1, 1, 1, 1]
        c[2] = h[0] * [0, 1, 1, 1, 1, 1]
        rows.append((h, c, 2))
    e = E.train(frame(spark, rows, 4), 6, width=4, epochs=25, rate=0.1)
    assert len(e.losses) == 25 and e.losses[-1] < 0.8 * e.losses[0] and all(b < a + 0.01 for a, b in zip(e.losses, e.losses[1:]))
    assert plain_loss(e, rows) < 0.8 * plain_loss(E.Encoder(e.w * 0, e.b * 0, e.v * 0), rows)
    again = E.train(frame(spark, rows, 4), 6, width=4, epochs=3, rate=0.1)
    assert np.allclose(again.losses, E.train(frame(spark, rows, 7), 6, width=4, epochs=3, rate=0.1).losses)
    none = E.train(frame(spark, rows, 1).limit(0), 6)
    assert none.losses == [] and (none.w == E.Encoder.start(6, 16).w).all()


def test_examples(spark):
    """The first clicked candidate counts among those with a vector; what teaches nothing is left out."""
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 9)] + [(50, None)], "article_id long, vec array<float>")
    cand = spark.createDataFrame([("a", 1, 99, 0), ("a", 2, 3, 0), ("a", 3, 4, 1), ("a", 4, 5, 1), ("b", 1, 3, 0), ("c", 1, 50, 1), ("d", 1, 5, 1), ("e", 1, 2, 0), ("e", 2, 3, 1)], "impression_id string, pos int, article_id long, label int")
    hist = {"a": [1, 99, 2], "b": [1], "c": [1], "d": [99], "e": [7]}
    h = spark.createDataFrame([(k, None, [(x, None) for x in v]) for k, v in hist.items()], "impression_id string, ts timestamp_ntz, history array<struct<article_id:long,clicked_at:timestamp_ntz>>")
    got = {r.impression_id: r for r in E.training_examples(cand, h, vec).collect()}
    assert got.keys() == {"a", "e"} and list(got["a"].hist) == [2, 1, 1, 1] and list(got["a"].cands) == [3, 1, 4, 1, 5, 1] and got["a"].target == 1
    assert E.training_examples(cand, h, vec, most=1).count() == 0
    users = {r.impression_id: r.u for r in E.encoded_users(h, vec, E.Encoder.start(2, 3)).collect()}
    assert users.keys() == {"a", "b", "c", "e"} and all(np.linalg.norm(u) == pytest.approx(1) for u in users.values())


def test_trained_ranker(spark):
    r = tuning.attention_ranker(spark, SF).first()
    assert r.last_loss < r.first_loss and 0 <= r.auc <= 1 and r.n_impressions == I.candidates(spark, SF, "val").select("impression_id").distinct().count()


def test_sweep_equals_single_runs(spark):
    """Every article of these histories has a vector, so that places with and without gaps are the same."""
    got = {(r.cap, r.decay): r for r in tuning.user_vector_sweep(spark, SF).collect()}
    assert len(got) == 36
    cand, vec = I.candidates(spark, SF, "val"), I.unit_vectors(spark, SF)
    for cap, decay in ((5, 0.7), (20, 0.9), (50, 1.0)):
        users = S.user_vectors(I.as_of(cand, I.clicks(spark, SF), cap), vec, decay)
        scored = S.cosine(cand, users, vec).withColumn("score", F.round(F.col("score") + S.TINY, 6))
        one = M.mean_of(M.per_impression(S.rank(scored)), M.METRICS).first()
        assert all(got[cap, decay][m] == pytest.approx(one[m], abs=2e-6) for m in M.METRICS) and got[cap, decay].n_impressions == one.n_impressions


def test_folding_and_metrics_of_lists(spark):
    rng = np.random.default_rng(4)
    h = rng.standard_normal((13, 3))
    u = W.folded_users(h, [2, 40], [0.5, 1.0])
    for row, (cap, decay) in zip(u, [(2, 0.5), (2, 1.0), (40, 0.5), (40, 1.0)]):
        v = sum(decay**i * x for i, x in enumerate(h[:cap]))
        assert np.allclose(row, v / np.linalg.norm(v))
    assert (W.folded_users(h[:0], [2], [1.0]) == 0).all()
    scores = rng.integers(0, 4, (6, 9)) / 4
    labels = rng.integers(0, 2, 9)
    rows = [(f"{i}", p, float(s), int(y)) for i, r in enumerate(scores) for p, (s, y) in enumerate(zip(r, labels))]
    df = spark.createDataFrame(rows, "impression_id string, pos int, score double, label int").withColumn("article_id", F.col("pos"))
    want = {r.impression_id: r for r in M.per_impression(S.rank(df)).collect()}
    for i, row in enumerate(W.list_metrics(scores, labels)):
        assert np.allclose(row, [want[str(i)][m] for m in M.METRICS])
    assert W.list_metrics(scores, labels * 0)[0].tolist() == [0.5, 0, 0, 0] and W.list_metrics(scores, labels * 0 + 1)[0, 0] == 0.5


def test_no_impressions(spark):
    cand, vec = I.candidates(spark, SF, "val").limit(0), I.unit_vectors(spark, SF)
    h = I.as_of(cand, I.clicks(spark, SF), 50)
    assert W.user_vector_sweep(cand, h, vec, 64).count() == 0 and E.encoded_users(h, vec, tuning.by_rule()).count() == 0
