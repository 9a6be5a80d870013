"""Queries that tune and train: sweeps of user vectors and blends, the trained attention encoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gazette.operators import encoder as E
from gazette.operators import impressions as I  # noqa: E741
from gazette.operators import metrics as M
from gazette.operators import scoring as S
from gazette.operators import sweeps as W
from gazette.plans import registry as R
from gazette.plans.prelude import PARTS, cosine_part, history_part, metric_part, mm, unit_part
from gazette.plans.registry import query

#: Length of the vectors of the table embeddings.
DIMENSION = 64
_KEYS = "impression_id, cap, decay"

PARTS |= {
    "hist50": history_part(max(W.CAPS)),
    "grid": f"SELECT * FROM (SELECT unnest({W.CAPS}) AS cap), (SELECT unnest({W.DECAYS})::DOUBLE AS decay)",
    "users36": unit_part("SELECT impression_id, cap, decay, d, sum(x * pow(decay, back - 1)) AS v FROM hist50 JOIN emb USING (article_id), grid WHERE back <= cap GROUP BY ALL", "impression_id", "cap", "decay"),
    "scores36": """SELECT concat(impression_id, '|', cap, '|', decay) AS impression_id, pos, label, round(coalesce(s, 0) + 1e-9, 6) AS score FROM (SELECT * FROM val, grid) v LEFT JOIN (
        SELECT impression_id, article_id, cap, decay, sum(u * x) AS s FROM (SELECT impression_id, article_id FROM val) v JOIN users36 USING (impression_id) JOIN emb USING (article_id, d) GROUP BY ALL) USING (impression_id, article_id, cap, decay)""",
    "ranked36": "SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM scores36",
    "metrics36": metric_part("ranked36"),
}
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in M.METRICS)


@query(f"SELECT CAST(split_part(impression_id, '|', 2) AS BIGINT) AS cap, CAST(split_part(impression_id, '|', 3) AS DOUBLE) AS decay, count(*) AS n_impressions, {_MEANS} FROM metrics36 GROUP BY 1, 2")
def user_vector_sweep(spark, d):
    """All caps of the history by all decays of a click's weight, each click folded once."""
    cand = I.candidates(spark, d, "val")
    return W.user_vector_sweep(cand, I.as_of(cand, I.clicks(spark, d), max(W.CAPS)), I.unit_vectors(spark, d), DIMENSION)


def _share_sweep(name, scored, part, one, other, shares, label="beta"):
    """A query of share_sweep() and its SQL over the named subquery that has both scores."""
    PARTS[f"sw_{name}"] = f"""SELECT concat(impression_id, '|', share) AS impression_id, pos, label, round(share * a + (1 - share) * b + 1e-9, 6) AS score FROM (
        SELECT impression_id, pos, label, {mm(one)} AS a, {mm(other)} AS b FROM {part}), (SELECT unnest({[float(x) for x in shares]})::DOUBLE AS share) g"""
    PARTS[f"sr_{name}"] = f"SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM sw_{name}"
    PARTS[f"sm_{name}"] = metric_part(f"sr_{name}")

    @query(f"SELECT *, row_number() OVER (ORDER BY auc DESC, {label}) = 1 AS best FROM (SELECT CAST(split_part(impression_id, '|', 2) AS DOUBLE) AS {label}, count(*) AS n_impressions, {_MEANS} FROM sm_{name} GROUP BY 1)")
    def f(spark, d):
        return W.share_sweep(scored(spark, d), one, other, shares, label)

    R.QUERIES[name], R.SQL[name] = R.QUERIES.pop("f"), R.SQL.pop("f")


PARTS |= {
    "withcat": "SELECT c.*, signal FROM cos c JOIN (SELECT impression_id, article_id, signal FROM catsig) USING (impression_id, article_id)",
    "proxied": f"""SELECT * EXCLUDE (p), {mm('p')} AS signal FROM (
        SELECT r.*, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY impression_id, coalesce(cat, '')) / sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY impression_id) AS p
        FROM rcos r LEFT JOIN kinds USING (article_id))""",
}
_share_sweep("blend_sweep_metrics", R._both, "both_", "score", "bm25", [0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0])
_share_sweep("popularity_sweep", R._with_popularity, "withpop", "score", "lp", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], "alpha")
_share_sweep("category_sweep", R._with_category, "withcat", "score", "signal", [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0])
_share_sweep("proxy_sweep", lambda s, d: S.proxy_signal(S.rank(R._cosine(s, d), "id"), I.articles(s, d)), "proxied", "score", "signal", [0.5, 0.7, 0.85, 1.0])


# ---- the trained encoder ----


def by_rule(dimension: int = DIMENSION, width: int = 4) -> E.Encoder:
    """An encoder whose parameters follow from their places, for what SQL can follow."""
    a = np.arange(1, width + 1)
    return E.Encoder(np.cos(np.outer(a, np.arange(1, dimension + 1))) / 4, np.zeros(width), 1.0 / a)


PARTS |= {
    "att_s": """SELECT impression_id, back, article_id, sum(tanh(z) / a) AS s FROM (
        SELECT impression_id, back, article_id, a, sum(x * cos(a * d) / 4) AS z FROM vhist JOIN emb USING (article_id), (SELECT unnest([1, 2, 3, 4]) AS a) GROUP BY ALL) GROUP BY ALL""",
    "att_u": unit_part("SELECT impression_id, d, sum(w * x) AS v FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY impression_id)) AS w FROM att_s) JOIN emb USING (article_id) GROUP BY ALL", "impression_id"),
    "att": cosine_part("att_u"),
}


@query("SELECT impression_id, article_id, pos, label, score FROM att")
def additive_attention(spark, d):
    """Scores of an encoder with parameters by rule: the way from a history to a score, held against SQL."""
    vec = I.unit_vectors(spark, d)
    users = E.encoded_users(R._history(spark, d), vec, by_rule())
    return S.cosine(I.candidates(spark, d, "val"), users, vec).select("impression_id", "article_id", "pos", "label", "score")


def trained_encoder(spark, d, **options) -> E.Encoder:
    """Fitted on the impressions of the training split, with their histories as of then."""
    vec = I.unit_vectors(spark, d)
    cand = I.candidates(spark, d, "train")
    return E.train(E.training_examples(cand, I.as_of(cand, I.clicks(spark, d), 50), vec), DIMENSION, **options)


def _trained(spark, d):
    vec = I.unit_vectors(spark, d)
    users = E.encoded_users(I.as_of(I.candidates(spark, d, "val"), I.clicks(spark, d), 50), vec, trained_encoder(spark, d))
    return S.rank(S.cosine(I.candidates(spark, d, "val"), users, vec))


@query()
def attention_ranker(spark, d):
    """The trained encoder on the validation split, which it has not seen: means of the metrics, and the mean training loss before the first and the last step."""
    vec = I.unit_vectors(spark, d)
    e = trained_encoder(spark, d)
    users = E.encoded_users(I.as_of(I.candidates(spark, d, "val"), I.clicks(spark, d), 50), vec, e)
    rows = M.per_impression(S.rank(S.cosine(I.candidates(spark, d, "val"), users, vec)))
    ends = (e.losses[0], e.losses[-1]) if e.losses else (None, None)
    return M.mean_of(rows, ["recall5", "recall10", *M.METRICS]).withColumns({"first_loss": F.lit(ends[0]).cast("double"), "last_loss": F.lit(ends[1]).cast("double")})
