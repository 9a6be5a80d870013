"""Ranking metrics by impression, population slices, beyond-accuracy measures, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ["auc", "mrr", "ndcg5", "ndcg10"]


def ranked_within(scored: DataFrame, *by: str) -> DataFrame:
    """scored with rank, 1 for the best score among rows with equal columns by; ties go by position."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "pos")))


def per_impression(ranked: DataFrame, ks: tuple[int, ...] = (5, 10), by: tuple[str, ...] | list[str] = ("impression_id",)) -> DataFrame:
    """The columns by (an impression, or an impression under a setting), n, clicks, recall<k>, mrr, ndcg<k>, auc.

    One aggregation by impression; AUC counts ties half, 0.5 where all labels are equal.
    """
    ties = Window.partitionBy(*by, "score")
    place = F.rank().over(Window.partitionBy(*by).orderBy("score")) + (F.count("*").over(ties) - 1) / 2
    hit = F.col("label") == 1
    gain = 1 / F.log2(F.col("rank") + 1.0)
    pos = F.sum("label")
    aggs = [F.count("*").alias("n"), pos.alias("clicks"), F.sum(F.when(hit, F.col("place"))).alias("places"), F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        aggs += [F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits{k}"), F.sum(F.when(hit & (F.col("rank") <= k), gain)).alias(f"dcg{k}")]
    g = ranked.withColumn("place", place).groupBy(*by).agg(*aggs)
    p, n = F.col("clicks"), F.col("n")
    auc = F.when((p == 0) | (p == n), 0.5).otherwise((F.col("places") - p * (p + 1) / 2) / F.when((p == 0) | (p == n), 1).otherwise(p * (n - p)))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(p, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = {f"recall{k}": F.when(p == 0, 0.0).otherwise(F.col(f"hits{k}") / F.greatest(p, F.lit(1))) for k in ks}
    out |= {"mrr": F.coalesce(1 / F.col("first"), F.lit(0.0)), "auc": auc}
    out |= {f"ndcg{k}": F.when(p == 0, 0.0).otherwise(F.coalesce(f"dcg{k}", F.lit(0.0)) / ideal(k)) for k in ks}
    return g.select(*by, "n", "clicks", *[v.alias(k) for k, v in out.items()])


def mean_of(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_impressions"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def user_slice(length: Column, threshold: int = 5) -> Column:
    return F.when(length <= threshold, "cold").otherwise("warm")


def article_slice(mean_popularity: Column, threshold: float = 10) -> Column:
    """No clicked article counts as popularity 0."""
    return F.when(F.coalesce(mean_popularity, F.lit(0.0)) <= threshold, "tail").otherwise("head")


def slices(cand: DataFrame, histories: DataFrame, train_popularity: DataFrame) -> DataFrame:
    """impression_id, slice: all, the user's and the article's slice, and both together (nine names in all)."""
    user = histories.select("impression_id", user_slice(F.size("history")).alias("u"))
    pop = cand.where("label = 1").join(train_popularity.select("article_id", "exposures"), "article_id", "left").groupBy("impression_id").agg(F.avg(F.coalesce("exposures", F.lit(0))).alias("p"))
    j = cand.select("impression_id").distinct().join(user, "impression_id", "left").join(pop, "impression_id", "left")
    j = j.select("impression_id", F.coalesce("u", F.lit("cold")).alias("u"), article_slice(F.col("p")).alias("a"))
    return j.select("impression_id", F.explode(F.array(F.lit("all"), "u", "a", F.concat("u", F.lit("_"), "a"))).alias("slice"))


def novelty(ranked: DataFrame, popularity: DataFrame, k: int = 10) -> DataFrame:
    """impression_id, novelty: mean -log2 of the share of exposures over the first k."""
    total = popularity.agg(F.sum("exposures").alias("total"))
    j = ranked.where(F.col("rank") <= k).join(popularity.select("article_id", "exposures"), "article_id", "left").join(F.broadcast(total))
    x = -F.log2(F.greatest(F.coalesce("exposures", F.lit(0)), F.lit(1)) / F.when(F.col("total") > 0, F.col("total")))
    return j.groupBy("impression_id").agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("novelty"))


def intra_list_diversity(ranked: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """impression_id, ild: mean 1 - cosine over pairs of the first k with a vector; under two of them 0.

    For unit vectors the pairs' sum follows from the vector sum, so no pair is formed.
    """
    from gazette.functions.vectors import dot, normalize, weighted_sum

    j = ranked.where(F.col("rank") <= k).join(vectors, "article_id").select("impression_id", "rank", normalize(F.col("vec")).alias("vec"))
    g = j.groupBy("impression_id").agg(F.count("*").alias("m"), F.array_sort(F.collect_list(F.struct("rank", F.lit(1.0).alias("w"), "vec"))).alias("items"))
    g = g.select("impression_id", "m", weighted_sum(F.col("items"), "vec", "w").alias("s"), F.aggregate("items", F.lit(0.0), lambda a, e: a + dot(e["vec"], e["vec"])).alias("own"))
    pairs = F.col("m") * (F.col("m") - 1)
    ild = F.when(F.col("m") < 2, 0.0).otherwise(1 - (dot(F.col("s"), F.col("s")) - F.col("own")) / F.greatest(pairs, F.lit(1)))
    return ranked.select("impression_id").distinct().join(g.select("impression_id", ild.alias("ild")), "impression_id", "left").fillna(0.0, ["ild"])


def coverage(ranked: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Distinct articles among the first k over all candidates' articles."""
    shown = ranked.where(F.col("rank") <= k).agg(F.countDistinct("article_id").alias("shown"))
    of = catalog.agg(F.countDistinct("article_id").alias("catalog"))
    return shown.join(of).select("shown", "catalog", F.round(F.col("shown") / F.nullif(F.col("catalog"), F.lit(0)), 6).alias("coverage"))


def summary(rows: DataFrame, by_slice: DataFrame, names: list[str]) -> DataFrame:
    """Means by slice, the share of the population, and a flag for slices of under 1 or over 99 percent."""
    j = rows.join(by_slice, "impression_id")
    total = rows.agg(F.count("*").alias("total"))
    g = mean_of(j, names, "slice").join(F.broadcast(total))
    share = F.col("n_impressions") / F.col("total")
    return g.withColumn("frac_population", F.round(share, 6)).withColumn("flagged", (F.col("slice") != "all") & ((share < 0.01) | (share > 0.99))).drop("total")


def poisson_weights(keys, resamples: int, seed: int):
    """A count of a Poisson law of mean 1 for each key (unsigned 64 bits) and resample, by hash: the same wherever it is drawn."""
    import numpy as np

    step, mult = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    z = (np.asarray(keys, np.uint64) * mult + np.uint64(seed))[:, None] ^ (np.arange(1, resamples + 1, dtype=np.uint64) * step)[None, :]
    z = (z ^ (z >> np.uint64(30))) * mult
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    p, law = np.exp(-1.0), []
    for k in range(1, 20):
        law.append(p)
        p /= k
    return np.searchsorted(np.cumsum(law), ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53).astype(np.float64)


def bootstrap(rows: DataFrame, metric: str, by: str, resamples: int = 1000, seed: int = 42, at_once: int = 512) -> DataFrame:
    """by, mean, ci_low, ci_high: Poisson bootstrap of the mean, percentiles 2.5 and 97.5.

    Each row draws its own multiplicity in every resample from a hash of its key, for at_once rows together, so a group is summed
    in any number of tasks: sums of resamples combine, no group gathers anywhere.
    """
    import numpy as np
    import pyarrow as pa

    def sums(batches):
        held: dict = {}
        for b in batches:
            keys, x, s = np.array(b.column("key").to_pylist(), object), b.column("x").to_numpy(zero_copy_only=False), b.column("s").to_numpy(zero_copy_only=False).view(np.uint64)
            for key in set(keys.tolist()):
                acc = held.setdefault(key, np.zeros((2, resamples + 1)))
                mine = np.flatnonzero(keys == key)
                for i in range(0, len(mine), at_once):
                    at = mine[i : i + at_once]
                    w = poisson_weights(s[at], resamples, seed)
                    acc[0, :-1] += w.sum(0)
                    acc[1, :-1] += x[at] @ w
                acc[0, -1] += len(mine)
                acc[1, -1] += x[mine].sum()
        for key, acc in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * (resamples + 1), pa.string()), pa.array(np.arange(resamples + 1, dtype=np.int32)), pa.array(acc[0]), pa.array(acc[1])], ["key", "r", "w", "wx"])

    keyed = rows.where(F.col(metric).isNotNull()).select(F.col(by).cast("string").alias("key"), F.col(metric).cast("double").alias("x"), F.xxhash64("impression_id").alias("s"))
    parts = keyed.mapInArrow(sums, "key string, r int, w double, wx double").groupBy("key", "r").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    own = F.max(F.when(F.col("r") == resamples, F.col("m")))
    again = F.when(F.col("r") < resamples, F.col("m"))
    return parts.groupBy(F.col("key").alias(by)).agg(own.alias("mean"), F.percentile(again, F.lit(0.025)).alias("ci_low"), F.percentile(again, F.lit(0.975)).alias("ci_high"))


def summary_with_intervals(rows: DataFrame, by_slice: DataFrame, metric: str, **options) -> DataFrame:
    """slice, n_impressions, frac_population, mean, ci_low, ci_high, status: no interval (insufficient_n) for slices of under 1 or over 99 percent."""
    small = summary(rows, by_slice, [metric]).select("slice", "n_impressions", "frac_population", "flagged")
    held = bootstrap(rows.join(by_slice, "impression_id"), metric, "slice", **options)
    bound = lambda c: F.when(~F.col("flagged"), F.col(c)).alias(c)
    return small.join(held, "slice", "left").select("slice", "n_impressions", "frac_population", "mean", bound("ci_low"), bound("ci_high"), F.when(F.col("flagged"), "insufficient_n").otherwise("ok").alias("status"))
