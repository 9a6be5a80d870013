"""The central relations, from the event log: articles, candidates of impressions, click histories, splits.

An impression is a user's week; its candidates are the items met in it in the order of first appearance, with label 1
if clicked or purchased; the history holds earlier clicks, strictly before the week begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VAL, TEST = "2024-01-15", "2024-01-22"
CAP = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(ts: Column, val: str = VAL, test: str = TEST) -> Column:
    """Half-open cut-offs; no time counts as train."""
    return F.when(ts >= F.lit(test).cast("timestamp_ntz"), "test").when(ts >= F.lit(val).cast("timestamp_ntz"), "val").otherwise("train")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("cleaned_text"), F.col("source").alias("category"), F.col("lang").alias("subcategory"))


def _events(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """split: only events whose week may begin in it, as a range of times that the scan can use."""
    e = table(spark, sf_dir, "events")
    t, at = F.col("ts"), lambda x: F.lit(x).cast("timestamp_ntz")
    ends = {"train": t.isNull() | (t < at(VAL) + F.expr("INTERVAL 7 DAYS")), "val": (t >= at(VAL)) & (t < at(TEST) + F.expr("INTERVAL 7 DAYS")), "test": t >= at(TEST)}
    e = e.where(ends[split]) if split else e
    return e.select("event_id", "ts", "user_id", "event_type", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("article_id"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), F.col("event_type").isin("click", "purchase").alias("clicked"))


def candidates(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """impression_id, user_id, ts, split, pos, article_id, label."""
    e = _events(spark, sf_dir, split)
    c = e.groupBy("user_id", "week", "article_id").agg(F.max(F.col("clicked").cast("int")).alias("label"), F.min(F.struct("ts", "event_id")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("first"))
    out = c.select(F.concat("user_id", F.lit("-"), F.date_format("week", "yyyyMMdd")).alias("impression_id"), "user_id", F.col("week").alias("ts"), split_of(F.col("week")).alias("split"), pos.alias("pos"), "article_id", "label")
    return out.where(F.col("split") == split) if split else out


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("clicked").select("user_id", "article_id", F.col("ts").alias("clicked_at"), "event_id")


def as_of(impressions: DataFrame, clicks: DataFrame, cap: int = CAP) -> DataFrame:
    """impression_id, user_id, ts, history: the last cap clicks strictly before each impression, oldest first (empty if none).

    Clicks are numbered within their user's days, and days by what lies before them, so no task needs all clicks of a user. Numbers cut the clicks into
    stretches of cap; an impression knows the number of the last click before it, so it meets two stretches, and no list is longer than twice the cap.
    A click without a time lies before all others. Impressions and clicks are dealt out once by user and day; the days' sums and their join stay there.
    """
    moves = clicks.select("user_id", F.col("clicked_at").alias("t"), "event_id", "article_id", F.lit(1).alias("click"))
    asks = impressions.select("impression_id", "user_id", "ts").distinct().select("impression_id", "user_id", F.col("ts").alias("t"), F.lit(0).alias("click"))
    both = moves.unionByName(asks, allowMissingColumns=True).withColumn("day", F.coalesce(F.to_date("t"), F.lit("0001-01-01").cast("date")))
    in_day = Window.partitionBy("user_id", "day").orderBy(F.col("t").asc_nulls_first(), "click", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    numbered = both.withColumn("n", F.sum("click").over(in_day))
    days = numbered.groupBy("user_id", "day").agg(F.max("n").alias("n")).select("user_id", "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = numbered.join(days, ["user_id", "day"]).withColumn("n", F.col("n") + F.col("before"))
    stretch = F.floor((F.col("n") - 1) / cap)
    entry = F.struct(F.col("t").alias("clicked_at"), "event_id", "article_id")
    held = numbered.where("click = 1").groupBy("user_id", stretch.alias("s")).agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("h")))).alias("hs"))
    need = numbered.where("click = 0").select("impression_id", "user_id", F.col("t").alias("ts"), F.col("n").alias("upto"), F.explode(F.when(F.col("n") % cap == 0, F.array(stretch)).otherwise(F.array(stretch - 1, stretch))).alias("s"))
    met = need.join(held, ["user_id", "s"], "left").groupBy("impression_id", "user_id", "ts", "upto").agg(F.flatten(F.array_sort(F.collect_list("hs"))).alias("hs"))
    last = F.filter("hs", lambda x: (x["n"] <= F.col("upto")) & (x["n"] > F.col("upto") - cap))
    return met.select("impression_id", "user_id", "ts", F.transform(last, lambda x: x["h"]).alias("history"))


def history_rows(histories: DataFrame) -> DataFrame:
    """impression_id, back (1: latest), article_id, clicked_at."""
    x = histories.select("impression_id", "ts", F.size("history").alias("n"), F.posexplode("history").alias("i", "h"))
    return x.select("impression_id", "ts", (F.col("n") - F.col("i")).alias("back"), "h.article_id", "h.clicked_at")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("vec"))


def popularity(cand: DataFrame) -> DataFrame:
    """article_id, exposures, clicks over the given candidates."""
    return cand.groupBy("article_id").agg(F.count("*").alias("exposures"), F.sum("label").alias("clicks"))
