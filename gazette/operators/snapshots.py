"""Point-in-time choices: the last snapshot of a user at or before a moment, publications after a moment, first occurrences in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_snapshot(impressions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """impression_id, user_id, ts, snapshot_ts, history: of each impression's user the last snapshot (user_id, snapshot_ts, history) at or before it; null and empty if there is none.

    A user has one snapshot for each time. Moments are put in order within a user's days, and days by their last snapshot, so no task needs all of a user's;
    the lists themselves move once, to the impressions that chose them.
    """
    asks = impressions.select("impression_id", "user_id", "ts").distinct()
    marks = snapshots.where("snapshot_ts IS NOT NULL").select("user_id", F.col("snapshot_ts").alias("t"), F.col("snapshot_ts").alias("at"))
    both = marks.unionByName(asks.where("ts IS NOT NULL").select("user_id", F.col("ts").alias("t"), F.col("impression_id").alias("ask")), allowMissingColumns=True).withColumn("day", F.to_date("t"))
    # of equal moments the snapshot is first: "at or before"
    so_far = Window.partitionBy("user_id", "day").orderBy("t", F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("user_id", "day").agg(F.max("at").alias("m")).select("user_id", "day", F.max("m").over(before).alias("earlier"))
    chosen = both.withColumn("here", F.max("at").over(so_far)).where("ask IS NOT NULL").join(days, ["user_id", "day"]).select("ask", "user_id", F.coalesce("here", "earlier").alias("snapshot_ts"))
    held = chosen.join(snapshots.select("user_id", "snapshot_ts", "history"), ["user_id", "snapshot_ts"], "left").select("ask", "snapshot_ts", "history")
    none = F.array().cast(snapshots.schema["history"].dataType)
    return asks.join(held, F.col("impression_id") == F.col("ask"), "left").select("impression_id", "user_id", "ts", "snapshot_ts", F.coalesce("history", none).alias("history"))


def published_later(items: DataFrame, published: DataFrame, hours: int = 24, days: int = 7) -> DataFrame:
    """The rows of items (article_id, ts, any others) whose article (article_id once, published_at) came out more than `hours` after ts; rows without either time pass.

    An article meets its items by week: it stands once for every stretch of `days` up to its publication in which there are items at all, so the items of
    an article that a large share of rows shows are dealt out by their time.
    """
    bucket = lambda t: F.floor(F.unix_date(t.cast("date")) / days)
    cut = F.col("published_at") - F.expr(f"INTERVAL {hours} HOURS")
    dated = items.where("ts IS NOT NULL").withColumn("__b", bucket(F.col("ts")))
    span = dated.agg(F.min("__b").alias("lo"), F.max("__b").alias("hi"))
    p = published.where("published_at IS NOT NULL").select("article_id", "published_at", cut.alias("__cut")).join(F.broadcast(span))  # one row
    last = F.least(bucket(F.col("__cut")), F.col("hi"))
    p = p.where(last >= F.col("lo")).select("article_id", "published_at", "__cut", F.explode(F.sequence("lo", last)).alias("__b"))
    return dated.join(p, ["article_id", "__b"]).where(F.col("ts") < F.col("__cut")).drop("__b", "__cut")


def first_occurrences(rows: DataFrame, key: str, item: str, order: Column, entry: Column, *more: Column) -> DataFrame:
    """key, entries (the entry of each item where it first occurred, in that order), and aggregates of all rows of the key.

    order: a struct that tells rows apart. Each item keeps the least order by a sum that combines, so nothing is sorted but a key's own distinct items.
    """
    once = rows.groupBy(key, item).agg(F.min(order).alias("__o"), F.min_by(entry, order).alias("__e"))
    out = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__o", "__e"))).alias("__xs")).select(key, F.transform("__xs", lambda x: x["__e"]).alias("entries"))
    return out.join(rows.groupBy(key).agg(*more), key) if more else out
