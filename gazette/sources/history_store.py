"""Click histories as a bucketed table: as-of lookups by user without a shuffle.

A user's clicks are cut into chunks in the order of time. Each chunk also holds the end of the chunk before it, so that the last clicks before
any moment lie in one chunk: an impression meets one row, and no list is longer than a chunk and the cap.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Clicks to a chunk, and how many of the chunk before it a chunk holds at most.
CHUNK, CAP = 256, 50


def numbered_clicks(clicks: DataFrame) -> DataFrame:
    """clicks with n, the number of a click among its user's by (time, event), from 1; those without a time come first.

    Numbered within days, and days by the clicks before them: no task sorts all clicks of a user.
    """
    c = clicks.select("user_id", "article_id", "clicked_at", "event_id", F.coalesce(F.to_date("clicked_at"), F.lit("0001-01-01").cast("date")).alias("day"))
    days = c.groupBy("user_id", "day").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.col("clicked_at").asc_nulls_first(), "event_id"))
    return c.withColumn("here", here).join(days.select("user_id", "day", before.alias("before")), ["user_id", "day"]).select("user_id", "article_id", "clicked_at", "event_id", (F.col("before") + F.col("here")).alias("n"))


def chunks(clicks: DataFrame, chunk: int = CHUNK, cap: int = CAP) -> DataFrame:
    """user_id, part, from_at (time of the chunk's first click), until_at (that of the next chunk's; null: none), entries: the last cap clicks before the chunk, and its own, oldest first."""
    n = numbered_clicks(clicks).withColumn("part", F.floor((F.col("n") - 1) / chunk))
    near_end = (F.col("n") - 1) % chunk >= chunk - cap
    if cap > chunk:
        raise ValueError("a chunk must hold as many clicks as the cap")
    held = n.withColumn("to", F.explode(F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    entry = F.struct("n", "article_id", "clicked_at", "event_id")
    own = F.col("to") == 0
    g = held.groupBy("user_id", (F.col("part") + F.col("to")).alias("part")).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.min_by(F.when(own, F.struct("clicked_at")), F.when(own, F.col("n"))).alias("first"))
    g = g.where("first IS NOT NULL")  # the end of a user's last chunk has no chunk after it
    on = F.lead("first").over(Window.partitionBy("user_id").orderBy("part"))
    # a chunk that begins without a time begins before everything; only the first ones of a user can
    early = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return g.withColumn("next", on).select("user_id", "part", F.coalesce("first.clicked_at", early).alias("from_at"), F.when(F.col("next").isNotNull(), F.coalesce("next.clicked_at", early)).alias("until_at"), "entries")


class HistoryStore:
    """A bucketed table of chunks, named or (where no name is given) of its own and dropped by close(); `with` closes it as well."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, own: list[str]):
        self.spark, self.name, self.buckets, self.own = spark, name, buckets, own

    @classmethod
    def build(cls, clicks: DataFrame, name: str | None = None, buckets: int = 8, chunk: int = CHUNK, cap: int = CAP) -> HistoryStore:
        """Writes clicks (user_id, article_id, clicked_at, event_id) into the warehouse, bucketed by user and sorted; an existing table of the name is replaced."""
        spark = clicks.sparkSession
        table = name or f"gazette_history_{uuid.uuid4().hex}"
        store = cls(spark, table, buckets, [] if name else [table])
        store._write(chunks(clicks, chunk, cap), table, "user_id", "from_at")
        return store

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> HistoryStore:
        """A store that an earlier session built."""
        found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        return cls(spark, name, int(found["Num Buckets"]), [])

    def _write(self, df: DataFrame, table: str, *order: str) -> None:
        # one task for each bucket writes one file for it
        df.repartition(self.buckets, "user_id").write.mode("overwrite").bucketBy(self.buckets, "user_id").sortBy(*order).option("compression", "zstd").saveAsTable(table)

    def bucketed(self, impressions: DataFrame) -> DataFrame:
        """impression_id, user_id, ts as a table of the same buckets: written once, met often."""
        table = f"gazette_impressions_{uuid.uuid4().hex}"
        self._write(impressions.select("impression_id", "user_id", "ts").distinct(), table, "user_id", "ts")
        self.own.append(table)
        return self.spark.table(table)

    def as_of(self, impressions: DataFrame, cap: int = CAP) -> DataFrame:
        """impression_id, user_id, ts, history: the last cap clicks strictly before each impression, oldest first (empty if none).

        impressions as bucketed() gives them are joined in place, without an exchange; any others are shuffled alone. cap: at most that of build().
        """
        found = self.spark.table(self.name).withColumnRenamed("user_id", "__user")
        here = (F.col("user_id") == F.col("__user")) & (F.col("from_at") < F.col("ts")) & (F.col("until_at").isNull() | (F.col("until_at") >= F.col("ts")))
        # the bucketed side must not be broadcast away; a merge keeps both where they lie
        j = impressions.select("impression_id", "user_id", "ts").hint("merge").join(found, here, "left")
        past = F.filter("entries", lambda x: x["clicked_at"].isNull() | (x["clicked_at"] < F.col("ts")))
        some = F.slice(past, F.greatest(F.size(past) - cap, F.lit(0)) + 1, cap)
        entry = lambda x: F.struct(x["clicked_at"].alias("clicked_at"), x["event_id"].alias("event_id"), x["article_id"].alias("article_id"))
        j = j.withColumn("history", F.transform(some, entry))
        none = F.array().cast(j.schema["history"].dataType)
        return j.select("impression_id", "user_id", "ts", F.coalesce("history", none).alias("history"))

    def close(self) -> None:
        for table in self.own:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.own.clear()

    def __enter__(self) -> HistoryStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
