"""Score tables: one row for each impression with JSON arrays, the form in which runs hand their rankings on; and result tables kept by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the form, all text; the last five hold JSON arrays.
COLUMNS = ["impression_id", "user_id", "timestamp", "candidates", "labels", "ranked_ids", "scores", "ground_truth"]


def to_score_table(ranked: DataFrame) -> DataFrame:
    """The form of a ranking (impression_id, user_id, ts, pos, article_id, label, score, rank): candidates and labels by position, ranked ids and scores by rank."""
    g = ranked.groupBy("impression_id", "user_id", "ts").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "label"))).alias("c"), F.array_sort(F.collect_list(F.struct("rank", "article_id", "score"))).alias("r"))
    text = lambda xs, f: F.to_json(F.transform(xs, lambda x: x[f].cast("string") if f == "article_id" else x[f]))
    truth = F.to_json(F.transform(F.filter("c", lambda x: x["label"] == 1), lambda x: x["article_id"].cast("string")))
    return g.select(F.col("impression_id").cast("string").alias("impression_id"), F.col("user_id").cast("string").alias("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), text("c", "article_id").alias("candidates"), text("c", "label").alias("labels"), text("r", "article_id").alias("ranked_ids"), text("r", "score").alias("scores"), truth.alias("ground_truth"))


def write_scores(ranked: DataFrame, path: str) -> None:
    to_score_table(ranked).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """impression_id, user_id, ts, pos, article_id (text), label, score, rank: the long form of a score table, in its order.

    The columns are checked when the table is opened, the arrays when rows are met: arrays that aren't JSON, or that differ in length, or ranked ids
    that aren't the candidates, are errors that name the impression. A candidate that stands twice takes its last label. Null arrays are empty.
    """
    t = spark.read.parquet(path)
    lacks = [c for c in COLUMNS if c not in t.columns]
    other = [f"{f.name} is {f.dataType.simpleString()}" for f in t.schema if f.name in COLUMNS and f.dataType.simpleString() != "string"]
    if lacks or other:
        raise ValueError("no score table: " + ", ".join([*(f"{c} is missing" for c in lacks), *other]))
    kinds = {"candidates": "array<string>", "labels": "array<int>", "ranked_ids": "array<string>", "scores": "array<double>"}
    read = {c: F.from_json(F.coalesce(c, F.lit("[]")), k) for c, k in kinds.items()}
    t = t.select("impression_id", "user_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"), *[v.alias(c) for c, v in read.items()])
    sound = F.coalesce((F.size("candidates") == F.size("labels")) & (F.size("ranked_ids") == F.size("scores")) & (F.size(F.array_except("ranked_ids", "candidates")) == 0), F.lit(False))
    t = t.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a score row: impression "), F.coalesce("impression_id", F.lit("without an id"))))))
    last = F.map_from_entries(F.transform(F.array_distinct("candidates"), lambda c: F.struct(c, F.element_at(F.filter(F.arrays_zip("candidates", "labels"), lambda x: x["candidates"] == c), -1)["labels"])))
    rows = t.select("impression_id", "user_id", "ts", "candidates", last.alias("label_of"), F.posexplode(F.arrays_zip("ranked_ids", "scores")).alias("at", "x"))
    place = F.array_position("candidates", F.col("x.ranked_ids")).cast("int")
    return rows.select("impression_id", "user_id", "ts", place.alias("pos"), F.col("x.ranked_ids").alias("article_id"), F.coalesce(F.element_at("label_of", F.col("x.ranked_ids")), F.lit(0)).alias("label"), F.col("x.scores").alias("score"), (F.col("at") + 1).alias("rank"))


def upsert_in_place(df: DataFrame, path: str, key: str) -> None:
    """Replaces what a table holds under the keys of df and leaves all other keys alone.

    A key is a folder, so other keys are neither read nor written. New rows are staged beside the table and moved in when all tasks are done:
    a writer that fails leaves the old rows, of its own keys too. A null key is a key.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cached_by_content(spark: SparkSession, root: str, name: str, ids: DataFrame, make) -> DataFrame:
    """The table that make() gives for these ids (article_id), written once and found again, also by later sessions, under a tag of the set of ids.

    Other ids have another tag, so they make another table. It is written under a name of its own and renamed: a reader never
    sees half a table, and of two writers the second keeps the first's.
    """
    from gazette.sources.writers import catalog_tag

    path = f"{root.rstrip('/')}/{name}-{catalog_tag(ids).first().tag}"
    fs, at = _files(spark, path)
    if not fs.exists(at):
        fresh = f"{path}.{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(fresh)
        new = _files(spark, fresh)[1]
        # renaming onto a folder that came meanwhile would move into it
        if fs.exists(at) or not fs.rename(new, at):
            fs.delete(new, True)
    return spark.read.parquet(path)
