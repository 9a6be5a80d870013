"""Tables and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet with zstd; by: a partition column."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table, then takes its place: a reader sees the old rows or the new ones, and df may read the table itself."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").option("compression", "zstd").parquet(new)
    at = {x: jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, old)}
    fs = at[path].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at[old], True)
    if fs.exists(at[path]):
        fs.rename(at[path], at[old])
    fs.rename(at[new], at[path])
    fs.delete(at[old], True)


def score_name(dataset: str, retriever: str, **config) -> str:
    """One name for a score table, with its whole configuration."""
    return "_".join([dataset, retriever, *[f"{k}-{config[k]}" for k in sorted(config)]])


def score_table(ranked: DataFrame) -> DataFrame:
    """One row for each impression: ranked ids, scores and clicked ids as arrays."""
    g = ranked.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "score", "label"))).alias("xs"))
    pick = lambda c: F.transform("xs", lambda x: x[c])
    return g.select("impression_id", pick("article_id").alias("ranked_ids"), pick("score").alias("scores"), F.transform(F.filter("xs", lambda x: x["label"] == 1), lambda x: x["article_id"]).alias("ground_truth"))


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose keys new has not."""
    if old is None:
        return new
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_popularity(df: DataFrame, path: str) -> None:
    df.select(F.col("article_id").cast("string").alias("article_id"), "clicks").write.mode("overwrite").json(path)


def catalog_tag(ids: DataFrame) -> DataFrame:
    """One hash of a set of ids, from hashes of each: no list of all ids is built."""
    h = F.sha1(F.col("article_id").cast("string"))
    n = lambda i: F.bit_xor(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("long"))
    return ids.select("article_id").distinct().agg(F.sha1(F.concat_ws("-", n(0), n(1), F.count("*"))).alias("tag"))
