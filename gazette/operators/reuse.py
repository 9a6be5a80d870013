"""Tables that one plan reads several times, and joins that must not multiply rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_kept: list[DataFrame] = []
_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, gone when the session's process ends; where that is unset, in a folder of our own, in plain local mode alone."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own = _own or tempfile.mkdtemp(prefix="gazette-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Lets go of all that reused() and shared_path() made so far: kept tables leave the cache, written ones their folder. Results that still need them must have been read."""
    while _kept:
        _kept.pop().unpersist()
    while _written:
        remove(*_written.pop())


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before us
        pass


def reused(df: DataFrame, name: str, now: bool = False, rows: int = 0) -> DataFrame:
    """df, made once: written to the folder of spark.checkpoint.dir, or where that is unset kept by the session (and made again if a part is lost).

    Both go with release(), or when the session's process ends. now: written in any case,
    for a df whose sources are about to go. rows: of large rows, how many go into a file, the least that a task reads.
    """
    spark = df.sparkSession
    if now or spark.conf.get("spark.checkpoint.dir", None):
        path = shared_path(spark, name)
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    _kept.append(df.persist())
    return _kept[-1]


def small(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has at most this many rows, which are counted here and now; else the join shuffles, and adaptive execution splits its skewed keys."""
    return F.broadcast(df) if df.count() <= most else df


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which every key occurs once on the right; a repeated key is an error when it is met, so rows never multiply."""
    once = right.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in right.columns if c not in keys])
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("a key occurs several times: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
    return left.join(once.where(checked).drop("__n"), keys, how)
