"""Raw news logs and embeddings as DataFrames of one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.functions import parse
from gazette.functions.vectors import normalize
from gazette.operators.snapshots import first_occurrences

# The columns of the public log format, and the places where files of a data set may lie, best first.
NEWS = ["news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities"]
BEHAVIORS = ["impression_id", "user_id", "time", "history", "impressions"]

BEHAVIOR_FILES = ["test/behaviors.tsv", "*test*/behaviors.tsv", "behaviors.tsv"]
PARQUET_TESTS = ["test/behaviors.parquet", "*test*/test/behaviors.parquet", "*test*/behaviors.parquet"]
VECTOR_FILES = {"default": ["*document_vector*.parquet", "*/document_vector.parquet"], "w2v": ["*document_vector*.parquet", "*/document_vector.parquet"], "bert": ["*bert*.parquet", "*bert*/*.parquet"]}


def find_first(spark: SparkSession, root: str, patterns: list[str]) -> str:
    """The first path under root, in the order of the patterns and then of names; looked up by Spark's file systems, so any store will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{p}")
        if found := sorted(x.getPath().toString() for x in path.getFileSystem(conf).globStatus(path) or []):
            return found[0]
    raise FileNotFoundError(f"none of {', '.join(patterns)} under {root}")


def _tsv(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Tab-separated, no header, no quoting, all strings; missing fields are null, surplus ones go."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)


def mind_articles(spark: SparkSession, paths: list[str], last: bool = False) -> DataFrame:
    """Articles of several news files; of rows with one id that of the first file stays (last: the last)."""
    union = None
    for i, p in enumerate(paths):
        one = _tsv(spark, p, NEWS).withColumn("__file", F.lit(i))
        union = one if union is None else union.unionByName(one)
    order = F.col("__file").desc() if last else F.col("__file")
    chosen = union.withColumn("__n", F.row_number().over(Window.partitionBy("news_id").orderBy(order, "title", "url"))).where("__n = 1")
    return chosen.select(
        F.col("news_id").alias("article_id"), F.lit("mind").alias("dataset"), F.coalesce("title", F.lit("")).alias("title"), parse.none_if_empty(F.col("abstract")).alias("abstract"),
        F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("body_source"), parse.none_if_empty(F.col("category")).alias("category"), parse.none_if_empty(F.col("subcategory")).alias("subcategory"),
        parse.entities(F.col("title_entities"), F.col("abstract_entities")).alias("entities"), F.lit(None).cast("timestamp_ntz").alias("published_at"),
    )


def mind_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """article_id, text, category over train, dev and test files; the last file wins."""
    a = mind_articles(spark, paths, last=True)
    return a.select("article_id", F.concat_ws(" ", "title", "abstract").alias("text"), "category")


def mind_behaviors(spark: SparkSession, path, labelled: bool = True) -> DataFrame:
    """Impressions; without labels the candidates alone, and a bad time is null."""
    b = _tsv(spark, path, BEHAVIORS)
    cand = parse.impressions(F.col("impressions")) if labelled else parse.unlabelled(F.col("impressions"))
    b = b.select("impression_id", F.lit("mind").alias("dataset"), "user_id", parse.mind_time(F.col("time"), labelled).alias("ts"), parse.history(F.col("history")).alias("clicked_history"), cand.alias("c"))
    if not labelled:
        return b.withColumnRenamed("c", "candidates").where(F.size("candidates") > 0)
    return b.select("impression_id", "dataset", "user_id", "ts", "clicked_history", F.transform("c", lambda x: x["article_id"]).alias("candidates"), F.transform("c", lambda x: x["label"]).alias("labels"))


def ebnerd_articles(spark: SparkSession, path) -> DataFrame:
    a = spark.read.parquet(path)
    sub = F.transform("subcategory", lambda x: x.cast("string"))
    return a.select(
        F.col("article_id").cast("string").alias("article_id"), F.lit("ebnerd").alias("dataset"), F.coalesce("title", F.lit("")).alias("title"), parse.none_if_empty(F.col("subtitle")).alias("abstract"),
        parse.none_if_empty(F.col("body")).alias("body"), F.when(parse.none_if_empty(F.col("body")).isNotNull(), "native").alias("body_source"), parse.none_if_empty(F.col("category_str")).alias("category"),
        parse.none_if_empty(F.array_join(sub, ",")).alias("subcategory"), parse.tagged_entities(F.col("ner_clusters"), F.col("entity_groups")).alias("entities"), F.col("published_time").cast("timestamp_ntz").alias("published_at"),
    )


def ebnerd_behaviors(spark: SparkSession, path, history_path=None, labelled: bool = True) -> DataFrame:
    """Impressions, each with its user's history (none: empty) if history_path is given."""
    ids = lambda c: F.transform(c, lambda x: x.cast("string"))
    b = spark.read.parquet(path).select(F.col("impression_id").cast("string").alias("impression_id"), F.lit("ebnerd").alias("dataset"), F.col("user_id").cast("string").alias("user_id"), F.col("impression_time").cast("timestamp_ntz").alias("ts"), ids("article_ids_inview").alias("candidates"), *([parse.labels(F.col("article_ids_inview"), F.col("article_ids_clicked")).alias("labels")] if labelled else []))
    if history_path is None:
        return b
    none = F.array().cast("array<struct<article_id:string,clicked_at:timestamp_ntz>>")
    return b.join(ebnerd_history(spark, history_path), "user_id", "left").withColumn("clicked_history", F.coalesce("clicked_history", none))


def ebnerd_history(spark: SparkSession, path) -> DataFrame:
    """user_id, clicked_history: the parallel arrays zipped; a missing time is null."""
    z = F.arrays_zip(F.col("article_id_fixed").alias("a"), F.col("impression_time_fixed").alias("t"))
    return spark.read.parquet(path).select(F.col("user_id").cast("string").alias("user_id"), F.transform(F.filter(z, lambda x: x["a"].isNotNull()), lambda x: F.struct(x["a"].cast("string").alias("article_id"), x["t"].cast("timestamp_ntz").alias("clicked_at"))).alias("clicked_history"))


def ebnerd_user_summary(spark: SparkSession, path) -> DataFrame:
    """user_id, dataset, clicked_history, history_len, last_active_at for each row of a history file, as it stands."""
    h = ebnerd_history(spark, path)
    return h.select("user_id", F.lit("ebnerd").alias("dataset"), "clicked_history", F.size("clicked_history").cast("long").alias("history_len"), F.array_max(F.transform("clicked_history", lambda x: x["clicked_at"])).alias("last_active_at"))


def ebnerd_users(spark: SparkSession, splits: list[tuple[str, str]]) -> DataFrame:
    """user_id, dataset, clicked_history, history_len, last_active_at over several (behaviors, history) files.

    A user's articles stand in the order in which impressions first show them: by file, row and place in the history. Rows are told
    apart by the file's own row numbers, so no file is read in one piece and nothing is sorted but a user's articles.
    """
    union = None
    for i, (behaviors, history) in enumerate(splits):
        b = spark.read.parquet(behaviors).select(F.col("user_id").cast("string").alias("user_id"), F.col("impression_time").cast("timestamp_ntz").alias("ts"), F.lit(i).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
        # a user's impressions of a file show the same history: the first of them counts
        first = b.groupBy("user_id", "file").agg(F.min(F.struct("path", "row")).alias("at"), F.max("ts").alias("ts"))
        one = first.join(ebnerd_history(spark, history), "user_id", "left")
        union = one if union is None else union.unionByName(one)
    shown = union.select("user_id", "ts", "file", "at", F.posexplode_outer("clicked_history").alias("place", "e"))
    last = shown.groupBy("user_id").agg(F.max("ts").alias("last_active_at"))
    lists = first_occurrences(shown.where("e IS NOT NULL").withColumn("article_id", F.col("e.article_id")), "user_id", "article_id", F.struct("file", "at", "place"), F.col("e"))
    none = F.array().cast(lists.schema["entries"].dataType)
    j = last.join(lists, "user_id", "left").withColumn("entries", F.coalesce("entries", none))
    return j.select("user_id", F.lit("ebnerd").alias("dataset"), F.col("entries").alias("clicked_history"), F.size("entries").cast("long").alias("history_len"), "last_active_at")


def embeddings(spark: SparkSession, path, wanted: DataFrame | None = None) -> DataFrame:
    """article_id, vec (unit): from one list column or many float columns; wanted keeps its article_ids alone."""
    e = spark.read.parquet(path)
    lists = [f.name for f in e.schema if f.dataType.typeName() == "array"]
    vec = F.col(lists[0]) if lists else F.array(*[F.col(c) for c in e.columns if c != "article_id"])
    e = e.select(F.col("article_id").cast("string").alias("article_id"), normalize(vec).alias("vec"))
    return e.join(wanted.select("article_id"), "article_id", "left_semi") if wanted is not None else e


def load_embeddings(spark: SparkSession, root: str, model: str = "default", wanted: DataFrame | None = None) -> DataFrame:
    """The vectors of a model under root, by its name."""
    if model not in VECTOR_FILES:
        raise ValueError(f"{model}: one of {', '.join(VECTOR_FILES)}")
    return embeddings(spark, find_first(spark, root, VECTOR_FILES[model]), wanted)


def embedding_coverage(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The share of the wanted articles that have a vector."""
    j = wanted.select("article_id").distinct().join(vectors.select("article_id", F.lit(1).alias("has")), "article_id", "left")
    return j.agg((F.count("has") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"))
