"""Queries through files: the tables written in the raw forms of logs and results, and read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import parse
from gazette.functions.text import DANISH, language, tokens
from gazette.functions.vectors import dot
from gazette.operators import impressions as I  # noqa: E741
from gazette.operators import scoring as S
from gazette.operators.reuse import shared_path
from gazette.plans import registry as R
from gazette.plans.registry import query
from gazette.sources import readers, score_tables, writers


def _text(df: DataFrame, path: str, *columns) -> str:
    """Lines of fields between tabs; a null is an empty field."""
    fields = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return path


def _pools(spark, d) -> DataFrame:
    """impression_id, user_id, ts, xs (pos, article_id, label) of all splits."""
    return I.candidates(spark, d).groupBy("impression_id", "user_id", "ts").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "label"))).alias("xs"))


def _joined(f) -> Column:
    return F.array_join(F.transform("xs", f), " ")


_ID, _LABEL = (lambda x: x["article_id"].cast("string")), (lambda x: F.concat(x["article_id"].cast("string"), F.lit("-"), x["label"].cast("string")))


# ---- the tab-separated logs ----


@query("SELECT c.impression_id, CAST(user_id AS VARCHAR) AS user_id, ts, coalesce(n, 0) AS n_history, pos, CAST(article_id AS VARCHAR) AS article_id, label FROM cand c LEFT JOIN (SELECT impression_id, count(*) AS n FROM hist GROUP BY 1) h USING (impression_id)")
def raw_behaviors_log(spark, d):
    """Impressions with histories and labelled candidates as a log, read back."""
    h = I.as_of(I.candidates(spark, d), I.clicks(spark, d)).select("impression_id", F.array_join(F.transform("history", lambda x: x["article_id"].cast("string")), " ").alias("h"))
    rows = _pools(spark, d).join(h, "impression_id", "left")
    path = _text(rows, shared_path(spark, "behaviors"), "impression_id", F.col("user_id").cast("string"), F.date_format("ts", parse.TIME), "h", _joined(_LABEL))
    b = readers.mind_behaviors(spark, path).select("impression_id", "user_id", "ts", F.size("clicked_history").cast("long").alias("n_history"), F.posexplode(F.arrays_zip("candidates", "labels")).alias("i", "x"))
    return b.select("impression_id", "user_id", "ts", "n_history", (F.col("i") + 1).cast("long").alias("pos"), F.col("x.candidates").alias("article_id"), F.col("x.labels").alias("label"))


@query("SELECT impression_id, ts, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM cand GROUP BY 1, 2")
def raw_test_log(spark, d):
    """A log without labels, found by the places where test files may lie; some tokens have a label all the same."""
    root = shared_path(spark, "logs")
    mixed = _joined(lambda x: F.when(x["pos"] % 2 == 0, _ID(x)).otherwise(_LABEL(x)))
    _text(_pools(spark, d), f"{root}/test/behaviors.tsv", "impression_id", F.col("user_id").cast("string"), F.date_format("ts", parse.TIME), F.lit(""), mixed)
    b = readers.mind_behaviors(spark, readers.find_first(spark, root, readers.BEHAVIOR_FILES), labelled=False)
    return b.select("impression_id", "ts", F.array_join("candidates", " ").alias("ids"))


@query("SELECT impression_id, ts, n_history, ids FROM (SELECT impression_id, ts, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM cand GROUP BY 1, 2) JOIN (SELECT impression_id, hlen AS n_history FROM nimps) USING (impression_id)")
def raw_log_lines(spark, d):
    """The same lines parsed one by one, where each must have five fields and candidates."""
    h = I.as_of(I.candidates(spark, d), I.clicks(spark, d)).select("impression_id", F.array_join(F.transform("history", lambda x: x["article_id"].cast("string")), " ").alias("h"))
    line = F.concat_ws("\t", "impression_id", F.col("user_id").cast("string"), F.date_format("ts", parse.TIME), "h", _joined(_LABEL))
    return _pools(spark, d).join(h, "impression_id").select(parse.behavior_row(line).alias("r")).select("r.impression_id", "r.ts", F.size("r.clicked_history").cast("long").alias("n_history"), F.array_join("r.candidates", " ").alias("ids"))


def _news(spark, d) -> list[str]:
    """Two files of articles: the second has them all, under another title."""
    a = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    entity = lambda label, kind: F.struct(F.coalesce(label, F.lit("")).alias("Label"), F.lit(kind).alias("Type"), F.lit("Q").alias("WikidataId"), F.lit(1.0).alias("Confidence"))
    one, both = F.to_json(F.array(entity(F.col("lang"), "L"))), F.to_json(F.array(entity(F.col("lang"), "L"), entity(F.col("source"), "S")))
    fields = lambda title: [F.col("id").cast("string"), "source", F.when(F.col("lang") != "en", F.col("lang")), title, F.when(F.col("id") % 2 == 1, F.col("source")), F.lit("u"), one, F.when(F.col("id") % 5 == 0, F.lit("no json")).otherwise(both)]
    return [_text(a.where("id % 3 <> 0"), shared_path(spark, "news"), *fields("lang")), _text(a, shared_path(spark, "news"), *fields(F.lit("later")))]


@query("""SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') ELSE 'later' END AS title, CASE WHEN doc_id % 2 = 1 THEN nullif(source, '') END AS abstract, nullif(source, '') AS category,
  CASE WHEN lang <> 'en' THEN nullif(lang, '') END AS subcategory, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS n_entities FROM documents""")
def raw_news_files(spark, d):
    """Of an article in several files the first stays; entities of both lists, each once."""
    return readers.mind_articles(spark, _news(spark, d)).select("article_id", "title", "abstract", "category", "subcategory", F.size("entities").alias("n_entities"))


@query("SELECT CAST(doc_id AS VARCHAR) AS article_id, concat_ws(' ', 'later', CASE WHEN doc_id % 2 = 1 THEN nullif(source, '') END) AS text, nullif(source, '') AS category FROM documents")
def raw_news_catalog(spark, d):
    """The catalog of a submission: the last file wins."""
    return readers.mind_catalog(spark, _news(spark, d))


# ---- the Parquet logs ----


@query("""SELECT CAST(doc_id AS VARCHAR) AS article_id, coalesce(lang, '') AS title, nullif(source, '') AS abstract, CASE WHEN doc_id % 4 <> 0 AND lang <> '' THEN 'native' END AS body_source, CASE WHEN doc_id % 2 = 1 THEN '1,2' END AS subcategory,
  CASE WHEN lang <> '' THEN 2 ELSE 0 END AS n_entities, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 28 AS INTEGER)) AS published_at FROM documents""")
def raw_article_table(spark, d):
    a = I.table(spark, d, "documents")
    path = shared_path(spark, "articles")
    a.select(
        F.col("doc_id").cast("int").alias("article_id"), F.col("lang").alias("title"), F.col("source").alias("subtitle"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("body"), F.col("source").alias("category_str"),
        F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>")).alias("subcategory"), F.array("lang", "lang", F.lit("")).alias("ner_clusters"), F.array("lang").alias("entity_groups"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("doc_id") % 28)).alias("published_time"),
    ).write.parquet(path)
    return readers.ebnerd_articles(spark, path).select("article_id", "title", "abstract", "body_source", "subcategory", F.size("entities").alias("n_entities"), "published_at")


@query("SELECT impression_id, ts, coalesce(n, 0) AS n_history, last_click, pos, CAST(article_id AS VARCHAR) AS article_id, label FROM cand LEFT JOIN (SELECT user_id, count(*) AS n, max(clicked_at) AS last_click FROM clicks GROUP BY 1) USING (user_id)")
def raw_impression_tables(spark, d):
    """Impressions and histories as two Parquet files of parallel arrays, joined by user; labels from the clicked ids."""
    b, h = shared_path(spark, "impressions"), shared_path(spark, "histories")
    pick = lambda f: F.transform(f, lambda x: x["article_id"])
    _pools(spark, d).select("impression_id", "user_id", F.col("ts").alias("impression_time"), pick("xs").alias("article_ids_inview"), pick(F.filter("xs", lambda x: x["label"] == 1)).alias("article_ids_clicked")).write.parquet(b)
    xs = F.array_sort(F.collect_list(F.struct("clicked_at", "event_id", "article_id")))
    I.clicks(spark, d).groupBy("user_id").agg(xs.alias("xs")).select("user_id", pick("xs").alias("article_id_fixed"), F.transform("xs", lambda x: x["clicked_at"]).alias("impression_time_fixed")).write.parquet(h)
    r = readers.ebnerd_behaviors(spark, b, h)
    r = r.select("impression_id", "ts", F.size("clicked_history").cast("long").alias("n_history"), F.array_max(F.transform("clicked_history", lambda x: x["clicked_at"])).alias("last_click"), F.posexplode(F.arrays_zip("candidates", "labels")).alias("i", "x"))
    return r.select("impression_id", "ts", "n_history", "last_click", (F.col("i") + 1).cast("long").alias("pos"), F.col("x.candidates").alias("article_id"), F.col("x.labels").alias("label"))


@query("SELECT CAST(vec_id AS VARCHAR) AS article_id, CAST(1 AS DOUBLE) AS same FROM embeddings")
def raw_vector_files(spark, d):
    """Vectors as a list column and as one column for each place, found by the name of their model: both are the same unit vectors."""
    root, v = shared_path(spark, "vectors"), I.unit_vectors(spark, d)
    v.select("article_id", "vec").write.parquet(f"{root}/w2v/document_vector.parquet")
    v.select("article_id", *[F.col("vec")[i].alias(f"v{i:02d}") for i in range(64)]).write.parquet(f"{root}/own_bert.parquet")
    one, other = readers.load_embeddings(spark, root, "w2v"), readers.load_embeddings(spark, root, "bert").withColumnRenamed("vec", "other")
    return one.join(other, "article_id").select("article_id", F.round(dot(F.col("vec"), F.col("other")), 4).alias("same"))


@query("SELECT round(count(v.vec_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id")
def vector_coverage(spark, d):
    ids = lambda df: df.withColumn("article_id", F.col("article_id").cast("string"))
    return readers.embedding_coverage(ids(I.unit_vectors(spark, d)), ids(I.articles(spark, d))).select(F.round("coverage", 6).alias("coverage"))


# ---- results ----


@query("SELECT split, count(*) AS n, sum(label)::BIGINT AS clicks FROM cand GROUP BY 1")
def stored_split_table(spark, d):
    """A table with a folder for each split; the whole of it is then replaced by what is read from it."""
    path = shared_path(spark, "splits")
    writers.write_table(I.candidates(spark, d), path, "split")
    whole = shared_path(spark, "whole")
    writers.write_table(spark.read.parquet(path), whole)
    writers.replace_table(spark.read.parquet(whole), whole)
    return spark.read.parquet(whole).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("clicks"))


@query("SELECT split, article_id, count(*) * CASE WHEN split = 'val' THEN 10 ELSE 1 END AS exposures FROM cand WHERE split <> 'val' OR article_id < 50 GROUP BY 1, 2")
def upserted_results(spark, d):
    """Results by split; those of one split are replaced in place."""
    path = shared_path(spark, "results")
    n = I.candidates(spark, d).groupBy("split", "article_id").agg(F.count("*").alias("exposures"))
    score_tables.upsert_in_place(n, path, "split")
    score_tables.upsert_in_place(n.where("split = 'val' AND article_id < 50").withColumn("exposures", F.col("exposures") * 10), path, "split")
    return spark.read.parquet(path).select("split", "article_id", "exposures")


@query("SELECT count(*) AS n, 1 AS made FROM embeddings")
def cached_vectors(spark, d):
    """Vectors asked for twice under the same ids are written once."""
    root, made, v = shared_path(spark, "cache"), [], I.unit_vectors(spark, d)

    def make():
        made.append(1)
        return v

    for _ in range(2):
        held = score_tables.cached_by_content(spark, root, "vectors", v.select("article_id"), make)
    return held.agg(F.count("*").alias("n")).withColumn("made", F.lit(len(made)))


@query("SELECT CAST(article_id AS VARCHAR) AS article_id, clicks FROM pop")
def popularity_file(spark, d):
    path = shared_path(spark, "popularity")
    writers.write_popularity(R._train_pop(spark, d), path)
    return spark.read.schema("article_id string, clicks long").json(path)


@query()
def summary_file(spark, d):
    """The summary by slice as a CSV file, read back."""
    path, rows = shared_path(spark, "summary"), R.summary_by_slice(spark, d)
    writers.write_summary(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


R.SQL["summary_file"] = R.SQL["summary_by_slice"]


@query("SELECT impression_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY rank) AS ranked, count(*) FILTER (WHERE label = 1) AS clicked FROM rcos GROUP BY 1")
def score_arrays(spark, d):
    """A score table of native arrays, under its name with the whole configuration."""
    path = f"{shared_path(spark, 'scores')}/{writers.score_name('events', 'cosine', cap=I.CAP)}"
    writers.write_table(writers.score_table(S.rank(R._cosine(spark, d), "id")), path)
    t = spark.read.parquet(path)
    return t.select("impression_id", F.array_join(F.transform("ranked_ids", lambda x: x.cast("string")), " ").alias("ranked"), F.size("ground_truth").cast("long").alias("clicked"))


# ---- small functions over whole tables ----


@query("SELECT impression_id, CAST(count(*) + 1 AS BIGINT) AS n, sum(label)::BIGINT AS clicked FROM cand GROUP BY 1")
def label_lookup(spark, d):
    """Labels of ranked ids, where each candidate stands twice, first without its label, and one ranked id is no candidate."""
    ids, ys = F.transform("xs", lambda x: x["article_id"]), F.transform("xs", lambda x: x["label"])
    ranked = F.concat(F.reverse(ids), F.array(F.lit(-1).cast("long")))
    found = parse.labels_of(ranked, F.concat(ids, ids), F.concat(F.transform(ys, lambda y: F.lit(0)), ys))
    return _pools(spark, d).select("impression_id", F.size(found).cast("long").alias("n"), F.aggregate(found, F.lit(0).cast("long"), lambda s, y: s + y).alias("clicked"))


@query("SELECT doc_id AS article_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE 'da' END AS language FROM documents")
def dataset_language(spark, d):
    name = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("MIND-"), F.col("article_id").cast("string"))).otherwise(F.lit("ebnerd_large"))
    return I.articles(spark, d).select("article_id", language(name).alias("language"))


_STOP = ", ".join(f"'{w}'" for w in DANISH)


@query(rf"SELECT article_id, len(list_filter(regexp_extract_all(lower(cleaned_text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda t: t NOT IN ({_STOP}))) AS n_tokens FROM art")
def tokenize_danish_stopwords(spark, d):
    return I.articles(spark, d).select("article_id", F.size(tokens(F.col("cleaned_text"), "da", True)).cast("long").alias("n_tokens"))
