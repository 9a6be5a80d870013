"""All queries over the standard tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.functions import parse
from gazette.functions.text import tokens
from gazette.functions.vectors import dot, normalize
from gazette.operators import impressions as I  # noqa: E741
from gazette.operators import metrics as M
from gazette.operators import scoring as S
from gazette.operators.reuse import reused, unique_join
from gazette.plans.prelude import mm, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return register


def _history(spark, d, split="val"):
    return I.as_of(I.candidates(spark, d, split), I.clicks(spark, d))


def _base(spark, d):
    """The validation split's candidates and histories, made once for all that a query does with them."""
    cand = reused(I.candidates(spark, d, "val"), "candidates")
    return cand, reused(I.as_of(cand, I.clicks(spark, d)), "histories")


def _cosine(spark, d, decay=None, base=None):
    cand, h = base or (I.candidates(spark, d, "val"), _history(spark, d))
    vec = I.unit_vectors(spark, d)
    return S.cosine(cand, S.user_vectors(h, vec, decay), vec)


def _bm25(spark, d, stopwords=False, stem=False, base=None):
    cand, h = base or _base(spark, d)
    return S.bm25(cand, h, I.articles(spark, d), stopwords=stopwords, stem=stem)


def _train_pop(spark, d):
    return I.popularity(I.candidates(spark, d, "train"))


def _both(spark, d):
    base = _base(spark, d)
    return unique_join(_cosine(spark, d, base=base), _bm25(spark, d, base=base).select("impression_id", "article_id", F.col("score").alias("bm25")), ["impression_id", "article_id"])


def _blended(spark, d, beta=0.8):
    return S.rank(S.blend(_both(spark, d), "score", "bm25", beta))


def _with_popularity(spark, d):
    pop = _train_pop(spark, d).select("article_id", "clicks")
    return _cosine(spark, d).join(pop, "article_id", "left").withColumn("lp", F.log1p(F.coalesce("clicks", F.lit(0)))).drop("clicks")


def _hybrid(spark, d, alpha=0.8):
    return S.rank(S.blend(_with_popularity(spark, d), "score", "lp", alpha))


def _with_category(spark, d):
    base = _base(spark, d)
    sig = S.category_signal(*base, I.articles(spark, d)).select("impression_id", "article_id", "signal")
    return _cosine(spark, d, base=base).join(sig, ["impression_id", "article_id"])


def _catblend(spark, d, beta=0.85):
    return S.rank(S.blend(_with_category(spark, d), "score", "signal", beta))


_COLS = ["impression_id", "article_id", "pos", "label", "score", "rank"]
_MEANS = ["recall5", "recall10", *M.METRICS]
_AVG = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS)


# ---- sources, lookups, filters, sets ----


@query("SELECT doc_id AS article_id, source AS category, lang AS subcategory FROM documents WHERE doc_id = 7 LIMIT 1")
def point_lookup(spark, d):
    return I.articles(spark, d).where("article_id = 7").select("article_id", "category", "subcategory").limit(1)


@query("SELECT doc_id AS article_id, source AS category FROM documents WHERE doc_id IN (3, 5, 8, 13, 21)")
def batch_lookup(spark, d):
    return I.articles(spark, d).where(F.col("article_id").isin(3, 5, 8, 13, 21)).select("article_id", "category")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def sql_escape_hatch(spark, d):
    spark.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("gazette_customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM gazette_customer WHERE c_mktsegment = :seg AND c_acctbal > 0", args={"seg": "BUILDING"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def project_where(spark, d):
    return I.table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, d):
    return I.table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"))


@query("SELECT impression_id, pos, article_id, label FROM val")
def split_filter(spark, d):
    return I.candidates(spark, d, "val").select("impression_id", "pos", "article_id", "label")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def vertical_concat(spark, d):
    n = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return n.unionByName(I.table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("SELECT article_id, clicks FROM (SELECT article_id, sum(label) AS clicks FROM cand WHERE split = 'train' GROUP BY 1) ORDER BY clicks DESC, article_id LIMIT 10")
def top_articles(spark, d):
    return _train_pop(spark, d).orderBy(F.desc("clicks"), "article_id").limit(10).select("article_id", "clicks")


@query("SELECT impression_id FROM (SELECT impression_id, sum(label) AS c, count(*) AS n FROM cand GROUP BY 1) WHERE c BETWEEN 1 AND n - 1")
def degenerate_filter(spark, d):
    g = I.candidates(spark, d).groupBy("impression_id").agg(F.sum("label").alias("c"), F.count("*").alias("n"))
    return g.where("c BETWEEN 1 AND n - 1").select("impression_id")


@query("SELECT DISTINCT impression_id FROM val ORDER BY impression_id LIMIT 25")
def first_n_sample(spark, d):
    return I.candidates(spark, d, "val").select("impression_id").distinct().orderBy("impression_id").limit(25)


@query("SELECT impression_id FROM (SELECT DISTINCT impression_id FROM val) ORDER BY md5(concat('42-', impression_id)), impression_id LIMIT 25")
def hashed_sample(spark, d):
    key = F.md5(F.concat(F.lit("42-"), F.col("impression_id").cast("string")).cast("binary"))
    return I.candidates(spark, d, "val").select("impression_id").distinct().orderBy(key, "impression_id").limit(25)


# ---- parsing, over logs written out in their raw form ----


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS parsed, CAST(NULL AS TIMESTAMP) AS bad FROM events")
def parse_mind_time(spark, d):
    e = I.table(spark, d, "events").select("event_id", F.date_format("ts", parse.TIME).alias("raw"))
    return e.select("event_id", parse.mind_time(F.col("raw")).alias("parsed"), parse.mind_time(F.concat(F.lit("x"), "raw"), strict=False).alias("bad"))


@query("SELECT impression_id, pos, CAST(article_id AS VARCHAR) AS article_id, label FROM cand")
def parse_impressions(spark, d):
    c = I.candidates(spark, d).groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "label"))).alias("xs"))
    raw = c.select("impression_id", F.array_join(F.transform("xs", lambda x: F.concat(x["article_id"].cast("string"), F.lit("-"), x["label"].cast("string"))), " ").alias("raw"))
    noisy = raw.select("impression_id", F.concat("raw", F.lit("  broken N9-x ")).alias("raw"))
    return noisy.select("impression_id", F.posexplode(parse.impressions(F.col("raw"))).alias("i", "p")).select("impression_id", (F.col("i") + 1).cast("long").alias("pos"), "p.article_id", "p.label")


@query("SELECT impression_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM cand GROUP BY 1")
def parse_unlabelled(spark, d):
    c = I.candidates(spark, d).groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "article_id", "label"))).alias("xs"))
    mixed = F.transform("xs", lambda x: F.when(x["pos"] % 2 == 0, x["article_id"].cast("string")).otherwise(F.concat(x["article_id"].cast("string"), F.lit("-"), x["label"].cast("string"))))
    return c.select("impression_id", F.array_join(parse.unlabelled(F.array_join(mixed, " ")), " ").alias("ids"))


@query("SELECT impression_id, count(*) FILTER (WHERE label = 1) AS n_clicked, count(*) AS n FROM cand GROUP BY 1")
def labels_from_clicked(spark, d):
    c = I.candidates(spark, d).groupBy("impression_id").agg(F.array_sort(F.collect_list("article_id")).alias("inview"), F.collect_list(F.when(F.col("label") == 1, F.col("article_id"))).alias("clicked"))
    lab = parse.labels(F.col("inview"), F.col("clicked"))
    return c.select("impression_id", F.aggregate(lab, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_clicked"), F.size("inview").cast("long").alias("n"))


@query("SELECT doc_id AS article_id, concat_ws(' ', lang, CASE WHEN source <> 'src0' THEN source END) AS cleaned_text, CASE WHEN source <> 'src0' THEN source END AS abstract, CASE WHEN source <> 'src0' THEN 'native' END AS body_source FROM documents")
def article_fields(spark, d):
    from gazette.functions.text import cleaned

    a = I.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), parse.none_if_empty(F.when(F.col("source") == "src0", "").otherwise(F.col("source"))).alias("abstract"))
    return a.select("article_id", cleaned(F.col("title"), F.col("abstract")).alias("cleaned_text"), "abstract", F.when(F.col("abstract").isNotNull(), "native").alias("body_source"))


@query("SELECT doc_id AS article_id, CAST(CASE WHEN lang = source THEN 1 ELSE 2 END AS INTEGER) AS n_entities, lang AS first_label FROM documents")
def merged_entities(spark, d):
    as_json = lambda *cs: F.to_json(F.array(*[F.struct(c.alias("Label"), F.lit("T").alias("Type"), F.lit("Q").alias("WikidataId"), F.lit(1.0).alias("Confidence")) for c in cs]))
    e = I.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), parse.entities(as_json(F.col("lang"), F.col("lang")), as_json(F.col("source"))).alias("e"))
    return e.select("article_id", F.size("e").alias("n_entities"), F.get("e", F.lit(0))["label"].alias("first_label"))


@query("SELECT article_id, count(term) AS n_tokens, count(DISTINCT term) AS n_terms FROM art LEFT JOIN tok USING (article_id) GROUP BY 1")
def tokenize(spark, d):
    a = I.articles(spark, d).select("article_id", tokens(F.col("cleaned_text")).alias("t"))
    return a.select("article_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(r"SELECT article_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_terms FROM (SELECT article_id, regexp_extract_all(lower(cleaned_text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS ts FROM art)")
def tokenize_danish(spark, d):
    a = I.articles(spark, d).select("article_id", tokens(F.col("cleaned_text"), "da").alias("t"))
    return a.select("article_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("SELECT article_id, dl AS n_tokens FROM dls")
def tokenize_stopwords(spark, d):
    return I.articles(spark, d).select("article_id", F.size(tokens(F.col("cleaned_text"), stopwords=True)).cast("long").alias("n_tokens"))


# ---- histories, splits, users ----


@query("SELECT split, count(DISTINCT impression_id) AS n FROM cand GROUP BY 1")
def split_counts(spark, d):
    return I.candidates(spark, d).groupBy("split").agg(F.countDistinct("impression_id").alias("n"))


@query("SELECT impression_id, back, article_id, clicked_at FROM hist")
def history_as_of(spark, d):
    return I.history_rows(_history(spark, d, None)).select("impression_id", F.col("back").cast("long").alias("back"), "article_id", "clicked_at")


@query("SELECT impression_id, article_id, back, round(exp(-greatest(epoch(ts) - epoch(clicked_at), 0) / 604800.0), 6) AS weight FROM hist")
def recency_weights(spark, d):
    h = I.history_rows(_history(spark, d, None))
    return h.select("impression_id", "article_id", F.col("back").cast("long").alias("back"), F.round(S.recency_weight(F.col("clicked_at"), F.col("ts")), 6).alias("weight"))


@query("SELECT impression_id, article_id, back, round(pow(0.9, back - 1) / sum(pow(0.9, back - 1)) OVER (PARTITION BY impression_id), 6) AS weight FROM hist")
def position_decay(spark, d):
    w = F.pow(F.lit(0.9), F.col("back") - 1)
    return I.history_rows(_history(spark, d, None)).select("impression_id", "article_id", F.col("back").cast("long").alias("back"), F.round(w / F.sum(w).over(S.imp()), 6).alias("weight"))


@query("SELECT user_id, count(*) AS history_len, max(t) AS last_active_at, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY t, article_id) AS articles FROM (SELECT user_id, article_id, min(clicked_at) AS t FROM clicks GROUP BY ALL) GROUP BY 1")
def user_features(spark, d):
    first = I.clicks(spark, d).groupBy("user_id", "article_id").agg(F.min("clicked_at").alias("t"))
    g = first.groupBy("user_id").agg(F.count("*").alias("history_len"), F.max("t").alias("last_active_at"), F.array_sort(F.collect_list(F.struct("t", "article_id"))).alias("h"))
    return g.select("user_id", "history_len", "last_active_at", F.array_join(F.transform("h", lambda x: x["article_id"].cast("string")), " ").alias("articles"))


@query("SELECT user_id, max(ts) AS last_active_at, arg_max(impression_id, struct_pack(t := ts, i := impression_id)) AS latest FROM cand GROUP BY 1")
def latest_snapshot(spark, d):
    return I.candidates(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_active_at"), F.max_by("impression_id", F.struct("ts", "impression_id")).alias("latest"))


@query("SELECT user_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY article_id) AS ids FROM (SELECT DISTINCT user_id, article_id FROM cand) GROUP BY 1")
def user_article_union(spark, d):
    g = I.candidates(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("article_id")).alias("ids"))
    return g.select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT user_id, max(hlen) AS longest FROM nimps JOIN (SELECT DISTINCT impression_id, user_id FROM cand) USING (impression_id) GROUP BY 1")
def history_lengths(spark, d):
    h = I.as_of(I.candidates(spark, d), I.clicks(spark, d))
    return h.groupBy("user_id").agg(F.max(F.size("history")).cast("long").alias("longest"))


# ---- corpus statistics and scores ----


@query("SELECT term, df, round(idf, 6) AS idf FROM idf_bm")
def idf_table(spark, d):
    return S.corpus(I.articles(spark, d))[1].select("term", "df", F.round("idf", 6).alias("idf"))


@query("SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st_bm")
def corpus_stats(spark, d):
    return S.corpus(I.articles(spark, d))[2].select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


@query("SELECT h.impression_id, q.term, sum(q.tf)::BIGINT AS qtf FROM vhist h JOIN tf_bm q USING (article_id) GROUP BY ALL")
def query_terms(spark, d):
    tf = S.corpus(I.articles(spark, d))[0]
    return I.history_rows(_history(spark, d)).join(tf, "article_id").groupBy("impression_id", "term").agg(F.sum("tf").alias("qtf"))


@query(f"SELECT {', '.join(_COLS)} FROM rbm")
def bm25_ranking(spark, d):
    return S.rank(_bm25(spark, d)).select(*_COLS)


@query(f"SELECT {', '.join(_COLS)} FROM rbs")
def bm25_stopwords_ranking(spark, d):
    return S.rank(_bm25(spark, d, True)).select(*_COLS)


@query()
def bm25_stem_ranking(spark, d):
    return S.rank(_bm25(spark, d, stem=True)).select(*_COLS)


@query()
def bm25_stopwords_stem_ranking(spark, d):
    return S.rank(_bm25(spark, d, True, True)).select(*_COLS)


@query("""SELECT query_id, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM (
  SELECT q.article_id AS query_id, w.article_id, round(sum(q.tf * w.w) + 1e-9, 4) AS score FROM tf_bm q JOIN w_bm w USING (term) WHERE q.article_id % 50 = 0 GROUP BY ALL)) WHERE rank <= 20""")
def bm25_full_corpus(spark, d):
    """Every article whose id is divisible by 50, against all."""
    return S.search_bm25(I.articles(spark, d), F.col("article_id") % 50 == 0)


@query(f"SELECT {', '.join(_COLS)} FROM rcos")
def cosine_ranking(spark, d):
    return S.rank(_cosine(spark, d), "id").select(*_COLS)


@query(f"SELECT {', '.join(_COLS)} FROM rdcos")
def decayed_cosine_ranking(spark, d):
    return S.rank(_cosine(spark, d, 0.9)).select(*_COLS)


@query("SELECT impression_id, d::INTEGER AS d, round(u, 6) AS u FROM uvec")
def mean_user_vectors(spark, d):
    u = S.user_vectors(_history(spark, d), I.unit_vectors(spark, d))
    return u.select("impression_id", F.posexplode("u").alias("i", "x")).select("impression_id", (F.col("i") + 1).alias("d"), F.round("x", 6).alias("u"))


@query("SELECT vec_id AS article_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS own FROM embeddings")
def self_similarity(spark, d):
    v = I.unit_vectors(spark, d).select("article_id", normalize(F.col("vec")).alias("v"))
    return v.select("article_id", F.round(dot(F.col("v"), F.col("v")), 4).alias("own"))


@query("""SELECT query_id, article_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM (
  SELECT a.article_id AS query_id, b.article_id, round(sum(a.x * b.x) + 1e-9, 6) AS score FROM emb a JOIN emb b USING (d) WHERE a.article_id % 50 = 0 GROUP BY ALL)) WHERE rank <= 10""")
def full_catalog_top_k(spark, d):
    """Every vector whose id is divisible by 50, against all."""
    return S.search_vectors(I.unit_vectors(spark, d), F.col("article_id") % 50 == 0)


ATTENTION_SQL = """SELECT v.impression_id, v.article_id, v.pos, v.label, round(coalesce(s, 0), 6) AS score FROM val v LEFT JOIN (
  SELECT impression_id, article_id, sum(o * x) / sqrt(sum(o * o)) AS s FROM (
    SELECT a.impression_id, a.article_id, e.d, sum(a.w * e.x) AS o FROM (
      SELECT *, exp((dp - max(dp) OVER (PARTITION BY impression_id, article_id)) / 0.2) AS w FROM (
        SELECT v.impression_id, v.article_id, h.article_id AS h, h.back, sum(c.x * e.x) AS dp FROM val v JOIN vhist h USING (impression_id)
        JOIN emb c ON c.article_id = v.article_id JOIN emb e ON e.article_id = h.article_id AND e.d = c.d GROUP BY ALL)) a
    JOIN emb e ON e.article_id = a.h GROUP BY ALL) JOIN emb c USING (article_id, d) GROUP BY ALL) USING (impression_id, article_id)"""


@query(ATTENTION_SQL)
def query_key_attention(spark, d):
    vec = I.unit_vectors(spark, d)
    return S.attention(I.candidates(spark, d, "val"), _history(spark, d), vec).select("impression_id", "article_id", "pos", "label", "score")


@query(f"SELECT {', '.join(_COLS)} FROM rblended")
def bm25_embedding_blend(spark, d):
    return _blended(spark, d).select(*_COLS)


@query(f"SELECT {', '.join(_COLS)} FROM rhybrid")
def popularity_hybrid(spark, d):
    return _hybrid(spark, d).select(*_COLS)


@query(f"SELECT {', '.join(_COLS)} FROM rcatblend")
def category_blend(spark, d):
    return _catblend(spark, d).select(*_COLS)


@query("SELECT impression_id, article_id, round(p_cat, 6) AS p_cat_share, round(signal, 6) AS signal FROM catsig")
def category_affinity(spark, d):
    base = _base(spark, d)
    raw = S.category_signal(*base, I.articles(spark, d))
    kinds = I.articles(spark, d).select("article_id", "category")
    h = I.history_rows(base[1]).join(kinds, "article_id", "left")
    n = Window.partitionBy("impression_id")
    share = h.groupBy("impression_id", "category").agg(F.count("*").alias("m")).withColumn("p", F.col("m") / F.sum("m").over(n)).select("impression_id", "category", "p")
    j = raw.join(kinds, "article_id", "left").join(share, ["impression_id", "category"], "left")
    return j.select("impression_id", "article_id", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("p_cat_share"), F.round("signal", 6).alias("signal"))


@query(f"""SELECT impression_id, article_id, round({mm('p')}, 6) AS signal FROM (
  SELECT r.*, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY impression_id, coalesce(cat, '')) / sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY impression_id) AS p
  FROM rcos r LEFT JOIN kinds USING (article_id))""")
def proxy_category(spark, d):
    return S.proxy_signal(S.rank(_cosine(spark, d), "id"), I.articles(spark, d)).select("impression_id", "article_id", F.round("signal", 6).alias("signal"))


@query(f"""SELECT impression_id, article_id, label, round({mm('score')}, 6) AS f1, round({mm('bm25')}, 6) AS f2,
  round((row_number() OVER (PARTITION BY impression_id ORDER BY score, pos DESC) - 1) / greatest(count(*) OVER (PARTITION BY impression_id) - 1, 1), 6) AS f3,
  round((row_number() OVER (PARTITION BY impression_id ORDER BY bm25, pos DESC) - 1) / greatest(count(*) OVER (PARTITION BY impression_id) - 1, 1), 6) AS f4,
  round({mm('score')} - {mm('bm25')}, 6) AS f5 FROM both_""")
def combiner_features(spark, d):
    f = S.combiner_features(_both(spark, d), "score", "bm25")
    return f.select("impression_id", "article_id", "label", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(1, 6)])


@query()
def gbt_combiner(spark, d):
    """A gradient-boosted blend: impressions split 80/20 by hash, mean AUC of the held-out fifth."""
    return M.mean_of(M.per_impression(S.rank(_combined(spark, d).where("held"))), ["auc", "mrr"])


def _combined(spark, d):
    """Candidates with the learned blend's score, and whether their impression was held out (a fifth, by hash). The features are made once, for fit and scores."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = S.combiner_features(_both(spark, d), "score", "bm25").withColumn("held", F.pmod(F.xxhash64("impression_id"), F.lit(5)) == 0)
    f = VectorAssembler(inputCols=[f"f{i}" for i in range(1, 6)], outputCol="features").transform(reused(f, "combiner-features"))
    model = GBTClassifier(maxDepth=4, maxIter=10, seed=42, labelCol="label", featuresCol="features").fit(f.where("NOT held"))
    return model.transform(f).withColumn("score", F.round(vector_to_array("probability")[1], 6))


# ---- evaluation ----


def _metrics(name, ranked):
    @query(f"SELECT impression_id, n, clicks, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM m{ranked[1]}")
    def f(spark, d):
        return M.per_impression(ranked[0](spark, d)).select("impression_id", "n", "clicks", *[F.round(c, 6).alias(c) for c in _MEANS])

    QUERIES[name], SQL[name] = QUERIES.pop("f"), SQL.pop("f")

    def mean(spark, d):
        return M.mean_of(M.per_impression(ranked[0](spark, d)), _MEANS)

    QUERIES[f"mean_{name}"], SQL[f"mean_{name}"] = mean, sql(f"SELECT count(*) AS n_impressions, {_AVG} FROM m{ranked[1]}")


for _name, _ranked in {
    "metrics_cosine": (lambda s, d: S.rank(_cosine(s, d), "id"), "rcos"),
    "metrics_bm25": (lambda s, d: S.rank(_bm25(s, d)), "rbm"),
    "metrics_blend": (_blended, "rblended"),
    "metrics_hybrid": (_hybrid, "rhybrid"),
    "metrics_category": (_catblend, "rcatblend"),
    "metrics_decayed": (lambda s, d: S.rank(_cosine(s, d, 0.9)), "rdcos"),
}.items():
    _metrics(_name, _ranked)


@query("SELECT round(avg(recall5), 6) AS recall5, round(avg(recall10), 6) AS recall10, count(*) AS n_impressions FROM mrcos")
def recall_cosine(spark, d):
    return M.mean_of(M.per_impression(S.rank(_cosine(spark, d), "id")), ["recall5", "recall10"])


@query("SELECT article_id, exposures, clicks FROM pop")
def popularity_train(spark, d):
    return _train_pop(spark, d)


@query("SELECT impression_id, slice FROM sl")
def population_slices(spark, d):
    return M.slices(I.candidates(spark, d, "val"), _history(spark, d), _train_pop(spark, d))


@query(f"SELECT slice, count(*) AS n_impressions, {_AVG}, round(count(*) / max(total), 6) AS frac_population, slice <> 'all' AND (count(*) / max(total) < 0.01 OR count(*) / max(total) > 0.99) AS flagged FROM mrcos JOIN sl USING (impression_id), (SELECT count(*) AS total FROM mrcos) t GROUP BY 1")
def summary_by_slice(spark, d):
    base = _base(spark, d)
    rows = reused(M.per_impression(S.rank(_cosine(spark, d, base=base), "id")), "metrics")
    return M.summary(rows, M.slices(*base, _train_pop(spark, d)), _MEANS)


@query("SELECT slice, round(avg(b.recall10), 6) AS bm25, round(avg(c.recall10), 6) AS cosine, round(avg(b.recall10), 6) > round(avg(c.recall10), 6) AS bm25_wins FROM sl JOIN mrbm b USING (impression_id) JOIN mrcos c USING (impression_id) GROUP BY 1")
def compare_retrievers(spark, d):
    base = _base(spark, d)
    b = M.per_impression(S.rank(_bm25(spark, d, base=base))).select("impression_id", F.col("recall10").alias("b"))
    c = M.per_impression(S.rank(_cosine(spark, d, base=base), "id")).select("impression_id", F.col("recall10").alias("c"))
    j = M.slices(*base, _train_pop(spark, d)).join(b, "impression_id").join(c, "impression_id")
    g = j.groupBy("slice").agg(F.round(F.avg("b"), 6).alias("bm25"), F.round(F.avg("c"), 6).alias("cosine"))
    return g.withColumn("bm25_wins", F.col("bm25") > F.col("cosine"))


@query("SELECT impression_id, round(avg(-log2(greatest(coalesce(exposures, 0), 1) / (SELECT sum(exposures) FROM pop))), 6) AS novelty FROM rcos LEFT JOIN pop USING (article_id) WHERE rank <= 10 GROUP BY 1")
def novelty(spark, d):
    return M.novelty(S.rank(_cosine(spark, d), "id"), _train_pop(spark, d)).select("impression_id", F.round("novelty", 6).alias("novelty"))


@query("""SELECT i.impression_id, round(coalesce(s, 0), 6) AS ild FROM (SELECT DISTINCT impression_id FROM val) i LEFT JOIN (
  SELECT impression_id, avg(1 - c) AS s FROM (SELECT a.impression_id, a.article_id, b.article_id, sum(x.x * y.x) AS c FROM rcos a JOIN rcos b ON a.impression_id = b.impression_id AND a.rank < b.rank AND a.rank <= 10 AND b.rank <= 10
  JOIN emb x ON x.article_id = a.article_id JOIN emb y ON y.article_id = b.article_id AND x.d = y.d GROUP BY ALL) GROUP BY 1) USING (impression_id)""")
def intra_list_diversity(spark, d):
    return M.intra_list_diversity(S.rank(_cosine(spark, d), "id"), I.unit_vectors(spark, d)).select("impression_id", F.round("ild", 6).alias("ild"))


@query("SELECT count(DISTINCT article_id) AS shown, (SELECT count(DISTINCT article_id) FROM cand) AS catalog, round(count(DISTINCT article_id) / (SELECT count(DISTINCT article_id) FROM cand), 6) AS coverage FROM rcos WHERE rank <= 10")
def coverage(spark, d):
    return M.coverage(S.rank(_cosine(spark, d), "id"), I.candidates(spark, d))


@query("SELECT min(n) AS min_pool, round(median(n), 6) AS median_pool, round(avg(n), 6) AS mean_pool, round(quantile_cont(n, 0.9), 6) AS p90_pool, max(n) AS max_pool FROM (SELECT impression_id, count(*) AS n FROM cand GROUP BY 1)")
def candidate_pool_sizes(spark, d):
    g = I.candidates(spark, d).groupBy("impression_id").agg(F.count("*").alias("n"))
    return g.agg(F.min("n").alias("min_pool"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median_pool"), F.round(F.avg("n"), 6).alias("mean_pool"), F.round(F.percentile("n", F.lit(0.9)), 6).alias("p90_pool"), F.max("n").alias("max_pool"))


@query()
def bootstrap_auc(spark, d):
    base = _base(spark, d)
    rows = M.per_impression(S.rank(_cosine(spark, d, base=base), "id")).join(M.slices(*base, _train_pop(spark, d)), "impression_id")
    return M.bootstrap(rows, "auc", "slice")


@query()
def summary_auc_intervals(spark, d):
    base = _base(spark, d)
    rows = reused(M.per_impression(S.rank(_cosine(spark, d, base=base), "id")), "metrics")
    return M.summary_with_intervals(rows, M.slices(*base, _train_pop(spark, d)), "auc")


_GRID = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query(f"""SELECT beta, round(avg(mrr), 6) AS mrr FROM (SELECT beta, impression_id, coalesce(1.0 / min(CASE WHEN label = 1 THEN rank END), 0) AS mrr FROM (
  SELECT *, row_number() OVER (PARTITION BY impression_id, beta ORDER BY score DESC, pos) AS rank FROM (
  SELECT impression_id, pos, label, beta, round(beta * a + (1 - beta) * b + 1e-9, 6) AS score FROM (SELECT impression_id, pos, label, {mm('score')} AS a, {mm('bm25')} AS b FROM both_), (SELECT unnest({[float(x) for x in _GRID]})::DOUBLE AS beta) g)) GROUP BY ALL) GROUP BY 1""")
def blend_sweep(spark, d):
    """The grid is a handful of rows; both scores are made once for all of it."""
    both = _both(spark, d).select("impression_id", "pos", "label", S.minmax(F.col("score")).alias("a"), S.minmax(F.col("bm25")).alias("b"))
    all_ = both.select("*", F.explode(F.array(*map(F.lit, _GRID))).alias("beta"))
    s = all_.withColumn("score", F.round(F.col("beta") * F.col("a") + (1 - F.col("beta")) * F.col("b") + S.TINY, 6))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("impression_id", "beta").orderBy(F.desc("score"), "pos")))
    m = s.groupBy("beta", "impression_id").agg(F.coalesce(1 / F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"))
    return m.groupBy("beta").agg(F.round(F.avg("mrr"), 6).alias("mrr"))


# ---- submissions, checks, profiles ----


@query("SELECT impression_id, concat(impression_id, ' [', string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos), ']') AS line FROM rcos GROUP BY 1")
def prediction_lines(spark, d):
    from gazette.sources.submission import ranks_by_candidate

    return ranks_by_candidate(S.rank(_cosine(spark, d), "id"))


def _lines(name, make, part):
    @query(f"SELECT impression_id, concat(impression_id, ' [', string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos), ']') AS line FROM {part} GROUP BY 1")
    def f(spark, d):
        from gazette.sources.submission import ranks_by_candidate

        return ranks_by_candidate(make(spark, d))

    QUERIES[name], SQL[name] = QUERIES.pop("f"), SQL.pop("f")


#: Ways to rank the candidates of a submission, each with the name of its ranking in SQL.
SCORERS = {
    "cosine": (lambda s, d: S.rank(_cosine(s, d), "id"), "rcos"), "bm25": (lambda s, d: S.rank(_bm25(s, d)), "rbm"), "blend": (_blended, "rblended"), "hybrid": (_hybrid, "rhybrid"),
    "category": (_catblend, "rcatblend"), "decayed": (lambda s, d: S.rank(_cosine(s, d, 0.9)), "rdcos"),
}
for _name, (_make, _part) in SCORERS.items():
    if _name != "cosine":
        _lines(f"prediction_lines_{_name}", _make, _part)


def generate_submission(spark, d, scorer: str, target: str) -> tuple[int, str]:
    """Ranks every validation impression, checks all lines, packs them as a ZIP; gives the number of lines and the digest."""
    from gazette.sources import submission

    lines = submission.ranks_by_candidate(SCORERS[scorer][0](spark, d))
    bad = lines.where(~submission.valid_line(F.col("line"))).limit(1).collect()
    if bad:
        raise ValueError(f"not a valid line: {bad[0].line[:80]}")
    digest = submission.package(lines, target)
    return submission.validate_package(target), digest


@query("SELECT impression_id, user_id % 3 <> 0 OR n = 1 AS valid FROM (SELECT impression_id, any_value(user_id) AS user_id, count(*) AS n FROM val GROUP BY 1)")
def find_invalid_predictions(spark, d):
    """Lines of which every third user's repeat their first rank in every place."""
    from gazette.sources.submission import ranks_by_candidate, valid_line

    ranked = S.rank(_cosine(spark, d), "id").withColumn("rank", F.when(F.col("user_id") % 3 == 0, F.lit(1)).otherwise(F.col("rank")))
    return ranks_by_candidate(ranked, checked=False).select("impression_id", valid_line(F.col("line")).alias("valid"))


@query("""SELECT n_train, n_val, n_test, round(n_val / (n_train + n_val), 6) AS val_share, n_val * 9 >= n_train AS enough, last_train < first_val AND last_val < first_test AS in_order, n_all = n_train + n_val + n_test AS all_split FROM (
  SELECT count(*) AS n_all, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, max(ts) FILTER (WHERE split = 'train') AS last_train,
  min(ts) FILTER (WHERE split = 'val') AS first_val, max(ts) FILTER (WHERE split = 'val') AS last_val, min(ts) FILTER (WHERE split = 'test') AS first_test FROM imps)""")
def split_checks(spark, d):
    """The splits follow one another, hold every impression, and validation at least a tenth of what it is chosen from."""
    i = I.candidates(spark, d).select("impression_id", "ts", "split").distinct()
    n, when = (lambda s: F.count_if(F.col("split") == s)), (lambda s: F.when(F.col("split") == s, F.col("ts")))
    g = i.agg(F.count("*").alias("n_all"), n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test"), F.max(when("train")).alias("lt"), F.min(when("val")).alias("fv"), F.max(when("val")).alias("lv"), F.min(when("test")).alias("ft"))
    share = F.round(F.col("n_val") / F.nullif(F.col("n_train") + F.col("n_val"), F.lit(0)), 6)
    return g.select("n_train", "n_val", "n_test", share.alias("val_share"), (F.col("n_val") * 9 >= F.col("n_train")).alias("enough"), ((F.col("lt") < F.col("fv")) & (F.col("lv") < F.col("ft"))).alias("in_order"), (F.col("n_all") == F.col("n_train") + F.col("n_val") + F.col("n_test")).alias("all_split"))


@query("SELECT impression_id, concat(impression_id, ' [', string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank), ']') AS line FROM rcos GROUP BY 1")
def positions_by_rank(spark, d):
    from gazette.sources.submission import positions_by_rank as f

    return f(S.rank(_cosine(spark, d), "id"))


@query("SELECT impression_id, TRUE AS valid FROM (SELECT DISTINCT impression_id FROM val)")
def validate_predictions(spark, d):
    from gazette.sources.submission import ranks_by_candidate, valid_line

    lines = ranks_by_candidate(S.rank(_cosine(spark, d), "id"))
    return lines.select("impression_id", valid_line(F.col("line")).alias("valid"))


@query("SELECT c.article_id FROM (SELECT DISTINCT article_id FROM cand) c LEFT JOIN art USING (article_id) WHERE art.article_id IS NULL")
def unresolved_candidates(spark, d):
    return I.candidates(spark, d).select("article_id").distinct().join(I.articles(spark, d).select("article_id"), "article_id", "left_anti")


@query("SELECT c.impression_id, c.article_id FROM cand c JOIN (SELECT article_id, min(clicked_at) AS published_at FROM clicks GROUP BY 1) p USING (article_id) WHERE p.published_at > c.ts + INTERVAL 24 HOUR")
def publication_leaks(spark, d):
    """Candidates of an impression first clicked more than a day after it began stand for late publications."""
    first = I.clicks(spark, d).groupBy("article_id").agg(F.min("clicked_at").alias("published_at"))
    return I.candidates(spark, d).join(first, "article_id").where("published_at > ts + INTERVAL 24 HOURS").select("impression_id", "article_id")


@query("SELECT split, count(DISTINCT impression_id) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM cand GROUP BY 1")
def split_bounds(spark, d):
    return I.candidates(spark, d).groupBy("split").agg(F.countDistinct("impression_id").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT count(*) AS n_rows, count(DISTINCT impression_id) AS n_ids, sum(n)::BIGINT AS n_candidates FROM (SELECT impression_id, count(*) AS n FROM cand GROUP BY 1)")
def join_diagnostics(spark, d):
    g = I.candidates(spark, d).groupBy("impression_id").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_rows"), F.countDistinct("impression_id").alias("n_ids"), F.sum("n").alias("n_candidates"))


@query("SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS n_users, round(avg(CAST(clicked AS INTEGER)), 6) AS ctr FROM ev")
def profile_events(spark, d):
    return I._events(spark, d).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg(F.col("clicked").cast("int")), 6).alias("ctr"))


@query("SELECT xs[CAST(floor(len(xs) * 0.25) AS BIGINT) + 1] AS p25, xs[CAST(floor(len(xs) * 0.5) AS BIGINT) + 1] AS p50, xs[CAST(floor(len(xs) * 0.75) AS BIGINT) + 1] AS p75, xs[-1] AS most FROM (SELECT list(n ORDER BY n) AS xs FROM (SELECT user_id, count(*) AS n FROM clicks GROUP BY 1))")
def clicks_per_user(spark, d):
    """Quantiles by index of the sorted counts, from a histogram of counts: no list of all users."""
    hist = I.clicks(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))
    run = hist.withColumn("upto", F.sum("users").over(Window.orderBy("n")))  # a row for each distinct count
    total = hist.agg(F.sum("users").alias("total"))
    j = run.join(F.broadcast(total))
    q = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("n")))
    return j.agg(q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("n").alias("most"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR text = '') AS missing_text, count(DISTINCT source) AS categories FROM documents GROUP BY 1")
def profile_articles(spark, d):
    return I.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("missing_text"), F.countDistinct("source").alias("categories"))
