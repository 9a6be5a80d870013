"""Queries over stored histories, snapshots, cut rankings, score tables, leak checks, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.operators import impressions as I  # noqa: E741
from gazette.operators import metrics as M
from gazette.operators import scoring as S
from gazette.operators import snapshots as P
from gazette.operators.reuse import reused, shared_path
from gazette.plans import registry as R
from gazette.plans.prelude import PARTS, cosine_part, history_part, mm, unit_part
from gazette.plans.registry import query
from gazette.sources import readers, score_tables
from gazette.sources.history_store import HistoryStore
from gazette.sources.submission import ranks_by_candidate

_COLS = ", ".join(R._COLS)


# ---- histories: stored in buckets, chosen from snapshots ----


@query("SELECT impression_id, back, article_id, clicked_at FROM hist")
def history_store_as_of(spark, d):
    """history_as_of from a bucketed store: the join by user has no exchange."""
    with HistoryStore.build(I.clicks(spark, d)) as store:
        rows = I.history_rows(store.as_of(store.bucketed(I.candidates(spark, d)), I.CAP))
        # the store is dropped with this block, so its answer is kept
        return reused(rows.select("impression_id", F.col("back").cast("long").alias("back"), "article_id", "clicked_at"), "stored-histories", now=True)


def _snapshots(spark, d) -> DataFrame:
    """user_id, snapshot_ts, history: what a user had clicked by the Wednesdays between impressions."""
    c = I.candidates(spark, d).select("user_id", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).distinct()
    taken = I.as_of(c.withColumn("impression_id", F.concat("user_id", F.lit("@"), F.col("ts").cast("string"))), I.clicks(spark, d))
    return taken.select("user_id", F.col("ts").alias("snapshot_ts"), "history")


PARTS |= {
    "snaps": "SELECT DISTINCT user_id, ts + INTERVAL 2 DAY AS snapshot_ts FROM cand",
    "chosen": "SELECT i.impression_id, i.user_id, i.ts, max(s.snapshot_ts) AS snapshot_ts FROM (SELECT * FROM imps WHERE split = 'val') i LEFT JOIN snaps s ON s.user_id = i.user_id AND s.snapshot_ts <= i.ts GROUP BY ALL",
    "shist": """SELECT * FROM (SELECT i.impression_id, i.snapshot_ts, c.article_id, c.clicked_at, row_number() OVER (PARTITION BY i.impression_id ORDER BY c.clicked_at DESC, c.event_id DESC) AS back
        FROM chosen i JOIN clicks c ON c.user_id = i.user_id AND c.clicked_at < i.snapshot_ts) WHERE back <= 20""",
    "suvec": unit_part("SELECT impression_id, d, avg(x) AS v FROM shist JOIN emb USING (article_id) GROUP BY ALL", "impression_id"),
    "scos": cosine_part("suvec"),
    "rscos": "SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, CAST(article_id AS VARCHAR)) AS rank FROM scos",
}


@query("SELECT impression_id, snapshot_ts, back, article_id FROM chosen LEFT JOIN (SELECT impression_id, back, article_id FROM shist) USING (impression_id)")
def snapshot_history(spark, d):
    """The last snapshot at or before each impression, and what it holds (back null: nothing)."""
    h = P.last_snapshot(I.candidates(spark, d, "val"), _snapshots(spark, d))
    rows = h.select("impression_id", "snapshot_ts", F.size("history").alias("n"), F.posexplode_outer("history").alias("i", "h"))
    return rows.select("impression_id", "snapshot_ts", (F.col("n") - F.col("i")).cast("long").alias("back"), "h.article_id")


@query(f"SELECT {_COLS} FROM rscos")
def snapshot_cosine_ranking(spark, d):
    cand, vec = I.candidates(spark, d, "val"), I.unit_vectors(spark, d)
    return S.rank(S.cosine(cand, S.user_vectors(P.last_snapshot(cand, _snapshots(spark, d)), vec), vec), "id").select(*R._COLS)


@query("SELECT user_id, count(*) AS history_len, max(t) AS last_active_at, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY f) AS articles FROM (SELECT user_id, article_id, min(struct_pack(t := ts, p := pos)) AS f, max(ts) AS t FROM cand GROUP BY ALL) GROUP BY 1")
def ordered_user_merge(spark, d):
    """A user's articles in the order in which impressions first showed them."""
    c = I.candidates(spark, d)
    out = P.first_occurrences(c, "user_id", "article_id", F.struct("ts", "pos"), F.col("article_id").cast("string"), F.max("ts").alias("last_active_at"))
    return out.select("user_id", F.size("entries").cast("long").alias("history_len"), "last_active_at", F.array_join("entries", " ").alias("articles"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS history_len, max(clicked_at) AS last_active_at, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY clicked_at, event_id) AS articles FROM clicks GROUP BY 1")
def history_file_summary(spark, d):
    """Clicks written as a history file of parallel arrays, and that file's summary by user."""
    g = I.clicks(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("clicked_at", "event_id", "article_id"))).alias("xs"))
    path = shared_path(spark, "history-file")
    g.select("user_id", F.transform("xs", lambda x: x["article_id"]).alias("article_id_fixed"), F.transform("xs", lambda x: x["clicked_at"]).alias("impression_time_fixed")).write.parquet(path)
    s = readers.ebnerd_user_summary(spark, path)
    return s.select("user_id", "history_len", "last_active_at", F.array_join(F.transform("clicked_history", lambda x: x["article_id"]), " ").alias("articles"))


# ---- rankings that are cut, written and read back ----

#: Candidates that a cut ranking keeps here; pools of these tables have up to 29.
CUT = 8


@query(f"SELECT {_COLS} FROM rbm WHERE rank <= {CUT}")
def bm25_cut(spark, d):
    return S.top_k(R._bm25(spark, d), CUT).select(*R._COLS)


@query(f"SELECT impression_id, article_id, pos, label, CASE WHEN rank <= {CUT} THEN score ELSE 0 END AS score, CASE WHEN rank <= {CUT} THEN rank ELSE {CUT} + row_number() OVER (PARTITION BY impression_id, rank <= {CUT} ORDER BY pos) END AS rank FROM rcos")
def cosine_cut_and_append(spark, d):
    return S.cut_and_append(reused(R._cosine(spark, d), "cosine-scores"), CUT, "id").select(*R._COLS)


_MEANS = ", ".join(f"round({c}, 6) AS {c}" for c in R._MEANS)


@query(f"SELECT impression_id, n, clicks, {_MEANS} FROM mrcos")
def score_table_metrics(spark, d):
    """The cosine ranking written as a score table of JSON arrays, read back into rows, and measured."""
    path = shared_path(spark, "scores")
    score_tables.write_scores(S.rank(R._cosine(spark, d), "id"), path)
    return M.per_impression(score_tables.read_scores(spark, path)).select("impression_id", "n", "clicks", *[F.round(c, 6).alias(c) for c in R._MEANS])


@query("SELECT impression_id, CAST(user_id AS VARCHAR) AS user_id, ts, pos, CAST(article_id AS VARCHAR) AS article_id, label, score, rank FROM rbm")
def score_table_rows(spark, d):
    path = shared_path(spark, "scores")
    score_tables.write_scores(S.rank(R._bm25(spark, d)), path)
    return score_tables.read_scores(spark, path)


PARTS["rqk"] = f"SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM ({R.ATTENTION_SQL})"


def _attended(spark, d):
    return S.rank(S.attention(I.candidates(spark, d, "val"), R._history(spark, d), I.unit_vectors(spark, d)))


R._lines("prediction_lines_attention", _attended, "rqk")


@query()
def prediction_lines_combiner(spark, d):
    return ranks_by_candidate(S.rank(R._combined(spark, d)))


@query()
def prediction_lines_trained(spark, d):
    from gazette.plans.tuning import _trained

    return ranks_by_candidate(_trained(spark, d))


def _late(spark, d):
    from gazette.plans.tuning import _trained

    return _trained(spark, d)


R.SCORERS |= {"attention": (_attended, "rqk"), "combiner": (lambda s, d: S.rank(R._combined(s, d)), None), "trained": (_late, None)}


# ---- checks and profiles ----


@query("""SELECT kind, impression_id, article_id, count(*) AS n FROM (
  SELECT 'candidate' AS kind, impression_id, article_id, ts FROM cand UNION ALL SELECT 'history', impression_id, article_id, ts FROM hist) x
  JOIN (SELECT doc_id AS article_id, TIMESTAMP '2024-01-01' + to_days(CAST(n_chars % 28 AS INTEGER)) AS published_at FROM documents) p USING (article_id) WHERE published_at > ts + INTERVAL 24 HOUR GROUP BY ALL""")
def publication_leaks_everywhere(spark, d):
    """Candidates and histories that show an article more than a day before it came out. The tables have no such time: the day follows from an article's length."""
    cand = I.candidates(spark, d)
    shown = cand.select(F.lit("candidate").alias("kind"), "impression_id", "article_id", "ts")
    read = I.history_rows(I.as_of(cand, I.clicks(spark, d))).select(F.lit("history").alias("kind"), "impression_id", "article_id", "ts")
    day = F.make_dt_interval(F.col("n_chars") % 28)
    published = I.table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("published_at"))
    return P.published_later(shown.unionByName(read), published).groupBy("kind", "impression_id", "article_id").agg(F.count("*").alias("n"))


@query("SELECT a.article_id FROM art a LEFT JOIN (SELECT DISTINCT article_id FROM cand) c USING (article_id) WHERE c.article_id IS NULL")
def never_shown_articles(spark, d):
    """The set difference the other way round from unresolved_candidates."""
    return I.articles(spark, d).select("article_id").join(I.candidates(spark, d).select("article_id"), "article_id", "left_anti")


@query("""SELECT n_one, n_other, ids_one, ids_other, least_list, round(median_list, 6) AS median_list, most_list, joined, joined > 2 * least(n_one, n_other) AS exploded FROM
  (SELECT count(*) AS n_one, count(DISTINCT impression_id) AS ids_one, min(n) AS least_list, median(n) AS median_list, max(n) AS most_list FROM (SELECT impression_id, count(*) AS n FROM rcos GROUP BY 1)),
  (SELECT count(*) AS n_other, count(DISTINCT impression_id) AS ids_other FROM (SELECT impression_id FROM rbm GROUP BY 1)),
  (SELECT count(*) AS joined FROM (SELECT impression_id FROM rcos GROUP BY 1) JOIN (SELECT impression_id FROM rbm GROUP BY 1) USING (impression_id))""")
def blend_diagnosis(spark, d):
    """Two score tables before they are blended: rows, ids, lengths of lists, and the rows of their join (counted by id, without joining rows)."""
    one = score_tables.to_score_table(S.rank(R._cosine(spark, d), "id"))
    other = score_tables.to_score_table(S.rank(R._bm25(spark, d)))
    length = F.size(F.from_json("ranked_ids", "array<string>"))
    by = one.select("impression_id", length.alias("n"), F.lit(1).alias("one"), F.lit(0).alias("other")).unionByName(other.select("impression_id", F.lit(None).cast("int").alias("n"), F.lit(0).alias("one"), F.lit(1).alias("other")))
    g = by.groupBy("impression_id").agg(F.sum("one").alias("a"), F.sum("other").alias("b"), F.max("n").alias("n"))
    lists = F.col("n")
    out = g.agg(F.sum("a").alias("n_one"), F.sum("b").alias("n_other"), F.count_if(F.col("a") > 0).alias("ids_one"), F.count_if(F.col("b") > 0).alias("ids_other"), F.min(lists).cast("long").alias("least_list"), F.round(F.percentile(lists, F.lit(0.5)), 6).alias("median_list"), F.max(lists).cast("long").alias("most_list"), F.sum(F.col("a") * F.col("b")).alias("joined"))
    return out.withColumn("exploded", F.col("joined") > 2 * F.least("n_one", "n_other"))


@query("""SELECT slice, count(*) AS n_impressions, round(avg(t), 6) AS novelty_train, round(avg(f), 6) AS novelty_full FROM sl JOIN (
  SELECT impression_id, avg(-log2(greatest(coalesce(p.exposures, 0), 1) / (SELECT sum(exposures) FROM pop))) AS t, avg(-log2(greatest(coalesce(a.exposures, 0), 1) / (SELECT count(*) FROM cand))) AS f
  FROM rcos LEFT JOIN pop p USING (article_id) LEFT JOIN (SELECT article_id, count(*) AS exposures FROM cand GROUP BY 1) a USING (article_id) WHERE rank <= 10 GROUP BY 1) USING (impression_id) GROUP BY 1""")
def novelty_by_popularity(spark, d):
    """Novelty by slice under both popularities: of the training split, and of all splits, which knows what comes later."""
    ranked = reused(S.rank(R._cosine(spark, d), "id").where("rank <= 10").select("impression_id", "article_id", "rank"), "best-ten")
    train, full = R._train_pop(spark, d), I.popularity(I.candidates(spark, d))
    n = M.novelty(ranked, train).withColumnRenamed("novelty", "t").join(M.novelty(ranked, full).withColumnRenamed("novelty", "f"), "impression_id")
    sl = M.slices(I.candidates(spark, d, "val"), R._history(spark, d), train)
    return sl.join(n, "impression_id").groupBy("slice").agg(F.count("*").alias("n_impressions"), F.round(F.avg("t"), 6).alias("novelty_train"), F.round(F.avg("f"), 6).alias("novelty_full"))


def spread(counts: DataFrame, n: str, marks: dict[str, float], down: bool = False) -> DataFrame:
    """One row: how many counts there are, the least, the largest, their mean, and for each mark the count at that share of the sorted list (down: from the largest).

    From a histogram of the counts: a row for each distinct one, so no list of all is made.
    """
    hist = counts.groupBy(F.col(n).alias("c")).agg(F.count("*").alias("m"))
    order = F.col("c").desc() if down else F.col("c")
    run = hist.withColumn("upto", F.sum("m").over(Window.orderBy(order))).join(F.broadcast(hist.agg(F.sum("m").alias("total"))))
    pick = F.max if down else F.min
    at = [pick(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("c"))).alias(k) for k, p in marks.items()]
    return run.agg(F.max("total").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"), F.round(F.sum(F.col("c") * F.col("m")) / F.sum("m"), 2).alias("mean"), *at)


def _spread_sql(inner: str, marks: dict[str, float], down: bool = False) -> str:
    at = ", ".join(f"xs[CAST(floor(len(xs) * {p}) AS BIGINT) + 1] AS {k}" for k, p in marks.items())
    return f"SELECT len(xs) AS n, list_min(xs) AS least, list_max(xs) AS most, round(list_sum(xs) / len(xs), 2) AS mean, {at} FROM (SELECT list(c ORDER BY c {'DESC' if down else ''}) AS xs FROM ({inner}))"


_USER = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Shares of the list from the largest count on.
_ARTICLE = {"median": 0.5, "p75": 0.25, "p90": 0.1, "p95": 0.05}


@query(_spread_sql("SELECT sum(label) AS c FROM cand GROUP BY user_id HAVING sum(label) > 0", _USER))
def clicks_by_user(spark, d):
    return spread(I.candidates(spark, d).groupBy("user_id").agg(F.sum("label").alias("c")).where("c > 0"), "c", _USER)


@query(_spread_sql("SELECT count(*) AS c FROM cand GROUP BY article_id", _ARTICLE, True))
def impressions_by_article(spark, d):
    return spread(I.candidates(spark, d).groupBy("article_id").agg(F.count("*").alias("c")), "c", _ARTICLE, True)


@query("SELECT count(*) AS pairs, CAST(sum(label) AS BIGINT) AS clicks, round(avg(label), 4) AS ctr, min(ts) AS first_ts, max(ts) AS last_ts FROM cand")
def click_through_rate(spark, d):
    return I.candidates(spark, d).agg(F.count("*").alias("pairs"), F.sum("label").alias("clicks"), F.round(F.avg("label"), 4).alias("ctr"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT count(*) AS articles, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS missing_text, round(100.0 * count(*) FILTER (WHERE trim(coalesce(text, '')) = '') / count(*), 2) AS missing_text_pct, count(*) FILTER (WHERE trim(coalesce(source, '')) = '') AS missing_category, round(100.0 * count(*) FILTER (WHERE trim(coalesce(source, '')) = '') / count(*), 2) AS missing_category_pct FROM documents")
def missing_fields(spark, d):
    none = lambda c: F.count_if(F.trim(F.coalesce(c, F.lit(""))) == "")
    g = I.articles(spark, d).agg(F.count("*").alias("articles"), none("cleaned_text").alias("missing_text"), none("category").alias("missing_category"))
    pct = lambda c: F.round(100 * F.col(c) / F.nullif(F.col("articles"), F.lit(0)), 2).alias(f"{c}_pct")
    return g.select("*", pct("missing_text"), pct("missing_category"))


@query("SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, d):
    return I.unit_vectors(spark, d).groupBy(F.size("vec").cast("long").alias("dimension")).agg(F.count("*").alias("n"))
