"""Parsing, metrics, ranking and file formats on small cases."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from gazette.functions import parse
from gazette.functions.stem import danish, english, stems
from gazette.functions.text import tokens
from gazette.operators import metrics as M
from gazette.operators import scoring as S
from gazette.operators import impressions as I
from gazette.operators.impressions import as_of, history_rows
from gazette.operators.reuse import unique_join
from gazette.plans import registry
from gazette.sources import readers, submission, writers


def ranked(spark, labels, scores):
    rows = [("i", p, p, y, float(x)) for p, (y, x) in enumerate(zip(labels, scores, strict=True), 1)]
    return S.rank(spark.createDataFrame(rows, "impression_id string, pos int, article_id long, label int, score double"))


@pytest.mark.parametrize(
    "labels,scores,auc,mrr",
    [([1, 1, 0, 0, 0], [0.9, 0.8, 0.3, 0.2, 0.1], 1, 1), ([0, 1], [0.9, 0.1], 0, 0.5), ([0, 1, 0, 1], [0.5] * 4, 0.5, 0.5), ([0, 0], [1, 2], 0.5, 0), ([1, 1], [1, 2], 0.5, 1)],
)
def test_metrics(spark, labels, scores, auc, mrr):
    r = M.per_impression(ranked(spark, labels, scores)).first()
    assert (r.auc, r.mrr) == (auc, mrr)


def test_recall_at_k(spark):
    df = ranked(spark, [1, 0, 1, 0, 0], [5, 2, 4, 3, 1]).withColumn("label", F.col("article_id").isin(1, 2).cast("int"))
    r = M.per_impression(df, (1, 2, 3, 5)).first()
    assert (r.recall1, r.recall2, r.recall3, r.recall5) == (0.5, 0.5, 0.5, 1.0)


def test_stable_ranks_and_positions(spark):
    df = ranked(spark, [0] * 4, [0.2, 0.9, 0.2, -1])
    assert submission.ranks_by_candidate(df).first().line == "i [2,1,3,4]"
    assert submission.positions_by_rank(df).first().line == "i [2,1,3,4]"
    df = ranked(spark, [0] * 3, [1, 3, 2])
    assert (submission.ranks_by_candidate(df).first().line, submission.positions_by_rank(df).first().line) == ("i [3,1,2]", "i [2,3,1]")


def test_lines_and_package(spark, tmp_path):
    df = spark.createDataFrame([("1", "1 [2,1]"), ("2", "2 [1,2]")], "impression_id string, line string")
    assert [r.v for r in df.select(submission.valid_line(F.col("line")).alias("v")).collect()] == [True, True]
    bad = spark.createDataFrame([("1 [1,1]",), ("1 [0,1]",), ("1 2",), ("",), ("1 []",)], "line string")
    assert not any(r.v for r in bad.select(submission.valid_line(F.col("line")).alias("v")).collect())
    digest = submission.package(df, str(tmp_path / "p.zip"))
    assert len(digest) == 64 and submission.validate_package(str(tmp_path / "p.zip")) == 2


def test_as_of_is_strict(spark):
    t = dt.datetime(2023, 5, 25, 7)
    clicks = [("u", i, t + dt.timedelta(seconds=s), i) for i, s in enumerate([-9e5, -100, -1, 0, 100])]
    c = spark.createDataFrame(clicks, "user_id string, article_id long, clicked_at timestamp_ntz, event_id long")
    i = spark.createDataFrame([("a", "u", t), ("b", "none", t), ("c", "u", t - dt.timedelta(days=90))], "impression_id string, user_id string, ts timestamp_ntz")
    h = as_of(i, c, 2)
    assert {r.impression_id: [x.article_id for x in r.history] for r in h.collect()} == {"a": [1, 2], "b": [], "c": []}
    assert sorted((r.back, r.article_id) for r in history_rows(h).collect()) == [(1, 2), (2, 1)]


def test_as_of_keeps_clicks_without_a_time_and_numbers_across_days(spark):
    t = dt.datetime(2024, 3, 1, 12)
    clicks = [("u", 100 + i, t - dt.timedelta(hours=7 * i), i) for i in range(40)] + [("u", 7, None, 99), ("v", 8, None, 1)]
    c = spark.createDataFrame(clicks, "user_id string, article_id long, clicked_at timestamp_ntz, event_id long")
    rows = [("a", "u", t), ("b", "u", t - dt.timedelta(days=3)), ("c", "v", t), ("d", "u", t - dt.timedelta(days=90))]
    i = spark.createDataFrame(rows, "impression_id string, user_id string, ts timestamp_ntz")
    got = {r.impression_id: [x.article_id for x in r.history] for r in as_of(i, c, 5).collect()}

    def brute(user, ts):
        own = sorted(((x[2] is not None, x[2] or t, x[3], x[1]) for x in clicks if x[0] == user and (x[2] is None or x[2] < ts)))
        return [x[3] for x in own][-5:]

    assert got == {k: brute(u, ts) for k, u, ts in rows} and got["c"] == [8] and got["d"] == [7]


def test_history_needs_no_list_of_all_clicks_and_splits_reach_the_scan(spark):
    d = "/root/testdata/sf0.001"
    plan = I.candidates(spark, d, "val")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-15" in plan and "LessThan(ts,2024-01-29" in plan
    held = as_of(I.candidates(spark, d, "val"), I.clicks(spark, d))
    assert held.selectExpr("max(size(history))").first()[0] <= I.CAP


def test_unique_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k long, v string")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k long, w long")
    assert sorted(map(tuple, unique_join(a, b, ["k"]).collect())) == [(1, "x", 5), (2, "y", 6), (2, "z", 6)]
    with pytest.raises(Exception, match="a key occurs several times: 2"):
        unique_join(b, a, ["k"]).collect()


def test_vector_search_in_blocks(spark, monkeypatch):
    v = I.unit_vectors(spark, "/root/testdata/sf0.001")
    one = sorted(map(tuple, S.search_vectors(v, F.col("article_id") % 7 == 0, 3).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, S.search_vectors(v, F.col("article_id") % 7 == 0, 3).collect())) == one and len(one) > 6
    assert S.search_vectors(v, F.col("article_id") < 0, 3).count() == 0


def test_recency_weight(spark):
    t = dt.datetime(2024, 1, 8)
    r = spark.createDataFrame([(t - dt.timedelta(days=7), None, t)], "a timestamp_ntz, b timestamp_ntz, ts timestamp_ntz").select(S.recency_weight(F.col("a"), F.col("ts")).alias("a"), S.recency_weight(F.col("b"), F.col("ts")).alias("b"), S.recency_weight(F.col("ts"), F.col("a")).alias("c")).first()
    assert r.a == pytest.approx(math.exp(-1)) and r.b == 1.0 and r.c == 1.0


def test_single_lines_and_labels(spark):
    ok = spark.createDataFrame([("9\tKim\t3/4/2021 7:45:10 AM\tA7\tC30 D31-1",)], "line string").select(parse.behavior_row(F.col("line")).alias("r")).first().r
    assert ok.candidates == ["C30", "D31"] and ok.impression_id == "9"
    for bad in ("9\tKim\t3/4/2021 7:45:10 AM\tA7", "9\tKim\t3/4/2021 7:45:10 AM\tA7\t "):
        with pytest.raises(Exception, match="not a line of five fields"):
            spark.createDataFrame([(bad,)], "line string").select(parse.behavior_row(F.col("line"))).collect()
    r = spark.createDataFrame([(["a", "b", "c"], ["b", "a", "b"], [1, 1, 0])], "r array<string>, c array<string>, y array<int>").select(parse.labels_of(F.col("r"), F.col("c"), F.col("y")).alias("y")).first()
    assert r.y == [1, 0, 0]


def test_files_are_found_and_replaced(spark, tmp_path):
    (tmp_path / "x_test").mkdir()
    (tmp_path / "x_test" / "behaviors.tsv").write_text("1\tKim\t3/4/2021 7:45:10 AM\tA7\tC30\n")
    assert readers.find_first(spark, str(tmp_path), readers.BEHAVIOR_FILES).endswith("x_test/behaviors.tsv")
    with pytest.raises(FileNotFoundError):
        readers.find_first(spark, str(tmp_path), readers.PARQUET_TESTS)
    spark.createDataFrame([(1, [3.0, 4.0])], "article_id long, v array<double>").write.parquet(str(tmp_path / "a_bert" / "v.parquet"))
    assert readers.load_embeddings(spark, str(tmp_path), "bert").first().vec == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        readers.load_embeddings(spark, str(tmp_path), "other")
    at = str(tmp_path / "t")
    writers.replace_table(spark.range(3).toDF("x"), at)
    old = spark.read.parquet(at)
    writers.replace_table(old.where("x > 0"), at)
    assert sorted(r.x for r in spark.read.parquet(at).collect()) == [1, 2] and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_generated_submission(spark, tmp_path):
    n, digest = registry.generate_submission(spark, "/root/testdata/sf0.001", "decayed", str(tmp_path / "p.zip"))
    assert n == I.candidates(spark, "/root/testdata/sf0.001", "val").select("impression_id").distinct().count() and len(digest) == 64


def test_bm25_toy(spark):
    """Against the formula, term by term."""
    texts = {1: "rain over the harbour and rain over the hills", 2: "a ferry leaves the harbour", 3: "ferries and trains", 4: "the rain and the ferry", 5: "one gull"}
    arts = spark.createDataFrame(list(texts.items()), "article_id long, cleaned_text string")
    cand = spark.createDataFrame([("i", 1, a) for a in texts], "impression_id string, pos int, article_id long")
    hist = spark.createDataFrame([("i", dt.datetime(2024, 1, 1), [(4,)])], "impression_id string, ts timestamp_ntz, history array<struct<article_id:long>>").withColumn("history", F.transform("history", lambda h: F.struct(F.lit(None).cast("timestamp_ntz").alias("clicked_at"), F.lit(1).cast("long").alias("event_id"), h["article_id"].alias("article_id"))))
    got = {r.article_id: r.score for r in S.bm25(cand, hist, arts).collect()}
    docs = {a: t.split() for a, t in texts.items()}
    n, avg = 5, sum(map(len, docs.values())) / 5
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    raw = {w: math.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    for a, d in docs.items():
        s = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in docs[4] if w in d)
        assert got[a] == pytest.approx(max(s, 0), abs=1e-4)


def test_bootstrap_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(f"i{i}", "ab"[i % 2], float(rng.random())) for i in range(700)] + [("n", "a", None)]
    rows = spark.createDataFrame(data, "impression_id string, slice string, auc double").repartition(5)
    keys = {r.impression_id: r.k for r in rows.select("impression_id", F.xxhash64("impression_id").alias("k")).collect()}
    got = {r.slice: r for r in M.bootstrap(rows, "auc", "slice", resamples=400).collect()}
    for name in "ab":
        mine = [(keys[i], x) for i, s, x in data if s == name and x is not None]
        x = np.array([v for _, v in mine])
        w = M.poisson_weights(np.array([k for k, _ in mine], np.int64).view(np.uint64), 400, 42)
        again = x @ w / w.sum(0)
        assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
        assert (got[name].mean, got[name].ci_low, got[name].ci_high) == pytest.approx((x.mean(), *np.percentile(again, [2.5, 97.5])))
        plain = rng.choice(x, (2000, len(x))).mean(1)
        assert (got[name].ci_low, got[name].ci_high) == pytest.approx(tuple(np.percentile(plain, [2.5, 97.5])), abs=0.01)


def test_intervals_of_slices(spark):
    rows = spark.createDataFrame([(f"i{i}", i / 300) for i in range(300)], "impression_id string, auc double")
    where = spark.createDataFrame([(f"i{i}", s) for i in range(300) for s in ("all", "big" if i else "tiny")], "impression_id string, slice string")
    got = {r.slice: r for r in M.summary_with_intervals(rows, where, "auc").collect()}
    assert got["all"].status == "ok" and got["all"].ci_low < got["all"].mean < got["all"].ci_high
    assert got["tiny"].status == got["big"].status == "insufficient_n" and got["tiny"].ci_low is None


def test_stems(spark):
    """Words whose stems the two algorithms' descriptions fix."""
    en = "consign consigned consigning consignment consist consistency consistently knack knightly generously running skies dying happily relational hopping hoping national controlling news agreed flies ties by say cries conditional sensational replacement adoption"
    to = "consign consign consign consign consist consist consist knack knight generous run sky die happili relat hop hope nation control news agre fli tie by say cri condit sensat replac adopt"
    assert [english(w) for w in en.split()] == to.split()
    da = "indtage indtagelse indtager indvendig undersøgelse undersøgelser underskrift katten heste hestenes billig løst bestemt dagligt"
    to = "indtag indtag indtag indvend undersøg undersøg underskrift kat hest hest bil løst bestemt dag"
    assert [danish(w) for w in da.split()] == to.split()
    got = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in en.split() * 2], "term string")).collect()}
    assert got == {w: english(w) for w in en.split()}


def test_bm25_of_stems(spark):
    """Stemming terms is the same as stemming the texts' words beforehand."""
    arts = spark.createDataFrame([(1, "the ferries are running"), (2, "a ferry runs"), (3, "gulls"), (4, "running ferries")], "article_id long, cleaned_text string")
    plain = spark.createDataFrame([(r.article_id, " ".join(english(w) for w in r.cleaned_text.split())) for r in arts.collect()], "article_id long, cleaned_text string")
    rows = lambda df: sorted((r.article_id, r.term, r.tf, round(r.w, 9)) for r in df.collect())
    assert rows(S.weights(arts, stem=True)) == rows(S.weights(plain)) and len(rows(S.weights(plain))) > 7


def test_danish_tokens(spark):
    r = spark.createDataFrame([("Katten så måtten på en ræv",)], "t string").select(tokens(F.col("t"), "da").alias("a"), tokens(F.col("t"), "da", True).alias("b")).first()
    assert r.a == ["katten", "så", "måtten", "på", "en", "ræv"] and r.b == ["katten", "så", "måtten", "ræv"]


def test_mind_files(spark, tmp_path):
    ent = json.dumps([{"Label": "X", "Type": "P", "WikidataId": "Q1", "Confidence": 1.0, "OccurrenceOffsets": [1], "SurfaceForms": ["x"]}] * 2)
    (tmp_path / "a.tsv").write_text(f"A7\tculture\tfilm\tTitle \"one\tAbs\tu\t{ent}\t[]\nB8\tsport\t\tT2\t\tu\tnot json\n")
    (tmp_path / "b.tsv").write_text("A7\tculture\tfilm\tLater\tAbs2\tu\t[]\t[]\n")
    a = {r.article_id: r for r in readers.mind_articles(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).collect()}
    assert a["A7"].title == 'Title "one' and len(a["A7"].entities) == 1 and a["B8"].abstract is None and a["B8"].entities == []
    c = {r.article_id: r.text for r in readers.mind_catalog(spark, [str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv")]).collect()}
    assert c["A7"] == "Later Abs2" and c["B8"] == "T2"
    (tmp_path / "c.tsv").write_text("1\tKim\t3/4/2021 7:45:10 AM\tA7 B8\tC30-1 D-31-0 E32-x bad\n2\tAda\t3/4/2021 7:45:10 PM\t\tA7-0\n")
    b = readers.mind_behaviors(spark, str(tmp_path / "c.tsv")).orderBy("impression_id").collect()
    assert b[0].candidates == ["C30", "D-31"] and b[0].labels == [1, 0] and b[0].ts == dt.datetime(2021, 3, 4, 7, 45, 10) and b[1].ts.hour == 19 and b[1].clicked_history == []
    (tmp_path / "d.tsv").write_text("51\tKim\t3/4/2021 7:45:10 AM\tA7 B8\tC30 D31-1 E32\n52\tKim\tsoon\tA7\tB8\n")
    t = readers.mind_behaviors(spark, str(tmp_path / "d.tsv"), labelled=False).orderBy("impression_id").collect()
    assert t[0].candidates == ["C30", "D31", "E32"] and t[1].ts is None


def test_ebnerd_files(spark, tmp_path):
    t = dt.datetime(2023, 5, 25)
    spark.createDataFrame([(1, [10, 11], [11], 7, t), (2, [10], None, 8, t)], "impression_id long, article_ids_inview array<int>, article_ids_clicked array<int>, user_id long, impression_time timestamp").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(7, [t, None], [5, 6])], "user_id long, impression_time_fixed array<timestamp>, article_id_fixed array<int>").write.parquet(str(tmp_path / "h"))
    r = readers.ebnerd_behaviors(spark, str(tmp_path / "b"), str(tmp_path / "h")).orderBy("impression_id").collect()
    assert r[0].labels == [0, 1] and [h.article_id for h in r[0].clicked_history] == ["5", "6"] and r[0].clicked_history[1].clicked_at is None and r[1].labels == [0] and r[1].clicked_history == []
    spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "article_id int, v0 float, v1 float").write.parquet(str(tmp_path / "e"))
    e = {r.article_id: r.vec for r in readers.embeddings(spark, str(tmp_path / "e")).collect()}
    assert e["1"] == pytest.approx([0.6, 0.8]) and e["2"] == [0.0, 0.0]


def test_upsert_and_names(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, writers.upsert(old, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 3)]
    assert writers.score_name("mind", "bm25", stem=0, stop=1) == "mind_bm25_stem-0_stop-1"
    ids = spark.createDataFrame([(i,) for i in range(9)], "article_id long")
    assert writers.catalog_tag(ids).first() == writers.catalog_tag(ids.orderBy(F.desc("article_id"))).first()


def test_tagged_entities_and_tail(spark):
    r = spark.createDataFrame([(["A", "", "A"], None)], "n array<string>, g array<string>").select(parse.tagged_entities(F.col("n"), F.col("g")).alias("e"), parse.tail(F.array(*map(F.lit, [1, 2, 3])), 5).alias("x"), parse.tail(F.array(*map(F.lit, [1, 2, 3])), 2).alias("y")).first()
    assert [tuple(x) for x in r.e] == [("A", "NER")] and r.x == [1, 2, 3] and r.y == [2, 3]


def test_streamed_popularity(spark, tmp_path):
    from gazette.streaming.popularity import start

    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(src, tmp_path / "in/e.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("exposures").alias("n")).first().n
    assert 0 < out <= spark.read.parquet(src).count()


def test_text_search_in_blocks(spark, monkeypatch):
    """Any grid gives the rows of a plain sum over pairs."""
    a = I.articles(spark, "/root/testdata/sf0.001").where("article_id < 90")
    w = S.weights(a).collect()
    mine, want = {}, []
    for r in w:
        mine.setdefault(r.term, []).append(r)
    for q in range(0, 90, 7):
        total = {}
        for r in (r for r in w if r.article_id == q):
            for x in mine[r.term]:
                total[x.article_id] = total.get(x.article_id, 0) + r.tf * x.w
        want += [(q, i, round(s + S.TINY, 4), n) for n, (i, s) in enumerate(sorted(total.items(), key=lambda x: (-round(x[1] + S.TINY, 4), x[0]))[:5], 1)]
    for blocks in ((2048, 4096), (2, 7)):
        monkeypatch.setattr(S, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(S, "ARTICLE_BLOCK", blocks[1])
        got = sorted((tuple(r) for r in S.search_bm25(a, F.col("article_id") % 7 == 0, 5).collect()), key=lambda r: (r[0], r[3]))
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want] and all(abs(x[2] - y[2]) < 2e-4 for x, y in zip(got, want))
    assert S.search_bm25(a, F.col("article_id") < 0, 3).count() == 0


def test_text_search_shuffles_no_copies(spark, monkeypatch):
    """What is shuffled doesn't grow with the pairs of blocks."""
    a = I.articles(spark, "/root/testdata/sf0.001")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    took, rows = [], []
    for blocks in ((2048, 4096), (4, 12)):
        monkeypatch.setattr(S, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(S, "ARTICLE_BLOCK", blocks[1])
        before = shuffled()
        rows.append(sorted(map(tuple, S.search_bm25(a, F.col("article_id") % 7 == 0, 5).collect())))
        took.append(shuffled() - before)
    assert rows[0] == rows[1] and 0 < took[1] < 2.5 * took[0]


def test_text_search_with_odd_rows(spark, monkeypatch):
    """Repeated and null ids, weights of zero and below, texts without tokens: the rows of a plain sum by id."""
    texts = [(1, "alpha beta gamma"), (2, "alpha beta"), (7, "alpha delta delta"), (7, "beta alpha"), (9, ""), (10, None), (None, "delta omega"), (None, "alpha"), (14, "alpha omega omega"), (15, "zeta"), (21, "beta alpha beta")]
    a = spark.createDataFrame(texts, "article_id long, cleaned_text string")
    docs = [(i, (t or "").split()) for i, t in texts]
    n, avgdl = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {t: sum(t in d for _, d in docs) for _, x in docs for t in x}
    raw = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    want = []
    for q in (7, 14, 21):
        total = {}
        for i, d in docs:
            for t in (t for j, e in docs if j == q for t in e if t in d):
                total[i] = total.get(i, 0) + idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
        best = sorted(total.items(), key=lambda x: (-round(x[1] + S.TINY, 4), x[0] is None, x[0] or 0))[:4]
        want += [(q, i, round(s + S.TINY, 4), r) for r, (i, s) in enumerate(best, 1)]
    for block in (4096, 2):
        monkeypatch.setattr(S, "ARTICLE_BLOCK", block)
        got = sorted(map(tuple, S.search_bm25(a, F.col("article_id") % 7 == 0, 4).collect()), key=lambda r: (r[0], r[3]))
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want] and all(abs(x[2] - y[2]) < 2e-4 for x, y in zip(got, want))


def test_attention_against_its_definition(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    vec = {i: rng.standard_normal(4) for i in range(12)}
    cand = [("a", p, i, 0) for p, i in enumerate([3, 99, 5, 7], 1)] + [("b", 1, 4, 1), ("c", 1, 98, 0)]
    hist = {"a": [1, 2, 99, 2], "b": [], "c": [1]}
    df = spark.createDataFrame(cand, "impression_id string, pos int, article_id long, label int")
    h = spark.createDataFrame([(k, None, [(x, None) for x in v]) for k, v in hist.items()], "impression_id string, ts timestamp_ntz, history array<struct<article_id:long,clicked_at:timestamp_ntz>>")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in vec.items()], "article_id long, vec array<double>")
    got = {(r.impression_id, r.pos): r.score for r in S.attention(df, h, v).collect()}
    for k, p, i, _ in cand:
        own, want = [vec[x] for x in hist[k] if x in vec], 0.0
        if own and i in vec:
            e = np.exp([x @ vec[i] / 0.2 for x in own])
            u = sum(a * x for a, x in zip(e, own))
            want = u @ vec[i] / np.linalg.norm(u)
        assert got[k, p] == pytest.approx(want, abs=1e-5)
    assert len(got) == len(cand)


@pytest.mark.parametrize("stopwords,name", [(False, "bm25_stem_ranking"), (True, "bm25_stopwords_stem_ranking")])
def test_stem_rankings_against_plain_python(spark, stopwords, name):
    import re
    from collections import Counter

    from gazette.functions.text import ENGLISH

    d = "/root/testdata/sf0.001"
    found = {r.article_id: re.findall("[a-z0-9]+", (r.cleaned_text or "").lower()) for r in I.articles(spark, d).collect()}
    terms = {i: Counter(english(t) for t in ts if not stopwords or t not in ENGLISH) for i, ts in found.items()}
    size = {i: sum(c.values()) for i, c in terms.items()}
    n, mean = len(terms), sum(size.values()) / len(terms)
    df = Counter(t for c in terms.values() for t in c)
    raw = {t: math.log((n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    cand = I.candidates(spark, d, "val").collect()
    hist = {r.impression_id: [h.article_id for h in r.history] for r in registry._history(spark, d).collect()}
    pools = {}
    for r in cand:
        query = Counter()
        for h in hist.get(r.impression_id, []):
            query.update(terms.get(h, {}))
        own = terms.get(r.article_id, {})
        s = sum(q * idf[t] * own[t] * 2.5 / (own[t] + 1.5 * (0.25 + 0.75 * size[r.article_id] / mean)) for t, q in query.items() if t in own)
        pools.setdefault(r.impression_id, []).append((-round(max(s, 0) + S.TINY, 4), r.pos, r.article_id))
    want = {(i, a): (k, -s) for i, pool in pools.items() for k, (s, _, a) in enumerate(sorted(pool), 1)}
    got = {(r.impression_id, r.article_id): (r["rank"], r.score) for r in registry.QUERIES[name](spark, d).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-4 for x in want)
