"""Stored histories, snapshots, leak checks, merges in order, score tables and keyed tables."""

import datetime as dt
import json
import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from gazette.operators import impressions as I
from gazette.operators import metrics as M
from gazette.operators import reuse
from gazette.operators import scoring as S
from gazette.operators import snapshots as P
from gazette.plans import catalog, extended, registry
from gazette.sources import history_store, readers, score_tables, submission
from gazette.sources.history_store import HistoryStore

SF = "/root/testdata/sf0.001"
T = dt.datetime(2024, 3, 1, 12)
CLICKS = "user_id string, article_id long, clicked_at timestamp_ntz, event_id long"
ASKS = "impression_id string, user_id string, ts timestamp_ntz"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_clicks(rng):
    """Few moments, so that times tie; some without a time; a user with most clicks."""
    rows = []
    for i in range(400):
        user = "hot" if rng.random() < 0.6 else f"u{rng.randrange(8)}"
        rows.append((user, rng.randrange(50), None if rng.random() < 0.05 else T + dt.timedelta(hours=rng.randrange(60)), i))
    return rows


def last_clicks(rows, user, ts, cap):
    own = sorted((c is not None, c or T, e, a) for u, a, c, e in rows if u == user and (c is None or c < ts))
    return [x[3] for x in own][-cap:]


@pytest.mark.parametrize("chunk,cap", [(5, 5), (8, 3), (256, 50)])
def test_bucketed_history_against_brute_force(spark, chunk, cap):
    rng = random.Random(chunk)
    rows = some_clicks(rng)
    asks = [(f"i{k}", rng.choice(["hot", "u0", "u1", "nobody"]), T + dt.timedelta(hours=rng.randrange(-5, 65))) for k in range(60)]
    with HistoryStore.build(spark.createDataFrame(rows, CLICKS), buckets=3, chunk=chunk, cap=cap) as store:
        imps = spark.createDataFrame(asks, ASKS)
        mine = store.bucketed(imps)
        found = store.as_of(mine, cap)
        assert "Exchange" not in plan(found) and "Bucketed: true" in plan(found)
        want = {i: last_clicks(rows, u, t, cap) for i, u, t in asks}
        assert {r.impression_id: [x.article_id for x in r.history] for r in found.collect()} == want
        assert {r.impression_id: [x.article_id for x in r.history] for r in store.as_of(imps, cap).collect()} == want
        assert all(len(r.entries) <= chunk + cap for r in spark.table(store.name).collect())
        names = [store.name, *store.own]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_named_store_is_found_again(spark):
    rows = [("a", 1, T, 1), ("a", 2, T + dt.timedelta(hours=1), 2)]
    clicks = spark.createDataFrame(rows, CLICKS)
    name = "gazette_test_store"
    HistoryStore.build(clicks, name, buckets=2).close()
    store = HistoryStore.open(spark, name)
    assert store.buckets == 2
    asks = spark.createDataFrame([("x", "a", T + dt.timedelta(hours=1)), ("y", "a", None)], ASKS)
    assert {r.impression_id: [h.article_id for h in r.history] for r in store.as_of(asks).collect()} == {"x": [1], "y": []}
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError):
        history_store.chunks(clicks, chunk=3, cap=4)
    with HistoryStore.build(clicks.limit(0)) as none:
        assert [r.history for r in none.as_of(asks).collect()] == [[], []]


def test_last_snapshot_against_brute_force(spark):
    rng = random.Random(9)
    snaps = {(rng.choice("ab"), T + dt.timedelta(hours=rng.randrange(200))): [rng.randrange(9)] for _ in range(40)}
    asks = [(f"i{k}", rng.choice("abc"), T + dt.timedelta(hours=rng.randrange(-20, 230))) for k in range(80)] + [("same", *next(iter(snaps))), ("never", "a", None)]
    df = spark.createDataFrame([(u, t, h) for (u, t), h in snaps.items()], "user_id string, snapshot_ts timestamp_ntz, history array<int>")
    got = {r.impression_id: (r.snapshot_ts, r.history) for r in P.last_snapshot(spark.createDataFrame(asks, ASKS), df).collect()}
    for i, u, t in asks:
        last = max((at for user, at in snaps if user == u and t and at <= t), default=None)
        assert got[i] == (last, snaps.get((u, last), []))
    assert P.last_snapshot(spark.createDataFrame(asks, ASKS), df.limit(0)).where("size(history) > 0").count() == 0


def test_published_later_against_brute_force(spark):
    rng = random.Random(2)
    out = {a: None if a == 0 else T + dt.timedelta(hours=rng.randrange(-300, 900)) for a in range(30)}
    items = [(i, rng.choice([1, rng.randrange(32)]), None if i == 0 else T + dt.timedelta(hours=rng.randrange(700))) for i in range(500)]
    df, pub = spark.createDataFrame(items, "id int, article_id int, ts timestamp_ntz"), spark.createDataFrame(list(out.items()), "article_id int, published_at timestamp_ntz")
    want = {i for i, a, t in items if t and out.get(a) and out[a] > t + dt.timedelta(hours=24)}
    for days in (1, 7, 400):
        got = [r.id for r in P.published_later(df, pub, days=days).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert P.published_later(df.limit(0), pub).count() == 0 and P.published_later(df, pub.limit(0)).count() == 0


def test_users_of_two_splits_in_order(spark, tmp_path):
    hours = lambda *hs: [T + dt.timedelta(hours=h) for h in hs]
    one = [(5, [3, 1, 3], hours(1, 2, 3)), (6, [], []), (7, None, None)]
    two = [(5, [9, 1, 4], hours(4, 5, 6)), (8, [2], hours(1))]
    beh = [[(5, hours(1)[0]), (7, hours(0)[0]), (5, hours(9)[0]), (6, hours(2)[0])], [(8, hours(3)[0]), (5, hours(5)[0])]]
    splits = []
    for k, (h, b) in enumerate(((one, beh[0]), (two, beh[1]))):
        spark.createDataFrame(h, "user_id int, article_id_fixed array<int>, impression_time_fixed array<timestamp_ntz>").write.parquet(str(tmp_path / f"h{k}"))
        spark.createDataFrame(b, "user_id int, impression_time timestamp_ntz").repartition(2).write.parquet(str(tmp_path / f"b{k}"))
        splits.append((str(tmp_path / f"b{k}"), str(tmp_path / f"h{k}")))
    got = {r.user_id: ([x.article_id for x in r.clicked_history], r.history_len, r.last_active_at) for r in readers.ebnerd_users(spark, splits).collect()}
    assert got == {"5": (["3", "1", "9", "4"], 4, hours(9)[0]), "6": ([], 0, hours(2)[0]), "7": ([], 0, hours(0)[0]), "8": (["2"], 1, hours(3)[0])}
    first = {x.article_id: x.clicked_at for x in next(r for r in readers.ebnerd_users(spark, splits).collect() if r.user_id == "5").clicked_history}
    assert first["3"] == hours(1)[0] and first["1"] == hours(2)[0]
    s = {r.user_id: (r.history_len, r.last_active_at) for r in readers.ebnerd_user_summary(spark, splits[0][1]).collect()}
    assert s["5"] == (3, hours(3)[0]) and s["6"] == (0, None)


def scored(spark, pools):
    rows = [(i, 7, T, p, p * 10, int(p % 3 == 0), float(s)) for i, scores in pools.items() for p, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "impression_id string, user_id int, ts timestamp_ntz, pos int, article_id long, label int, score double")


def test_cut_and_append(spark):
    df = scored(spark, {"a": [1, 5, 5, 2, 9], "b": [3, 4], "c": [0, 0, 0]})
    got = sorted((r.impression_id, r["rank"], r.pos, r.score) for r in S.cut_and_append(df, 2).collect())
    assert got == [("a", 1, 5, 9), ("a", 2, 2, 5), ("a", 3, 1, 0), ("a", 4, 3, 0), ("a", 5, 4, 0), ("b", 1, 2, 4), ("b", 2, 1, 3), ("c", 1, 1, 0), ("c", 2, 2, 0), ("c", 3, 3, 0)]
    kept = S.top_k(df, 2)
    assert "WindowGroupLimit" in plan(kept) and kept.count() == 6


def test_score_tables(spark, tmp_path):
    df = S.rank(scored(spark, {"a": [1, 5, 5, 2], "b": [3, 4], "c": [0.5]}))
    path = str(tmp_path / "s")
    score_tables.write_scores(df, path)
    raw = {r.impression_id: r for r in spark.read.parquet(path).collect()}
    assert list(raw["a"].asDict()) == score_tables.COLUMNS and json.loads(raw["a"].ranked_ids) == ["20", "30", "40", "10"] and json.loads(raw["a"].ground_truth) == ["30"]
    back = score_tables.read_scores(spark, path)
    key = lambda r: (r.impression_id, r["rank"])
    assert [(r.impression_id, r.ts, r.pos, int(r.article_id), r.label, r.score, r["rank"]) for r in sorted(back.collect(), key=key)] == [(r.impression_id, r.ts, r.pos, r.article_id, r.label, r.score, r["rank"]) for r in sorted(df.collect(), key=key)]
    assert sorted(map(tuple, M.per_impression(back).collect())) == sorted(map(tuple, M.per_impression(df).collect()))
    good = spark.read.parquet(path)
    # the last label of a candidate that stands twice; null arrays
    odd = good.where("impression_id = 'b'").withColumns({"candidates": F.lit('["10","20","10"]'), "labels": F.lit("[0,0,1]")})
    odd.unionByName(good.where("impression_id = 'c'").withColumns({c: F.lit(None).cast("string") for c in score_tables.COLUMNS[3:]})).write.parquet(str(tmp_path / "odd"))
    assert {(r.article_id, r.label) for r in score_tables.read_scores(spark, str(tmp_path / "odd")).collect()} == {("10", 1), ("20", 0)}
    for k, bad in enumerate(({"scores": "[1.0]"}, {"labels": "nothing"}, {"ranked_ids": '["20","77","40","10"]'})):
        good.where("impression_id = 'a'").withColumns({c: F.lit(v) for c, v in bad.items()}).write.parquet(str(tmp_path / f"bad{k}"))
        with pytest.raises(Exception, match="impression a"):
            score_tables.read_scores(spark, str(tmp_path / f"bad{k}")).collect()
    good.drop("labels").withColumn("scores", F.lit(1.0)).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="labels is missing, scores is double"):
        score_tables.read_scores(spark, str(tmp_path / "other"))


def test_upsert_in_place_leaves_other_keys_and_fails_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *xs: spark.createDataFrame(list(xs), "dataset string, x int")
    score_tables.upsert_in_place(rows(("a", 1), ("b", 2), (None, 3)), path, "dataset")
    stands = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "dataset=b").iterdir()}
    score_tables.upsert_in_place(rows(("a", 10), ("a", 11), (None, 4)), path, "dataset")
    read = lambda: sorted(((r.dataset or "", r.x) for r in spark.read.parquet(path).collect()))
    assert read() == [("", 4), ("a", 10), ("a", 11), ("b", 2)]
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "dataset=b").iterdir()} == stands
    breaks = rows(("a", 5), ("b", 6), ("c", 7)).repartition(3).withColumn("x", F.when(F.col("x") == 6, F.raise_error(F.lit("no"))).otherwise(F.col("x")).cast("int"))
    with pytest.raises(Exception):
        score_tables.upsert_in_place(breaks, path, "dataset")
    assert read() == [("", 4), ("a", 10), ("a", 11), ("b", 2)]


def test_cache_by_content(spark, tmp_path):
    made = []

    def make(df):
        def f():
            made.append(1)
            return df.withColumn("vec", F.array(F.lit(1.0)))

        return f

    ids, more = spark.range(5).toDF("article_id"), spark.range(6).toDF("article_id")
    get = lambda df: score_tables.cached_by_content(spark, str(tmp_path), "vectors", df, make(df))
    assert get(ids).count() == 5 and get(ids.orderBy(F.desc("article_id"))).count() == 5 and len(made) == 1
    assert get(more).count() == 6 and len(made) == 2 and get(ids).count() == 5 and len(made) == 2
    other = spark.newSession()
    assert score_tables.cached_by_content(other, str(tmp_path), "vectors", other.range(5).toDF("article_id"), make(other.range(0).toDF("article_id"))).count() == 5 and len(made) == 2
    assert not [p for p in tmp_path.iterdir() if "." in p.name and not p.name.startswith(".")]

    def fails():
        raise RuntimeError("no vectors")

    with pytest.raises(RuntimeError):
        score_tables.cached_by_content(spark, str(tmp_path), "vectors", spark.range(9).toDF("article_id"), fails)
    assert len(list(tmp_path.iterdir())) == 2


def test_lines_must_be_permutations(spark):
    df = S.rank(scored(spark, {"a": [1, 5], "b": [3, 4]}))
    twice = df.withColumn("rank", F.when(F.col("impression_id") == "b", 1).otherwise(F.col("rank")))
    for f in (submission.ranks_by_candidate, submission.positions_by_rank):
        assert f(df).count() == 2
        with pytest.raises(Exception, match="impression b"):
            f(twice).collect()
    with pytest.raises(Exception, match="no permutation"):
        submission.ranks_by_candidate(df.where("pos > 1")).collect()


def test_combiner(spark):
    """The features from their definition; the learned blend ranks the impressions it has seen better than either score."""
    both = registry._both(spark, SF).collect()
    got = {(r.impression_id, r.article_id): r for r in catalog.QUERIES["combiner_features"](spark, SF).collect()}
    pools = {}
    for r in both:
        pools.setdefault(r.impression_id, []).append(r)
    for pool in pools.values():
        for f, col, place in (("f1", "score", "f3"), ("f2", "bm25", "f4")):
            xs = [r[col] for r in pool]
            lo, hi = min(xs), max(xs)
            for r in pool:
                want = 0 if hi - lo < 1e-12 else (r[col] - lo) / (hi - lo)
                under = sum((o[col], -o.pos) < (r[col], -r.pos) for o in pool)
                g = got[r.impression_id, r.article_id]
                assert g[f] == pytest.approx(want, abs=1e-6) and g[place] == pytest.approx(under / max(len(pool) - 1, 1), abs=1e-6)
                assert g.f5 == pytest.approx(g.f1 - g.f2, abs=2e-6)
    combined = registry._combined(spark, SF)
    auc = lambda df: M.mean_of(M.per_impression(S.rank(df)), ["auc"]).first().auc
    seen = combined.where("NOT held").drop("score")
    learned = auc(combined.where("NOT held"))
    assert learned > max(auc(seen.withColumn("score", F.col("f1"))), auc(seen.withColumn("score", F.col("f2"))))


def test_a_repeated_key_stops_the_blend(spark, monkeypatch):
    once = registry._bm25
    monkeypatch.setattr(registry, "_bm25", lambda s, d, base: once(s, d, base=base).unionByName(once(s, d, base=base)))
    with pytest.raises(Exception, match="several times"):
        registry._both(spark, SF).collect()


def test_spread(spark):
    xs = [5, 1, 1, 9, 3, 3, 3, 2]
    df = spark.createDataFrame([(x,) for x in xs], "c int")
    r = extended.spread(df, "c", {"half": 0.5, "p90": 0.9}).first()
    assert (r.n, r.least, r["most"], r["mean"], r.half, r.p90) == (8, 1, 9, 3.38, sorted(xs)[4], sorted(xs)[7])
    down = extended.spread(df, "c", {"q": 0.25, "h": 0.5}, down=True).first()
    assert (down.q, down.h) == (sorted(xs, reverse=True)[2], sorted(xs, reverse=True)[4])


def test_release(spark):
    df = reuse.reused(spark.range(3).toDF("x"), "numbers", now=True)
    path = Path(urlparse(df.inputFiles()[0]).path)
    kept = reuse.reused(spark.range(4).toDF("x"), "numbers")
    assert df.count() == 3 and path.exists() and kept.count() == 4
    assert kept.is_cached == (spark.conf.get("spark.checkpoint.dir", None) is None)
    reuse.release()
    assert not path.parent.exists() and not kept.is_cached
