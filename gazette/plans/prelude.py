"""Shared parts of the SQL: named subqueries, put together with what they need."""

from __future__ import annotations

import re

from gazette.functions.text import ENGLISH

_stop = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)

PARTS = {
    "ev": "SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS article_id, date_trunc('week', ts)::TIMESTAMP AS week, event_type IN ('click', 'purchase') AS clicked FROM events",
    "cand": """SELECT concat(user_id, '-', strftime(week, '%Y%m%d')) AS impression_id, user_id, week AS ts,
        CASE WHEN week >= TIMESTAMP '2024-01-22' THEN 'test' WHEN week >= TIMESTAMP '2024-01-15' THEN 'val' ELSE 'train' END AS split,
        row_number() OVER (PARTITION BY user_id, week ORDER BY f) AS pos, article_id, label
      FROM (SELECT user_id, week, article_id, max(CAST(clicked AS INTEGER)) AS label, min(struct_pack(t := ts, e := event_id)) AS f FROM ev GROUP BY ALL)""",
    "val": "SELECT * FROM cand WHERE split = 'val'",
    "imps": "SELECT DISTINCT impression_id, user_id, ts, split FROM cand",
    "clicks": "SELECT user_id, article_id, ts AS clicked_at, event_id FROM ev WHERE clicked",
    "hist": """SELECT * FROM (SELECT i.impression_id, i.split, i.ts, c.article_id, c.clicked_at, c.event_id,
        row_number() OVER (PARTITION BY i.impression_id ORDER BY c.clicked_at DESC, c.event_id DESC) AS back
        FROM imps i JOIN clicks c ON c.user_id = i.user_id AND c.clicked_at < i.ts) WHERE back <= 20""",
    "vhist": "SELECT * FROM hist WHERE split = 'val'",
    "emb": "SELECT vec_id AS article_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings",
    "art": "SELECT doc_id AS article_id, text AS cleaned_text, source AS category, lang AS subcategory FROM documents",
    "uvec": """SELECT impression_id, d, v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS u FROM (
        SELECT *, sqrt(sum(v * v) OVER (PARTITION BY impression_id)) AS norm FROM (
        SELECT impression_id, d, avg(x) AS v FROM vhist JOIN emb USING (article_id) GROUP BY ALL))""",
    "dvec": """SELECT impression_id, d, v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS u FROM (
        SELECT *, sqrt(sum(v * v) OVER (PARTITION BY impression_id)) AS norm FROM (
        SELECT impression_id, d, sum(x * pow(0.9, back - 1)) / sum(pow(0.9, back - 1)) AS v FROM vhist JOIN emb USING (article_id) GROUP BY ALL))""",
    "cos": """SELECT v.*, round(coalesce(s, 0), 6) AS score FROM val v LEFT JOIN (
        SELECT impression_id, v.article_id, sum(u * x) AS s FROM val v JOIN uvec USING (impression_id) JOIN emb e ON e.article_id = v.article_id AND e.d = uvec.d GROUP BY ALL) USING (impression_id, article_id)""",
    "dcos": """SELECT v.*, round(coalesce(s, 0), 6) AS score FROM val v LEFT JOIN (
        SELECT impression_id, v.article_id, sum(u * x) AS s FROM val v JOIN dvec USING (impression_id) JOIN emb e ON e.article_id = v.article_id AND e.d = dvec.d GROUP BY ALL) USING (impression_id, article_id)""",
    "rcos": "SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, CAST(article_id AS VARCHAR)) AS rank FROM cos",
    "tok": "SELECT article_id, unnest(regexp_extract_all(lower(cleaned_text), '[a-z0-9]+')) AS term FROM art",
    "toks": f"SELECT * FROM tok WHERE term NOT IN ({_stop})",
    "dl0": "SELECT article_id, len(regexp_extract_all(lower(cleaned_text), '[a-z0-9]+')) AS dl FROM art",
    "dls": "SELECT a.article_id, count(t.term) AS dl FROM art a LEFT JOIN toks t USING (article_id) GROUP BY 1",
    "pop": "SELECT article_id, count(*) AS exposures, sum(label) AS clicks FROM cand WHERE split = 'train' GROUP BY 1",
    "nimps": "SELECT impression_id, split, count(h.article_id) AS hlen FROM (SELECT DISTINCT impression_id, split FROM cand) LEFT JOIN (SELECT impression_id, article_id FROM hist) h USING (impression_id) GROUP BY ALL",
    "sl": """SELECT impression_id, unnest(['all', u, a, concat(u, '_', a)]) AS slice FROM (
        SELECT n.impression_id, CASE WHEN hlen <= 5 THEN 'cold' ELSE 'warm' END AS u, CASE WHEN coalesce(p, 0) <= 10 THEN 'tail' ELSE 'head' END AS a
        FROM nimps n LEFT JOIN (SELECT impression_id, avg(coalesce(exposures, 0)) AS p FROM cand LEFT JOIN pop USING (article_id) WHERE label = 1 GROUP BY 1) USING (impression_id) WHERE split = 'val')""",
    "kinds": "SELECT article_id, coalesce(category, '') AS cat, coalesce(subcategory, '') AS sub FROM art",
    "hk": "SELECT h.impression_id, coalesce(cat, '') AS cat, coalesce(sub, '') AS sub FROM vhist h LEFT JOIN kinds USING (article_id)",
    "ncat": "SELECT impression_id, cat, count(*) / sum(count(*)) OVER (PARTITION BY impression_id) AS p FROM hk GROUP BY 1, 2",
    "nsub": "SELECT impression_id, sub, count(*) / sum(count(*)) OVER (PARTITION BY impression_id) AS p FROM hk GROUP BY 1, 2",
    "catraw": """SELECT v.*, coalesce(c.p, 0) AS p_cat, coalesce(s.p, 0) AS p_sub FROM val v LEFT JOIN kinds USING (article_id)
        LEFT JOIN ncat c ON c.impression_id = v.impression_id AND c.cat = coalesce(kinds.cat, '') LEFT JOIN nsub s ON s.impression_id = v.impression_id AND s.sub = coalesce(kinds.sub, '')""",
}


def bm25_parts(tok: str, dl: str, out: str) -> dict[str, str]:
    """BM25 over one way of making tokens."""
    return {
        f"tf_{out}": f"SELECT article_id, term, count(*) AS tf FROM {tok} GROUP BY ALL",
        f"st_{out}": f"SELECT count(*) AS n, avg(dl) AS avgdl FROM {dl}",
        f"raw_{out}": f"SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM tf_{out} GROUP BY 1), st_{out}",
        f"idf_{out}": f"SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_{out}) ELSE raw END AS idf FROM raw_{out}",
        f"w_{out}": f"SELECT article_id, term, tf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM tf_{out} JOIN idf_{out} USING (term) JOIN {dl} USING (article_id), st_{out}",
        f"ha_{out}": "SELECT impression_id, article_id AS h, count(*) AS times FROM vhist GROUP BY ALL",
        f"pair_{out}": f"SELECT DISTINCT h, v.article_id FROM val v JOIN ha_{out} USING (impression_id)",
        f"ps_{out}": f"SELECT p.h, p.article_id, sum(q.tf * w.w) AS s FROM pair_{out} p JOIN tf_{out} q ON q.article_id = p.h JOIN w_{out} w ON w.article_id = p.article_id AND w.term = q.term GROUP BY ALL",
        out: f"""SELECT v.*, round(greatest(coalesce(s, 0), 0) + 1e-9, 4) AS score FROM val v LEFT JOIN (
            SELECT impression_id, v.article_id, sum(times * s) AS s FROM val v JOIN ha_{out} USING (impression_id) JOIN ps_{out} p ON p.h = ha_{out}.h AND p.article_id = v.article_id GROUP BY ALL) USING (impression_id, article_id)""",
        f"r{out}": f"SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM {out}",
    }


PARTS |= bm25_parts("tok", "dl0", "bm") | bm25_parts("toks", "dls", "bs")


def history_part(cap: int, before: str = "i.ts", split: str = "val") -> str:
    """The last cap clicks of each impression of a split before a time."""
    return f"""SELECT * FROM (SELECT i.impression_id, i.ts, c.article_id, c.clicked_at,
        row_number() OVER (PARTITION BY i.impression_id ORDER BY c.clicked_at DESC, c.event_id DESC) AS back
        FROM imps i JOIN clicks c ON c.user_id = i.user_id AND c.clicked_at < {before} WHERE split = '{split}') WHERE back <= {cap}"""


def unit_part(raw: str, *by: str) -> str:
    """Unit vectors of rows (by, d, v)."""
    keys = ", ".join(by)
    return f"SELECT {keys}, d, v / CASE WHEN norm = 0 THEN 1 ELSE norm END AS u FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS norm FROM ({raw}))"


def cosine_part(users: str) -> str:
    """Candidates of the validation split with the product of their vector and their impression's user vector."""
    return f"""SELECT v.*, round(coalesce(s, 0), 6) AS score FROM val v LEFT JOIN (
        SELECT impression_id, v.article_id, sum(u * x) AS s FROM val v JOIN {users} w USING (impression_id) JOIN emb e ON e.article_id = v.article_id AND e.d = w.d GROUP BY ALL) USING (impression_id, article_id)"""


def mm(x: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY impression_id)", f"max({x}) OVER (PARTITION BY impression_id)"
    return f"(CASE WHEN {hi} - {lo} < 1e-12 THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo}) END)"


PARTS |= {
    "both_": "SELECT c.*, b.score AS bm25 FROM cos c JOIN (SELECT impression_id, article_id, score FROM bm) b USING (impression_id, article_id)",
    "blended": f"SELECT * EXCLUDE (score), round(0.8 * {mm('score')} + 0.2 * {mm('bm25')} + 1e-9, 6) AS score FROM both_",
    "withpop": "SELECT c.*, ln(1 + coalesce(clicks, 0)) AS lp FROM cos c LEFT JOIN pop USING (article_id)",
    "hybrid": f"SELECT * EXCLUDE (score), round(0.8 * {mm('score')} + 0.2 * {mm('lp')} + 1e-9, 6) AS score FROM withpop",
    "catsig": f"SELECT *, 0.5 * {mm('p_cat')} + 0.5 * {mm('p_sub')} AS signal FROM catraw",
    "catblend": f"SELECT c.* EXCLUDE (score), round(0.85 * {mm('score')} + 0.15 * {mm('signal')} + 1e-9, 6) AS score FROM (SELECT c.*, signal FROM cos c JOIN (SELECT impression_id, article_id, signal FROM catsig) USING (impression_id, article_id)) c",
}
PARTS |= {f"r{x}": f"SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, pos) AS rank FROM {x}" for x in ("blended", "hybrid", "catblend", "dcos")}


def metric_part(ranked: str) -> str:
    """Per-impression metrics of one ranking."""
    dcg = lambda k: f"sum(CASE WHEN label = 1 AND rank <= {k} THEN 1 / log2(rank + 1.0) END)"
    ideal = lambda k: f"list_sum(list_transform(range(1, CAST(greatest(least(clicks, {k}), 1) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0)))"
    return f"""SELECT impression_id, n, clicks, CASE WHEN clicks = 0 THEN 0.0 ELSE h5 / clicks END AS recall5, CASE WHEN clicks = 0 THEN 0.0 ELSE h10 / clicks END AS recall10,
        coalesce(1.0 / f, 0.0) AS mrr, CASE WHEN clicks IN (0, n) THEN 0.5 ELSE (places - clicks * (clicks + 1) / 2) / (clicks * (n - clicks)) END AS auc,
        CASE WHEN clicks = 0 THEN 0.0 ELSE coalesce(d5, 0) / {ideal(5)} END AS ndcg5, CASE WHEN clicks = 0 THEN 0.0 ELSE coalesce(d10, 0) / {ideal(10)} END AS ndcg10
      FROM (SELECT impression_id, count(*) AS n, sum(label) AS clicks, sum(CASE WHEN label = 1 THEN place END) AS places, min(CASE WHEN label = 1 THEN rank END) AS f,
        count(*) FILTER (WHERE label = 1 AND rank <= 5) AS h5, count(*) FILTER (WHERE label = 1 AND rank <= 10) AS h10, {dcg(5)} AS d5, {dcg(10)} AS d10
        FROM (SELECT *, rank() OVER (PARTITION BY impression_id ORDER BY score) + (count(*) OVER (PARTITION BY impression_id, score) - 1) / 2 AS place FROM {ranked}) GROUP BY 1)"""


PARTS |= {f"m{x}": metric_part(x) for x in ("rcos", "rbm", "rbs", "rblended", "rhybrid", "rcatblend", "rdcos")}


def sql(main: str) -> str:
    """main with every named part that it needs, in order."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\b[a-z_0-9]+\b", text)) & PARTS.keys()):
            # a name counts only where a relation stands
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(PARTS[name])
                if name not in need:
                    need.append(name)

    visit(main)
    parts = ",\n".join(f"{n} AS ({PARTS[n]})" for n in need)
    return f"WITH {parts}\n{main}" if need else main
