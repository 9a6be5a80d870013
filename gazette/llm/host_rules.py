"""Host-level quality rules: failures by host and rule, shrunk by an empirical beta prior, joined back to documents.

Per document: word and symbol counts, repeated lines, and words inside three-word windows that the text holds
more than once; from these five rules. For each rule the hosts' failure rates give a beta prior (mean and strength by weighted moments,
the binomial noise of each host taken off), and the prior and a host's own counts its posterior. A host fails a rule if the lower end of
its posterior rate (``z`` standard deviations under the mean) has over ``odds`` times the odds of the mean of all hosts, and
the documents of a host that fails any rule are rejected. Where hosts differ by no more than chance, the prior is as strong as the
table has rows, all posteriors lie at the mean, and no host fails.

Everything is a projection of one row, a sum by host that combines before its shuffle, and a join.
Defined cases: null text has no words; null sources form a host of their own; rows that repeat count each;
an empty table gives an empty table; a single host is measured against itself and kept; columns of the same names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table, words

#: Hosts up to which verdicts are broadcast (under 100 bytes each); beyond, the join shuffles.
BROADCAST_HOSTS = 100_000


def _hash(*w: Column) -> Column:
    return F.xxhash64(*w)


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    blank = " \t\n\x0b\f\r"
    rows = docs.select(
        *keep, words(text).alias("__w"), F.length(F.translate(text, blank, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("__l"),
    )
    # three-word windows: the low bits of a long hold the place, as many as the text needs, the rest the hash, so that equal ones meet when sorted
    start = F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    bits = F.ceil(F.log2(F.size("__w") + 2)).cast("int")
    at = lambda i, j: F.get(F.col("__w"), i + j)
    packed = F.transform(start, lambda x, i: F.call_function("shiftleft", _hash(x, at(i, 1), at(i, 2)), F.col("__b")).bitwiseOR(i.cast("long")))
    rows = rows.select(*keep, "__w", bits.alias("__b"), "word_chars", "n_symbols", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    rows = rows.withColumn("__p", F.sort_array(packed))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1).cast("int")

    def meets(x: Column, i: Column) -> Column:
        """Against the next window: 0 if the hashes differ, 1 if the words are equal, 2 if only the hashes are."""
        y = F.get(F.col("__p"), i + 1)
        near = F.call_function("shiftright", x, F.col("__b")) == F.call_function("shiftright", y, F.col("__b"))
        p, q = place(x), place(y)
        same = (at(p, 0) == at(q, 0)) & (at(p, 1) == at(q, 1)) & (at(p, 2) == at(q, 2))
        return F.when(F.coalesce(near, F.lit(False)), F.when(same, 1).otherwise(2)).otherwise(0)

    rows = rows.withColumn("__e", F.transform("__p", meets))
    told = lambda of, i: (F.get(F.col("__e"), i) == 1) | F.coalesce((i > 0) & (F.get(F.col("__e"), F.greatest(i - 1, F.lit(0))) == 1), F.lit(False))
    twice = F.transform(F.filter(F.transform("__p", lambda x, i: F.struct(place(x).alias("p"), told(x, i).alias("t"))), lambda x: x["t"]), lambda x: x["p"])
    # windows of equal hash that differ may stand between equal ones: such a text is sorted by the words themselves
    plain = F.sort_array(F.transform(start, lambda x, i: F.struct(x.alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c"), i.alias("i"))))
    rows = rows.withColumn("__s", F.when(F.array_contains("__e", 2), plain))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    other = lambda i: F.get(F.col("__s"), i)
    exact = F.transform(F.filter("__s", lambda x, i: equal(x, other(i + 1)) | ((i > 0) & equal(x, other(F.greatest(i - 1, F.lit(0)))))), lambda x: x["i"])
    rows = rows.select(*keep, F.size("__w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.sort_array(F.when(F.col("__s").isNotNull(), exact).otherwise(twice)).alias("__t"))
    covered = F.zip_with("__t", F.slice("__t", 2, F.greatest(F.size("__t"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.size("__t") > 0, F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The rules whose failures are counted by host; the first two make base_failed."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "lines": 20 * F.col("n_dup_lines") > n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lengths": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
    }


def prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and strength of the beta prior of each rule; hosts: n and the rules' failures.

    Sums weighted by n: the squared deviations of the hosts' rates are those of the binomial, (hosts - 1) mean (1 - mean), and the hosts' own.
    """
    n = F.col("n").cast("double")
    parts = [F.count("*"), F.sum(n), F.sum(n * n)]
    for c in names:
        parts += [F.sum(F.col(c).cast("double")), F.sum(F.col(c) * F.col(c) / n)]
    k, total, squares, *sums = hosts.agg(*parts).first()
    out = {}
    for i, c in enumerate(names):
        if not k:
            out[c] = (0.5, 1.0)
            continue
        fails, of_squares = sums[2 * i], sums[2 * i + 1]
        mean = fails / total
        noise = mean * (1 - mean)
        left = of_squares - fails * mean - (k - 1) * noise
        between = left / (total - squares / total) if k > 1 else noise
        strength = min(max(noise / between - 1, 1.0), total) if between > 0 else (total if k > 1 else 1.0)
        out[c] = (mean, strength)
    return out


def verdicts(rows: DataFrame, z: float = 3.0, odds: float = 3.0) -> DataFrame:
    """host, n, rate_<rule> (posterior means) and host_rules, the rules that the host fails; rows: host and the counts."""
    tests = rules()
    hosts = materialize(rows.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(t.cast("long")).alias(c) for c, t in tests.items()]), "hosts")
    fails, rates = [], []
    for c, (mean, strength) in prior(hosts, list(tests)).items():
        weight = F.col("n") + strength
        rate = (F.col(c) + mean * strength) / weight
        low = rate - z * F.sqrt(rate * (1 - rate) / (weight + 1))
        # low / (1 - low) > odds * mean / (1 - mean), without dividing
        fails.append(F.when(low * (1 - mean) > odds * mean * (1 - low), c))
        rates.append(rate.alias(f"rate_{c}"))
    return hosts.select("host", "n", *rates, F.array_compact(F.array(*fails)).alias("host_rules"))


def judge(docs: DataFrame, host: str = "source", z: float = 3.0, odds: float = 3.0) -> DataFrame:
    """doc_id, the counts, base_failed, host, host_rules, kept of each row."""
    own = docs.select("doc_id", "text", F.col(host).alias("host"))
    rows = materialize(counts(own, "doc_id", "host").withColumn("base_failed", failed()), "host-rows")
    hosts = materialize(verdicts(rows, z, odds).select(F.col("host").alias("__host"), "host_rules"), "verdicts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    out = rows.join(hosts, rows["host"].eqNullSafe(hosts["__host"]), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("host_rules") == 0))


def op8_host_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("host_rules", ",").alias("host_rules"))


#: The rules over the SQL's columns, and the posterior's lower end against the mean's odds.
_RULES = {
    "short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "lines": "20 * n_dup_lines > n_words",
    "symbols": "10 * n_symbols > n_words", "lengths": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
}
_PRIOR = ", ".join(
    f"sum({c}) / sum(n) AS m_{c}, (sum({c} * {c} / n) - sum({c}) * sum({c}) / sum(n) - (count(*) - 1) * (sum({c}) / sum(n)) * (1 - sum({c}) / sum(n))) / nullif(sum(n) - sum(n * n) / sum(n), 0) AS v_{c}" for c in _RULES
)
_STRENGTH = ", ".join(
    f"CASE WHEN k = 1 THEN 1 WHEN v_{c} > 0 THEN least(greatest(m_{c} * (1 - m_{c}) / v_{c} - 1, 1), total) ELSE total END AS s_{c}" for c in _RULES
)
_RATE = ", ".join(f"({c} + m_{c} * s_{c}) / (n + s_{c}) AS r_{c}" for c in _RULES)
_LOW = ", ".join(f"r_{c} - 3 * sqrt(r_{c} * (1 - r_{c}) / (n + s_{c} + 1)) AS l_{c}" for c in _RULES)
_FAILS = ", ".join(f"CASE WHEN l_{c} * (1 - m_{c}) > 3 * m_{c} * (1 - l_{c}) THEN '{c}' END" for c in _RULES)
_WORD = r"[^\x20\x09-\x0D]+"

SQL: dict[str, str] = {
    "op8_host_rules": rf"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM t)),
win AS (SELECT * FROM (SELECT doc_id, i, w AS a, lead(w) OVER d AS b, lead(w, 2) OVER d AS c FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(coalesce(nxt - i, 3), 3)) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1),
ws AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
base AS (SELECT t.doc_id, t.host, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN ws USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
hosts AS (SELECT host, count(*)::DOUBLE AS n, {', '.join(f'(count(*) FILTER (WHERE {t}))::DOUBLE AS {c}' for c, t in _RULES.items())} FROM base GROUP BY 1),
pri AS (SELECT count(*) AS k, sum(n) AS total, {_PRIOR} FROM hosts),
str AS (SELECT *, {_STRENGTH} FROM pri),
post AS (SELECT *, {_LOW} FROM (SELECT *, {_RATE} FROM hosts, str)),
verdict AS (SELECT host, list_filter([{_FAILS}], lambda x: x IS NOT NULL) AS host_rules FROM post)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND len(host_rules) = 0 AS kept, array_to_string(host_rules, ',') AS host_rules
FROM base JOIN verdict ON base.host IS NOT DISTINCT FROM verdict.host
"""
}
