"""Cross-site line deduplication by distinct-site spread.

Every line (trimmed, of at least ``min_words`` words; for 1, every line that is not blank) gets a HyperLogLog sketch of the sites it occurs
on; sketches merge in the aggregation, so a line on a third of all pages costs one small row a task.
Lines whose estimate is clearly under ``min_sites`` are left, clearly over it are boilerplate, and those
near it get an exact distinct count. Of a boilerplate line the first occurrence (least doc_id, then
position) stays, so that copied text is thinned out but never lost.

Defined cases: null text stays null; a null site is no site; a null doc_id is an id of its own; rows that
repeat a doc_id are cleaned each by its own lines; an empty table gives an empty table; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table

#: Lines (a hash and a position, some 50 bytes) up to which they are broadcast; beyond, the join shuffles, salted.
BROADCAST_ROWS = 200_000
#: Parts into which the shuffled join deals the occurrences of each line.
SALTS = 32
#: A line that is not blank holds anything but ASCII white space.
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """__id, __th (hash of the text), __site, __pos, __h of the lines that count."""
    lines = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.col("source").alias("__site"), F.posexplode(F.split("text", "\n")).alias("__pos", "__line"))
    spaces = F.length(F.trim("__line")) - F.length(F.replace(F.trim("__line"), F.lit(" "), F.lit("")))
    counted = spaces >= min_words - 1 if min_words > 1 else F.regexp("__line", F.lit(NOT_BLANK))
    return lines.where(counted).select("__id", "__th", "__site", "__pos", _key(F.col("__line")).alias("__h"))


def _meet(occ: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """The occurrences of some lines (a written table): by broadcast up to most lines, else dealt out by line and salt, so that no task gets a common line whole."""
    if lines.count() <= most:
        return occ.join(F.broadcast(lines), "__h")
    salted = lines.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return occ.withColumn("__salt", F.pmod(F.xxhash64("__id", "__pos"), F.lit(SALTS)).cast("int")).join(salted, ["__h", "__salt"]).drop("__salt")


def boilerplate_lines(docs: DataFrame, min_sites: int = 10, min_words: int = 4, lg_k: int = 10, margin: float = 0.2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """__h, __first (struct of id and position) of lines on at least min_sites distinct sites.

    margin: a share of min_sites around it within which the exact count decides; over six standard
    errors of a sketch of 2**lg_k registers by default.
    """
    occ = _occurrences(docs, min_words)
    spread = occ.groupBy("__h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(lg_k))).alias("__est"),
        F.min(F.struct("__id", "__pos")).alias("__first"),
    )
    spread = materialize(spread.where(F.col("__est") >= min_sites * (1 - margin)), "spread")
    sure = spread.where(F.col("__est") > min_sites * (1 + margin)).select("__h", "__first")
    near = spread.where(F.col("__est") <= min_sites * (1 + margin)).select("__h", "__first")
    exact = (
        _meet(occ, near, broadcast_rows).groupBy("__h", "__first", "__site").agg(F.lit(1).alias("__one"))
        .groupBy("__h", "__first").agg(F.count("__site").alias("__n")).where(F.col("__n") >= min_sites).select("__h", "__first")
    )
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, min_words: int = 4, lg_k: int = 10, margin: float = 0.2, counts: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with boilerplate lines taken out of text; counts adds n_lines and n_removed (long), in place of columns of these names."""
    boiler = materialize(boilerplate_lines(docs, min_sites, min_words, lg_k, margin, broadcast_rows), "boilerplate")
    occ = _meet(_occurrences(docs, min_words), boiler, broadcast_rows)
    first = (F.col("__first.__id").eqNullSafe(F.col("__id"))) & (F.col("__first.__pos") == F.col("__pos"))
    drops = occ.groupBy("__id", "__th").agg(F.collect_set("__h").alias("__drop"), F.collect_set(F.when(first, F.col("__pos"))).alias("__keep"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__drop", _key(x)) | F.array_contains("__keep", i))
    drops = drops.withColumnRenamed("__th", "__of")
    joined = docs.withColumn("__th", F.xxhash64("text"))
    joined = joined.join(drops, joined["doc_id"].eqNullSafe(drops["__id"]) & (joined["__th"] == drops["__of"]), "left")
    out = joined.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        n = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n)
        out = out.withColumn("n_lines", n).withColumn("n_removed", F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(n - F.size("__kept")).cast("long"))
    out = out.withColumn("text", F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text")))
    more = ["n_lines", "n_removed"] if counts else []
    names = [*(c for c in docs.columns if c not in more), *more]
    return out.select(*names)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


SQL = {
    "op1_line_dedup": """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, trim(line) AS t, length(trim(line)) - length(replace(trim(line), ' ', '')) >= 3 AS counts FROM l
), b AS (
  SELECT t, min(struct_pack(d := doc_id, p := pos)) AS f FROM k WHERE counts GROUP BY t HAVING count(DISTINCT source) >= 10
), m AS (
  SELECT k.doc_id, k.pos, k.line, b.t IS NOT NULL AND NOT (b.f.d = k.doc_id AND b.f.p = k.pos) AS gone
  FROM k LEFT JOIN b ON k.counts AND k.t = b.t
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM m GROUP BY doc_id
"""
}
