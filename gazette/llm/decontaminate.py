"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Numbers, units after or at numbers, and capitalised words, wherever they stand, become typed placeholders that carry
their value; the rest is lower-cased and freed of punctuation. A window of placeholders alone has no template and is met by its values. Windows of ``k`` template words of the
benchmark meet those of the documents in a hash join. A document leaks an item if it holds at least
``similarity`` of the item's windows and the values in the placeholders are consistent: a value of the item
stands for the same value of the document throughout, so re-parameterised questions are caught as well. A document
that isn't consistent as a whole may hold an item several times: windows are then told apart by where the item would begin,
and one place that holds enough windows consistently, or enough windows with the item's own values, is a leak.

Defined cases: null text is empty; an item of fewer than k words is one window, met only by a document that
is the same few words; items without words are no items; null ids are ids of their own; repeated rows get the
same verdict; an empty benchmark or table flags nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table

# Units of measure, currencies and times that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms w kw v a hz khz mhz ghz kb mb gb tb percent pct usd eur gbp dollar dollars euro euros cent cents second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres mile miles gram grams kilogram kilograms litre litres liter liters pound pounds inch inches foot feet degree degrees"
#: Rows of benchmark windows up to which they are broadcast (some 60 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 400_000


def _valued(text: Column) -> Column:
    """The text with placeholders for names, numbers and units, each with =value. Patterns that few texts need run on those alone."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(F.contains(t, F.lit("=")) | F.contains(t, F.lit("§")) | F.contains(t, F.lit("_")), F.translate(t, "=§_", "   ")).otherwise(t)
    glued = rf"(?i)(?<![\p{{L}}\p{{N}}])([0-9]++(?:[.,:/][0-9]++)*+)(?=(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}]))"
    number = r"(?=[0-9])(?<![\p{L}\p{N}])[0-9]++(?:[.,:/][0-9]++)*+(?![\p{L}\p{N}])"
    unit = rf"(?i)(§n=[0-9.,:/]++\x20)({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])"
    apart = F.when(F.regexp(t, F.lit(r"[0-9]\p{L}")), F.regexp_replace(t, glued, "$1 ")).otherwise(t)
    valued = F.regexp_replace(F.regexp_replace(apart, number, "§n=$0"), unit, "$1§u=$2")
    t = F.when(F.regexp(t, F.lit("[0-9]")), F.regexp_replace(valued, r"(?<=[0-9])[.,:/](?=[0-9])", "_")).otherwise(t)
    return F.lower(F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{N}'’=-].)[\p{L}'’-]*+", "§p=$0"))


def _template(rows: DataFrame) -> DataFrame:
    """rows: key columns and __text; gives the keys, __v (words with values) and __c (words of the template)."""
    keys = [c for c in rows.columns if c != "__text"]
    rows = rows.select(*keys, _valued(F.col("__text")).alias("__t"))
    rows = rows.select(*keys, F.array_remove(F.split("__t", r"[^\p{L}\p{N}§=_]+"), "").alias("__v"), F.contains("__t", F.lit("§")).alias("__any"))
    return rows.select(*keys, "__any", "__v", F.when(F.col("__any"), F.transform("__v", lambda x: F.substring_index(x, "=", 1))).otherwise(F.col("__v")).alias("__c"))


def _starts(k: int) -> Column:
    """A word for each window: all but the last k - 1, or the first of a text of fewer words."""
    return F.slice("__c", 1, F.when(F.size("__c") > 0, F.greatest(F.size("__c") - (k - 1), F.lit(1))).otherwise(0))


def _window(i: Column, k: int, of: str = "__c") -> list[Column]:
    return [F.get(F.col(of), i + j if j else i) for j in range(k)]


def _hash(i: Column, k: int) -> Column:
    """Of the template's words, or of the values where they are all placeholders."""
    own = [F.coalesce(F.startswith(w, F.lit("§")), F.lit(True)) for w in _window(i, k)]
    none = own[0]
    for x in own[1:]:
        none = none & x
    return F.when(F.col("__any") & none, F.xxhash64(*_window(i, k, "__v"))).otherwise(F.xxhash64(*_window(i, k)))


def _hashes(rows: DataFrame, k: int) -> DataFrame:
    """The keys with __h of each window."""
    keys = [c for c in rows.columns if c != "__text"]
    return _template(rows).select(*keys, F.explode(F.transform(_starts(k), lambda _, i: _hash(i, k))).alias("__h"))


def _windows(rows: DataFrame, k: int) -> DataFrame:
    """The keys with __i, __h and __s (words with values, null without placeholders) of each window."""
    keys = [c for c in rows.columns if c != "__text"]

    def window(_, i: Column) -> Column:
        values = F.concat_ws("|", *_window(i, k, "__v"))
        return F.struct(i.alias("i"), _hash(i, k).alias("h"), F.when(F.contains(values, F.lit("§")), values).alias("s"))

    return _template(rows).select(*keys, F.explode(F.transform(_starts(k), window)).alias("__w")).select(*keys, F.col("__w.i").alias("__i"), F.col("__w.h").alias("__h"), F.col("__w.s").alias("__s"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """__id, __th (hash of the text), item_id, coverage of every leak."""
    items = benchmark.select(F.col("item_id").alias("__item"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__ith"), F.coalesce("text", F.lit("")).alias("__text"))
    own = _windows(items, k)
    # an item may stand inside a sentence, where its first word may be written small
    inside = _windows(items.withColumn("__text", F.concat(F.lower(F.substring("__text", 1, 1)), F.expr("substring(__text, 2)"))), k).where("__i = 0")
    sizes = own.groupBy("__item", "__ith").agg(F.count("*").alias("__of"))
    wins = own.unionByName(inside).distinct()
    wins = materialize(wins.join(sizes, wins["__item"].eqNullSafe(sizes["__item"]) & (wins["__ith"] == sizes["__ith"])).select(wins["__item"], wins["__ith"], F.col("__i").alias("__bi"), "__h", F.col("__s").alias("__bs"), "__of"), "windows")
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th"), F.col("text").alias("__text"))
    key = ["__id", "__th", "__item", "__ith"]
    # first by hashes alone: which documents hold enough of an item
    met = _hashes(texts, k).join(_small(wins.select("__item", "__ith", "__bi", "__h", "__of").distinct()), "__h")
    hits = met.groupBy(*key, "__bi", "__of").agg(F.lit(1).alias("__one")).groupBy(*key, "__of").agg(F.count("*").alias("hits"))
    held = materialize(hits.where(F.col("hits") >= similarity * F.col("__of")), "held")
    # then the values, in those documents alone; a value of the item should stand for one value of the document
    some = held.select(F.col("__id").alias("__wid"), F.col("__th").alias("__wth")).distinct()
    some = texts.join(_small(some), texts["__id"].eqNullSafe(F.col("__wid")) & (texts["__th"] == F.col("__wth")), "left_semi")
    # the places where an item may stand: the window's offset in parts of half an item, cut twice, so that words put in or left out
    # in a quarter of it stay in one part of either cut, and two occurrences share none
    off, half = F.col("__i") - F.col("__bi"), F.greatest(F.floor((F.col("__of") + k - 1) / 2), F.lit(1))
    cut = lambda n: F.struct(F.lit(n).alias("cut"), F.floor((off + F.lit(n) * F.floor(half / 2)) / half).alias("part"))
    whole = F.struct(F.lit(-1).alias("cut"), F.lit(0).cast("long").alias("part"))
    # of a document's windows only those of the items that it holds
    own = held.select(*[F.col(c).alias(f"{c}h") for c in key])
    mine = F.col("__id").eqNullSafe(F.col("__idh")) & (F.col("__th") == F.col("__thh")) & F.col("__item").eqNullSafe(F.col("__itemh")) & (F.col("__ith") == F.col("__ithh"))
    met = _windows(some, k).join(_small(wins), "__h").join(own, mine, "left_semi")
    met = materialize(met.select(*key, "__of", "__bi", "__bs", "__s", F.explode(F.array(whole, cut(0), cut(1))).alias("__at")).distinct(), "met")
    place = [*key, "__at"]
    same = F.when(F.col("__bs").isNull() | (F.col("__bs") == F.col("__s")), F.col("__bi"))
    places = met.groupBy(*place, "__of").agg(F.count_distinct("__bi").alias("n"), F.count_distinct(same).alias("verbatim"))
    valued = met.where("__bs IS NOT NULL").groupBy(*place, "__bs", "__s").agg(F.lit(1).alias("__one"))
    pairs = F.filter(F.arrays_zip(F.split("__bs", r"\|").alias("b"), F.split("__s", r"\|").alias("d")), lambda x: F.startswith(x["b"], F.lit("§")))
    slots = valued.select(*place, F.explode(pairs).alias("p")).select(*place, F.col("p.b").alias("b"), F.col("p.d").alias("d"))
    slots = slots.groupBy(*place, "b", "d").agg(F.lit(1).alias("__one")).groupBy(*place, "b").agg(F.count("*").alias("ways"))
    slots = slots.groupBy(*place).agg(F.count("*").alias("values"), F.sum((F.col("ways") > 1).cast("int")).alias("clashes"))
    slots = slots.select(*[F.col(c).alias(f"{c}s") for c in place], "values", "clashes")
    equal = lambda a, b, names: F.expr(" AND ".join(f"{a}{c} <=> {b}{c}s" for c in names))
    judged = places.join(slots, equal("", "", place), "left")
    enough = lambda c: F.col(c) >= similarity * F.col("__of")
    fine = judged.where(enough("verbatim") | (enough("n") & F.coalesce(F.col("clashes") <= (1 - similarity) * F.col("values"), F.lit(True))))
    fine = fine.select(*[F.col(c).alias(f"{c}s") for c in key]).distinct()
    found = held.join(fine, equal("", "", key), "left_semi")
    return found.select("__id", "__th", F.col("__item").alias("item_id"), (F.col("hits") / F.col("__of")).alias("coverage"))


def _marked(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    own = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(found, own["doc_id"].eqNullSafe(found["__id"]) & (own["__own"] == found["__th"]), how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without those that leak an item."""
    found = leaks(docs, benchmark, k, similarity).select("__id", "__th").distinct()
    return _marked(docs, found, "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("__id", "__th").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))
    out = _marked(docs.select("doc_id", "text"), found, "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


SQL: dict[str, str] = {}
