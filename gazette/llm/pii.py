"""Personal data: pattern spans, and terms that the corpus shows to disclose them, in DataFrame functions alone.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Then, following
information-theoretic sanitisation, every term (a word of two letters or more outside base spans) is held against the protected
entities by their co-occurrence in whole documents: each kind, any kind, and each single value that ``support`` documents
hold. Pointwise mutual information as a share of the entity's own information says how far the term gives the entity away. A term
discloses if that share is at least ``disclosure``, at least ``support`` documents hold both, and chance doesn't explain it (a
Chernoff bound over all terms, so that 0.05 terms are expected by chance). So that copies of a text prove nothing, a term must also
stand between ``support`` different pairs of neighbours, and for kinds the whole test is repeated with these contexts in place of documents.
Disclosing terms become spans of kind term at every place of every text, whether the entity is printed there or not;
redact() replaces spans by their kind. All counts cover all texts.

Defined cases: null text has no spans; null or repeated doc_ids are rows like others (nothing is joined by id); an empty table gives an
empty table; a table whose every text holds an entity discloses nothing. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table

# Kinds in the order of their spans, and their patterns. Possessive forms find the same matches,
# and the card's, which begins at the first digit of a run, those of 12 digits or more.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = [
    r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]++)",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: Disclosing terms up to which they are sent to the tasks as one array (some 20 bytes each); beyond, terms are joined.
BROADCAST_TERMS = 20_000
_CHANCE = 3.0
_BLOCK = 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    digit = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    double = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, double(digit(i))).otherwise(digit(i))) % 10 == 0


def _passes(kind: int, m: Column) -> Column:
    d = _digits(m)
    if kind == 1:
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == 3:
        return F.length(d).between(9, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """use(value), with value bound to a variable: a column named inside a function of an array may be evaluated again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(a: Column, join=lambda x, y: x + y) -> Column:
    """Running totals (or another join's) of an array, by doubling the reach of each: m log m steps for m numbers."""
    reaches = lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2.0), k) < n), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    add = lambda s, r: F.transform(s, lambda x, i: F.when(i >= r, join(x, F.get(s, i - r))).otherwise(x))
    return _once(a, lambda v: F.aggregate(_once(F.size(v), reaches), v, add))


def _pieces(text: Column, starts: Column, stops: Column) -> Column:
    """The parts of a text from starts to stops, each read from its own blocks of the text."""
    part = lambda b, i, j: F.substring(F.array_join(F.slice(b, F.floor(i / _BLOCK).cast("int") + 1, (F.floor(j / _BLOCK) - F.floor(i / _BLOCK)).cast("int") + 1), ""), i % _BLOCK + 1, j - i)
    return _once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda b: F.zip_with(starts, stops, lambda i, j: part(b, i, F.greatest(j, i))))


def _found(rows: DataFrame, text: str, pattern: str | Column, may: Column, out: str) -> DataFrame:
    """Adds out: array of struct(start, m) of all matches: lengths of matches and of what lies between them add up."""
    keep = rows.columns
    matches = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))

    def placed(m: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        ends = _running(F.zip_with(between, m, lambda s, x: F.length(s) + F.length(x)))
        return F.zip_with(ends, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), x.alias("m")))

    empty = F.array().cast("array<struct<start:int,m:string>>")
    return rows.select(*keep, F.when(may, _once(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))).otherwise(empty).alias(out))


def _spans(kind: int) -> Column:
    """The matches that pass, as spans."""
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("k"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))
    return F.transform(F.filter(f"__f{kind}", lambda x: _passes(kind, x["m"])), span)


def base_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, __text and spans: array of struct(start, k, end, value), by start and kind."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    digit = F.regexp("__text", F.lit("[0-9]"))
    may = [F.contains("__text", F.lit("@")), digit, digit, F.contains("__text", F.lit("+"))]
    for k, pattern in enumerate(PATTERNS):
        rows = _found(rows, "__text", pattern, may[k], f"__f{k}")
    passing = [_spans(k) for k in range(4)]
    return rows.select(*keep, "__text", F.array_sort(F.concat(*passing)).alias("spans"))


def as_text(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat(name(x), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _masked(rows: DataFrame) -> DataFrame:
    """Adds __w: the words of the lower-cased text outside its base spans."""
    spans, text = F.col("spans"), F.col("__text")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    stops = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text)))
    between = F.array_join(_pieces(text, starts, stops), " ")
    free = F.when(F.size(spans) > 0, between).otherwise(text)
    return rows.withColumn("__w", F.filter(F.split(F.lower(free), r"[^\p{L}]+"), lambda w: F.length(w) >= 2))


def _flags(rows: DataFrame) -> DataFrame:
    """Adds f0 to f3 (a base span of each kind) and f4 (of any), as 0 or 1."""
    kinds = F.transform("spans", lambda x: x["k"])
    return rows.withColumns({**{f"f{k}": F.array_contains(kinds, k).cast("int") for k in range(4)}, "f4": (F.size("spans") > 0).cast("int")})


def _told(together, df, seen, n) -> Column:
    """How far a term gives an entity away: pointwise mutual information over the entity's own information."""
    return F.log(together * n / (seen * df)) / F.greatest(F.log(n / seen), F.lit(1e-9))


def _beyond_chance(together, df, seen, n, kinds: Column) -> Column:
    """Chernoff: so many documents of df would hold the entity by chance with a probability of at most exp(-df * divergence)."""
    p, q = together / df, F.least(seen / n, F.lit(1 - 1e-9))
    divergence = p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return (p > q) & (df * divergence >= F.log(kinds) + _CHANCE)


def _kinds_told(counts: DataFrame, seen: list[int], n: int, kinds: int, disclosure: float, support: int) -> Column:
    """counts has df and f0 to f4: does the term disclose one of the kinds?"""
    test = F.lit(False)
    for k, s in enumerate(seen):
        if 0 < s < n:
            t, args = F.col(f"f{k}"), (F.col("df"), F.lit(float(s)), F.lit(float(n)))
            test = test | ((t >= support) & (_told(F.greatest(t, F.lit(1)), *args) >= disclosure) & _beyond_chance(F.greatest(t, F.lit(1)), *args, F.lit(float(max(kinds, 1)))))
    return test


def _with_terms(rows: DataFrame, terms: DataFrame, many: int) -> DataFrame:
    """rows (with __w) that hold any of the terms, with __t: which ones."""
    if many <= BROADCAST_TERMS:
        one = F.broadcast(terms.agg(F.collect_set("term").alias("__all")))
        return rows.join(one).withColumn("__t", F.array_intersect("__w", "__all")).drop("__all").where(F.size("__t") > 0)
    keyed = materialize(rows.withColumn("__key", F.uuid()), "keyed")
    mine = keyed.select("__key", F.explode(F.array_distinct("__w")).alias("term")).join(terms, "term").groupBy("__key").agg(F.collect_set("term").alias("__t"))
    return keyed.join(mine, "__key").drop("__key")


def _contexts(rows: DataFrame) -> DataFrame:
    """A row for each term of __t with ctx: its neighbours at its first place, in all other columns but __w and __t."""
    entry = lambda w, i: F.struct(w.alias("term"), i.alias("i"))
    # sorted, a mark at -1 stands right before the first place of its term
    marked = F.sort_array(F.concat(F.transform("__t", lambda t: entry(t, F.lit(-1))), F.transform("__w", entry)))
    first = _once(marked, lambda s: F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1)["i"] == -1)))
    word = lambda w, j: F.coalesce(F.get(w, j), F.lit(""))
    at = lambda w: F.transform(first, lambda x: F.struct(x["term"].alias("term"), F.xxhash64(word(w, x["i"] - 1), word(w, x["i"] + 1)).alias("ctx")))
    keep = [c for c in rows.columns if c not in ("__w", "__t")]
    return rows.select(*keep, F.explode(_once(F.col("__w"), at)).alias("x")).select(*keep, "x.term", "x.ctx")


def disclosing_terms(docs: DataFrame, disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """term: those that give away a kind of protected entity, or a value that several documents hold."""
    rows = _masked(_flags(base_spans(docs)))
    flags = [f"f{k}" for k in range(5)]
    n, *seen = _flags(base_spans(docs)).agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in flags]).first()
    # counted before any join: each task sends a term once, however many texts hold it
    counts = rows.select(*flags, F.explode(F.array_distinct("__w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in flags])
    counts = materialize(counts.where(F.col("df") >= support), "terms")
    kinds = counts.count()
    some = materialize(counts.where(_kinds_told(counts, seen, n, kinds, disclosure, support)).select("term"), "candidates")
    contexts = _contexts(_with_terms(rows.select("__w", *flags), some, some.count()))
    contexts = contexts.groupBy("term", "ctx").agg(*[F.max(c).alias(c) for c in flags]).groupBy("term").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in flags])
    by_kind = contexts.where(_kinds_told(contexts, seen, n, kinds, disclosure, support)).select("term")
    # single values: only those that support documents hold can be given away by a term
    held = rows.where("f4 = 1").select("__w", F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(x["k"].alias("k"), F.lower(x["value"]).alias("value"))))).alias("v"))
    values = materialize(held.groupBy("v").agg(F.count("*").alias("seen")).where(F.col("seen") >= support), "values")
    many = values.count()
    mine = held.join(F.broadcast(values) if many <= BROADCAST_TERMS else values, "v")
    pairs = _contexts(mine.withColumn("__t", F.array_distinct("__w"))).groupBy("v", "seen", "term", "ctx").agg(F.count("*").alias("m"))
    pairs = pairs.groupBy("v", "seen", "term").agg(F.sum("m").alias("together"), F.count("*").alias("ways")).where((F.col("together") >= support) & (F.col("ways") >= support))
    args = F.col("together"), F.col("df"), F.col("seen"), F.lit(float(max(n, 1)))
    by_value = pairs.join(counts.select("term", "df"), "term").where((_told(*args) >= disclosure) & _beyond_chance(*args, F.lit(float(max(kinds * max(many, 1), 1))))).select("term")
    return by_kind.unionByName(by_value).distinct()


def _clear_terms(spans: Column) -> Column:
    """spans by start and kind, without the terms that meet a base span: one that began before, or the next to begin."""
    base = lambda x, at, other: F.when(x["k"] < 4, x[at]).otherwise(F.lit(other))
    before = lambda v: _running(F.transform(v, lambda x: base(x, "end", 0)), F.greatest)
    after = lambda v: F.reverse(_running(F.reverse(F.transform(v, lambda x: base(x, "start", 2**31 - 1))), F.least))
    free = lambda v: F.zip_with(before(v), after(v), lambda e, s: F.struct(e.alias("e"), s.alias("s")))
    held = lambda v: F.filter(F.zip_with(v, free(v), lambda x, f: F.when((x["k"] < 4) | ((f["e"] <= x["start"]) & (f["s"] >= x["end"])), x)), F.isnotnull)
    return _once(F.array_sort(spans), held)


def find(docs: DataFrame, disclosure: float = 0.8, support: int = 3) -> DataFrame:
    """doc_id, __text, base (array of spans), spans (base and terms) of each row."""
    reveal = materialize(disclosing_terms(docs, disclosure, support), "disclosing")
    rows = _masked(base_spans(docs, "doc_id"))
    many = reveal.count()
    none = F.array().cast("array<string>")
    if many <= BROADCAST_TERMS:
        one = F.broadcast(reveal.agg(F.coalesce(F.collect_set("term"), none).alias("__all")))
        rows = rows.join(one).withColumn("__t", F.array_intersect("__w", "__all")).drop("__all", "__w")
    else:
        rows = rows.withColumn("__row", F.uuid())
        rows = materialize(rows, "rows")
        mine = _with_terms(rows.select("__row", "__w"), reveal, many).select(F.col("__row").alias("__of"), "__t")
        rows = rows.join(mine, F.col("__row") == F.col("__of"), "left").withColumn("__t", F.coalesce("__t", none)).drop("__row", "__of", "__w")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("__t", "|"), F.lit(r")(?!\p{L})"))
    rows = _found(rows.withColumn("__p", F.when(F.size("__t") > 0, pattern).otherwise(F.lit("(?!)"))), "__text", F.col("__p"), F.size("__t") > 0, "__f")
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("k"), (x["start"] + F.length(x["m"])).alias("end"), F.lower(x["m"]).alias("value"))
    clear = _clear_terms(F.concat("spans", F.transform("__f", span)))
    return rows.select("doc_id", "__text", F.col("spans").alias("base"), F.when(F.size("__f") > 0, clear).otherwise(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; a span that begins before the end of another before it is passed over."""
    ends = lambda v: _running(F.transform(v, lambda x: x["end"]), F.greatest)
    before = lambda v: F.concat(F.array(F.lit(0)), F.slice(ends(v), 1, F.size(v) - 1))
    free = lambda v: F.filter(F.zip_with(v, before(v), lambda x, e: F.when(e <= x["start"], x)), F.isnotnull)
    name = lambda x: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit("]"))

    def built(v: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(v, lambda x: x["end"]))
        stops = F.concat(F.transform(v, lambda x: x["start"]), F.array(F.length(text)))
        names = F.concat(F.transform(v, name), F.array(F.lit("")))
        return F.array_join(F.zip_with(_pieces(text, starts, stops), names, lambda x, y: F.concat(x, y)), "")

    some = _once(F.array_sort(spans), lambda v: _once(free(v), built))
    return F.when(F.size(spans) > 0, some).otherwise(text)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_term, n_spans and the digest of the text as redact() leaves it."""
    out = find(table(spark, sf_dir, "documents")).withColumnRenamed("spans", "all")
    n = lambda k, of="base": F.size(F.filter(of, lambda x: x["k"] == k)).cast("long")
    clean = F.when(F.size("all") > 0, redact(F.col("__text"), F.col("all"))).otherwise(F.col("__text"))
    return out.select(
        "doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("all")).alias("spans"),
        n(4, "all").alias("n_term"), F.size("all").cast("long").alias("n_spans"), F.sha2(clean, 256).alias("redacted_sha256"),
    )


SQL: dict[str, str] = {}
