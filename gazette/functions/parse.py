"""Parsing of the raw news logs' fields: times, histories, impressions, entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME = "M/d/yyyy h:mm:ss a"
ENTITY = "array<struct<Label:string,Type:string,WikidataId:string,Confidence:double>>"


def mind_time(c: Column, strict: bool = True) -> Column:
    """M/D/YYYY h:mm:ss AM/PM; strict: a bad value is an error, else null."""
    return (F.to_timestamp(c, TIME) if strict else F.try_to_timestamp(c, F.lit(TIME))).cast("timestamp_ntz")


def history(c: Column) -> Column:
    """Ids between white space, each with no click time."""
    ids = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    return F.transform(ids, lambda x: F.struct(x.alias("article_id"), F.lit(None).cast("timestamp_ntz").alias("clicked_at")))


def impressions(c: Column) -> Column:
    """id-label tokens, split at the last hyphen; tokens without an integer label go."""
    toks = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    pairs = F.transform(toks, lambda t: F.struct(F.regexp_extract(t, "^(.+)-([^-]*)$", 1).alias("article_id"), F.regexp_extract(t, "^(.+)-([^-]*)$", 2).try_cast("int").alias("label")))
    return F.filter(pairs, lambda p: (p["article_id"] != "") & p["label"].isNotNull())


def unlabelled(c: Column) -> Column:
    """Candidate ids; a -0 or -1 at the end goes."""
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""), lambda t: F.regexp_replace(t, "^(.*)-[01]$", "$1"))


def entities(title: Column, abstract: Column) -> Column:
    """Entities of both JSON lists as struct(label, type, wikidata_id, confidence); of equal label and type the first stays."""

    def one(c: Column) -> Column:
        read = F.from_json(c, ENTITY, {"mode": "PERMISSIVE"})
        return F.transform(F.coalesce(read, F.array().cast(ENTITY)), lambda e: F.struct(F.coalesce(e["Label"], F.lit("")).alias("label"), F.coalesce(e["Type"], F.lit("")).alias("type"), e["WikidataId"].alias("wikidata_id"), e["Confidence"].alias("confidence")))

    return first_of(F.concat(one(title), one(abstract)))


def first_of(items: Column) -> Column:
    """Of the structs with equal label and type the first."""
    kind = F.slice(items, 1, 0)
    return F.aggregate(items, kind, lambda out, e: F.when(F.exists(out, lambda o: (o["label"] == e["label"]) & (o["type"] == e["type"])), out).otherwise(F.concat(out, F.array(e))))


def tagged_entities(clusters: Column, groups: Column) -> Column:
    """Two lists of labels, tagged NER and GROUP; empty labels and repeats go."""

    def one(c: Column, kind: str) -> Column:
        return F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(x.alias("label"), F.lit(kind).alias("type")))

    return F.array_distinct(F.concat(one(clusters, "NER"), one(groups, "GROUP")))


def behavior_row(line: Column) -> Column:
    """One line of a log as a struct: exactly five fields and at least one candidate, else an error."""
    f = F.split(line, "\t", -1)
    cand = unlabelled(F.get(f, 4))
    row = F.struct(f[0].alias("impression_id"), f[1].alias("user_id"), mind_time(f[2], strict=False).alias("ts"), history(f[3]).alias("clicked_history"), cand.alias("candidates"))
    return F.when((F.size(f) != 5) | (F.size(cand) < 1), F.raise_error(F.concat(F.lit("not a line of five fields with candidates: "), F.substring(line, 1, 80)))).otherwise(row)


def labels_of(ranked: Column, candidates: Column, labels: Column) -> Column:
    """The labels of ranked ids; of repeated candidates the last label counts, an id without one has 0."""
    pairs = F.reverse(F.arrays_zip(candidates.alias("id"), labels.alias("y")))
    return F.transform(ranked, lambda r: F.coalesce(F.get(F.filter(pairs, lambda p: p["id"] == r), F.lit(0))["y"], F.lit(0)))


def labels(inview: Column, clicked: Column) -> Column:
    """1 for each candidate among the clicked ones."""
    return F.transform(inview, lambda x: F.coalesce(F.array_contains(clicked, x), F.lit(False)).cast("int"))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tail(items: Column, cap: int) -> Column:
    """The last cap items."""
    return F.slice(items, F.greatest(F.size(items) - cap, F.lit(0)) + 1, cap)
