"""Prediction files: lines, validation, packaging."""

from __future__ import annotations

import hashlib
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(ranked: DataFrame, order: str, value: str, checked: bool) -> DataFrame:
    """checked: places and ranks must both be 1 to n within an impression; anything else is an error that names it."""
    g = ranked.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v")))).alias("xs"))
    whole = F.sequence(F.lit(1), F.size("xs")).cast("array<bigint>")
    sound = (F.transform("xs", lambda x: x["o"]) == whole) & (F.array_sort(F.transform("xs", lambda x: x["v"])) == whole)
    if checked:
        g = g.where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("ranks are no permutation: impression "), F.coalesce(F.col("impression_id").cast("string"), F.lit("without an id"))))))
    inner = F.array_join(F.transform("xs", lambda x: x["v"].cast("string")), ",")
    return g.select("impression_id", F.concat(F.col("impression_id").cast("string"), F.lit(" ["), inner, F.lit("]")).alias("line"))


def ranks_by_candidate(ranked: DataFrame, checked: bool = True) -> DataFrame:
    """impression_id, line: the rank of each candidate, in candidate order (the default). Ranks that are no permutation are an error unless checked is off."""
    return _line(ranked, "pos", "rank", checked)


def positions_by_rank(ranked: DataFrame, checked: bool = True) -> DataFrame:
    """impression_id, line: the candidate's place, in rank order (the inverse permutation). As above."""
    return _line(ranked, "rank", "pos", checked)


def valid_line(line: Column) -> Column:
    """An id, then a permutation of 1..n in brackets."""
    inner = F.regexp_extract(line, r"^\S+ \[([0-9]+(?:,[0-9]+)*)\]$", 1)
    ranks = F.transform(F.split(inner, ","), lambda x: x.try_cast("int"))
    return (inner != "") & (F.array_sort(ranks) == F.sequence(F.lit(1), F.size(ranks)))


def write_predictions(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def package(lines: DataFrame, target: str, member: str = "prediction.txt") -> str:
    """A ZIP with one member, written line by line; gives its SHA-256."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as out:
        for row in lines.orderBy("impression_id").select("line").toLocalIterator():
            out.write(f"{row.line}\n".encode())
    return hashlib.sha256(Path(target).read_bytes()).hexdigest()


def validate_package(target: str) -> int:
    """The number of lines; an error unless the ZIP holds exactly one member of valid lines."""
    import re

    with zipfile.ZipFile(target) as z:
        if len(z.namelist()) != 1:
            raise ValueError(f"{len(z.namelist())} members")
        n = 0
        for raw in z.open(z.namelist()[0]):
            m = re.fullmatch(r"\S+ \[(\d+(?:,\d+)*)\]", raw.decode().rstrip("\n"))
            if not m or sorted(map(int, m[1].split(","))) != list(range(1, m[1].count(",") + 2)):
                raise ValueError(f"line {n + 1}: {raw[:80]!r}")
            n += 1
    return n
