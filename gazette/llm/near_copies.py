"""Near copies by the Jaccard similarity of their word shingles: MinHash bands find candidates, the shingles decide.

A row has ``BANDS`` band values of ``ROWS`` least hashes each. Rows that share one are a bucket; a pair at a similarity of j
shares one with a probability of 1 - (1 - j**ROWS)**BANDS: 0.99993 at 0.8. Every pair of a bucket that is not joined yet is held
against the shingles themselves (by a prefix filter, which loses nothing), so each link is exact, and a bucket gives a spanning
forest of its links, never all pairs. Buckets of the same rows are searched once. A bucket of more than PART rows is dealt out
as simhash does its shards: every two parts of it meet in one task.

Defined cases: a text of fewer words than a shingle has one shingle, of all its words; a null or blank text has none and is no
copy here; rows that repeat a doc_id and text are one row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import simhash
from gazette.llm.common import materialize
from gazette.llm.components import components

BANDS, ROWS = 24, 5
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are hashed at once (120 rows of 8 bytes each).
_AT_ONCE = 4096


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes (uint64, sorted) of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle, len(words))
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MULT + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _MULT
    return np.unique(out ^ (out >> np.uint64(29)))


def _bands_of(hashes: np.ndarray) -> np.ndarray:
    """A value (int64) for each band."""
    rng = np.random.default_rng(42)
    a = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _AT_ONCE):
        least = np.minimum(least, ((hashes[None, i : i + _AT_ONCE] ^ b) * a).min(1))
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = (out ^ (out >> np.uint64(29))) * _MULT + least[r::ROWS]
    return ((out ^ (out >> np.uint64(32))) * _MULT).view(np.int64)


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, not empty) at a Jaccard similarity of at least similarity.

    Two such sets share a member among the rarest n - ceil(similarity * n) + 1 of either, so only these are looked up.
    """
    whole, counts = np.unique(np.concatenate(sets), return_counts=True)
    joined, out, holders = simhash._Sets(len(sets)), [], defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda x: len(sets[x])):
        own = sets[i]
        at = np.searchsorted(whole, own)
        # the rounding of a product must not shorten a prefix
        few = len(own) - ceil(similarity * len(own) - 1e-9) + 1
        rare = at[np.lexsort((at, counts[at]))][:few].tolist()
        met = np.array(sorted({j for x in rare for j in holders[x]}), np.int64)
        for x in rare:
            if counts[x] > 1:
                holders[x].append(i)
        for j in met.tolist():
            other = sets[j]
            if len(other) < similarity * len(own) - 1e-9 or joined.root(i) == joined.root(j):
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                ri, rj = joined.root(i), joined.root(j)
                joined.parent[max(ri, rj)] = min(ri, rj)
                out.append((i, j))
    return out


def links(rows: DataFrame, shingle: int, similarity: float, part: int = simhash.PART) -> DataFrame:
    """u, v: nodes that span each group joined by links of at least similarity; rows: node (long, distinct), text (binary)."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, values = [], []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(h := shingles(text, shingle)):
                    nodes.append(node)
                    values.append(_bands_of(h))
            if nodes:
                s = np.tile(np.arange(BANDS, dtype=np.int32), len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.concatenate(values)), pa.array(np.repeat(np.array(nodes, np.int64), BANDS))], ["s", "k", "fp"])

    held = materialize(rows.mapInArrow(bands, "s int, k long, fp long"), "bands")
    buckets = held.groupBy("s", "k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.min("fp").alias("m")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "m").agg(F.min(F.struct("s", "k")).alias("b")).select("b.s", "b.k")
    shards = materialize(held.join(buckets, ["s", "k"], "left_semi"), "buckets")
    texts = simhash._dealt(shards, part).join(rows, F.col("fp") == F.col("node")).select("s", "k", "cell", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and cell; a cell may span batches."""
        key, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            found = set_links(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[n]] for x in found], pa.int64()) for n in (0, 1)], ["u", "v"])

        for b in batches:
            for s, k, c, node, text in zip(*(b.column(n).to_pylist() for n in ("s", "k", "cell", "node", "text")), strict=True):
                if (s, k, c) != key:
                    if len(sets) > 1:
                        yield done()
                    key, nodes, sets = (s, k, c), [], []
                nodes.append(node)
                sets.append(shingles(text, shingle))
        if len(sets) > 1:
            yield done()

    return texts.repartition("s", "k", "cell").sortWithinPartitions("s", "k", "cell").mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id (null ids last)."""
    kept = materialize(docs.withColumn("__node", F.xxhash64(simhash._key(docs))).dropDuplicates(["__node"]), "kept")
    found = materialize(components(links(kept.select(F.col("__node").alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), shingle, similarity)), "copies")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__node").alias("node"))
    ids = members.join(kept.select("__node", order.alias("at")), F.col("node") == F.col("__node")).select("node", "root", "at")
    stay = ids.groupBy("root").agg(F.min("at").alias("at")).select("at.node")
    gone = members.select("node").join(stay, "node", "left_anti")
    return kept.join(gone, kept["__node"] == gone["node"], "left_anti").select(*docs.columns)
