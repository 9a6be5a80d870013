"""SimHash near-duplicates: fingerprints of word shingles, exact Hamming links by vantage-point trees.

Fingerprints that are equal become one node. By the pigeonhole principle two fingerprints at up to ``bits``
differing bits agree in two of ``bits + 2`` blocks, so each goes into one shard for every pair of blocks;
those shards overlap and no link crosses all their boundaries. (A vantage-point partition of whole 64-bit
fingerprints cannot do this step: distances of unrelated texts to a point lie around 32, so that at a radius of 4 some 74 % of the rows
would be copied over every boundary, measured alike on 927 and on 9,296 fingerprints, and a tuple of ten points' distances still
leaves 0.6 % of all pairs, a share that doesn't fall with the rows.) Inside a shard a
vantage-point tree finds the exact links: the points are split by their distance to a vantage point, each
side is searched by itself, and by the triangle inequality only points within the radius of the boundary
are held against the other side. A shard gives a spanning forest of its links, never all pairs. A shard of
more than PART fingerprints is dealt out: its points are hashed into parts of half that size, and each two parts meet in one task.

Defined cases: null or blank text has fingerprint zero; a null doc_id is a row of its own, after all others;
rows that repeat a doc_id share its component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table
from gazette.llm.components import components

SEED = 42
#: Pairs of fingerprints that are compared at once inside a task (some 10 MB with all that follows from them).
_CELLS = 200_000
#: Fingerprints of a shard that one task takes; larger shards are dealt out in parts.
PART = 20_000
#: Large shards up to which their sizes are broadcast; beyond, the join shuffles.
BROADCAST_SHARDS = 100_000


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = max(len(words) - shingle + 1, 1)
    stops = ends[shingle - 1 :] - 1 if len(words) >= shingle else [len(joined)]
    hashes = np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[:k].tolist(), list(map(int, stops)), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, k, 65536):
        votes += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > k, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, fp (long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(prints, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _key(docs).alias("key"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key string, fp long")


class _Sets:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[i]
        while not np.array_equal(r, p[r]):
            r = p[r]
        p[i] = r
        return r

    def root(self, i: int) -> int:
        return int(self.roots(np.array([i]))[0])


def tree_links(points: np.ndarray, radius: int, leaf: int = 8) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of points (uint64) at a distance of at most radius."""
    sets, out = _Sets(len(points)), []

    def link(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if (ra := sets.root(a)) != (rb := sets.root(b)):
                sets.parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        """Links between two groups, in blocks of bounded memory."""
        if not len(i) or not len(j):
            return
        wide, high = min(len(j), _CELLS), max(1, _CELLS // len(j))
        for s in range(0, len(i), high):
            for t in range(0, len(j), wide):
                a, c = i[s : s + high], j[t : t + wide]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[c][None, :]) <= radius)
                ra, rb = sets.roots(a)[x], sets.roots(c)[y]
                new = ra != rb
                if new.any():
                    lo, hi = np.minimum(ra[new], rb[new]), np.maximum(ra[new], rb[new])
                    _, one = np.unique(lo * len(points) + hi, return_index=True)
                    link(a[x[new]][one], c[y[new]][one])

    def across(i: np.ndarray, j: np.ndarray) -> None:
        """Links between two groups. Points of the component that holds most of them are joined already and are not held against each other."""
        if not len(i) or not len(j):
            return
        ri, rj = sets.roots(i), sets.roots(j)
        roots, n = np.unique(np.concatenate([ri, rj]), return_counts=True)
        most = roots[n.argmax()]
        compare(i[ri != most], j)
        compare(i[ri == most], j[sets.roots(j) != sets.root(int(most))])

    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            if len(at) > 1:
                across(at, at)
            continue
        far = np.bitwise_count(points[at] ^ points[at[0]]).astype(np.int64)
        near = at[(far <= radius) & (far > 0)]
        link(np.full(len(near), at[0]), near)
        # the vantage point is the one farthest from the first: distances to it spread most
        vantage = at[int(far.argmax())]
        far = np.bitwise_count(points[at] ^ points[vantage]).astype(np.int64)
        mu = int(np.median(far))
        if (far <= mu).all():
            mu -= 1
        inside = far <= mu
        if not inside.any() or inside.all():
            across(at, at)
            continue
        across(at[inside & (far > mu - radius)], at[~inside & (far <= mu + radius)])
        todo += [at[inside], at[~inside]]
    return out


def _blocks(n: int) -> list[int]:
    """Masks of n blocks of the 64 bits, as signed longs."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [int(np.array([sum(1 << b for b in range(lo, hi))], np.uint64).view(np.int64)[0]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _dealt(shards: DataFrame, part: int) -> DataFrame:
    """Adds cell, by which a shard of over part fingerprints is dealt out: a cell holds two of its parts, and every two parts share one."""
    one = F.lit(0).cast("long").alias("cell")
    large = materialize(shards.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") > part).select("s", "k", F.ceil(F.col("n") * 2 / part).alias("parts")), "large-shards")
    n = large.count()
    if n == 0:
        return shards.select("*", one)
    known = shards.join(F.broadcast(large) if n <= BROADCAST_SHARDS else large, ["s", "k"], "left").withColumn("p", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    pair = lambda j: F.least(F.col("p"), j) * F.col("parts") + F.greatest(F.col("p"), j)
    cells = F.when(F.col("parts").isNull(), F.array(one)).otherwise(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: j != F.col("p")), pair))
    return known.select("s", "k", "fp", F.explode(cells).alias("cell"))


def links(nodes: DataFrame, bits: int, part: int = PART) -> DataFrame:
    """u, v: fingerprints (column fp, distinct) that span each group joined by links of at most bits differing bits."""
    masks = [a | b for a, b in combinations(_blocks(bits + 2), 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    shards = _dealt(nodes.select("fp", F.explode(keys).alias("x")).select("x.s", "x.k", "fp"), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and cell; a cell may span batches."""
        key, held = None, []

        def done() -> pa.RecordBatch:
            points = np.concatenate(held)
            found = tree_links(points.view(np.uint64), bits) if len(points) > 1 else []
            i, j = (np.array([x[n] for x in found], np.int64) for n in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(points[i]), pa.array(points[j])], ["u", "v"])

        for b in batches:
            s, k, c, fp = (b.column(n).to_numpy(zero_copy_only=False) for n in ("s", "k", "cell", "fp"))
            cut = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(s)], strict=True):
                if lo == hi:
                    continue
                if (s[lo], k[lo], c[lo]) != key:
                    if sum(map(len, held)) > 1:
                        yield done()
                    key, held = (s[lo], k[lo], c[lo]), []
                held.append(fp[lo:hi].copy())
        if sum(map(len, held)) > 1:
            yield done()

    return shards.repartition("s", "k", "cell").sortWithinPartitions("s", "k", "cell").mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """doc_id, fp, key, component_id (least doc_id of the group), survivor (key of the row that stands for it) for each row."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")), "nodes")
    found = components(links(nodes.select("fp"), bits))
    named = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    by_fp = named.drop("least").join(least, "root").select(F.col("fp").alias("__fp"), F.col("least.doc_id").alias("component_id"), F.col("least.key").alias("survivor"))
    return rows.join(by_fp, F.col("fp") == F.col("__fp")).drop("__fp")


def _key(docs: DataFrame):
    """The id and the text's hash: rows with equal keys are repeats of one row."""
    return F.concat_ws(":", docs["doc_id"].cast("long").cast("string"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).cast("string"))


def keep_one(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least doc_id (null ids last)."""
    stay = groups(docs, shingle, bits).where("key = survivor").select(F.col("key").alias("__key")).distinct()
    marked = docs.withColumn("__own", _key(docs))
    return marked.join(stay, F.col("__own") == F.col("__key"), "left_semi").dropDuplicates(["__own"]).select(*docs.columns)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
