"""Periodic runs of words: suffix array and LCP give longest previous factors, these the blocks of an LZ parse, and runs follow from the blocks.

A run is a stretch of words with a smallest period that no neighbour extends. A run that touches a block's edge comes from Main's extensions
to both sides of the edge; a run strictly inside a block is a copy of an earlier one and is taken over from the block's source, by buckets of starts.
All texts of an Arrow batch are worked together in numpy: words of different texts are different letters, so nothing is common between texts.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gazette.llm.common import table

SQL: dict[str, str] = {}
#: Words that are worked together, and pairs of (edge, period) that are held at once.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 1_000_000


def suffix_ranks(letters: np.ndarray) -> np.ndarray:
    """Row k: a number for the 2^k letters from each place on, equal for equal stretches, in their order, by prefix doubling; the last row orders all suffixes.

    One column more than letters, of -1, stands behind the end. Places whose rank is their own already are not sorted again.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    sorted_ = letters[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = start
    levels, h = [rank.astype(np.int32)], 1
    shared = ~(first & np.r_[first[1:], True])
    todo = order[shared]
    while len(todo):
        own, then = rank[todo], rank[np.minimum(todo + h, n)]
        key = own * (n + 1) + then + 1
        by = np.argsort(key)
        todo, key, own = todo[by], key[by], own[by]
        at = np.arange(len(todo))
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(new, at, 0))
        old = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], at, 0))
        rank = rank.copy()
        rank[todo] = own + group - old
        levels.append(rank.astype(np.int32))
        todo = todo[~(new & np.r_[new[1:], True])]
        h *= 2
    return np.stack(levels)


def common_after(ranks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters from places i and j on are equal, for i unlike j."""
    at, other, n = i.copy(), j.copy(), ranks.shape[1] - 1
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][at] == ranks[k][other]).astype(np.int64) << k
        at += step
        other += step
        np.minimum(at, n, out=at)
        np.minimum(other, n, out=other)
    return at - i


def common_before(ranks: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters up to places i and j, themselves included, are equal, for i unlike j; a place of -1 has none."""
    at, other = i.copy(), j.copy()
    for k in range(len(ranks) - 1, -1, -1):
        a, b = at - (1 << k) + 1, other - (1 << k) + 1
        ok = (a >= 0) & (b >= 0)
        step = (ok & (ranks[k][np.where(ok, a, 0)] == ranks[k][np.where(ok, b, 0)])).astype(np.int64) << k
        at -= step
        other -= step
    return i - at


def _nearest_smaller(x: np.ndarray, reach: int) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value; -1 or one with a larger value if there is none within reach."""
    mins, k = [x], 0
    while (2 << k) <= reach:
        w = mins[-1].copy()
        w[1 << k :] = np.minimum(w[1 << k :], mins[-1][: -(1 << k)])
        mins.append(w)
        k += 1
    at = np.arange(len(x)) - 1
    for k in range(len(mins) - 1, -1, -1):
        for _ in range(2):  # both halves of what the next higher step would have left
            skip = (at >= 0) & (mins[k][np.maximum(at, 0)] > x)
            at = np.maximum(np.where(skip, at - (1 << k), at), -1)
    return at


def previous_factors(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest stretch that begins there and at an earlier place, and that place (-1: none)."""
    n = ranks.shape[1] - 1
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1][:n]] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)  # with the suffix before it
    near = np.flatnonzero(ranks[0][suffixes[1:]] == ranks[0][suffixes[:-1]]) + 1
    lcp[near] = common_after(ranks, suffixes[near], suffixes[near - 1])
    held = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))  # suffixes whose first letter occurs again
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not len(held):
        return longest, source
    x = suffixes[held]
    letter = ranks[0][x]
    reach = int(np.unique(letter, return_counts=True)[1].max())
    for side in (_nearest_smaller(x, reach), len(x) - 1 - _nearest_smaller(x[::-1].copy(), reach)[::-1]):
        ok = (side >= 0) & (side < len(x))
        ok[ok] &= (x[side[ok]] < x[ok]) & (letter[side[ok]] == letter[ok])
        mine, prior = x[ok], x[side[ok]]
        length = common_after(ranks, mine, prior)
        better = length > longest[mine]
        longest[mine[better]], source[mine[better]] = length[better], prior[better]
    return longest, source


def _edge_runs(ranks, edges, before, after, low, high, exponent: int, least: int) -> np.ndarray:
    """Rows (start, end, period) of stretches around edges whose letters repeat after a period. before, after: lengths of the blocks at an edge; low, high: its text."""
    found = []
    top = len(ranks) - 1
    for left in (True, False):
        most = np.minimum(before + after - 1, edges - low) if left else np.minimum(after, high - edges)
        most = np.maximum(most, 0)
        total = np.r_[0, np.cumsum(most)]
        i = 0
        while i < len(edges):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS_AT_ONCE, "right")) - 1)
            for lo in range(0, int(total[j] - total[i]), PAIRS_AT_ONCE):  # a single block may be longer than that
                t = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(total[j] - total[i]))) + total[i]
                e = np.searchsorted(total, t, "right") - 1
                p = t - total[e] + 1
                b = edges[e]
                one, other = (b, b - p) if left else (b, b + p)
                need = np.maximum(least - p, (exponent - 1) * p)
                # one of both sides has half of what is needed: its first 2^k letters must be equal
                k = np.minimum(np.floor(np.log2(np.maximum((need + 1) // 2, 1))).astype(np.int64), top)
                ahead = ranks[k, one] == ranks[k, other]
                a, c = one - (1 << k), other - (1 << k)
                ok = (a >= 0) & (c >= 0)
                back = ok & (ranks[k, np.where(ok, a, 0)] == ranks[k, np.where(ok, c, 0)])
                keep = ahead | back
                if not keep.any():
                    continue
                one, other, p, need = one[keep], other[keep], p[keep], need[keep]
                fore = common_after(ranks, one, other)
                aft = common_before(ranks, one - 1, other - 1)
                good = fore + aft >= need
                first = np.minimum(one, other)[good]
                last = np.maximum(one, other)[good]
                found.append(np.stack([first - aft[good], last + fore[good], p[good]], 1))
            i = j
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def find_runs(letters: np.ndarray, bounds: np.ndarray, exponent: int = 2, least: int = 2) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start and period, of at least exponent periods and least letters.

    letters: whole numbers, of all texts one after another, no number in two texts; bounds: where each text begins, and the end. Starts count within the text.
    """
    n = len(letters)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if n < 2:
        return out
    ranks = suffix_ranks(letters)
    longest, source = previous_factors(ranks)
    step, blocks, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:  # the LZ parse: a new letter, or as much as an earlier place has
        blocks.append(i)
        i += step[i]
    begin = np.array(blocks)
    size = np.diff(np.r_[begin, n])
    text = np.searchsorted(bounds, begin, "right") - 1
    # edges: where a block begins but not its text, and the ends of texts
    inner = np.flatnonzero(begin != bounds[text])
    last = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    edges = np.r_[begin[inner], bounds[text[last] + 1]]
    before = np.r_[size[inner - 1], size[last]] if len(inner) else size[last]
    after = np.r_[size[inner], np.zeros(len(last), np.int64)]
    of = np.r_[text[inner], text[last]]
    # a run at the very start of a text touches the text's first block, of one letter: its end or an edge inside it is an edge above
    rows = _edge_runs(ranks, edges, before, after, bounds[of], bounds[of + 1], exponent, least)
    if not len(rows):
        return out
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]]  # of multiples of a period the period
    mine = np.searchsorted(bounds, rows[:, 0], "right") - 1
    for t in np.unique(mine):
        buckets: dict[int, list[tuple[int, int]]] = {}
        for s, e, p in rows[mine == t].tolist():
            buckets.setdefault(s, []).append((e - s, p))
        starts = sorted(buckets)
        for f in range(int(np.searchsorted(text, t, "left")), int(np.searchsorted(text, t, "right"))):
            b, length, src = int(begin[f]), int(size[f]), int(source[begin[f]])
            if src < 0 or length < least + 2:
                continue
            at = bisect_right(starts, src)
            while at < len(starts) and starts[at] < src + length:
                s = starts[at]
                for m, p in [x for x in buckets[s] if s + x[0] < src + length]:  # strictly inside: the same run again
                    if (to := s + b - src) not in buckets:
                        buckets[to] = []
                        insort(starts, to)
                    if (m, p) not in buckets[to]:
                        buckets[to].append((m, p))
                at += 1
        low = int(bounds[t])
        out[t] = sorted(((s - low, m, p) for s in starts for m, p in buckets[s]), key=lambda r: (r[0], r[2]))
    return out


def planted(words: list[bytes], doc_id: str) -> list[bytes]:
    """The words of a text; of a tenth of the texts, told by the id, the last part repeats with a period."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    times, rest = divmod(n - a, p)
    return words[:a] + cycle * times + cycle[:rest]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, m, p in runs:
        keep[s + p : s + m] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *told, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, plant: bool = False) -> DataFrame:
    """For each row of docs: doc_id, the number of its text's periodic runs, the one with most periods, and digests of all runs and of the text without repeats.

    A run has at least `exponent` periods and `least` words. A null text has no words; a null doc_id stays null, equal ids and repeated rows stay rows of their own;
    other columns are not read. plant: see planted(). A text is worked whole by the task that reads it.
    """

    def work(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        letters, bounds = [], [0]
        for words in texts:
            letters.append(pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + bounds[-1])
            bounds.append(bounds[-1] + len(words))
        runs = find_runs(np.concatenate(letters) if letters else np.zeros(0, np.int64), np.array(bounds), exponent, least)
        rows = [(i, *_described(w, r)) for i, w, r in zip(ids, texts, runs)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space alone
                texts.append(planted(words, "" if i is None else str(i)) if plant else words)
                ids.append(i)
                n += len(words)
                if n >= WORDS_AT_ONCE or len(ids) >= 10_000:
                    yield work(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield work(ids, texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
