"""Best-fit packing by patterns of few documents and non-negative least squares.

Documents are tokenised, closed by an end id and cut, only if longer than a sequence, into full pieces behind
a first, shorter one. Only the histogram of piece lengths (``max_tokens`` bins) goes to the driver. There,
patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts fitted to
the histogram by non-negative least squares, rounded down, and the residual histogram packed best-fit
decreasing, in counts. Each piece then finds its sequence from its rank among pieces of its length; ranks
come from running counts in each task plus offsets by task, so no length gathers in one place.

Defined cases: null text is empty (one token, the end id); null or repeated doc_ids are rows like others;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.llm.common import materialize, table

END_ID = 2
#: Unicode white space, as the pre-tokeniser's \s. A pre-token never spans from other characters to white space.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Units that split into a line end, one word and punctuation, each a pre-token; an apostrophe may open a contraction.
_WORD = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
_state: dict = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts, unit by unit (white space and what follows), with a bounded memory of units."""

    LIMIT = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes as one id wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _body(self, word: str) -> bytes:
        """Ids of one word of letters, with or without a space before it."""
        if (found := self.known.get(word)) is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
            found = self.known[word] = np.array(ids, "<u4").tobytes()
        return found

    def _learn(self, units: set[str]) -> None:
        for u in units:
            if m := _WORD.fullmatch(u):
                line, word, marks = m.groups()
                self.known[u] = (self.plain(line) if line else b"") + self._body(word) + (self.plain(marks) if marks else b"")
            else:
                self.known[u] = self.encode(u)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, as encode() gives; a text with an added token is encoded whole."""
        if any(x in text for x in self.added):
            return self.encode(text)
        units = _UNIT.findall(text)
        known = self.known
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            if len(known) > self.LIMIT:
                known.clear()
            self._learn({u for u in units if u not in known})
            return b"".join([known[u] for u in units])

    def plain(self, mark: str) -> bytes:
        """encode() of a few short strings that come again and again."""
        if (found := self.marks.get(mark)) is None:
            found = self.encode(mark)
            if len(self.marks) < 10_000:
                self.marks[mark] = found
        return found

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _tokens(path: str) -> Tokens:
    """One for each worker process; it outlives a task."""
    if path not in _state:
        _state[path] = Tokens(path)
    return _state[path]


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, shard, rank (among the shard's pieces of this length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, shard, seen = _tokens(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokens.ids(text) + end
                n = len(ids) // 4
                first = n % max_tokens or max_tokens
                starts = [0, *range(first, n, max_tokens)]
                for i, (start, stop) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    length = stop - start
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * stop]), shard, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, rank long")


def patterns(size: int, present: np.ndarray) -> np.ndarray:
    """All ways to fill a sequence exactly with one to three of the lengths present; rows padded with 0, longest first."""
    have = np.zeros(size + 1, bool)
    have[present] = True
    rows = [np.array([[size, 0, 0]])] if have[size] else []
    a = np.arange((size + 1) // 2, size)
    b = size - a
    ok = have[a] & have[b] & (a >= b)
    rows.append(np.stack([a[ok], b[ok], 0 * a[ok]], 1))
    a, b = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 1)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[a] & have[b] & have[c]
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows)


def fit_repeats(found: np.ndarray, histogram: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """x >= 0 that makes the patterns' lengths come near the histogram in the least squares sense.

    Coordinate descent: each pattern in turn takes the step that is best for it alone. Patterns of the longest
    lengths, which have the fewest ways to be filled, come first. The descent ends after ``sweeps`` rounds, or when no count moves by a
    quarter of a sequence, as counts are rounded down afterwards; what is left over is packed best-fit, so only the number of sequences depends on it.
    """
    cells = [[(int(v), int(m)) for v, m in zip(*np.unique(p[p > 0], return_counts=True), strict=True)] for p in found]
    x = [0.0] * len(cells)
    left = histogram.astype(float).tolist()
    order = sorted(range(len(cells)), key=lambda i: (-found[i][0], found[i][2] > 0, -found[i][1]))
    for _ in range(sweeps):
        moved, active = 0.0, []
        for i in order:
            g = w = 0.0
            for v, m in cells[i]:
                g += m * left[v]
                w += m * m
            new = max(0.0, x[i] + g / w)
            if (d := new - x[i]) != 0.0:
                x[i] = new
                for v, m in cells[i]:
                    left[v] -= m * d
                moved = max(moved, abs(d))
            if new > 0 or g > 0:
                active.append(i)
        order = active
        if moved < 0.25:
            break
    return np.array(x)


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that hold every piece of the histogram (index: length) in sequences of at most size."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    if (present := np.flatnonzero(left)).size:
        found = patterns(size, present)
        if len(found):
            x = fit_repeats(found, left)
            for i in np.argsort(-x, kind="stable"):
                if x[i] < 1:
                    break
                p = found[i][found[i] > 0]
                v, m = np.unique(p, return_counts=True)
                if (n := int(min(np.floor(x[i] + 1e-9), (left[v] // m).min()))) > 0:
                    out.append((tuple(int(k) for k in p), n))
                    left[v] -= n * m
    # what is left: best fit, longest first, many equal sequences at a time
    room: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fit = next((r for r in range(length, size) if room.get(r)), None)
            if fit is None:
                deep = size // length
                full, rest = divmod(n, deep)
                if full:
                    room.setdefault(size - deep * length, []).append([(length,) * deep, full])
                if rest:
                    room.setdefault(size - rest * length, []).append([(length,) * rest, 1])
                n = 0
                continue
            held, times = room[fit].pop()
            take = min(n, times)
            if times > take:
                room[fit].append([held, times - take])
            room.setdefault(fit - length, []).append([(*held, length), take])
            n -= take
    return out + [(tuple(p), k) for groups in room.values() for p, k in groups]


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 1024) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = materialize(pieces(docs, tokenizer, max_tokens), "pieces")
    by_shard = made.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = materialize(by_shard.withColumn("before", before), "shards")
    histogram = np.zeros(max_tokens + 1, np.int64)
    for length, n in shards.groupBy("length").agg(F.sum("n")).collect():  # at most max_tokens rows
        histogram[length] = n
    lengths, lo, repeats, base, offset, next_id = [], [], [], [], [], 0
    used = np.zeros(max_tokens + 1, np.int64)
    for p, n in plan(histogram, max_tokens):
        at = 0
        for length in p:
            lengths.append(length)
            lo.append(used[length])
            base.append(next_id)
            offset.append(at)
            repeats.append(n)
            used[length] += n
            at += length
        next_id += n
    span = 1 << 48
    keys = np.array(lengths, np.int64) * span + np.array(lo, np.int64)
    order = np.argsort(keys)
    keys, base, offset = keys[order], np.array(base, np.int64)[order], np.array(offset, np.int64)[order]
    starts = keys % span

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base[at] + rank - starts[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(shards.drop("n"), ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


SQL: dict[str, str] = {}
