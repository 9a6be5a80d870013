"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are the one, two or more words before a symbol (up to ``depth``, the tree's bound), over all words of the training rows, by hash.
A context of at least ``least`` occurrences stays in the tree if its smoothed next-symbol distribution diverges from that of its longest
retained suffix: 2 n KL beyond what its degrees of freedom give by chance, and KL of at least ``min_kl`` nats. These thresholds are
absolute, so the tree grows with the corpus; ``p_known`` alone is a share. Next symbols seen twice or more are smoothed by absolute discounting towards the suffix, down to
the add-one root. Symbols are the words with at least ``p_known`` of the tokens, each by itself (1/p_known at most, sent to all tasks),
and one for all rarer words, of which each has its add-one share. A text's score is its base score (the root's) plus what the
longest suffix state of each position gains over the root.

The tree is never in one place. Every position goes, packed, to the shard of the last word before it; all longer contexts
that end in this word are there too, so a shard builds its subtree, keeps or drops its states, and scores its positions. What
it gains goes back by text. A context of over half a shard's positions is common (words by exact count, longer ones by a sample). The
next-symbol counts of common contexts are summed over all tasks first, and their states decided once; their positions are dealt out by the
next earlier word, or by the text where every context is common, and begin with the state that is sent to each part. So all scores are those of
the one tree, whatever a shard holds, however the input is partitioned, and whichever contexts the sample finds. Gains are whole
numbers of 2^-28, which add up to the same in any order.

Word counts cover all training rows. Rare words' counts, for the base score, meet the words of each chunk of texts in shards of their own.

Defined cases: a null text is empty (one token, its end); a null doc_id counts as the empty text for the
fold; repeated rows count and are scored each; an empty table gives an empty table; without training rows all scores are the root's.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import doc_crc, materialize, table

END = b""
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Positions that a task packs at once.
_AT_ONCE = 1_000_000
#: Share of the texts looked at for common contexts of several words; only behind words that are common by exact count.
_LOOK = 0.01
#: Steps of a position's gain.
_GAIN = 2.0**28
#: Steps of a rare word's logarithm.
_FINE = 2.0**32


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (doc_crc(docs["doc_id"]) % 7 == 2).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _tokens(text: bytes) -> list[bytes]:
    """ASCII white space splits, A-Z are lowered; bytes methods do just that."""
    return [*text.lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, the end of a text is empty) and n over the training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(_tokens(text))
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    rows = _input(docs).where("NOT held_out").select("text").mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Symbols:
    """Known words: index from 1 by falling count, 0 is all else; and their hashes."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.blob, self.size, self.index = b"\n".join(words), len(words), None
        self.counts = np.asarray([0, *counts], np.int64)

    def __getstate__(self):
        return self.__dict__ | {"index": None, "hashes": None}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if self.index is None:
            from xxhash import xxh64_intdigest

            words = self.blob.split(b"\n") if self.size else []
            self.index = {w: i + 1 for i, w in enumerate(words)}
            self.hashes = np.array([0, *map(xxh64_intdigest, words)], np.uint64)
        get = self.index.get
        return np.fromiter((get(t, 0) for t in tokens), np.int64, len(tokens))

    def code(self, known: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A word in 4 bytes, of which few differ: its index, or for a rare word 23 bits or more of its hash."""
        wide = np.uint64(1 << max(23, self.size.bit_length()))
        return np.where(known > 0, known.astype(np.uint64), wide | (h & (wide - np.uint64(1)))).astype(np.uint32)

    def hash(self, tokens: list[bytes], known: np.ndarray) -> np.ndarray:
        from xxhash import xxh64_intdigest

        out = self.hashes[known]
        rare = np.flatnonzero(known == 0)
        out[rare] = [xxh64_intdigest(tokens[i]) for i in rare.tolist()]
        return out


def _planes(*cols: np.ndarray) -> bytes:
    """Columns of one length as one compressed value, byte by byte."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in map(np.ascontiguousarray, cols))
    return np.array([len(cols[0]), len(raw)], np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _columns(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n, size = np.frombuffer(blob[:16], np.int64).tolist()
    raw, at, out = np.frombuffer(pa.decompress(blob[16:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8), 0, []
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).reshape(n))
        at += n * wide
    return out


def _joined(words: bytes, *more: bytes) -> bytes:
    """Words, compressed, and the packed columns that go with them."""
    packed = pa.Codec("zstd", compression_level=1).compress(words, asbytes=True)
    return np.array([len(words), len(packed), *map(len, more)], np.int64).tobytes() + packed + b"".join(more)


def _words_of(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Rare words, how often each, and the texts."""
    size, one, two, _ = np.frombuffer(blob[:32], np.int64).tolist()
    words = pa.decompress(blob[32 : 32 + one], decompressed_size=size, codec="zstd", asbytes=True).split(b"\n")
    return words, _columns(blob[32 + one : 32 + one + two], np.uint32)[0], _columns(blob[32 + one + two :], np.uint32)[0]


def _mix(a: np.ndarray, b) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MULT + np.asarray(b, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * _MULT


class Shards:
    """Where a position goes: by the last word before it; with common contexts (by length: code and parts) by the next earlier word or by the text.

    A context's code is made of its words' symbols, the last word first; every word of a common context is a known one.
    """

    def __init__(self, n: int, common: list[dict[int, int]], kinds: int):
        """kinds: how many symbols there are."""
        self.n, self.homes = n, 4 * n + 60  # shards of positions, and of rare words behind them
        self.common = [(np.array(sorted(x), np.uint64), np.array([x[c] for c in sorted(x)], np.int64)) for x in common]
        self.offsets = np.r_[0, np.cumsum([len(x) for x in common], dtype=np.int64)].tolist()
        self.first = np.full(kinds, -1, np.int32)  # the number of a common word by its symbol
        if common:
            hit, at = self.find(self.common[0][0], self.word_codes(np.arange(kinds)))
            self.first[hit] = at[hit]

    @staticmethod
    def word_codes(symbols: np.ndarray) -> np.ndarray:
        return _mix(np.zeros(len(symbols), np.uint64), symbols.astype(np.uint64))

    @staticmethod
    def find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(known):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return known[at] == h, at

    def met(self, known: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length the positions whose context is common, and its number among those of the length. known: symbols of the words before, the last first."""
        if not self.common:
            return
        which = self.first[known[0]]
        at = np.flatnonzero(which >= 0)
        which = which[at].astype(np.int64)
        code = self.common[0][0][which]
        yield at, which
        for (codes, _), words in zip(self.common[1:], known[1:]):
            common = self.first[words[at]] >= 0  # only common words make common contexts
            at, code = at[common], code[common]
            code = _mix(code, words[at].astype(np.uint64))
            hit, which = self.find(codes, code)
            at, code = at[hit], code[hit]
            yield at, which[hit]

    def part_keys(self, code, part) -> np.ndarray:
        return _mix(np.asarray(code, np.uint64), np.asarray(part, np.uint64) + np.uint64(1)) >> np.uint64(16)

    def keys(self, hashes: list[np.ndarray], known: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
        """A key for each position, from its words before and, if need be, its text; equal keys are one context, at least of the last word, and meet in one shard."""
        out = hashes[0] >> np.uint64(16)
        for d, (at, which) in enumerate(self.met(known)):
            codes, parts = self.common[d]
            by = hashes[d + 1][at] if d + 1 < len(hashes) else _mix(doc[at].astype(np.uint64), 7)
            out[at] = self.part_keys(codes[which], by % parts[which].astype(np.uint64))
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(16)) * np.uint64(self.n) >> np.uint64(32)).astype(np.int64)


def _smoothed(n: np.ndarray, below: np.ndarray, ctx_of: np.ndarray, k: int, least: int, discount: float, min_kl: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of pairs of a context and a symbol, which of the k contexts are kept as states, and their totals. n: counts; below: the suffix's probabilities, which a context that isn't kept leaves."""
    total = np.bincount(ctx_of, n, k)
    twice = n >= 2
    direct = np.where(twice, n - discount, 0.0) / np.maximum(total[ctx_of], 1)
    lam = 1 - np.bincount(ctx_of, direct, k)
    new = direct + lam[ctx_of] * below
    gain = np.bincount(ctx_of, np.where(twice, new * np.log(new / below), 0.0), k)
    left = np.maximum(1 - np.bincount(ctx_of, np.where(twice, below, 0.0), k), 0)
    kl = gain + lam * np.log(lam) * left
    free = np.bincount(ctx_of, twice, k)
    keep = (free > 0) & (total >= least) & (2 * total * kl > free + 3 * np.sqrt(2 * free)) & (kl >= min_kl)
    return np.where(keep[ctx_of], new, below), keep, total


def subtree(contexts: list[np.ndarray], sym: np.ndarray, train: np.ndarray, p0: np.ndarray, least: int = 2, discount: float = 0.75, min_kl: float = 0.005, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list[int]]:
    """log10 of each position's probability over its root's, and how many states each level keeps.

    contexts: for each length a code of the context of every position; a longer one tells the shorter one. p0: the root by symbol.
    known: for each position its probability by the states of its contexts up to a length, and that length (0: none), which are not built here.
    """
    p, given = (p0[sym].copy(), np.zeros(len(sym), np.int8)) if known is None else known
    at = np.flatnonzero(given == 0)
    kept = []
    for level, codes in enumerate(contexts):
        if level:
            at = np.r_[at, np.flatnonzero(given == level)]
        if not len(at):
            kept.append(0)
            continue
        order = at[np.lexsort((sym[at], codes[at]))]
        c, s, t = codes[order], sym[order], train[order]
        ctx_at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        pair_at = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
        ctx_of = np.searchsorted(ctx_at, pair_at, "right") - 1  # of each pair
        n = np.add.reduceat(t, pair_at, dtype=np.int64)
        new, keep, total = _smoothed(n, p[order[pair_at]], ctx_of, len(ctx_at), least, discount, min_kl)
        kept.append(int(keep.sum()))
        p[order] = np.repeat(new, np.diff(np.r_[pair_at, len(order)]))
        # a longer context occurs no oftener, so only these may go on
        at = order[np.repeat(total >= least, np.diff(np.r_[ctx_at, len(order)]))]
    return np.log10(p / p0[sym]), kept


def known_words(counts: DataFrame, p_known: float) -> tuple[Symbols, int, int, float, np.ndarray]:
    """(symbols, N, V, least count of a known word, probabilities of the symbols at the root)."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, p_known * total)
    known = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toPandas()  # at most 1 / p_known rows
    symbols = Symbols([bytes(w) for w in known["word"]], known["n"].tolist())
    head = (symbols.counts[1:] + 1) / (total + kinds + 1)
    return symbols, total, kinds, least, np.concatenate([[max(1 - head.sum(), 1 / (total + kinds + 1))], head])


def _befores(texts: list[bytes], symbols: Symbols, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all positions of some texts: the symbol, the symbols of the words before (the last first), and the text's place."""
    end = symbols.of([END])
    whole, sizes = [], []
    for text in texts:
        known = symbols.of(_tokens(text))
        whole += [*[end] * depth, known]
        sizes.append(len(known))
    flat = np.concatenate(whole) if whole else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(text)) + depth * (text + 1)
    return flat[at], [flat[at - j] for j in range(1, depth + 1)], text


def _common(docs: DataFrame, symbols: Symbols, rows: int, depth: int) -> list[dict[int, int]]:
    """For each length the contexts of over half a shard's positions, code and parts: words by their counts, longer ones as a sample shows them. A context's shorter ones are common as well."""
    most = rows / 2
    many = np.flatnonzero(symbols.counts > most)
    if not len(many):
        return []
    first = dict(zip(Shards.word_codes(many).tolist(), np.ceil(symbols.counts[many] / most).astype(int).tolist()))
    hot = np.zeros(len(symbols.counts), bool)
    hot[many] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, known, _ = _befores(b.column("text").to_pylist(), symbols, depth)
            at, level, codes = np.flatnonzero(hot[known[0]]), [], []
            code = Shards.word_codes(known[0][at])
            for d in range(1, depth):
                go = hot[known[d][at]]  # only common words make common contexts
                at, code = at[go], _mix(code[go], known[d][at[go]].astype(np.uint64))
                found, n = np.unique(code, return_counts=True)
                level.append((np.full(len(found), d + 1), n))
                codes.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in level]) if level else np.empty(0, np.int64), pa.int64()) for i in (0, 1)] + [pa.array(np.concatenate(codes).view(np.int64) if codes else np.empty(0, np.int64))], ["level", "m", "code"])

    some = _input(docs).where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < int(1e6 * _LOOK)).select("text")
    found = some.mapInArrow(run, "level long, m long, code long").groupBy("level", "code").agg(F.sum("m").alias("m")).where(F.col("m") > most * _LOOK).collect()  # as many as there are shards, for each length, at most
    return [first, *({int(np.int64(r.code).view(np.uint64)): int(np.ceil(r.m / _LOOK / most)) for r in found if r.level == d} for d in range(2, depth + 1))]


def _counted(sym: np.ndarray, n: np.ndarray) -> bytes:
    """Symbols that rise, and a count of each."""
    return _planes(np.diff(sym, prepend=0).astype(np.uint32), n.astype(np.int64))


def _added(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed counts."""
    parts = [_columns(b, np.uint32, np.int64) for b in blobs]
    sym, back = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts]), return_inverse=True)
    return sym, np.bincount(back, np.concatenate([p[1] for p in parts]), len(sym)).astype(np.int64)


def common_counts(docs: DataFrame, symbols: Symbols, shards: Shards, depth: int, tokens: int, fan_in: int = 32) -> DataFrame:
    """c (the number of a common context, shorter ones first), up (that of its suffix), counts: how often each symbol follows in training rows (0: in others alone).

    A task packs a row for each context that it meets; these are summed in a tree, from some million tokens on, so a context that all tasks meet is no large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wide, part = len(symbols.counts), TaskContext.get().partitionId()
        texts, held, size, found = [], [], 0, []
        above = np.full(shards.offsets[-1] + 1, -1)

        def count() -> None:
            sym, known, text = _befores(texts, symbols, depth)
            train = 1 - np.array(held, np.int64)[text]
            up = np.full(len(sym), -1)
            for d, (at, which) in enumerate(shards.met(known)):
                c = which + shards.offsets[d]
                above[c] = up[at]
                up[at] = c
                key = np.sort((c * wide + sym[at]) << 1 | train[at])
                new = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1]) if len(key) else key
                found.append((key[new] >> 1, np.add.reduceat(key & 1, new) if len(key) else key))

        def out() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([f[1] for f in found]), len(key)).astype(np.int64)
            found.clear()
            c = key // wide
            edges = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist(), len(c)] if len(c) else [0]
            rows = [(int(c[lo]), int(above[c[lo]]), part, _counted(key[lo:hi] % wide, n[lo:hi])) for lo, hi in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [[]] * 4, [pa.int64()] * 3 + [pa.binary()])], ["c", "up", "part", "counts"])

        for b in batches:
            for text, h in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist()):
                texts.append(text)
                held.append(h)
                size += len(text)
                if size > 8 * _AT_ONCE:
                    count()
                    texts, held, size = [], [], 0
                    if sum(len(f[0]) for f in found) > 4 * _AT_ONCE:
                        yield out()
        if texts:
            count()
        if found:
            yield out()

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"c": t.column("c")[:1], "up": t.column("up")[:1], "part": t.column("part")[:1], "counts": pa.array([_counted(*_added(t.column("counts").to_pylist()))], pa.binary())})

    sums = _input(docs).select("text", "held_out").mapInArrow(run, "c long, up long, part long, counts binary")
    left = max(1, tokens // (4 * _AT_ONCE))
    while True:
        sums = sums.groupBy("c", "up", (F.col("part") % left).alias("node")).applyInArrow(add, "c long, up long, part long, counts binary")
        if left == 1:
            return sums.select("c", "up", "counts")
        left = -(-left // fan_in)


def common_states(counts: DataFrame, shards: Shards, p0: np.ndarray, least: int, discount: float, min_kl: float) -> list[DataFrame]:
    """c, state: the packed symbols and probabilities that the states of common contexts give, length by length, as a context rests on its suffix's."""

    def state(t: pa.Table) -> pa.Table:
        sym, n = _added(t.column("counts").to_pylist())
        below = p0[sym]
        if t.column("below").null_count == 0:
            syms, p = _columns(t.column("below")[0].as_py(), np.uint32, np.float64)
            below = p[np.searchsorted(syms, sym)]
        # one context: what stands for it is a position for each symbol, with its count
        new = _smoothed(n, below, np.zeros(len(n), np.int64), 1, least, discount, min_kl)[0]
        return pa.table({"c": t.column("c"), "state": pa.array([_planes(sym.astype(np.uint32), new)], pa.binary())})

    found: list[DataFrame] = []
    for d in range(len(shards.common)):
        rows = counts.where((F.col("c") >= shards.offsets[d]) & (F.col("c") < shards.offsets[d + 1]))
        rows = rows.join(found[-1].select(F.col("c").alias("up"), F.col("state").alias("below")), "up") if d else rows.withColumn("below", F.lit(None).cast("binary"))
        found.append(materialize(rows.select("c", "counts", "below").groupBy("c").applyInArrow(state, "c long, state binary"), "states"))
    return found


def _sent(states: list[DataFrame], shards: Shards) -> DataFrame:
    """shard, word (none), n (none), states: each common context's state to every shard that has a part of its positions."""

    def send(t: pa.Table) -> pa.Table:
        c, body = t.column("c")[0].as_py(), t.column("state")[0].as_py()
        d = int(np.searchsorted(shards.offsets, c, "right")) - 1
        codes, parts = shards.common[d]
        keys = shards.part_keys(codes[c - shards.offsets[d]], np.arange(parts[c - shards.offsets[d]]))
        to = shards.of(keys)
        where = np.unique(to)
        blobs = []
        for s in where.tolist():
            mine = _planes(np.sort(keys[to == s]))
            blobs.append(np.array([d + 1, len(mine)], np.int64).tobytes() + mine + body)
        return pa.table({"shard": where, "word": pa.array([b""] * len(where), pa.binary()), "n": pa.array([0] * len(where), pa.int64()), "states": pa.array(blobs, pa.binary())})

    out = states[0]
    for level in states[1:]:
        out = out.unionByName(level)
    return out.groupBy("c").applyInArrow(send, "shard long, word binary, n long, states binary")


def _given(sent: list[bytes], h: np.ndarray, sym: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What subtree() takes as known: the probabilities by the states that were sent to a shard, for the positions of their keys."""
    p, given = p0[sym].copy(), np.zeros(len(sym), np.int8)
    rows = []
    for blob in sent:
        level, size = np.frombuffer(blob[:16], np.int64).tolist()
        rows.append((level, _columns(blob[16 : 16 + size], np.uint64)[0], *_columns(blob[16 + size :], np.uint32, np.float64)))
    if rows:
        keys = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        order = np.argsort(keys)
        hit, at = Shards.find(keys[order], h)
        mine = np.flatnonzero(hit)
        who = owner[order][at[hit]]
        for i, (level, _, syms, values) in enumerate(rows):
            some = mine[who == i]
            p[some] = values[np.searchsorted(syms, sym[some])]
            given[some] = level
    return p, given


_ROW = "shard long, chunk long, blob binary"


def _packed(docs: DataFrame, symbols: Symbols, shards: Shards, depth: int, log_mass: float) -> DataFrame:
    """shard, chunk, blob: positions by shard, rare words by shards from the number of shards on, and under a number below zero the texts of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        logc = np.log10(symbols.counts + 1.0)
        rows: list[tuple] = []
        cols: list[list[np.ndarray]] = [[] for _ in range(3 * depth + 1)]  # of the words before: hashes, symbols, and codes of all but the last; symbol, text
        rare: list[bytes] = []
        rare_at: list[tuple[np.ndarray, np.ndarray]] = []  # hashes and text of the rare words
        size = 0

        def whole_of(parts: list[np.ndarray]) -> np.ndarray:
            """Parts as one array; they are let go of."""
            x = np.concatenate(parts)
            parts.clear()
            return x

        def out() -> pa.RecordBatch:
            *given, sym, doc = map(whole_of, cols)
            before = given[2 * depth :]
            keys = shards.keys(given[:depth], given[depth : 2 * depth], doc >> np.uint32(1))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            to = shards.of(keys)
            edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
            names, blobs = [], []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part, k = order[lo:hi], keys[lo:hi]
                new = np.r_[True, k[1:] != k[:-1]]
                own = doc[part]
                step = np.where(new, own, own - np.r_[np.uint32(0), own[:-1]]).astype(np.uint32)  # texts rise within a key
                names.append(int(to[lo]))
                blobs.append(_planes(np.diff(k[new], prepend=np.uint64(0)), np.diff(np.r_[np.flatnonzero(new), len(k)]).astype(np.uint32)))
                blobs[-1] = np.int64(len(blobs[-1])).tobytes() + blobs[-1] + _planes(*[x[part] for x in before], sym[part], step)
            if rare:
                hashes, docs = (np.concatenate([x[i] for x in rare_at]) for i in (0, 1))
                _, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
                words = [rare[i] for i in lead.tolist()]
                home = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards.homes
                order = np.argsort((home * len(words) + np.arange(len(words)))[which], kind="stable")  # by home and word, texts rising
                edges = [0, *(np.flatnonzero(np.diff(home[which[order]])) + 1).tolist(), len(order)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    w, times = np.unique(which[order[lo:hi]], return_counts=True)
                    names.append(shards.n + int(home[w[0]]))
                    blobs.append(_joined(b"\n".join([words[i] for i in w.tolist()]), _planes(times.astype(np.uint32)), _planes(docs[order[lo:hi]])))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            about = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "base"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(about)
            names.append(-chunk - 1)
            blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([chunk] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "chunk", "blob"])

        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            for doc_id, held, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = _tokens(text)
                known = symbols.of(tokens)
                whole = np.concatenate([np.repeat(symbols.of([END]), depth + 1), known])
                h = symbols.hash([END] * (depth + 1) + tokens, whole)
                codes, n = symbols.code(whole, h), len(h) - 1
                for d in range(depth):
                    cols[d].append(h[depth - d : n - d])
                    cols[depth + d].append(whole[depth - d : n - d].astype(np.uint32))
                    if d:
                        cols[2 * depth + d - 1].append(codes[depth - d : n - d])
                cols[3 * depth - 1].append(known.astype(np.uint32))
                cols[3 * depth].append(np.full(len(tokens), len(rows) << 1 | held, np.uint32))
                unseen = np.flatnonzero(known == 0)
                rare += [tokens[j] for j in unseen.tolist()]
                rare_at.append((h[depth + 1 :][unseen], np.full(len(unseen), len(rows), np.uint32)))
                rows.append((doc_id, held, len(tokens), len(tokens) - len(unseen), float(logc[known].sum() - len(tokens) * log_mass)))
                size += len(tokens)
                if size > _AT_ONCE:
                    yield out()
                    chunk, size, rows = chunk + 1, 0, []
                    rare, rare_at = [], []
        if rows:
            yield out()

    return _input(docs).mapInArrow(run, _ROW)


def score(docs: DataFrame, depth: int = 3, least: int = 2, discount: float = 0.75, min_kl: float = 0.005, p_known: float = 1e-6, shard_rows: int = 750_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    counts = materialize(word_counts(docs), "word-counts")
    symbols, total, kinds, least_known, p0 = known_words(counts, p_known)
    shards = Shards(max(1, int(total * 7 // (6 * shard_rows))), _common(docs, symbols, shard_rows, depth), len(symbols.counts))
    names = ["shard", "chunk", "blob"]

    def looked_up(table: pa.Table, known: pa.Table) -> pa.Table:
        """What the counts of the rare words add to the base score of each text of each chunk, and how many words have one."""
        lg = dict(zip(known.column("word").to_pylist(), np.log10(known.column("n").to_numpy() + 1.0).tolist(), strict=True))
        out = []
        for blob in table.column("blob").to_pylist():
            words, times, doc = _words_of(blob)
            value = np.repeat(np.array([lg.get(w, 0.0) for w in words]), times)
            which, place = np.unique(doc, return_inverse=True)
            out.append(_planes(np.diff(which, prepend=np.uint32(0)), np.round(np.bincount(place, value) * _FINE).astype(np.int64), np.bincount(place, value > 0).astype(np.uint32)))
        return pa.Table.from_arrays([pa.array([1] * len(out), pa.int64()), table.column("chunk").combine_chunks(), pa.array(out, pa.binary())], names)

    def one_shard(table: pa.Table, known: pa.Table) -> pa.Table:
        """The positions of a shard: what each text of each chunk gains there. The rows about texts pass."""
        if not table.num_rows or (shard := table.column("shard")[0].as_py()) < 0:
            return table
        if shard >= shards.n:
            return looked_up(table, known)
        chunks, blobs = table.column("chunk").to_pylist(), table.column("blob").to_pylist()
        parts = []
        for blob in blobs:
            cut = 8 + int(np.frombuffer(blob[:8], np.int64)[0])
            gaps, times = _columns(blob[8:cut], np.uint64, np.uint32)
            *before, sym, step = _columns(blob[cut:], *[np.uint32] * (depth + 1))
            first = np.zeros(len(sym), bool)
            first[np.cumsum(times) - times] = True
            run = np.cumsum(step, dtype=np.int64)
            base = run[first] - step[first]
            parts.append((np.repeat(np.cumsum(gaps, dtype=np.uint64), times), *before, sym, (run - np.repeat(base, times)).astype(np.uint32)))
        h, *before, sym, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        ends = np.cumsum([len(x[0]) for x in parts]).tolist()
        del parts
        contexts = [h]
        for x in before:
            contexts.append(_mix(contexts[-1], x))
        gain, _ = subtree(contexts, sym, doc & np.uint32(1) == 0, p0, least, discount, min_kl, _given(known.column("states").to_pylist(), h, sym, p0))
        gain = np.round(gain * _GAIN)
        out = []
        for lo, hi in zip([0, *ends], ends, strict=False):
            which, place = np.unique(doc[lo:hi] >> np.uint32(1), return_inverse=True)
            # whole numbers: equal texts gain alike, wherever their positions went
            out.append(_planes(np.diff(which, prepend=np.uint32(0)), np.bincount(place, gain[lo:hi]).astype(np.int64).view(np.uint64)))
        return pa.Table.from_arrays([pa.array([0] * len(out), pa.int64()), pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names)

    def one_chunk(table: pa.Table) -> pa.Table:
        """The texts of a chunk with all that they gain."""
        about, gains, found = None, [], []
        for kind, blob in zip(table.column("shard").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind < 0:
                about = pa.ipc.open_stream(blob).read_all()
            elif kind:
                found.append(_columns(blob, np.uint32, np.int64, np.uint32))
            else:
                gains.append(_columns(blob, np.uint32, np.int64))
        # whole numbers add up to the same in any order
        steps, fine, more = (np.zeros(about.num_rows, np.int64) for _ in range(3))
        for which, x in gains:
            steps[np.cumsum(which)] += x
        for which, x, n in found:
            at = np.cumsum(which)
            fine[at] += x
            more[at] += n
        base = about.column("base").to_numpy() + fine / _FINE
        n_known = about.column("n_known").to_numpy() + more
        cols = [*[about.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens")], pa.array(n_known), pa.array(np.full(len(base), total, np.int64)), pa.array(base), pa.array(base + steps / _GAIN)]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    packed = _packed(docs, symbols, shards, depth, float(np.log10(total + kinds + 1)))
    rare = counts.where(F.col("n") < least_known).select((F.crc32("word") % shards.homes + shards.n).alias("shard"), "word", "n", F.lit(None).cast("binary").alias("states"))
    if shards.common:
        sums = materialize(common_counts(docs, symbols, shards, depth, total), "common-counts")
        rare = rare.unionByName(_sent(common_states(sums, shards, p0, least, discount, min_kl), shards))
    back = packed.groupBy("shard").cogroup(rare.groupBy("shard")).applyInArrow(one_shard, _ROW)
    return back.groupBy("chunk").applyInArrow(one_chunk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
