"""Spelling variants: pairs of words at distance one by a self-join of the vocabulary's trie with active-node sets, and the form that each word goes back to.

The trie is dealt out by prefixes: a prefix with more words than a shard may hold is open, and the shortest prefixes that are not open are the shards.
Inside a shard each trie node carries its active nodes, those at distance 0 or 1, down to its children; a word's end that meets another's end at
distance 1 is a pair. Two words of different shards part at an open node, and behind that place they agree to the end: active nodes at distance 1
go on by equal letters alone. So words that part at an open node meet by (node, rest of the word), at most one for each letter of the alphabet.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import materialize, table

SQL: dict[str, str] = {}
#: Distinct words that a task holds before it sends on their counts.
HELD = 200_000
#: Open prefixes that the driver holds at most; shards grow beyond their size before there are more.
OPEN = 100_000
_END = "\0"


def word_counts(docs: DataFrame, shortest: int = 6, every: int = 199) -> DataFrame:
    """word, n: runs of letters a-z and U+00C0 to U+00FF after lower-casing A-Z, of `shortest` code points or more, over whole texts.

    Where `every` divides h, the crc32 of "<doc_id>:<run>", the run loses its code point h % length. Null texts have none, a null doc_id is the empty text.
    Counts are summed up in each task first, so a frequent word is a row for each task.
    """
    find = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not (text := text.as_py()):
                    continue
                begun = zlib.crc32(f"{'' if i is None else i}:".encode())
                # of bytes, lower() is of A-Z alone
                for w, n in Counter(find(text.encode("utf-8", "replace").lower().decode())).items():
                    h = zlib.crc32(w.encode(), begun)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < shortest:
                            continue
                    held[w] += n
                if len(held) >= HELD:
                    yield sums()
        if held:
            yield sums()

    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def open_prefixes(words: DataFrame, shard_words: int) -> set[str]:
    """The prefixes (the empty one among them) of which more than shard_words words are left; the words below them alone are counted one letter further."""
    found: set[str] = set()
    layer = {""} if words.count() > shard_words else set()
    depth = 0
    while layer:
        found |= layer
        depth += 1
        above, d = layer, depth

        def tell(batches: Iterator[pa.RecordBatch], above=above, d=d) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n = Counter(w[:d] for w in b.column(0).to_pylist() if w[: d - 1] in above and len(w) >= d)
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["prefix", "n"])

        many = words.select("word").mapInArrow(tell, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > shard_words)
        layer = {r.prefix for r in many.collect()}  # at most words * depth / shard_words, see near_pairs
    return found


def shard_of(word: str, opened: set[str]) -> str:
    """The shortest prefix that is not open, of the word and its end mark."""
    marked, i = word + _END, 0
    while marked[:i] in opened:
        i += 1
    return marked[:i]


def trie_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in words, both ways, of words at distance one: the trie is walked depth first, and each node's active nodes come from its parent's."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for place, word in enumerate(words):
        node = 0
        for c in word:
            down = children[node].get(c)
            if down is None:
                down = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = down
        ends[node] = place
    # active nodes at distance 0 are the node itself; those at distance 1 are listed
    stack = [(0, list(children[0].values()))]
    while stack:
        node, near = stack.pop()
        own = children[node]
        for c, child in own.items():
            active = {child_ for other in near if (child_ := children[other].get(c)) is not None}  # the same letter on
            active.add(node)  # c deleted
            active.update(own.values())  # c replaced
            active.update(children[child].values())  # a letter inserted after it
            active.discard(child)
            if ends[child] >= 0:
                for other in active:
                    if ends[other] >= 0:
                        yield ends[child], ends[other]
            stack.append((child, list(active)))


def near_pairs(vocabulary: DataFrame, shard_words: int = 2000) -> DataFrame:
    """word, near, near_n: each word of a vocabulary (word, n; words once each, none null) with each word that one inserted, deleted or replaced code point makes of it.

    The vocabulary should be a written table: it is read some times. A shard holds shard_words words, or more only where
    otherwise over OPEN prefixes would be open (two thousand million words); the number of pairs is that of the links, no other pairs are made.
    """
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    size = max(shard_words, 10 * total // OPEN)
    opened = spark.sparkContext.broadcast(open_prefixes(vocabulary, size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([shard_of(w, opened.value) for w in words], pa.string()), b.column(0), b.column(1)], ["shard", "word", "n"])

    def inside(shard: pa.Table) -> pa.Table:
        words, n = shard.column("word").to_pylist(), shard.column("n").to_pylist()
        pairs = list(trie_pairs(words))
        return pa.table({"word": pa.array([words[i] for i, _ in pairs], pa.string()), "near": pa.array([words[j] for _, j in pairs], pa.string()), "near_n": pa.array([n[j] for _, j in pairs], pa.int64())})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A word at each open node on its way: what stands behind the next letter, and what stands from the node on (letter: null)."""
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i in range(len(shard_of(w, opened.value))):
                    rows.append((w[:i], w[i:], None, w, n))
                    if i < len(w):
                        rows.append((w[:i], w[i + 1 :], w[i], w, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.int64()])] if rows else [pa.array([], t) for t in [pa.string()] * 4 + [pa.int64()]], ["node", "rest", "letter", "word", "n"])

    columns = vocabulary.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    low = columns.mapInArrow(deal, "shard string, word string, n long").groupBy("shard").applyInArrow(inside, "word string, near string, near_n long")
    met = columns.mapInArrow(part, "node string, rest string, letter string, word string, n long").groupBy("node", "rest").agg(F.collect_list(F.struct("letter", "word", "n")).alias("xs")).where(F.size("xs") > 1)
    one = met.select("rest", "xs", F.explode("xs").alias("x"))
    # a letter before the same letter may be inserted at several places: the last of them counts, where the rest goes on with another letter
    parts = lambda a, b: (a["word"] != b["word"]) & (F.coalesce(a["letter"], F.substring("rest", 1, 1)) != F.coalesce(b["letter"], F.substring("rest", 1, 1)))
    high = one.select(F.col("x.word").alias("word"), F.explode(F.filter("xs", lambda y: parts(F.col("x"), y))).alias("y")).select("word", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    return low.unionByName(high)


def variant_groups(vocabulary: DataFrame, times: int = 5, shard_words: int = 2000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a vocabulary (word, n).

    form: of the words at distance one that with the largest n (ties: the smallest in code-point order), if that is at least `times` its own (2 or more), else null;
    root: the last word that forms lead to, the word itself if none. n grows by `times` with each step, so ways are short: they are halved a fixed number of times.
    """
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    links = near_pairs(vocabulary, shard_words)
    # the largest n, then the smallest word: UTF-8 has the order of code points
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
    j = vocabulary.join(best, "word", "left").withColumn("takes", -F.col("b.less") >= times * F.col("n"))
    out = materialize(j.select("word", F.when(F.col("takes"), F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("takes"), -F.col("b.less")).alias("form_n")), "forms")
    ways = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = out.agg(F.max("n")).first()[0] or 1
    for k in range(math.ceil(math.log2(1 + math.log(max(most, times), times)))):
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("then"))
        ways = materialize(ways.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root")), f"roots-{k}")
    return out.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(word_counts(table(spark, sf_dir, "documents")).where("n >= 5"))
