"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from gazette.llm import spelling

SF = "/root/testdata/sf0.001"


def near_words(vocabulary):
    letters, out = set("".join(vocabulary)), {}
    for w in vocabulary:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for a in letters}
        out[w] = (made & vocabulary.keys()) - {w}
    return out


def grouped(vocabulary):
    near, form, rows = near_words(vocabulary), {}, set()
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 5 * n else None
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return rows


def counted(rows):
    found = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                found[w] += 1
    return found


def test_pairs_inside_a_trie():
    rng = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        near = near_words(dict.fromkeys(words, 1))
        pairs = [(words[i], words[j]) for i, j in spelling.trie_pairs(words)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, x) for w in words for x in near[w]}


@pytest.mark.parametrize("shard_words", [3, 60, 5000])
def test_groups_at_any_shard_size(spark, shard_words):
    """Few letters, so that letters repeat and prefixes are words; most words begin alike, and counts tie."""
    rng, vocabulary = random.Random(7), {}
    while len(vocabulary) < 500:
        w = ("aab" if rng.random() < 0.5 else "") + "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        vocabulary[w] = rng.choice([5, 5, 30, 200, int(5 * 10 ** rng.uniform(0, 6))])
    got = [tuple(r) for r in spelling.variant_groups(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), shard_words=shard_words).collect()]
    assert len(got) == len(vocabulary) and set(got) == grouped(vocabulary)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_open_prefixes(spark):
    words = spark.createDataFrame([(f"pre{i:03d}",) for i in range(100)] + [("x",), ("pre",)], "word string")
    opened = spelling.open_prefixes(words, 20)
    assert opened == {"", "p", "pr", "pre", "pre0"}
    assert spelling.shard_of("pre", opened) == "pre\0" and spelling.shard_of("pre012", opened) == "pre01" and spelling.shard_of("x", opened) == "x"
    assert spelling.open_prefixes(words.limit(0), 20) == set()


def test_counts_and_odd_rows(spark):
    rows = [(None, "Straße Straße naïveté"), (1, None), (1, ""), (2, " 12 -- "), (3, "ABCDEFÀ abcdefÀ abcdefà"), (3, "ABCDEFÀ"), (4, "wörter×wörter " * 20_000), *[(i, "spelling colour") for i in range(10, 500)]]
    docs = spark.createDataFrame([(i, t, 7, "w") for i, t in rows], "doc_id long, text string, n long, word string")
    want = counted(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == want and want["wörter×wörter"] == 20_000 and len(want) >= 8
    none = docs.limit(0)
    assert spelling.word_counts(none).count() == 0 and spelling.variant_groups(spelling.word_counts(none)).count() == 0


def test_query_against_brute_force(spark):
    got = [tuple(r) for r in spelling.op13_spelling_variants(spark, SF).collect()]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = grouped({w: n for w, n in counted(rows).items() if n >= 5})
    assert len(got) == len(want) > 500 and set(got) == want
