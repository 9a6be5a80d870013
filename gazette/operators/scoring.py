"""Scores of impression candidates: BM25, cosine to history vectors, attention, blends."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazette.functions.stem import stems
from gazette.functions.text import tokens
from gazette.functions.vectors import dot, normalize, weighted_sum
from gazette.operators.impressions import history_rows
from gazette.operators.reuse import reused, small

if TYPE_CHECKING:
    import pyarrow as pa

def imp():
    """A window over each impression."""
    return Window.partitionBy("impression_id")
K1, B = 1.5, 0.75
#: Keeps scores that lie between two rounded values from falling to either side by the order of a sum.
TINY = 1e-9
#: Terms (some 60 bytes each) up to which their weights are broadcast; queries, vectors and articles to a block of a search.
BROADCAST_TERMS, QUERY_BLOCK, VECTOR_BLOCK, ARTICLE_BLOCK = 1_000_000, 2048, 8192, 4096


def corpus(articles: DataFrame, lang: str = "en", stopwords: bool = False, stem: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tf: article_id, term, tf, dl), (idf: term, df, idf), (stats: n, avgdl). Negative idf becomes a quarter of the mean.

    Texts are cut into tokens once and counted where they lie, so tokens are not shuffled; df, stats and both sides of a score read the counts.
    An article is one row. stem: terms become their stems, after stop words went.
    """
    held = _term_counts(articles.select("article_id", tokens(F.col("cleaned_text"), lang, stopwords).alias("t")))
    if stem:
        held = reused(held, "plain-counts")
        stemmed = held.join(small(stems(held.where("term IS NOT NULL"), lang), BROADCAST_TERMS), "term", "left")
        held = stemmed.groupBy("article_id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    held = reused(held, "term-counts")
    stats = held.where("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    tf = held.where("term IS NOT NULL")
    idf = _idf(tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats)))
    return tf, idf, stats


def _idf(df: DataFrame) -> DataFrame:
    """term, df, idf of rows (term, df, n: articles in all); negative idf becomes a quarter of the mean."""
    raw = df.select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _term_counts(docs: DataFrame) -> DataFrame:
    """article_id, dl, term, tf of rows (article_id, t: tokens); a row without a term stands for each article, so that those without tokens count."""
    import numpy as np
    import pyarrow as pa

    names = ["article_id", "dl", "term", "tf"]

    def some(ids: pa.Array, t: pa.Array) -> pa.RecordBatch:
        size = np.diff(t.offsets.to_numpy())
        coded = t.flatten().dictionary_encode()
        key, n = np.unique(np.repeat(np.arange(len(size)), size) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(key, max(len(coded.dictionary), 1))
        all_ = np.arange(len(size))
        owner = np.concatenate([all_, row])
        terms = pa.concat_arrays([pa.nulls(len(size), pa.string()), coded.dictionary.take(pa.array(term)).cast(pa.string())])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(size[owner].astype(np.int32)), terms, pa.array(np.concatenate([np.ones(len(size), np.int64), n]))], names)

    def run(batches):
        for b in batches:
            ids, t = b.column("article_id"), b.column("t")
            ends, i = np.cumsum(np.diff(t.offsets.to_numpy())), 0
            while i < b.num_rows:  # some million tokens at once
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2_000_000, "right")))
                yield some(ids[i:j], t[i:j])
                i = j

    kind = docs.schema["article_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"article_id {kind}, dl int, term string, tf long")


def weights(articles: DataFrame, lang: str = "en", stopwords: bool = False, k1: float = K1, b: float = B, stem: bool = False, only: DataFrame | None = None) -> DataFrame:
    """article_id, term, tf, w: what each term of an article adds to a score, by its frequency there. only: the articles (article_id) to give, where they are few enough to be sent to the tasks."""
    tf, idf, stats = corpus(articles, lang, stopwords, stem)
    if only is not None and only.count() <= BROADCAST_TERMS:
        tf = tf.join(F.broadcast(only), "article_id", "left_semi")
    joined = tf.join(small(idf, BROADCAST_TERMS), "term").join(F.broadcast(stats))  # one row
    return joined.select("article_id", "term", "tf", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("w"))


def _grid(held: DataFrame, asked: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """asked and held dealt into a grid: what stands in row r of the first meets what stands in column c of the second in cell (r, c)."""
    hash_, span = F.xxhash64("article_id"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return asked.withColumn("row", F.pmod(hash_, F.lit(rows))).withColumn("column", span(columns)), held.withColumn("column", F.pmod(hash_, F.lit(columns))).withColumn("row", span(rows))


def _blocks(spark, asked: int, held: int, query_block: int, block: int) -> tuple[int, int]:
    """Rows and columns of a grid of bounded blocks, with a cell for every core where there is enough to do."""
    rows = max(1, -(-asked // query_block))
    return rows, max(1, -(-held // block), min(-(-spark.sparkContext.defaultParallelism // rows), held // 64))


_FOUND = "query_id long, article_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def _columns(*arrays) -> bytes:
    """Arrays as one compressed value, byte by byte, so that small numbers take little."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays)
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _arrays(blob: bytes, *kinds: str) -> list:
    """What _columns() packed."""
    import numpy as np
    import pyarrow as pa

    head = 8 * (len(kinds) + 1)
    size, *lengths = np.frombuffer(blob[:head], np.int64).tolist()
    raw, at, out = np.frombuffer(pa.decompress(blob[head:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8), 0, []
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _block(terms, ids, dl, df, place, *more) -> bytes:
    """A block of a search: ids and lengths by place; for each term (a string array) df rows of place and more, by place."""
    import numpy as np

    size = np.diff(np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]) if len(terms) else np.empty(0, np.int32)
    text = np.frombuffer("".join(terms.to_pylist()).encode(), np.uint8)
    return _columns(text, size.astype(np.int32), ids, dl.astype(np.int32), df.astype(np.int32), place.astype(np.int32), *more)


def _unblock(blob: bytes, *more: str) -> tuple:
    import numpy as np
    import pyarrow as pa

    text, size, *rest = _arrays(blob, "u1", "i4", "i8", "i4", "i4", "i4", *more)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes())), *rest


def _article_block(ids: pa.Array, t: pa.Array) -> pa.RecordBatch:
    """One row: n articles, tokens, the distinct terms, how many of the articles have each, and the block."""
    import numpy as np
    import pyarrow as pa

    ids = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    rank = np.argsort(order, kind="stable")
    size = np.diff(t.offsets.to_numpy())
    coded = t.flatten().dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(rank, size), return_counts=True)
    term, place = np.divmod(key, len(ids))
    df = np.bincount(term, minlength=len(terms))
    data = _block(terms, ids[order], size[order], df, place, tf.astype(np.int32))
    cols = [pa.array([len(ids)], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms), pa.array([df], pa.list_(pa.int64())), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["n", "tokens", "terms", "dfs", "data"])


_BLOCK = "n long, tokens long, terms array<string>, dfs array<long>, data binary"


def _article_blocks(docs: DataFrame, block: int) -> DataFrame:
    """Blocks of at most so many rows (article_id, t: tokens), and of some million tokens, cut where the rows lie."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held, rows, size = [], 0, 0
        for b in batches:
            ids, t = b.column("article_id"), b.column("t")
            ends, i = np.cumsum(np.diff(t.offsets.to_numpy())), 0
            while i < b.num_rows:
                before = ends[i - 1] if i else 0
                j = min(i + block - rows, max(i + (rows == 0), int(np.searchsorted(ends, before + 2_000_000 - size, "right"))))
                if j > i:
                    held.append((ids[i:j], t[i:j]))
                    rows, size = rows + j - i, size + int(ends[j - 1] - before)
                if rows == block or j < b.num_rows:
                    yield _article_block(*map(pa.concat_arrays, zip(*held, strict=True)))
                    held, rows, size = [], 0, 0
                i = j
        if held:
            yield _article_block(*map(pa.concat_arrays, zip(*held, strict=True)))

    return docs.mapInArrow(run, _BLOCK)


def _query_blocks(asked: DataFrame, rows: int) -> DataFrame:
    """data: blocks of queries, from rows (article_id, term, tf, idf)."""
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        coded = t.column("term").combine_chunks().dictionary_encode()
        ids, place = np.unique(t.column("article_id").to_numpy(), return_inverse=True)
        of = coded.indices.to_numpy()
        order = np.lexsort((place, of))
        df = np.bincount(of, minlength=len(coded.dictionary))
        tf, idf = t.column("tf").to_numpy()[order], t.column("idf").to_numpy()[order]
        first = np.cumsum(df) - df
        data = _block(coded.dictionary, ids, np.zeros(len(ids)), df, place[order], tf.astype(np.int32), idf[first])
        return pa.table({"data": pa.array([data], pa.binary())})

    return asked.groupBy(F.pmod(F.xxhash64("article_id"), F.lit(rows)).alias("row")).applyInArrow(run, "data binary")


def _products(n: tuple[int, int], df, place, value):
    """A function of (low, high): the matrix of sums over terms of what queries low to high and all articles of a block have.

    df, place, value: pairs (queries, articles) of the common terms' counts, and of the places and values of their rows, term by term. Terms
    that many on both sides have are multiplied as matrices, the others product by product.
    """
    import numpy as np

    many = df[0].astype(np.int64) * df[1]
    dense = np.argsort(-many, kind="stable")[:1024]
    dense = dense[many[dense] * 100 > n[0] * n[1]]
    column = np.full(len(many), -1)
    column[dense] = np.arange(len(dense))
    term = [np.repeat(np.arange(len(x)), x) for x in df]
    both = [column[x] >= 0 for x in term]
    wide = [np.zeros((len(dense), m)) for m in n]
    for w, c, p, v, x in zip(wide, term, place, value, both, strict=True):
        w[column[c[x]], p[x]] = v[x]
    (tq, ta), (pq, pa_), (vq, va) = (tuple(c[~x] for c, x in zip(cols, both, strict=True)) for cols in (term, place, value))

    def part(low: int, high: int):
        s = wide[0][:, low:high].T @ wide[1]
        mine = np.flatnonzero((pq >= low) & (pq < high))  # by term
        count = np.bincount(tq[mine], minlength=len(many))
        start = np.cumsum(count) - count
        here = np.flatnonzero(count[ta])
        reps = count[ta[here]]
        upto = np.concatenate([[0], np.cumsum(reps)])
        flat, row, weight = s.reshape(-1), (pq[mine] - low).astype(np.int64) * n[1], vq[mine]
        i = 0
        while i < len(here):  # some million products at once
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + 1_000_000, "right")) - 1)
            each = np.repeat(here[i:j], reps[i:j])
            q = np.arange(len(each)) + np.repeat(start[ta[here[i:j]]] - (upto[i:j] - upto[i]), reps[i:j])
            np.add.at(flat, row[q] + pa_[each], weight[q] * va[each])
            i = j
        return s

    return part


def _cell(asked: tuple, held: tuple, k: int, avgdl: float, k1: float = K1, b: float = B) -> tuple:
    """Query ids, article ids and scores: the best k of a block of articles for each query of a block."""
    import numpy as np
    import pyarrow.compute as pc

    (terms, ids, _, qdf, qplace, qtf, idf), (other, own, dl, adf, aplace, atf) = asked, held
    at = pc.fill_null(pc.index_in(terms, value_set=other), -1).to_numpy()
    common = np.flatnonzero(at >= 0)

    def rows(df, which):
        """The rows of some terms, in their order."""
        n, start = df[which], (np.cumsum(df) - df)[which]
        return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)

    rq, ra = rows(qdf, common), rows(adf, at[common])
    tf = atf[ra].astype(np.float64)
    v, w = qtf[rq] * np.repeat(idf[common], qdf[common]), tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[aplace[ra]] / avgdl))
    n, df, place = (len(ids), len(own)), (qdf[common], adf[at[common]]), (qplace[rq], aplace[ra])
    part = _products(n, df, place, (v, w))
    # weights above zero tell by the sum which pairs have a common term
    met = None if not len(v) or v.min() > 0 else _products(n, df, place, (np.ones(len(v)), np.ones(len(w))))
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])  # rows that repeat an id count as one article
    out = []
    for low in range(0, len(ids), 512):
        s = part(low, low + 512)
        hit = (s if met is None else met(low, low + 512)) > 0
        if len(first) < len(own):
            s, hit = np.add.reduceat(s, first, 1), np.logical_or.reduceat(hit, first, 1)
        s = np.where(hit, np.round(s + TINY, 4), -np.inf)
        least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k, None] if s.shape[1] > k else -np.inf
        r, c = np.nonzero(hit & (s >= least))
        score = s[r, c]
        order = np.lexsort((c, -score, r))  # of equal scores the least id
        r, c, score = r[order], c[order], score[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((ids[low + r[best]], own[first[c[best]]], score[best]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def search_bm25(articles: DataFrame, queries: Column, k: int = 20, lang: str = "en", stopwords: bool = False) -> DataFrame:
    """query_id, article_id, score, rank: the best k of all articles for the text of each article that queries picks.

    Articles are packed into blocks where they lie, and queries, with what their terms weigh, into a few others. Each block of articles meets
    each of queries as the tasks read both from the written tables: neither is copied into a shuffle, so that disk grows with the texts and
    not with the pairs of blocks. A pair has all terms of its articles, so it sums whole scores and sends on its best k
    for each query. Nothing passes through the driver but counts. Rows that repeat an article_id count as one article, whose scores are added.
    """
    import numpy as np
    import pyarrow as pa

    none = 2**63 - 1  # stands for a null id, which comes last among equal scores
    docs = articles.select(F.coalesce(F.col("article_id").cast("long"), F.lit(none)).alias("article_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col("article_id").isNull().alias("null"), tokens(F.col("cleaned_text"), lang, stopwords).alias("t"))
    met = docs.groupBy("article_id").agg(F.count("*").alias("times"), F.max("asks").alias("asks"), F.max("null").alias("null"))
    n = met.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks"), F.count_if("null").alias("null"), F.count_if(F.col("times") > 1).alias("again"), F.sum("times").alias("rows")).first()
    block = max(1, min(ARTICLE_BLOCK, max(64, -(-n["all"] // docs.sparkSession.sparkContext.defaultParallelism))))
    once = docs.select("article_id", "t")
    if n["again"]:
        again = small(met.where("times > 1").select("article_id"), BROADCAST_TERMS)
        grouped = once.join(again, "article_id", "left_semi").groupBy(F.pmod(F.xxhash64("article_id"), F.lit(-(-n["rows"] // ARTICLE_BLOCK))))

        def whole(t: pa.Table) -> pa.Table:
            ids, texts = t.select(["article_id", "t"]).combine_chunks().columns
            return pa.Table.from_batches([_article_block(ids.combine_chunks(), texts.combine_chunks())])

        once = once.join(again, "article_id", "left_anti")
        held = _article_blocks(once, block).unionByName(grouped.applyInArrow(whole, _BLOCK))
    else:
        held = _article_blocks(once, block)
    held = reused(held, "article-blocks", rows=1)
    total = held.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    df = held.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).groupBy("e.terms").agg(F.sum("e.dfs").alias("df")).withColumnRenamed("terms", "term")
    idf = reused(_idf(df.withColumn("n", F.lit(total["n"] or 0))), "term-weights")
    counted = _term_counts(docs.where("asks").select("article_id", "t")).where("term IS NOT NULL").groupBy("article_id", "term").agg(F.sum("tf").alias("tf"))
    asked = counted.join(small(idf.select("term", "idf"), BROADCAST_TERMS), "term")
    asked = reused(_query_blocks(asked, max(1, -(-n["asks"] // QUERY_BLOCK))), "query-blocks", rows=1)
    avgdl = total["tokens"] / total["n"] if total["tokens"] else 1.0

    def run(batches):
        last = one = None
        for b in batches:
            for held, asked in zip(b.column("held"), b.column("asked"), strict=True):
                held = held.as_py()
                if held != last:  # one block of articles meets some of queries in a row
                    last, one = held, _unblock(held, "i4")
                q, a, s = _cell(_unblock(asked.as_py(), "i4", "f8"), one, k, avgdl)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(a), pa.array(s)], ["query_id", "article_id", "score"])

    pairs = held.select(F.col("data").alias("held")).crossJoin(asked.select(F.col("data").alias("asked")).hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(run, _FOUND)
    if n["null"]:
        return _best(found, k).withColumn("article_id", F.expr(f"nullif(article_id, {none})"))
    return _best(found, k)


def search_vectors(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, article_id, score, rank: the best k of all vectors by inner product, for each vector that queries picks.

    The same grid: its plan does not grow with the number of queries, and a cell sends on at most k rows for each of its queries.
    """
    import numpy as np
    import pyarrow as pa

    v = reused(vectors.where("vec IS NOT NULL").select(F.col("article_id").cast("long").alias("article_id"), "vec", F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    n = v.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks")).first()
    rows, columns = _blocks(v.sparkSession, n["asks"], n["all"], QUERY_BLOCK, VECTOR_BLOCK)
    asked, held = _grid(v.select("article_id", "vec"), v.where("asks").select("article_id", "vec"), rows, columns)
    schema = pa.schema([("query_id", pa.int64()), ("article_id", pa.int64()), ("score", pa.float64())])

    def matrix(t: pa.Table):
        ids = t.column("article_id").to_numpy()
        return ids, t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)

    def cell(one: pa.Table, other: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and other.num_rows:
            (ids, q), (own, x) = matrix(one), matrix(other)
            by = np.argsort(own, kind="stable")  # of equal scores the least id
            own, x = own[by], x[by]
            for i in range(0, len(ids), 256):
                s = np.round(q[i : i + 256] @ x.T + TINY, 6)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out.append(pa.table([np.repeat(ids[i : i + 256], top.shape[1]), own[top].ravel(), np.take_along_axis(s, top, 1).ravel()], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return _best(asked.groupBy("row", "column").cogroup(held.groupBy("row", "column")).applyInArrow(cell, _FOUND), k)


def recency_weight(clicked_at: Column, ts: Column, days: float = 7.0) -> Column:
    """exp(-age / days), no age under zero; a click without a time weighs 1."""
    age = F.greatest(F.unix_micros(ts.cast("timestamp")) - F.unix_micros(clicked_at.cast("timestamp")), F.lit(0)) / 1e6
    return F.coalesce(F.when(clicked_at.isNotNull(), F.exp(-age / (days * 86400))), F.lit(1.0))


def bm25(cand: DataFrame, histories: DataFrame, articles: DataFrame, lang: str = "en", stopwords: bool = False, k1: float = K1, b: float = B, stem: bool = False) -> DataFrame:
    """cand with score: BM25 of each candidate for its history's texts as query, terms with multiplicity.

    The score is a sum over history articles, so each pair of (history, candidate) articles that occurs is
    scored once, and impressions only add up pair scores: the term joins grow with pairs of articles, not with impressions.
    """
    h = history_rows(histories).groupBy("impression_id", F.col("article_id").alias("h")).agg(F.count("*").alias("times"))
    met = cand.select("impression_id", "article_id").distinct().join(h, "impression_id")
    pairs = reused(met.select("h", "article_id").distinct(), "article-pairs")
    # the whole corpus tells what a term weighs, but only these articles are scored
    weight = weights(articles, lang, stopwords, k1, b, stem, pairs.select(F.explode(F.array("h", "article_id")).alias("article_id")).distinct())
    query = weight.select(F.col("article_id").alias("h"), "term", F.col("tf").alias("qtf"))
    scored = pairs.join(query, "h").join(weight.select("article_id", "term", "w"), ["article_id", "term"]).groupBy("h", "article_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("s"))
    total = met.join(scored, ["h", "article_id"]).groupBy("impression_id", "article_id").agg(F.sum(F.col("times") * F.col("s")).alias("s"))
    # scores that are not positive count as none
    score = F.round(F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) + TINY, 4)
    return cand.join(total, ["impression_id", "article_id"], "left").withColumn("score", score).drop("s")


def user_vectors(histories: DataFrame, vectors: DataFrame, decay: float | None = None) -> DataFrame:
    """impression_id, u: unit mean of the history's vectors; decay weighs each by decay ** (how many are later). Articles without one are left out."""
    h = history_rows(histories).join(vectors, "article_id")
    w = F.lit(1.0) if decay is None else F.pow(F.lit(float(decay)), F.col("back") - 1)
    items = h.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("back", w.alias("w"), "vec"))).alias("items"))
    items = items.select("impression_id", "items", F.aggregate("items", F.lit(0.0), lambda s, e: s + e["w"]).alias("total"))
    mean = items.select("impression_id", F.col("total"), weighted_sum(F.col("items"), "vec", "w").alias("v"))
    mean = mean.select("impression_id", F.transform("v", lambda x: x / F.col("total")).alias("v"))
    return mean.select("impression_id", normalize(F.col("v")).alias("u"))


def cosine(cand: DataFrame, users: DataFrame, vectors: DataFrame) -> DataFrame:
    """cand with score; 0 without a history or a vector."""
    joined = cand.join(users, "impression_id", "left").join(vectors, "article_id", "left")
    score = F.round(F.coalesce(dot(F.col("u"), F.col("vec")), F.lit(0.0)), 6)
    return joined.withColumn("score", score).drop("u", "vec")


def attention(cand: DataFrame, histories: DataFrame, vectors: DataFrame, temperature: float = 0.2) -> DataFrame:
    """cand with score: each candidate attends over the history (softmax of dot products), then its dot product with the unit mean.

    An impression's history and candidates stand in one row: a matrix product each way scores all of its candidates.
    """
    import numpy as np
    import pyarrow as pa

    from gazette.operators.encoder import lists, packed

    def run(batches):
        for b in batches:
            (h, ho), (c, co), (has, lo), (where, _) = (lists(b, x) for x in ("hist", "cands", "has", "pos"))
            has, sizes = has.astype(bool), np.diff(lo)
            found, out = np.concatenate([[0], np.cumsum(has)]), np.zeros(len(has))
            for i in range(b.num_rows):
                m, n = found[lo[i + 1]] - found[lo[i]], ho[i + 1] - ho[i]
                if m and n:
                    x = c[co[i] : co[i + 1]].reshape(m, -1).astype(np.float64)
                    y = h[ho[i] : ho[i + 1]].reshape(-1, x.shape[1]).astype(np.float64)
                    d = x @ y.T
                    u = np.exp((d - d.max(1, keepdims=True)) / temperature) @ y
                    norm = np.linalg.norm(u, axis=1)
                    out[np.flatnonzero(has[lo[i] : lo[i + 1]]) + lo[i]] = np.einsum("ij,ij->i", u, x) / np.where(norm == 0, 1, norm)
            yield pa.RecordBatch.from_arrays([b.column("impression_id").take(pa.array(np.repeat(np.arange(b.num_rows), sizes))), pa.array(where), pa.array(np.round(out, 6))], ["impression_id", "pos", "score"])

    kind = {f.name: f.dataType.simpleString() for f in cand.schema}
    scores = packed(cand, histories, vectors).select("impression_id", "hist", "cands", "has", "pos").mapInArrow(run, f"impression_id {kind['impression_id']}, pos {kind['pos']}, score double")
    return cand.join(scores, ["impression_id", "pos"])


def minmax(x: Column) -> Column:
    """Within an impression; no range gives 0."""
    lo, hi = F.min(x).over(imp()), F.max(x).over(imp())
    return F.when(hi - lo < 1e-12, 0.0).otherwise((x - lo) / F.when(hi - lo < 1e-12, 1.0).otherwise(hi - lo))


def rank_percent(x: Column) -> Column:
    """1 for the best of an impression, 0 for the last, ties by position."""
    r = F.row_number().over(imp().orderBy(x.asc(), F.col("pos").desc()))
    return (r - 1) / F.greatest(F.count("*").over(imp()) - 1, F.lit(1))


def blend(scored: DataFrame, one: str, other: str, share: float) -> DataFrame:
    """score = share * minmax(one) + (1 - share) * minmax(other)."""
    return scored.withColumn("score", F.round(share * minmax(F.col(one)) + (1 - share) * minmax(F.col(other)) + TINY, 6))


def category_signal(cand: DataFrame, histories: DataFrame, articles: DataFrame) -> DataFrame:
    """cand with signal: half the min-max of each of P(category) and P(subcategory) in the history; a missing one matches a missing one."""
    kinds = articles.select("article_id", F.coalesce("category", F.lit("")).alias("cat"), F.coalesce("subcategory", F.lit("")).alias("sub"))
    h = history_rows(histories).join(kinds, "article_id", "left").select("impression_id", F.coalesce("cat", F.lit("")).alias("cat"), F.coalesce("sub", F.lit("")).alias("sub"))
    total = h.groupBy("impression_id").agg(F.count("*").alias("n"))
    share = lambda c: h.groupBy("impression_id", c).agg(F.count("*").alias("m")).join(total, "impression_id").select("impression_id", c, (F.col("m") / F.col("n")).alias(f"p_{c}"))
    j = cand.join(kinds, "article_id", "left").fillna("", ["cat", "sub"]).join(share("cat"), ["impression_id", "cat"], "left").join(share("sub"), ["impression_id", "sub"], "left").fillna(0.0, ["p_cat", "p_sub"])
    return j.withColumn("signal", 0.5 * minmax(F.col("p_cat")) + 0.5 * minmax(F.col("p_sub"))).drop("cat", "sub", "p_cat", "p_sub")


def proxy_signal(ranked: DataFrame, articles: DataFrame, top: int = 5) -> DataFrame:
    """As category_signal, with the best-ranked candidates in place of the history."""
    kinds = articles.select("article_id", F.coalesce("category", F.lit("")).alias("cat"))
    j = ranked.join(kinds, "article_id", "left").fillna("", ["cat"])
    best = F.sum((F.col("rank") <= top).cast("int"))
    p = best.over(Window.partitionBy("impression_id", "cat")) / best.over(imp())
    return j.withColumn("signal", minmax(p)).drop("cat")


def rank(scored: DataFrame, order: str = "pos", out: str = "rank") -> DataFrame:
    """1 for the best score; ties by candidate position (pos) or by article id as text (id)."""
    tie = F.col("pos") if order == "pos" else F.col("article_id").cast("string")
    return scored.withColumn(out, F.row_number().over(imp().orderBy(F.col("score").desc(), tie)))


def top_k(scored: DataFrame, k: int = 200, order: str = "pos") -> DataFrame:
    """The best k of each impression; ranks beyond k end before the shuffle."""
    return rank(scored, order).where(F.col("rank") <= k)


def cut_and_append(scored: DataFrame, k: int = 200, order: str = "pos") -> DataFrame:
    """The best k of each impression, and after them the others in the order of candidates with score 0: every candidate keeps a rank."""
    kept = top_k(scored, k, order)
    rest = scored.join(kept.select("impression_id", "pos"), ["impression_id", "pos"], "left_anti")
    after = F.row_number().over(imp().orderBy("pos"))
    # only impressions with more than k candidates have others, so k is the number of those before
    return kept.unionByName(rest.withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(k) + after))


def combiner_features(scored: DataFrame, one: str, other: str) -> DataFrame:
    """Five features of the learned blend: both scores' min-max and rank percentile, and the difference."""
    a, b = minmax(F.col(one)), minmax(F.col(other))
    return scored.withColumns({"f1": a, "f2": b, "f3": rank_percent(F.col(one)), "f4": rank_percent(F.col(other)), "f5": a - b})
