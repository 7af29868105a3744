"""Batch hybrid retrieval: dense and keyword search, reranking, fusion, diversification and confidence.

Queries are a DataFrame, and each step keeps an explicit rank. Searches hold every query against all rows in one pass:
the queries of a block are broadcast, each task keeps its own best k of each query, and only these are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators.catalog import first_per_group, ranked
from corpusmill.session import materialize

#: Queries are broadcast in blocks of so many vectors.
QUERY_BLOCK = 2048
#: Sets of words are broadcast in blocks of so many.
WORDS_BLOCK = 16_384
_SLICE, _GROUP = 4096, 128


def hash_embedding(value: Column, dimensions: int = 384) -> Column:
    """A vector of unit length from the bytes of the text's SHA-256, repeated; no model is needed."""
    numbers = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") / 127.5 - 1.0)
    repeated = lambda v: F.slice(F.flatten(F.array_repeat(v, -(-dimensions // 32))), 1, dimensions)
    return scores.normalized(scores.once(scores.once(F.sha2(F.coalesce(value, F.lit("")), 256), numbers), repeated))


def vector_matrix(lists: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow list column at length 1; one that is null, of another size or of length 0 is all zero."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    data = np.zeros((len(lists), size))
    fits = lengths == size
    if size and fits.any():
        values = lists.filter(pa.array(fits)).flatten().fill_null(0).to_numpy(zero_copy_only=False)
        data[fits] = values.reshape(-1, size)
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    return np.divide(data, norm, out=np.zeros_like(data), where=norm > 0)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK, apart: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest ``vectors`` (id, vector) of each of ``queries`` (query_id, vector)
    by cosine; exact; ties by id. A vector of another length than the query's, null or of length 0 is at cosine 0.

    Queries are sent out in blocks of at most ``block``; a block costs one pass over the vectors, and each task sends on
    k rows a query. ``apart`` names an integer column of both: only vectors with another value than the query's count.
    """
    spark = queries.sparkSession
    rows = queries.where("vector is not null").orderBy("query_id").toLocalIterator()
    out, part = None, []

    def search(own: list) -> DataFrame:
        groups = np.array([r[apart] for r in own], np.int64) if apart else None
        shared = spark.sparkContext.broadcast(([r.query_id for r in own], np.array([r.vector for r in own], np.float64), groups))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, own_group = shared.value
            lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
            best, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for low in range(0, batch.num_rows, _SLICE):
                    part_ = batch.slice(low, _SLICE)
                    keys, data = part_.column(0).to_numpy(), vector_matrix(part_.column(1), unit.shape[1])
                    similarity = np.round(unit @ data.T, 12)
                    if own_group is not None:
                        similarity[own_group[:, None] == part_.column(2).to_numpy()[None, :]] = -np.inf
                    value, key = np.concatenate([best, similarity], axis=1), np.concatenate([best_id, np.broadcast_to(keys, similarity.shape)], axis=1)
                    least = np.partition(value, -k, axis=1)[:, -k]
                    row, at = np.nonzero(value >= least[:, None])
                    order = np.lexsort((key[row, at], -value[row, at], row))
                    row, at = row[order], at[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, at, place = (x[place < k] for x in (row, at, place))
                    best[row, place], best_id[row, place] = value[row, at], key[row, at]
            found = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), found.sum(axis=1))), pa.array(best_id[found]), pa.array(best[found])], names=["query_id", "id", "score"])

        columns = [F.col("id").cast("long").alias("id"), F.col("vector"), *([F.coalesce(F.col(apart).cast("long"), F.lit(-(2**62))).alias("apart")] if apart else [])]
        return vectors.select(*columns).where("id is not null").mapInArrow(run, "query_id long, id long, score double")

    for row in rows:
        part.append(row)
        if len(part) == block:
            out, part = search(part) if out is None else out.unionByName(search(part)), []
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double")
    return ranked(out, ["query_id"], [F.desc("score"), F.asc("id")], "rank", k)


def nearest(vectors: DataFrame, centers: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, cluster, score) of ``vectors`` (id, vector): the one of ``centers`` (cluster, vector) at the greatest cosine,
    the lowest of equals. Centers are few by what they are; up to ``most`` are broadcast, more are an error."""
    rows = centers.select("cluster", "vector").orderBy("cluster").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centers")
    shared = vectors.sparkSession.sparkContext.broadcast(([r.cluster for r in rows], np.array([r.vector for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True) if len(names) else None
        for batch in batches:
            lists = batch.column(1).to_pylist()
            if not len(names):
                continue
            unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
            data = np.array([v if v is not None and len(v) == unit.shape[1] else np.zeros(unit.shape[1]) for v in lists], np.float64).reshape(len(lists), -1)
            size = np.linalg.norm(data, axis=1, keepdims=True)
            similarity = np.divide(data, size, out=np.zeros_like(data), where=size > 0) @ unit.T
            best = similarity.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[b] for b in best], pa.int64()), pa.array(similarity[np.arange(len(best)), best])], names=["id", "cluster", "score"])

    return vectors.select(F.col("id").cast("long"), "vector").where("id is not null").mapInArrow(run, "id long, cluster long, score double")


def with_fallback(strict: DataFrame, loose: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of ``strict``, and for keys without any there, those of ``loose``."""
    return strict.unionByName(loose.join(strict.select(key).distinct(), key, "left_anti"))


def word_candidates(queries: DataFrame, chunks: DataFrame, least: int) -> DataFrame:
    """(query_id, chunk_id, asked, wanted, found): chunks with the rarest of a query's words that any chunk has, how many
    words it asks for, how many of them any chunk has and how many this one. Words are of ``least`` characters or more.

    Only the rarest word's postings meet a query, by an equi-join; a common word multiplies nothing unless a query has no
    rarer one. Word counts are over all chunks. Ties between words go by the word.
    """
    asked = queries.select("query_id", text.terms(F.col("query"), least).alias("asked_words"))
    had = materialize(chunks.select("chunk_id", text.terms(F.col("text"), least).alias("chunk_words")), "chunk-words")
    postings = had.select("chunk_id", F.explode("chunk_words").alias("word"))
    frequency = postings.groupBy("word").agg(F.count("*").alias("n"))
    per_query = asked.select("query_id", F.explode("asked_words").alias("word")).join(frequency, "word", "left").groupBy("query_id").agg(
        F.min_by("word", F.when(F.col("n").isNotNull(), F.struct("n", "word"))).alias("word"), F.count("*").alias("asked"), F.count("n").alias("wanted")
    )
    pairs = postings.join(per_query.where("wanted > 0"), "word").drop("word")
    found = F.size(F.array_intersect("asked_words", "chunk_words")).cast("long")
    return pairs.join(asked, "query_id").join(had, "chunk_id").select("query_id", "chunk_id", "asked", "wanted", found.alias("found"))


def shared_words(queries: DataFrame, chunks: DataFrame, least: int, fewest: int = 2, most: int = 20, block: int = WORDS_BLOCK) -> DataFrame:
    """(query_id, id, n, rank) of ``queries`` (query_id, query) over ``chunks`` (chunk_id, text): the ``most`` chunks that
    have the most of a query's distinct words of ``least`` characters or more, ``fewest`` at the least; exact; ties by id.

    Queries with the same words are searched for once. Sets of words are sent out in blocks of at most ``block``; a block
    costs one pass over the chunks, and each task sends on ``most`` rows a set.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_sort(text.terms(F.col("query"), least)).alias("words")).where(F.size("words") >= fewest)
    sets = asked.groupBy("words").agg(F.min("query_id").alias("set_id"))
    had = chunks.select(F.col("chunk_id").cast("long").alias("id"), text.terms(F.col("text"), least).alias("words")).where("id is not null and words is not null")
    out, part = None, []

    def search(own: list) -> DataFrame:
        own = sorted(own, key=lambda r: (len(r.words), r.set_id))
        vocabulary = sorted({w for r in own for w in r.words})
        code = {w: i for i, w in enumerate(vocabulary)}
        shared = spark.sparkContext.broadcast(([r.set_id for r in own], vocabulary, [[code[w] for w in r.words] for r in own]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, known, wanted = shared.value
            best_n, best_id = np.zeros((len(keys), most), np.int64), np.full((len(keys), most), np.iinfo(np.int64).max)
            groups = []
            for first in range(0, len(keys), _GROUP):
                lists = wanted[first : first + _GROUP]
                groups.append((first, np.array([codes + [len(known)] * (len(lists[-1]) - len(codes)) for codes in lists])))
            for batch in batches:
                for low in range(0, batch.num_rows, _SLICE):
                    ids, lists = batch.column(0).slice(low, _SLICE).to_numpy(), batch.column(1).slice(low, _SLICE)
                    values = lists.flatten()
                    codes = pc.fill_null(pc.index_in(values, value_set=pa.array(known, values.type)), -1).to_numpy(zero_copy_only=False)
                    at = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
                    seen, row = np.unique(codes[codes >= 0], return_inverse=True)
                    has = np.zeros((len(seen) + 1, len(ids)), np.min_scalar_type(len(wanted[-1])))
                    has[row, at[codes >= 0]] = 1
                    place = np.full(len(known) + 1, len(seen))
                    place[seen] = np.arange(len(seen))
                    for first, padded in groups:
                        rows = place[padded]
                        n = has[rows[:, 0]]
                        for j in range(1, rows.shape[1]):
                            n += has[rows[:, j]]
                        last_n, last_id = best_n[first : first + len(n), -1:], best_id[first : first + len(n), -1:]
                        better = n >= np.maximum(last_n, fewest).astype(np.int32)
                        for q in np.flatnonzero(better.any(axis=1)).tolist():
                            new = np.flatnonzero(better[q])
                            new = new[(n[q, new] > last_n[q]) | (ids[new] < last_id[q])]
                            if len(new):
                                all_n, all_id = np.concatenate([best_n[first + q], n[q, new]]), np.concatenate([best_id[first + q], ids[new]])
                                order = np.lexsort((all_id, -all_n))[:most]
                                best_n[first + q], best_id[first + q] = all_n[order], all_id[order]
            found = best_n > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), found.sum(axis=1))), pa.array(best_id[found]), pa.array(best_n[found])], names=["set_id", "id", "n"])

        return had.mapInArrow(run, "set_id long, id long, n long")

    for row in sets.orderBy("set_id").toLocalIterator():
        part.append(row)
        if len(part) == block:
            out, part = search(part) if out is None else out.unionByName(search(part)), []
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    if out is None:
        out = spark.createDataFrame([], "set_id long, id long, n long")
    hits = ranked(out, ["set_id"], [F.desc("n"), F.asc("id")], "rank", most)
    return asked.join(sets, "words").select("query_id", "set_id").join(hits, "set_id").select("query_id", "id", "n", "rank")


def keyword_search(queries: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank) of ``queries`` (query_id, query) over ``chunks`` (chunk_id, sequence_no, text):
    chunks that have all the query's words, first chunks of documents first, then by id. A rank's score is .85 less .01
    for each place."""
    own = materialize(queries.select("query_id", F.array_sort(text.terms(F.col("query"), 2)).alias("words")), "query-words")
    sets = materialize(own.groupBy("words").agg(F.min("query_id").alias("set_id")), "word-sets")  # equal words are searched for once
    found = word_candidates(sets.select(F.col("set_id").alias("query_id"), F.array_join("words", " ").alias("query")), chunks, 2).where("found = asked")
    whole = found.join(chunks.select("chunk_id", "sequence_no"), "chunk_id").withColumn("later", F.when(F.col("sequence_no") == 0, 0).otherwise(1))
    best = ranked(whole, ["query_id"], [F.asc("later"), F.asc("chunk_id")], "rank", most).withColumnRenamed("query_id", "set_id")
    out = own.join(sets, "words").select("query_id", "set_id").join(best, "set_id")
    return out.select("query_id", "chunk_id", F.round(0.85 - 0.01 * (F.col("rank") - 1), 6).alias("score"), "rank")


def rerank(hits: DataFrame, locale: Column | str, now: Column, most: int) -> DataFrame:
    """``hits`` (query_id, query, id, url, title, text, language, fetched_at, score) reranked: the query's locale, the overlap of
    the query's words with text, title and address, and freshness count; an address once, at most ``most`` a query."""
    words = text.terms(F.col("query"), 3)
    bonus = (
        F.when(text.language_code(F.col("language")) == locale, 0.15).when(F.col("language").isNotNull(), -0.05).otherwise(0.0)
        + text.overlap(words, F.col("text")) * 0.2
        + text.overlap(words, F.col("title")) * 0.15
        + text.overlap(words, F.col("url")) * 0.1
        + scores.freshness_boost(F.col("fetched_at"), now)
    )
    scored = hits.withColumn("reranked", F.round(F.col("score") + bonus, 9)).withColumn("url_key", F.lower("url"))
    single = first_per_group(scored, ["query_id", "url_key"], [F.desc("reranked"), F.asc("id")])
    return ranked(single, ["query_id"], [F.desc("reranked"), F.asc("id")], "rank", most).drop("url_key")


def semantic_rerank(hits: DataFrame, queries: DataFrame, vectors: DataFrame, limit: int, weight: float = 0.35, least: int = 24) -> DataFrame:
    """(query_id, id, score, rank) of ``hits`` (query_id, id, score, rank): the foremost max(3 limit, least) hits gain
    ``weight`` times their cosine with the query; the others are dropped; at most ``limit`` a query."""
    few = hits.where(F.col("rank") <= max(3 * limit, least)).select("query_id", "id", "score")
    both = few.join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(vectors.select("id", F.col("vector").alias("v")), "id")
    scored = both.select("query_id", "id", F.round(F.col("score") + weight * scores.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.asc("id")], "rank", limit)


def fuse(lists: list[DataFrame], k: int = 60, most: int = 50) -> DataFrame:
    """Reciprocal rank fusion of ``lists`` (query_id, id, rank from 1): (query_id, id, score, n_lists, rank)."""
    union = None
    for own in lists:
        part = own.select("query_id", "id", scores.reciprocal_rank(F.col("rank"), k).alias("part"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("n_lists"))
    return ranked(fused, ["query_id"], [F.desc("score"), F.asc("id")], "rank", most)


def diversify(candidates: DataFrame, most: int, balance: float = 0.7) -> DataFrame:
    """(query_id, id, mmr, rank) of ``candidates`` (query_id, id, document_id, text, score), a bounded list for each
    query: greedy maximal marginal relevance, a document once. Words of up to two letters and words of other than Latin
    letters do not count for likeness. Ties go to the higher score, then the lower id."""
    import re

    word = re.compile(r"[a-z0-9_]{3,}")

    def choose(rows: list[dict]) -> list[tuple[int, float, int]]:
        rows = sorted(rows, key=lambda r: (-r["score"], r["id"]))
        tokens = [set(word.findall((r["text"] or "").lower())) for r in rows]
        likeness, chosen, out, used = [0.0] * len(rows), set(), [], set()
        while len(out) < most:
            open_ = [i for i in range(len(rows)) if i not in chosen and rows[i]["document_id"] not in used]
            if not open_:
                break
            best = max(open_, key=lambda i: balance * rows[i]["score"] - (1 - balance) * likeness[i])
            out.append((rows[best]["id"], round(balance * rows[best]["score"] - (1 - balance) * likeness[best], 6), len(out) + 1))
            chosen.add(best)
            used.add(rows[best]["document_id"])
            for i in open_:
                union = len(tokens[i] | tokens[best])
                likeness[i] = max(likeness[i], len(tokens[i] & tokens[best]) / union if union else 0.0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, *own) for q, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for own in choose(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["query_id", "id", "mmr", "rank"])

    listed = candidates.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "document_id", "text", F.col("score").cast("double").alias("score"))).alias("rows"))
    return listed.mapInArrow(run, "query_id long, id long, mmr double, rank int")


def first_wins(lists: list[DataFrame], most: int) -> DataFrame:
    """(query_id, url, source, rank) of ``lists`` (query_id, url, rank): one list after the other, an address once."""
    union = None
    for n, own in enumerate(lists):
        part = own.select("query_id", "url", F.col("rank").alias("place"), F.lit(n).alias("source"))
        union = part if union is None else union.unionByName(part)
    single = first_per_group(union.withColumn("key", F.lower("url")), ["query_id", "key"], [F.asc("source"), F.asc("place"), F.asc("url")])
    return ranked(single, ["query_id"], [F.asc("source"), F.asc("place"), F.asc("url")], "rank", most).select("query_id", "url", "source", "rank")


def answer_confidence(hits: DataFrame) -> DataFrame:
    """(query_id, top, tier, route) of ``hits`` (query_id, score, rank)."""
    top = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    tier = scores.confidence(F.col("top"), F.col("second"))
    return top.select("query_id", F.round("top", 6).alias("top"), tier.alias("tier"), scores.route(tier).alias("route"))


def grounded(explanation: Column, passage: Column, window: int = 180, phrase: int = 20) -> Column:
    """Does the explanation have any ``phrase`` characters in a row of the passage's first ``window``?"""
    head = text.collapse(F.lower(F.substring(passage, 1, window)))
    body = text.collapse(F.lower(explanation))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(head) - phrase + 1))
    return F.coalesce((F.length(head) >= phrase) & F.exists(starts, lambda i: F.contains(body, F.substring(head, i, F.lit(phrase)))), F.lit(False))


def stable_id(*parts: str) -> int:
    """A positive 63-bit id of a point from its parts."""
    return int.from_bytes(hashlib.sha256("|".join(parts).encode()).digest()[:8], "big") >> 1
