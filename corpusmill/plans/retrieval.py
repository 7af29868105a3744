"""Retrieval over whole tables. Each tenth label's first vector, or each turn's message, is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import retrieval
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, hits_once, once, pages


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return _vectors(spark, root).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "label")


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): the 10 nearest vectors."""
    found = retrieval.dense_topk(_query_vectors(spark, root), _vectors(spark, root), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, rank): the 5 nearest of label 3, and for queries without any there, of all."""
    queries, vectors = _query_vectors(spark, root), _vectors(spark, root)
    strict = retrieval.dense_topk(queries.where("label <> 3"), vectors.where("label = 3"), 5)
    return retrieval.with_fallback(strict, retrieval.dense_topk(queries, vectors, 5)).select("query_id", "id", "rank")


def nearest_centroid(spark: SparkSession, root: str) -> DataFrame:
    """(id, cluster): the label whose mean vector is nearest. There is one centroid a label, which bounds them."""
    vectors = _vectors(spark, root)
    parts = vectors.select("label", F.posexplode("vector").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda p: p["mean"]).alias("vector"))
    return retrieval.nearest(vectors, centroids.select(F.col("label").alias("cluster"), "vector")).select("id", "cluster")


def best_match_threshold(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score): the nearest vector of another label, if its cosine is over .3."""
    best = retrieval.dense_topk(_query_vectors(spark, root), _vectors(spark, root), 1, apart="label")
    return best.where("score > 0.3").select("query_id", "id", F.round("score", 6).alias("score"))


def semantic_rerank(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): hits by the first 16 coordinates, reranked by all of them."""
    queries, vectors = _query_vectors(spark, root), _vectors(spark, root)
    short = [own.withColumn("vector", F.slice("vector", 1, 16)) for own in (queries, vectors)]
    return retrieval.semantic_rerank(retrieval.dense_topk(*short, 30), queries, vectors, 5)


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return once(spark, root, "chat_turn", "id", "user_message").where("user_message is not null").select(F.col("id").alias("query_id"), F.col("user_message").alias("query"))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunks(spark, root, "document_id", "sequence_no", "text").withColumnRenamed("id", "chunk_id")


def keyword_search(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks with all of a message's words."""
    return retrieval.keyword_search(_turns(spark, root), _chunks(spark, root))


def _keyword_hits(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that share at least two of a message's words, by how many they share."""
    return retrieval.shared_words(_turns(spark, root), _chunks(spark, root), 4)


def _cited_hits(spark: SparkSession, root: str) -> DataFrame:
    """First chunks of the pages a turn's hits name, by score."""
    hits = hits_once(spark, root).where("doc is not null").groupBy(F.col("turn_id").alias("query_id"), "doc").agg(F.max("score").alias("s"))
    first = _chunks(spark, root).where("sequence_no = 0").select(F.col("document_id").alias("doc"), F.col("chunk_id").alias("id"))
    return retrieval.ranked(hits.join(first, "doc"), ["query_id"], [F.desc("s"), F.asc("id")], "rank", 20)


def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, n_lists, rank): keyword hits and cited chunks in one list."""
    return retrieval.fuse([_keyword_hits(spark, root), _cited_hits(spark, root)], most=10)


def reranked_hits(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, reranked, rank): the pages a turn's hits name, reranked."""
    hits = hits_once(spark, root).where("doc is not null").groupBy(F.col("turn_id").alias("query_id"), F.col("doc").alias("id")).agg(F.max("score").alias("score"))
    detail = pages(spark, root, F.col("canonical_url").alias("url"), "title", F.col("lead_text").alias("text"), "language", "fetched_at")
    rows = hits.join(detail, "id").join(_turns(spark, root), "query_id")
    return retrieval.rerank(rows, text.script_language(F.col("query")), as_of(), 8).select("query_id", "id", F.round("reranked", 6).alias("reranked"), "rank")


def mmr_diversify(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, mmr, rank): keyword hits diversified."""
    detail = _chunks(spark, root).select(F.col("chunk_id").alias("id"), "document_id", "text")
    return retrieval.diversify(_keyword_hits(spark, root).select("query_id", "id", (F.col("n") / 10).alias("score")).join(detail, "id"), 5)


def url_first_wins(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, url, source, rank): keyword hits' pages, then cited ones, an address once."""
    urls = _chunks(spark, root).select(F.col("chunk_id").alias("id"), "document_id").join(pages(spark, root, "canonical_url").withColumnRenamed("id", "document_id"), "document_id").select("id", F.col("canonical_url").alias("url"))
    lists = [own.select("query_id", "id", "rank").join(urls, "id") for own in (_keyword_hits(spark, root), _cited_hits(spark, root))]
    return retrieval.first_wins(lists, 8)


def hybrid_topk(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, top, tier, route): both lists fused, scaled to the best possible score, with the answer's route."""
    fused = rrf_fusion(spark, root).withColumn("score", F.col("score") * 61 / 2)
    return retrieval.answer_confidence(fused)


def citable_hits(spark: SparkSession, root: str) -> DataFrame:
    """(turn_id, n_hits, n_citable): hits on pages that may be cited: no navigation, parsed."""
    rows = hits_once(spark, root).join(pages(spark, root, "page_kind", "fetch_status").withColumnRenamed("id", "doc"), "doc")
    fine = (F.lower("page_kind") != "navigation") & (F.col("fetch_status").isNull() | F.col("fetch_status").isin("parsed", "stale"))
    return rows.groupBy("turn_id").agg(F.count("*").alias("n_hits"), F.count_if(fine).alias("n_citable"))


def grounding(spark: SparkSession, root: str) -> DataFrame:
    """(id, grounded): does a page's English summary quote its lead?"""
    return pages(spark, root, "summary_en", "lead_text").select("id", retrieval.grounded(F.col("summary_en"), F.col("lead_text")).alias("grounded"))


def hash_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """(id, v0, v1, v31, length): coordinates of each title's hash vector."""
    rows = pages(spark, root, "title").select("id", retrieval.hash_embedding(F.col("title")).alias("v"))
    return rows.select("id", *(F.round(F.element_at("v", i + 1), 6).alias(f"v{i}") for i in (0, 1, 31)), F.size("v").alias("length"))


_HITS = "h as (select turn_id as query_id, try_cast(trim(document_id, E' \\t\\n\\r') as bigint) as doc, max(score) as s from hits where try_cast(trim(document_id, E' \\t\\n\\r') as bigint) is not null group by all)"
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= {n}))"
_KEYWORD = "qw as (select id as query_id, unnest(" + _TERMS.format(c="user_message", n=4) + ") as word from turns where user_message is not null), cw as (select id, unnest(" + _TERMS.format(c="text", n=4) + ") as word from chunks), kh as (select query_id, id, count(*) as n, row_number() over (partition by query_id order by count(*) desc, id) as rank from qw join cw using (word) group by query_id, id having count(*) >= 2 qualify rank <= 20)"
_CITED = _HITS + ", ch as (select query_id, c.id, row_number() over (partition by query_id order by s desc, c.id) as rank from h join chunks c on c.document_id = h.doc and c.sequence_no = 0 qualify rank <= 20)"
_FUSED = "f as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, count(*) as n_lists from (select query_id, id, rank from kh union all select query_id, id, rank from ch) group by all), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from f qualify rank <= 10)"
_COS = "list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[]))"

_SHORT = "round(list_cosine_similarity(cast(q.embedding[1:16] as double[]), cast(v.embedding[1:16] as double[])), 12)"

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_filtered, nearest_centroid, best_match_threshold, semantic_rerank, keyword_search, rrf_fusion, reranked_hits, mmr_diversify, url_first_wins,
        hybrid_topk, citable_hits, grounding, hash_embeddings,
    )
}
SQL = {
    "vector_topk": f"select q.vec_id as query_id, v.vec_id as id, round({_COS}, 6) as score, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify rank <= 10",
    "vector_topk_filtered": f"select q.vec_id as query_id, v.vec_id as id, row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 50 = 0 and (q.label = 3 or v.label = 3) qualify rank <= 5",
    "nearest_centroid": "with p as (select label, i, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) r(i) group by all), c as (select label, list(m order by i) as c from p group by label) select vec_id as id, cast(label2 as bigint) as cluster from (select e.vec_id, c.label as label2, row_number() over (partition by e.vec_id order by list_cosine_similarity(cast(e.embedding as double[]), c.c) desc, c.label) as n from embeddings e, c) where n = 1",
    "best_match_threshold": f"select q.vec_id as query_id, v.vec_id as id, round({_COS}, 6) as score from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.label <> v.label and {_COS} > 0.3 qualify row_number() over (partition by q.vec_id order by {_COS} desc, v.vec_id) = 1",
    "semantic_rerank": f"with s as (select q.vec_id as query_id, v.vec_id as id, {_COS} as c, {_SHORT} as h, row_number() over (partition by q.vec_id order by {_SHORT} desc, v.vec_id) as n from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify n <= 24) select query_id, id, round(h + 0.35 * c, 6) as score, row_number() over (partition by query_id order by round(h + 0.35 * c, 6) desc, id) as rank from s qualify rank <= 5",
    "keyword_search": WITH + ", qw as (select id as query_id, unnest(" + _TERMS.format(c="user_message", n=2) + ") as word from turns where user_message is not null), need as (select query_id, count(*) as needed from qw group by 1), cw as (select id as chunk_id, sequence_no, unnest(" + _TERMS.format(c="text", n=2) + ") as word from chunks), m as (select query_id, chunk_id, sequence_no, count(*) as found from qw join cw using (word) group by all), r as (select query_id, chunk_id, row_number() over (partition by query_id order by case when sequence_no = 0 then 0 else 1 end, chunk_id) as rank from m join need using (query_id) where found = needed qualify rank <= 20) select query_id, chunk_id, round(cast(0.85 as double) - 0.01 * (rank - 1), 6) as score, rank from r",
    "rrf_fusion": WITH + f", {_KEYWORD}, {_CITED}, {_FUSED} select query_id, id, score, n_lists, rank from r",
    "hybrid_topk": WITH + f", {_KEYWORD}, {_CITED}, {_FUSED}, t as (select query_id, max(score * 61 / 2) filter (rank = 1) as top, max(score * 61 / 2) filter (rank = 2) as second from r group by 1), c as (select query_id, top, case when top > 0.75 and top - coalesce(second, 0.0) > 0.05 then 'HIGH' when top > 0.55 then 'MEDIUM' when top > 0.35 then 'LOW' else 'NONE' end as tier from t) select query_id, round(top, 6) as top, tier, case tier when 'HIGH' then 'cite' when 'MEDIUM' then 'suggest' when 'LOW' then 'clarify' else 'refuse' end as route from c",
    "url_first_wins": WITH + f", {_KEYWORD}, {_CITED}, u as (select query_id, id, rank, 0 as source from kh union all select query_id, id, rank, 1 from ch), j as (select query_id, p.canonical_url as url, rank as place, source from u join chunks c using (id) join pages p on p.id = c.document_id), s as (select *, row_number() over (partition by query_id, lower(url) order by source, place, url) as n from j) select query_id, url, source, row_number() over (partition by query_id order by source, place, url) as rank from s where n = 1 qualify rank <= 8",
    "reranked_hits": WITH + f", {_HITS}, j as (select h.query_id, p.id, p.canonical_url as url, p.title, p.lead_text as text, p.language, p.fetched_at, h.s as score, " + _TERMS.format(c="t.user_message", n=3) + f" as w, case when length(t.user_message) - length(regexp_replace(t.user_message, '[ა-ჿ]', '', 'g')) >= length(t.user_message) - length(regexp_replace(t.user_message, '[A-Za-z]', '', 'g')) then 'ka' else 'en' end as locale, floor((epoch_us(timestamp '{AS_OF}') - epoch_us(p.fetched_at)) / 86400000000.0) as age from h join pages p on p.id = h.doc join turns t on t.id = h.query_id where t.user_message is not null), o as (select *, " + ", ".join(f"case when len(w) > 0 and coalesce(trim({c}), '') <> '' then len(list_filter(w, lambda x: contains(lower({c}), x))) / len(w) else 0.0 end as o_{c}" for c in ("text", "title", "url")) + " from j), s as (select query_id, id, url, round(score + case when " + text.language_code_sql("language") + " = locale then 0.15 when language is not null then -0.05 else 0.0 end + o_text * 0.2 + o_title * 0.15 + o_url * 0.1 + case when age <= 30 then 0.08 when age <= 180 then 0.04 when age <= 365 then 0.02 else 0.0 end, 9) as r from o), d as (select *, row_number() over (partition by query_id, lower(url) order by r desc, id) as n from s) select query_id, id, round(r, 6) as reranked, row_number() over (partition by query_id order by r desc, id) as rank from d where n = 1 qualify rank <= 8",
    "citable_hits": WITH + ", h as (select turn_id, try_cast(trim(document_id, E' \\t\\n\\r') as bigint) as doc from hits) select turn_id, count(*) as n_hits, count(*) filter (lower(page_kind) <> 'navigation' and (fetch_status is null or fetch_status in ('parsed', 'stale'))) as n_citable from h join pages p on p.id = h.doc group by 1",
    "grounding": WITH + ", g as (select id, trim(regexp_replace(lower(substring(lead_text, 1, 180)), '[ \\t\\n\\r\\f]+', ' ', 'g')) as head, trim(regexp_replace(lower(summary_en), '[ \\t\\n\\r\\f]+', ' ', 'g')) as body from pages) select id, coalesce(length(head) >= 20 and len(list_filter(range(1, greatest(2, length(head) - 18)), lambda i: contains(body, substring(head, i, 20)))) > 0, false) as grounded from g",
    "hash_embeddings": WITH + ", d as (select id, list_transform(range(0, 32), lambda i: ('0x' || substring(sha256(coalesce(title, '')), i * 2 + 1, 2))::int / 127.5 - 1.0) as v from pages), n as (select id, v, sqrt(12 * list_sum(list_transform(v, lambda x: x * x))) as l from d) select id, round(v[1] / l, 6) as v0, round(v[2] / l, 6) as v1, round(v[32] / l, 6) as v31, 384 as length from n",
}
