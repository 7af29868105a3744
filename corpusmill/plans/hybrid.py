"""Hybrid search over whole tables: every turn whose id is divisible by 50 is a query, held against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import hybrid, retrieval
from corpusmill.operators.points import copy_vectors
from corpusmill.operators.retrieval import hash_embedding
from corpusmill.session import materialize
from corpusmill.sources.tables import table
from corpusmill.sources.views import WITH, chunks, once, pages

DIMENSIONS, LEG, LIMIT = 32, 20, 8


def _queries(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, query, locale, vector)."""
    rows = once(spark, root, "chat_turn", "id", "user_message").where("id % 50 = 0")
    query = F.col("user_message")
    return with_vectors(rows.select(F.col("id").alias("query_id"), query.alias("query"), text.script_language(query).alias("locale")))


def with_vectors(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query, locale) with their vectors; blank ones are left out."""
    rows = queries.where("trim(query) <> ''").select(F.col("query_id").cast("long").alias("query_id"), "query", "locale", hash_embedding(F.col("query"), DIMENSIONS).alias("vector"))
    return materialize(rows, "hybrid-queries")


def _points(spark: SparkSession, root: str, corpus: int | None = None) -> DataFrame:
    """Of all corpora, or of one: (id, document_id, sequence_no, text, url, title, lead, summary, language, citable): every chunk of a known page; a
    chunk may be cited if its page is parsed, no navigation and not removed."""
    removed = table(spark, root, "document_deletion", "document_id").distinct().withColumn("removed", F.lit(True))
    detail = pages(spark, root, "corpus_id", F.col("canonical_url").alias("url"), "title", F.col("lead_text").alias("lead"), F.coalesce(text.first_non_blank(F.col("summary_ka"), F.col("summary_en"))).alias("summary"), text.language_code(F.col("language")).alias("language"), "page_kind", "fetch_status")
    detail = (detail if corpus is None else detail.where(F.col("corpus_id") == corpus)).drop("corpus_id")
    detail = detail.withColumnRenamed("id", "document_id").join(removed, "document_id", "left")
    citable = (F.col("fetch_status") == "parsed") & (F.coalesce("page_kind", F.lit("unknown")) != "navigation") & F.col("removed").isNull()
    rows = chunks(spark, root, "document_id", "sequence_no", "text").join(detail.withColumn("citable", F.coalesce(citable, F.lit(False))).drop("page_kind", "fetch_status", "removed"), "document_id")
    return materialize(rows, "hybrid-points")


def _named(points: DataFrame, column: str) -> DataFrame:
    """(document_id, vector): of each page that has the text, the vector of it."""
    return points.where(f"trim({column}) <> ''").select("document_id", column).distinct().select("document_id", hash_embedding(F.col(column), DIMENSIONS).alias("vector"))


def _nearest(queries: DataFrame, vectors: DataFrame, most: int = LEG) -> DataFrame:
    """``vectors`` (id, vector, language) of the query's locale, or all of them for a query without one, by cosine."""
    out = None
    for locale in ("ka", "en", None):
        mine, own = queries.where(F.col("locale").eqNullSafe(F.lit(locale))), vectors if locale is None else vectors.where(F.col("language") == locale)
        near = retrieval.dense_topk(mine.select("query_id", "vector"), own.select("id", "vector"), most)
        out = near if out is None else out.unionByName(near)
    return out


def _legs(queries: DataFrame, points: DataFrame) -> dict[str, DataFrame]:
    """Body, title and summary vectors and keywords. A page's vector is copied to all its points; what may not be cited is
    left out of the vectors' hits after their limit, and never searched for words."""
    citable = points.where("citable").select("id")
    own = points.where("text is not null").select("id", "language", hash_embedding(F.col("text"), DIMENSIONS).alias("vector"))
    legs = {"body": hybrid.after_limit(_nearest(queries, own), citable)}
    for name in ("title", "summary"):
        copied = copy_vectors(points.select("id", "document_id", "language"), _named(points, name), "vector").where("vector is not null")
        legs[name] = hybrid.after_limit(_nearest(queries, copied), citable)
    legs["keyword"] = hybrid.keyword_hits(queries, points.where("citable"), LEG)
    return legs


def keyword_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): citable chunks with all a message's words, or with one of its patterns."""
    return hybrid.keyword_hits(_queries(spark, root), _points(spark, root).where("citable"), LEG)


def title_vector_hits(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): chunks by their pages' title vectors; what may not be cited goes after the limit."""
    points = _points(spark, root)
    return _legs(_queries(spark, root), points)["title"].select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, n_lists, rank): the four legs fused."""
    return hybrid.hybrid(_legs(_queries(spark, root), _points(spark, root)))


def hybrid_sources(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, body, title, summary, keyword): how many hits each leg gave."""
    return hybrid.contributions(_legs(_queries(spark, root), _points(spark, root)))


def _passages(points: DataFrame) -> DataFrame:
    passage = F.concat_ws(". ", F.coalesce("title", F.lit("")), F.substring(F.coalesce(text.first_non_blank(F.col("lead"), F.col("text")), F.lit("")), 1, 512))
    return points.select("id", "url", hash_embedding(passage, DIMENSIONS).alias("vector"))


def hybrid_reranked(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): the fused hits, reranked by their passages' vectors."""
    queries, points = _queries(spark, root), _points(spark, root)
    return hybrid.passages_reranked(hybrid.hybrid(_legs(queries, points)), queries, _passages(points), LIMIT)


def search(spark: SparkSession, root: str, queries: DataFrame, most: int = LIMIT, corpus: int | None = None) -> DataFrame:
    """(query_id, id, document_id, url, title, text, score, rank) for ``queries`` (query_id, query, locale or null): the hybrid
    search of all corpora or one, reranked, at most ``most`` chunks a query."""
    asked, points = with_vectors(queries), _points(spark, root, corpus)
    hits = hybrid.passages_reranked(hybrid.hybrid(_legs(asked, points)), asked, _passages(points), most)
    return hits.join(points.select("id", "document_id", "url", "title", "text"), "id").select("query_id", "id", "document_id", "url", "title", "text", "score", "rank")


def hybrid_answer(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, mmr, rank): the reranked hits, diversified: what a message is answered with."""
    points = _points(spark, root)
    return retrieval.diversify(hybrid_reranked(spark, root).select("query_id", "id", "score").join(points.select("id", "document_id", "text"), "id"), 5)


def hybrid_confidence(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, top, tier, route) of the reranked hits."""
    return retrieval.answer_confidence(hybrid_reranked(spark, root))


def keyword_first(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, url, source, rank): the default search: hits by words, then by body vectors, an address once."""
    queries, points = _queries(spark, root), _points(spark, root)
    legs = _legs(queries, points)
    urls = points.select("id", "url").where("url is not null")
    return retrieval.first_wins([legs[name].select("query_id", "id", "rank").join(urls, "id") for name in ("keyword", "body")], LIMIT)


def multi_query(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, id, score, rank): the message, the same in lower case, and without punctuation, as three queries at once."""
    queries = _queries(spark, root)
    variants = queries.select("query_id", F.posexplode(F.array(F.col("query"), F.lower("query"), F.regexp_replace(F.lower("query"), text.WORD_SPLIT, " "))).alias("variant", "q"))
    variants = variants.select("query_id", "variant", hash_embedding(F.col("q"), DIMENSIONS).alias("vector"))
    vectors = _points(spark, root).where("text is not null").select("id", hash_embedding(F.col("text"), DIMENSIONS).alias("vector"))
    return hybrid.union_queries(variants, vectors, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _vector(value: str) -> str:
    return f"list_transform(range(0, 32), lambda i: ('0x' || substring(sha256({value}), i * 2 + 1, 2))::int / 127.5 - 1.0)"


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 1))"
_LETTERS = "length(user_message) - length(regexp_replace(user_message, '[{r}]', '', 'g'))"
_PATTERN_WORDS = "list_filter(regexp_split_to_array(lower(trim(user_message)), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 4)"
_BASE = (
    WITH
    + f", q0 as (select id as query_id, user_message as query, case when {_LETTERS.format(r='ა-ჿ')} >= {_LETTERS.format(r='A-Za-z')} then 'ka' else 'en' end as locale, {_vector('user_message')} as v, {_WORDS.format(c='user_message')} as words,"
    + f" list_concat([trim(user_message)], flatten(list_transform({_PATTERN_WORDS}, lambda w: case when length(w) >= 5 then [w, w[1:length(w) - 1]] else [w] end))) as listed from turns where id % 50 = 0 and trim(user_message) <> ''),"
    + " q as (select *, list_transform(list_filter(listed, lambda p, i: list_position(listed, p) = i), lambda p: lower(p)) as all_patterns from q0),"
    + f" pt as (select c.id, c.document_id, sequence_no, c.text, canonical_url as url, title, lead_text as lead, coalesce(nullif(trim(summary_ka), ''), nullif(trim(summary_en), '')) as summary, {text.language_code_sql('p.language')} as language, coalesce(fetch_status = 'parsed' and coalesce(page_kind, 'unknown') <> 'navigation' and p.id not in (select document_id from document_deletion where document_id is not null), false) as citable from chunks c join pages p on p.id = c.document_id)"
)


def _leg(name: str, column: str, where: str) -> str:
    near = f"select query_id, id, citable, score, row_number() over (partition by query_id order by round(score, 12) desc, id) as old from (select query_id, id, citable, list_cosine_similarity(q.v, x.v) as score from q join (select id, language, citable, {_vector(column)} as v from pt where {where}) x on x.language = q.locale) qualify old <= {LEG}"
    return f"{name} as (select query_id, id, score, row_number() over (partition by query_id order by old) as rank from ({near}) where citable)"


_KEYWORD = (
    "keyword as (select query_id, id, row_number() over (partition by query_id order by case when sequence_no = 0 then 0 else 1 end, found desc, id) as rank from (select query_id, id, sequence_no, len(list_intersect(words, tokens)) as found from q join (select *, "
    + _WORDS.format(c="concat_ws(' ', text, title, replace(coalesce(url, ''), '/', ' '))")
    + f" as tokens from pt where citable) x on x.language = q.locale and ((len(words) > 0 and list_has_all(tokens, words)) or len(list_filter(all_patterns[1:8], lambda p: contains(lower(coalesce(title, '')), p) or contains(lower(coalesce(url, '')), p) or contains(lower(coalesce(text, '')), p))) > 0)) qualify rank <= {LEG})"
)
_ALL = f"{_BASE}, {_leg('body', 'text', 'text is not null')}, {_leg('title_leg', 'title', chr(116) + 'rim(title) <> ' + chr(39) * 2)}, {_leg('summary_leg', 'summary', 'summary is not null')}, {_KEYWORD}"
_FUSED = ", fused as (select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score, count(*) as n_lists from (" + " union all ".join(f"select query_id, id, rank from {leg}" for leg in ("body", "title_leg", "summary_leg", "keyword")) + ") group by all), f as (select *, row_number() over (partition by query_id order by score desc, id) as rank from fused qualify rank <= 50)"
_PASSAGE = _vector("concat_ws('. ', coalesce(title, ''), substring(coalesce(nullif(trim(lead), ''), nullif(trim(text), ''), ''), 1, 512))")
_RERANKED = f", rr as (select f.query_id, f.id, url, round(f.score + 0.35 * list_cosine_similarity(q.v, x.v), 6) as score from f join q using (query_id) join (select id, url, {_PASSAGE} as v from pt) x on x.id = f.id where f.rank <= 24), ru as (select * from rr qualify row_number() over (partition by query_id, coalesce(lower(url), cast(id as varchar)) order by score desc, id) = 1), h as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from ru qualify rank <= {LIMIT})"

QUERIES = {f.__name__: f for f in (keyword_chunks, title_vector_hits, hybrid_search, hybrid_sources, hybrid_reranked, hybrid_answer, hybrid_confidence, keyword_first, multi_query)}
SQL = {
    "keyword_chunks": _ALL + " select query_id, id, round(cast(0.85 as double) - 0.01 * (rank - 1), 6) as score, rank from keyword",
    "title_vector_hits": _ALL + " select query_id, id, round(score, 6) as score, rank from title_leg",
    "hybrid_search": _ALL + _FUSED + " select query_id, id, score, n_lists, rank from f",
    "hybrid_sources": _ALL + ", u as (" + " union all ".join(f"select query_id, '{leg}' as leg from {leg}" for leg in ("body", "title_leg", "summary_leg", "keyword")) + ") select query_id, count(*) filter (leg = 'body') as body, count(*) filter (leg = 'title_leg') as title, count(*) filter (leg = 'summary_leg') as summary, count(*) filter (leg = 'keyword') as keyword from u group by 1",
    "hybrid_reranked": _ALL + _FUSED + _RERANKED + " select query_id, id, score, rank from h",
    "hybrid_confidence": _ALL + _FUSED + _RERANKED + ", t as (select query_id, max(score) filter (rank = 1) as top, max(score) filter (rank = 2) as second from h group by 1), c as (select query_id, top, case when top > 0.75 and top - coalesce(second, 0.0) > 0.05 then 'HIGH' when top > 0.55 then 'MEDIUM' when top > 0.35 then 'LOW' else 'NONE' end as tier from t) select query_id, round(top, 6) as top, tier, case tier when 'HIGH' then 'cite' when 'MEDIUM' then 'suggest' when 'LOW' then 'clarify' else 'refuse' end as route from c",
    "keyword_first": _ALL + f", j as (select query_id, id, rank as place, 0 as source from keyword union all select query_id, id, rank, 1 from body), w as (select j.query_id, url, source, place from j join pt using (id) where url is not null qualify row_number() over (partition by j.query_id, lower(url) order by source, place, url) = 1) select query_id, url, source, row_number() over (partition by query_id order by source, place, url) as rank from w qualify rank <= {LIMIT}",
    "multi_query": _ALL + f", vq as (select query_id, unnest([1, 2, 3]) as variant, unnest([query, lower(query), regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')]) as t from q), vv as (select query_id, variant, {_vector('t')} as v from vq), near as (select query_id, id, list_cosine_similarity(vv.v, x.xv) as score from vv join (select id, {_vector('text')} as xv from pt where text is not null) x on true qualify row_number() over (partition by query_id, variant order by round(score, 12) desc, id) <= 10), b as (select query_id, id, round(max(score), 9) as score from near group by query_id, id) select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, id) as rank from b qualify rank <= 10",
}
