"""Hybrid search: named vectors and keywords over one set of points, fused, reranked and merged.

Queries are a stated set and are held against all rows in blocks, which are broadcast; each task sends on what may be
among a query's best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.catalog import first_per_group, ranked
from corpusmill.operators.retrieval import dense_topk, fuse

#: Queries of a keyword search are broadcast in blocks of so many.
KEYWORD_BLOCK = 512


def search_words(query: Column) -> Column:
    """All distinct words of a query, in lower case."""
    return text.terms(query, 1)


def keyword_hits(queries: DataFrame, rows: DataFrame, most: int = 20, block: int = KEYWORD_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of ``queries`` (query_id, query, locale) over ``rows`` (id, sequence_no, title, url, text,
    language): rows whose text, title and address together have all the query's words, or of which one contains a pattern
    of the query (``text.search_patterns``), whatever the case; of the query's locale, if it has one. First chunks come
    first, then those with more of the words, then by id; a rank's score is .85 less .01 for each place. Blank queries find
    nothing."""
    spark = queries.sparkSession
    asked = queries.where(F.trim("query") != "").select("query_id", "locale", search_words(F.col("query")).alias("words"), F.transform(text.search_patterns(F.col("query")), F.lower).alias("patterns"))
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "url", "text")]
    had = rows.select(
        F.col("id").cast("long").alias("id"), "sequence_no", "language", search_words(F.concat_ws(" ", "text", "title", F.replace(F.coalesce("url", F.lit("")), F.lit("/"), F.lit(" ")))).alias("tokens"),
        *(c.alias(f"low_{n}") for c, n in zip(low, ("title", "url", "text"), strict=True)),
    ).where("id is not null")
    out, part = None, []

    def search(own: list) -> DataFrame:
        given = F.broadcast(spark.createDataFrame(own, asked.schema))
        whole = F.forall("words", lambda w: F.array_contains("tokens", w)) & (F.size("words") > 0)
        pattern = F.exists("patterns", lambda p: F.contains("low_title", p) | F.contains("low_url", p) | F.contains("low_text", p))
        hits = had.join(given, (F.col("locale").isNull() | (F.col("language") == F.col("locale"))) & (whole | pattern))
        return hits.select("query_id", "id", F.when(F.col("sequence_no") == 0, 0).otherwise(1).alias("later"), F.size(F.array_intersect("words", "tokens")).alias("found"))

    for row in asked.orderBy("query_id").toLocalIterator():
        part.append(row)
        if len(part) == block:
            out, part = search(part) if out is None else out.unionByName(search(part)), []
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    best = ranked(out, ["query_id"], [F.asc("later"), F.desc("found"), F.asc("id")], "rank", most)
    return best.select("query_id", "id", F.round(0.85 - 0.01 * (F.col("rank") - 1), 6).alias("score"), "rank")


def point_hits(queries: DataFrame, vectors: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank): the ``most`` nearest ``points`` (id, document_id, language) of each of ``queries``
    (query_id, vector, locale), by a named vector that all points of a document share: ``vectors`` (document_id, vector).
    Only points of the query's locale count, if it has one.

    Documents are searched, not points: a document among the best has at least one point."""
    own = points.select("document_id", "language").distinct().join(vectors, "document_id").select(F.col("document_id").alias("id"), "vector", "language")
    out = None
    for locale in [r.locale for r in queries.select("locale").distinct().orderBy("locale").collect()]:
        mine = queries.where(F.col("locale").eqNullSafe(F.lit(locale)))
        near = dense_topk(mine.select("query_id", "vector"), own if locale is None else own.where(F.col("language") == locale), most)
        there = points if locale is None else points.where(F.col("language") == locale)
        hits = near.select("query_id", F.col("id").alias("document_id"), F.round("score", 9).alias("score")).join(there.select("id", "document_id"), "document_id")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return ranked(out.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.asc("id")], "rank", most)


def after_limit(hits: DataFrame, citable: DataFrame) -> DataFrame:
    """``hits`` (query_id, id, score, rank) of ``citable`` (id) alone, ranked anew: what is left out does not make room."""
    kept = hits.join(citable.select("id"), "id", "left_semi")
    return ranked(kept.withColumnRenamed("rank", "_old"), ["query_id"], [F.asc("_old")], "rank", 1_000_000).drop("_old")


def union_queries(variants: DataFrame, vectors: DataFrame, most: int, per: int = 3) -> DataFrame:
    """(query_id, id, score, rank): the best hits of several variants of a query, ``variants`` (query_id, variant, vector) of
    which the first ``per`` count; of a hit of several variants the best score."""
    few = variants.where(F.col("variant") < per).withColumn("key", F.col("query_id") * per + F.col("variant"))
    near = dense_topk(few.select(F.col("key").alias("query_id"), "vector"), vectors, most)
    best = near.groupBy(F.floor(F.col("query_id") / per).cast("long").alias("query_id"), "id").agg(F.round(F.max("score"), 9).alias("score"))
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("id")], "rank", most)


def contributions(legs: dict[str, DataFrame]) -> DataFrame:
    """(query_id, one column a leg): how many hits each leg gave."""
    union = None
    for name, hits in legs.items():
        part = hits.select("query_id", F.lit(name).alias("leg"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id").pivot("leg", list(legs)).count().fillna(0)


def passages_reranked(fused: DataFrame, queries: DataFrame, passages: DataFrame, limit: int, weight: float = 0.35, least: int = 24) -> DataFrame:
    """(query_id, id, score, rank) of ``fused`` (query_id, id, score, rank): the foremost max(3 limit, least) hits gain
    ``weight`` times the cosine of the query's vector with the passage's, ``passages`` (id, url, vector); of one address the
    best; at most ``limit``."""
    from corpusmill.functions import scores

    few = fused.where(F.col("rank") <= max(3 * limit, least)).select("query_id", "id", "score")
    both = few.join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(passages, "id")
    scored = both.select("query_id", "id", "url", F.round(F.col("score") + weight * scores.cosine(F.col("q"), F.col("vector")), 6).alias("score"))
    single = first_per_group(scored.withColumn("key", F.coalesce(F.lower("url"), F.col("id").cast("string"))), ["query_id", "key"], [F.desc("score"), F.asc("id")])
    return ranked(single.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.asc("id")], "rank", limit)


def hybrid(legs: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """(query_id, id, score, n_lists, rank): the legs' hits fused by reciprocal ranks."""
    return fuse([hits.select("query_id", "id", "rank") for hits in legs.values()], most=most)
