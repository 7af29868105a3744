"""The vector index as a table of points, and tables that are kept by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.catalog import first_per_group
from corpusmill.operators.retrieval import hash_embedding
from corpusmill.session import materialize

#: Keywords are broadcast up to so many bytes, 100 of them a row; beyond, queries' grams are shuffled.
KEYWORD_BYTES = 32 << 20


def build_points(chunks: DataFrame, documents: DataFrame, dimensions: int = 32) -> DataFrame:
    """(point_id, document_id, vector, payload) of ``chunks`` (chunk_id, document_id, text) of ``documents`` (document_id,
    url, title, language, page_kind, serve_state, score_boost); chunks of unknown documents and without text give none."""
    rows = chunks.where("text is not null").join(documents, "document_id")
    payload = F.struct("url", "title", "language", "page_kind", "serve_state", F.coalesce("score_boost", F.lit(1.0)).alias("score_boost"), text.excerpt(F.col("text"), 240).alias("text"))
    return rows.select(F.sha2(F.concat_ws("|", F.col("document_id"), F.col("chunk_id")), 256).alias("point_id"), "document_id", hash_embedding(F.col("text"), dimensions).alias("vector"), payload.alias("payload"))


def delete_points(points: DataFrame, documents: DataFrame) -> DataFrame:
    """Points of none of the ``documents`` (document_id)."""
    return points.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def replace_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """All points of the documents in ``new`` replaced: what an index does when a document comes again, however often."""
    return delete_points(points, new).unionByName(new)


def patch_payload(points: DataFrame, patches: DataFrame) -> DataFrame:
    """``points`` with the serve_state, page_kind and score_boost of ``patches`` (document_id, patched_at, ...) where these
    are not null; vectors stay. Of several patches of a document the latest counts, as a whole."""
    fields = ("serve_state", "page_kind", "score_boost")
    one = patches.groupBy("document_id").agg(F.max(F.struct("patched_at", *fields)).alias("p")).select("document_id", *(F.col(f"p.{f}").alias(f"new_{f}") for f in fields))
    joined = points.join(one, "document_id", "left")
    payload = F.col("payload")
    for field in fields:
        payload = payload.withField(field, F.coalesce(F.col(f"new_{field}"), F.col("payload")[field]))
    return joined.select("point_id", "document_id", "vector", payload.alias("payload"))


def copy_vectors(points: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """Points with their document's vector (document_id, vector) as another named vector; null where there is none."""
    return points.join(vectors.select("document_id", F.col("vector").alias(name)), "document_id", "left")


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``stored`` and those of ``rows`` whose key it does not have, the first of each: on conflict, do nothing."""
    return stored.unionByName(first_per_group(rows.join(stored.select(*keys).distinct(), keys, "left_anti"), keys, order))


def cached(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """``wanted`` (cache_key, ...) with the latest ``cache`` entry (cache_key, value, stored_at, expires_at) that has not
    expired, and whether there is one."""
    fresh = cache.where(F.col("expires_at") > now).groupBy("cache_key").agg(F.max_by("value", F.struct("stored_at", "value")).alias("value"))
    return wanted.join(fresh, "cache_key", "left").withColumn("hit", F.col("value").isNotNull())


def pending(documents: DataFrame, ledger: DataFrame, kind: str, version: str) -> DataFrame:
    """Documents (id) without a completed run of a kind and version in ``ledger`` (document_id, kind, version, status)."""
    done = ledger.where((F.col("kind") == kind) & (F.col("version") == version) & (F.col("status") == "completed"))
    return documents.join(done.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def _grams(value: str, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a column; none in a shorter value."""
    starts = F.sequence(F.lit(1), F.length(value) - size + 1)
    return F.when(F.length(value) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(value, i, size)))).otherwise(F.array().cast("array<string>"))


def rarest_grams(asked: DataFrame, keywords: DataFrame, gram: int) -> DataFrame:
    """(keyword, gram) of ``keywords`` (keyword): the ``gram`` characters in a row, or all of a shorter one, that the fewest
    rows of ``asked`` (gram) have; keywords with one that none has are left out. Neither side is broadcast: Spark takes
    exploded rows to be no larger than the table they come from."""
    often = asked.groupBy("gram").agg(F.count("*").alias("n"))
    words = keywords.select("keyword").distinct().where("keyword <> ''")
    own = words.select("keyword", F.explode(_grams("keyword", F.least(F.lit(gram), F.length("keyword")))).alias("gram"))
    rarest = own.join(often.hint("merge"), "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return rarest.where("r.n > 0").select("keyword", "r.gram")


def contained(queries: DataFrame, keywords: DataFrame, gram: int = 3, most: int = KEYWORD_BYTES) -> DataFrame:
    """(query_id, keyword) of ``queries`` (query_id, query) and ``keywords`` (keyword): keywords that the query has as a
    substring; empty ones are in none. They meet by an equi-join on a keyword's rarest ``gram`` characters in a row, or on
    all of a shorter one, and only these pairs are compared; so characters that many queries or keywords have join little.

    Keywords that some query may have are written out and broadcast, so that queries' grams stay in the task that makes
    them. If they take more than ``most`` bytes, the grams are shuffled without the texts, which the pairs get afterwards."""
    queries = queries.where("query is not null").select("query_id", "query")
    asked = queries.select("*", F.explode(F.concat(*(_grams("query", F.lit(n)) for n in range(1, gram + 1)))).alias("gram"))
    rarest = materialize(rarest_grams(asked, keywords, gram), "rarest")
    if rarest.agg(F.coalesce(F.sum(F.octet_length("keyword") + 100), F.lit(0))).first()[0] <= most:
        pairs = asked.join(F.broadcast(rarest), "gram")
    else:
        met = asked.select("query_id", "gram").join(rarest.hint("merge"), "gram").select(F.col("query_id").alias("met_id"), "keyword").distinct()
        pairs = met.hint("merge").join(queries, F.col("met_id").eqNullSafe(F.col("query_id")))
    return pairs.where(F.contains("query", F.col("keyword"))).select("query_id", "keyword").distinct()


def renamed(labels: DataFrame, renames: DataFrame) -> DataFrame:
    """``labels`` (id, label) under ``renames`` (id, label, created_at): the latest name, else the own one."""
    latest = renames.groupBy("id").agg(F.max_by("label", F.struct("created_at", "label")).alias("new"))
    return labels.join(latest, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def label_topics(labels: DataFrame, topics: list[tuple[str, str]]) -> DataFrame:
    """(id, topic) of ``labels`` (id, label): the topic (name, phrase) of the highest score: 3 for the whole phrase, 2 for
    each of its words of at least 4 characters; the first of equals; no topic below 2. Topics are a fixed list."""
    low = F.lower("label")
    scored = []
    for place, (name, phrase) in enumerate(topics):
        score = F.when(F.contains(low, F.lit(phrase)), 3).otherwise(0)
        for word in sorted({w for w in phrase.split() if len(w) >= 4}):
            score = score + F.when(F.contains(low, F.lit(word)), 2).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("topic")))
    best = F.array_max(F.array(*scored))
    return labels.select("id", F.when(best["score"] >= 2, best["topic"]).alias("topic"))
