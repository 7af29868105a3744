"""The vector index, caches, ledgers and label joins over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text, urls
from corpusmill.operators import points
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, hits_once, once, pages

TOPICS = [("trade", "export of goods"), ("trade", "import of goods"), ("labour", "unemployment rate"), ("labour", "average monthly wage"), ("population", "number of births"), ("prices", "consumer price index")]


def _points(spark: SparkSession, root: str) -> DataFrame:
    documents = pages(spark, root, F.col("canonical_url").alias("url"), "title", "language", "page_kind").withColumnRenamed("id", "document_id")
    documents = documents.withColumns({"serve_state": F.lit("live"), "score_boost": F.lit(None).cast("double")})
    return points.build_points(chunks(spark, root, "document_id", "text").withColumnRenamed("id", "chunk_id"), documents)


def point_table(spark: SparkSession, root: str) -> DataFrame:
    """(point_id, document_id, v0, url, boost): the index."""
    return _points(spark, root).select("point_id", "document_id", F.round(F.element_at("vector", 1), 6).alias("v0"), F.col("payload.url").alias("url"), F.col("payload.score_boost").alias("boost"))


def points_deleted(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, n_points): the index without removed pages."""
    gone = table(spark, root, "document_deletion", "document_id")
    return points.delete_points(_points(spark, root), gone).groupBy("document_id").agg(F.count("*").alias("n_points"))


def payload_patch(spark: SparkSession, root: str) -> DataFrame:
    """(serve_state, boost, n_points): removed pages' points patched to dropped, at half their score."""
    patches = table(spark, root, "document_deletion", "document_id", "deleted_at").select("document_id", F.col("deleted_at").alias("patched_at"), F.lit("dropped").alias("serve_state"), F.lit(None).cast("string").alias("page_kind"), F.lit(0.5).alias("score_boost"))
    out = points.patch_payload(_points(spark, root), patches)
    return out.groupBy(F.col("payload.serve_state").alias("serve_state"), F.col("payload.score_boost").alias("boost")).agg(F.count("*").alias("n_points"))


def points_replaced(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, n_points): points of even pages replaced by the first point of each."""
    all_ = _points(spark, root)
    new = all_.where("document_id % 2 = 0").groupBy("document_id").agg(F.min_by(F.struct("point_id", "vector", "payload"), "point_id").alias("p")).select("p.point_id", "document_id", "p.vector", "p.payload")
    return points.replace_points(all_, new).groupBy("document_id").agg(F.count("*").alias("n_points"))


def intent_cache(spark: SparkSession, root: str) -> DataFrame:
    """(id, hit): which messages a cache of the day's turns would answer: entries last for 400 days."""
    rows = once(spark, root, "chat_turn", "id", "user_message", "created_at").where("user_message is not null")
    key = F.sha2(F.lower(text.collapse(F.col("user_message"))), 256)
    cache = rows.where("id % 2 = 0").select(key.alias("cache_key"), F.col("user_message").alias("value"), F.col("created_at").alias("stored_at"), (F.col("created_at") + F.expr("interval 400 days")).alias("expires_at"))
    return points.cached(cache, rows.where("id % 2 = 1").select("id", key.alias("cache_key")), as_of()).select("id", "hit")


def enrichment_pending(spark: SparkSession, root: str) -> DataFrame:
    """(id): pages without an English summary run, by the ledger of runs."""
    rows = pages(spark, root, "summary_en")
    ledger = rows.where("summary_en is not null").select(F.col("id").alias("document_id"), F.lit("summary").alias("kind"), F.lit("v1").alias("version"), F.lit("completed").alias("status"))
    return points.pending(rows.select("id"), ledger, "summary", "v1")


def first_messages(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, id): sessions' first turns; what comes later to a session does nothing."""
    rows = once(spark, root, "chat_turn", "session_id", "id", "created_at")
    return points.insert_new(rows.limit(0), rows, ["session_id"], [F.asc("created_at"), F.asc("id")]).select("session_id", "id")


def keyword_containment(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, keyword): the page titles' words that a message has as substrings."""
    words = pages(spark, root, "title").select(F.explode(text.terms(F.col("title"), 4)).alias("keyword"))
    queries = once(spark, root, "chat_turn", "id", "user_message").select(F.col("id").alias("query_id"), F.lower("user_message").alias("query"))
    return points.contained(queries, words)


def topic_rename(spark: SparkSession, root: str) -> DataFrame:
    """(id, label): corpora under the titles of their newest page."""
    labels = table(spark, root, "ingestion_corpus", "id", F.col("corpus_name").alias("label"))
    renames = pages(spark, root, "corpus_id", "title", "created_at").where("title is not null").select(F.col("corpus_id").alias("id"), F.col("title").alias("label"), "created_at")
    return points.renamed(labels, renames)


def label_topics(spark: SparkSession, root: str) -> DataFrame:
    """(id, topic): pages' topics by their titles."""
    return points.label_topics(pages(spark, root, F.col("title").alias("label")), TOPICS)


def url_whitelist(spark: SparkSession, root: str) -> DataFrame:
    """(hit_id): hits whose address is a page's."""
    known = pages(spark, root, "canonical_url").select(urls.source_key(F.col("canonical_url")).alias("key"))
    return hits_once(spark, root).withColumn("key", urls.source_key(F.col("source_url"))).join(known, "key", "left_semi").select("hit_id")


def turn_hits(spark: SparkSession, root: str) -> DataFrame:
    """(id, n_hits, best): turns with their hits, those without too."""
    hits = hits_once(spark, root).groupBy(F.col("turn_id").alias("id")).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return once(spark, root, "chat_turn", "id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_hits"), F.round("best", 6).alias("best"))


def gate_overrides(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, n_accepted): pages long enough for their corpus; one corpus has a limit of its own."""
    limits = spark.createDataFrame([(1, 400)], "corpus_id long, own int")
    rows = pages(spark, root, "corpus_id", F.length("content_text").alias("n")).join(F.broadcast(limits), "corpus_id", "left")
    return rows.groupBy("corpus_id").agg(F.count_if(F.col("n") >= F.coalesce("own", F.lit(200))).alias("n_accepted"))


def script_mix(spark: SparkSession, root: str) -> DataFrame:
    """(language, n, n_mixed): pages by label, and those with many letters of two scripts."""
    t = F.coalesce("content_text", F.lit(""))
    mixed = (text.count_matches(t, "[ა-ჿ]") >= 50) & (text.count_matches(t, "[A-Za-z]") >= 50)
    return pages(spark, root, "language", "content_text").groupBy("language").agg(F.count("*").alias("n"), F.count_if(mixed).alias("n_mixed"))


def published_dates(spark: SparkSession, root: str) -> DataFrame:
    """(id, path_day, published): dates that an address or the page itself names; what is no date is null."""
    day = F.regexp_extract("canonical_url", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return pages(spark, root, "canonical_url", "published_at").select("id", F.date_format(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "yyyy-MM-dd").alias("path_day"), F.date_format("published_at", "yyyy-MM-dd").alias("published"))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= {n}))"
_P = "pt as (select sha256(cast(c.document_id as varchar) || '|' || cast(c.id as varchar)) as point_id, c.document_id, c.text, p.canonical_url as url from chunks c join pages p on p.id = c.document_id where c.text is not null)"
_LABEL = "greatest(" + ", ".join(
    "struct_pack(score := " + " + ".join([f"case when contains(lower(title), '{phrase}') then 3 else 0 end", *(f"case when contains(lower(title), '{w}') then 2 else 0 end" for w in sorted({w for w in phrase.split() if len(w) >= 4}))]) + f", place := {-i}, topic := '{name}')" for i, (name, phrase) in enumerate(TOPICS)
) + ")"

QUERIES = {
    f.__name__: f
    for f in (
        point_table, points_deleted, payload_patch, points_replaced, intent_cache, enrichment_pending, first_messages, keyword_containment, topic_rename, label_topics, url_whitelist, turn_hits,
        gate_overrides, script_mix, published_dates,
    )
}
SQL = {
    "point_table": WITH + f", {_P}, d as (select *, list_transform(range(0, 32), lambda i: ('0x' || substring(sha256(text), i * 2 + 1, 2))::int / 127.5 - 1.0) as v from pt) select point_id, document_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as v0, url, cast(1.0 as double) as boost from d",
    "points_deleted": WITH + f", {_P} select document_id, count(*) as n_points from pt where document_id not in (select document_id from document_deletion) group by 1",
    "payload_patch": WITH + f", {_P} select case when document_id in (select document_id from document_deletion) then 'dropped' else 'live' end as serve_state, cast(case when document_id in (select document_id from document_deletion) then 0.5 else 1.0 end as double) as boost, count(*) as n_points from pt group by all",
    "points_replaced": WITH + f", {_P} select document_id, case when document_id % 2 = 0 then 1 else count(*) end as n_points from pt group by document_id",
    "intent_cache": WITH + f", t as (select *, lower(trim(regexp_replace(user_message, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as k from turns where user_message is not null) select id, k in (select k from t where id % 2 = 0 and created_at + interval 400 days > timestamp '{AS_OF}') as hit from t where id % 2 = 1",
    "enrichment_pending": WITH + "select id from pages where summary_en is null",
    "first_messages": WITH + "select session_id, id from turns qualify row_number() over (partition by session_id order by created_at, id) = 1",
    "keyword_containment": WITH + ", w as (select distinct unnest(" + _TERMS.format(c="title", n=4) + ") as keyword from pages) select id as query_id, keyword from turns, w where contains(lower(user_message), keyword)",
    "topic_rename": WITH + ", r as (select corpus_id, arg_max(title, (created_at, title)) as new from pages where title is not null group by 1) select c.id, coalesce(new, corpus_name) as label from ingestion_corpus c left join r on r.corpus_id = c.id",
    "label_topics": WITH + f", b as (select id, title, {_LABEL} as b from pages) select id, case when title is not null and b.score >= 2 then b.topic end as topic from b",
    "url_whitelist": WITH + "select hit_id from hits where lower(regexp_replace(regexp_replace(source_url, '#.*$', ''), '/+$', '')) in (select lower(regexp_replace(regexp_replace(canonical_url, '#.*$', ''), '/+$', '')) from pages)",
    "turn_hits": WITH + ", h as (select turn_id, count(*) as n, max(score) as best from hits group by 1) select id, coalesce(n, 0) as n_hits, round(best, 6) as best from turns left join h on turn_id = id",
    "gate_overrides": WITH + "select corpus_id, count(*) filter (length(content_text) >= case when corpus_id = 1 then 400 else 200 end) as n_accepted from pages group by 1",
    "script_mix": WITH + "select language, count(*) as n, count(*) filter (length(content_text) - length(regexp_replace(content_text, '[ა-ჿ]', '', 'g')) >= 50 and length(content_text) - length(regexp_replace(content_text, '[A-Za-z]', '', 'g')) >= 50) as n_mixed from pages group by 1",
    "published_dates": WITH + "select id, strftime(try_cast(nullif(regexp_extract(canonical_url, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as date), '%Y-%m-%d') as path_day, strftime(published_at, '%Y-%m-%d') as published from pages",
}
