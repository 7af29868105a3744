"""Quality reports, evaluation, sessions and relational coverage over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import quality
from corpusmill.operators.catalog import ranked
from corpusmill.sources.tables import table
from corpusmill.sources.views import WITH, chunks, hits_once, links, once, pages


MARKERS = ["adapted version", "ადაპტირებული ვერსია"]


def _described(spark: SparkSession, root: str) -> DataFrame:
    own = chunks(spark, root, "document_id").select(F.col("document_id").alias("id"), F.lit(True).alias("has_chunk")).distinct()
    marker = F.lower("content_text").rlike("|".join(MARKERS))
    rows = pages(
        spark, root, "corpus_id", "fetch_status", F.length(F.trim("content_text")).alias("length"), F.coalesce(marker, F.lit(False)).alias("has_marker"), "validation_violations",
        (F.col("summary_ka").isNotNull() | F.col("summary_en").isNotNull()).alias("has_summary"), F.coalesce(F.col("page_kind") != "unknown", F.lit(False)).alias("has_kind"),
        F.coalesce(text.encoding_mismatch(F.col("canonical_url"), F.col("content_text")), F.lit(False)).alias("encoding_issue"),
    )
    return rows.join(own, "id", "left").select(
        "id", "corpus_id", "fetch_status", (F.col("fetch_status") == "parsed").alias("parsed"), F.coalesce("length", F.lit(0)).alias("body_length"),
        F.col("validation_violations").alias("violations"), "has_summary", "has_kind", "has_marker", "encoding_issue", F.coalesce("has_chunk", F.lit(False)).alias("has_chunk"),
    )


def quality_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, n_pages and the metrics)."""
    out = quality.corpus_metrics(_described(spark, root))
    return out.select("corpus_id", "n_pages", *(F.round(m, 6).alias(m) for m in quality.METRICS))


def quality_advice(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, advice): what to do about each corpus."""
    limits = {"empty_body_rate": ("<=", 0.1, "CONSIDER_HEADLESS"), "failure_rate": ("<=", 0.03, "RECRAWL"), "chunk_coverage": (">=", 0.9, "REINDEX")}
    out = quality.recommendations(quality.corpus_metrics(_described(spark, root)), limits)
    return out.select("corpus_id", F.array_join("advice", ",").alias("advice"))


def readiness(spark: SparkSession, root: str) -> DataFrame:
    """(check, value, threshold, passed): the gates over all pages."""
    totals = _described(spark, root).agg(quality.METRICS["summary_coverage"]().alias("summary_coverage"), quality.METRICS["empty_body_rate"]().alias("empty_body_rate"), F.count("*").alias("n_pages"))
    return quality.checks(totals, {"summary_coverage": (">=", 0.95), "empty_body_rate": ("<=", 0.05), "n_pages": (">=", 150)})


def null_profile(spark: SparkSession, root: str) -> DataFrame:
    """(column, n_null, n_blank, null_share) of ingestion_document's columns."""
    return quality.null_profile(table(spark, root, "ingestion_document"))


def duplicate_texts(spark: SparkSession, root: str) -> DataFrame:
    """(content_hash, n, first_doc): texts that several documents have."""
    rows = table(spark, root, "documents", "doc_id", "text").select("doc_id", text.content_hash(F.col("text")).alias("content_hash")).where("content_hash is not null")
    return rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def duplicate_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, text_hash, n): a document's equal chunks."""
    return quality.duplicate_groups(chunks(spark, root, "document_id", "text").select("document_id", F.sha2("text", 256).alias("text_hash")), ["document_id", "text_hash"])


def length_stats(spark: SparkSession, root: str) -> DataFrame:
    """(lang, n, shortest, longest, mean_length): of documents by language."""
    rows = table(spark, root, "documents", "lang", F.length("text").alias("n_chars"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 6).alias("mean_length"))


def status_counts(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, n_pages, n_parsed, n_failed, n_empty): conditional counts."""
    rows = pages(spark, root, "corpus_id", "fetch_status", (F.coalesce(F.trim("content_text"), F.lit("")) == "").alias("empty"))
    return rows.groupBy("corpus_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("fetch_status") == "parsed").alias("n_parsed"), F.count_if(F.col("fetch_status") == "failed").alias("n_failed"), F.count_if("empty").alias("n_empty"))


def shortest_bodies(spark: SparkSession, root: str) -> DataFrame:
    """(id, length): the 50 shortest bodies that are not empty."""
    rows = pages(spark, root, F.length("content_text").alias("length"), "canonical_url").where("length > 0")
    return rows.orderBy("length", "canonical_url", "id").limit(50).select("id", "length")


def chunks_per_page(spark: SparkSession, root: str) -> DataFrame:
    """(id, n_chunks): pages with the number of their chunks, those without too."""
    own = chunks(spark, root, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return pages(spark, root).select("id").join(own, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def link_counts(spark: SparkSession, root: str) -> DataFrame:
    """(target_url, n_links, n_sources, n_unresolved): of each target; counted before the shuffle, as one target has a
    tenth of all links."""
    rows = links(spark, root, "target_url", "source_doc_id", "target_doc_id")
    per = rows.groupBy("target_url", "source_doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("target_doc_id").isNull()).alias("u"))
    return per.groupBy("target_url").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_sources"), F.sum("u").alias("n_unresolved"))


def embedded_pages(spark: SparkSession, root: str) -> DataFrame:
    """(id): pages that have an embedded chunk."""
    return pages(spark, root).select("id").join(chunks(spark, root, "document_id", "embedding_status").where("embedding_status = 'embedded'").select(F.col("document_id").alias("id")), "id", "left_semi")


def unlinked_pages(spark: SparkSession, root: str) -> DataFrame:
    """(id): pages that no link leads to."""
    return pages(spark, root).select("id").join(links(spark, root, F.col("target_doc_id").cast("long").alias("target")).select(F.col("target").alias("id")), "id", "left_anti")


def session_last_n(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, id, place): each session's last three messages; a busy session sends three rows a task."""
    rows = once(spark, root, "chat_turn", "id", "session_id", "created_at")
    return ranked(rows, ["session_id"], [F.desc("created_at"), F.desc("id")], "place", 3).select("session_id", "id", "place")


def session_budget(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, id, used): messages until a session's 200 characters are used up; empty messages are left out. Since
    each one uses a character at least, a session sends no more than 200 rows a task."""
    rows = once(spark, root, "chat_turn", "id", "session_id", "user_message", "created_at").where("length(user_message) > 0")
    rows = ranked(rows, ["session_id"], [F.asc("created_at"), F.asc("id")], "place", 200)
    window = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(F.length("user_message")).over(window)).where("used <= 200").select("session_id", "id", "used")


def session_encoding(spark: SparkSession, root: str) -> DataFrame:
    """(turn_id, meta): a turn's three best hits as one string."""
    best = ranked(hits_once(spark, root), ["turn_id"], [F.desc("score"), F.asc("hit_id")], "place", 3)
    part = F.concat(F.lpad(F.col("place").cast("string"), 2, "0"), F.lit(":"), F.substring(F.coalesce("source_url", F.lit("")), 1, 100))
    return best.groupBy("turn_id").agg(F.array_join(F.array_sort(F.collect_list(part)), " | ").alias("meta"))


def eval_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(n_queries, hit_1, hit_5, mrr, ndcg_10, ndcg_plain): vectors of the query's label are relevant. ndcg_plain divides
    by the ideal of a single relevant result, so it may exceed 1."""
    from corpusmill.plans.retrieval import vector_topk

    labels = table(spark, root, "embeddings", F.col("vec_id").alias("id"), "label")
    found = vector_topk(spark, root).where("query_id <> id").join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = found.withColumn("place", place).withColumn("right", (F.col("label") == F.col("wanted")).cast("int"))
    gain = F.col("right") / (F.log2(F.col("place") + 1))
    per = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("place") <= 1, F.col("right"))).alias("h1"), F.max(F.when(F.col("place") <= 5, F.col("right"))).alias("h5"),
        F.coalesce(1.0 / F.min(F.when(F.col("right") == 1, F.col("place"))), F.lit(0.0)).alias("rr"), F.sum(gain).alias("dcg"), F.sum("right").alias("n_right"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_right"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("h1"), 6).alias("hit_1"), F.round(F.avg("h5"), 6).alias("hit_5"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg_10"), F.round(F.avg("dcg"), 6).alias("ndcg_plain"))


def feedback_boost(spark: SparkSession, root: str) -> DataFrame:
    """(user_id, hits, boost): events of the last seven days; a purchase is approval, an error the contrary."""
    from corpusmill.functions import scores

    rows = table(spark, root, "events", "user_id", "event_type", "ts")
    last = rows.agg(F.max("ts").alias("last"))
    recent = rows.join(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("interval 7 days"))
    counts = recent.groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if(F.col("event_type") == "purchase").alias("up"), F.count_if(F.col("event_type") == "error").alias("down")).where("hits >= 10")
    return counts.select("user_id", "hits", F.round(scores.clamp_boost(1 + scores.feedback_delta(F.col("hits"), F.col("up"), F.col("down"))), 6).alias("boost"))


def star_join(spark: SparkSession, root: str) -> DataFrame:
    """(n_name, order_year, n_orders, revenue): revenue of customers' nations by year."""
    lines = table(spark, root, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    orders = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, root, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, root, "nation", "n_nationkey", "n_name")
    joined = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").cast("int").alias("order_year")).agg(F.count("*").alias("n_orders"), F.sum("r").cast("double").alias("revenue"))


def random_sample(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id): about a hundredth of the documents, by a hash of the id, so the same at every run."""
    return table(spark, root, "documents", "doc_id").where(F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, F.lit(4)), 16, 10).cast("int") % 100 == 0)


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, prompt_version, n_turns): the newest prompt version each session used and its turns."""
    rows = once(spark, root, "chat_turn", "id", "session_id", "prompt_version", "created_at")
    return rows.groupBy("session_id").agg(F.max_by("prompt_version", F.struct("created_at", "id")).alias("prompt_version"), F.count("*").alias("n_turns"))


_D = "c as (select distinct document_id from chunks), d as (select *, fetch_status = 'parsed' as parsed, coalesce(length(trim(content_text)), 0) as body_length, summary_ka is not null or summary_en is not null as has_summary, id in (select document_id from c) as has_chunk, coalesce(regexp_matches(lower(content_text), '" + "|".join(MARKERS) + "'), false) as has_marker, coalesce(page_kind <> 'unknown', false) as has_kind, coalesce(contains(canonical_url, '/ka/') and coalesce(trim(content_text), '') <> '' and not regexp_matches(content_text, '[Ⴀ-ჿⴀ-⴯]'), false) as encoding_issue from pages)"
_RATIO = {
    "empty_body_rate": ("count(*) filter (parsed and body_length < 30)", "count(*) filter (parsed)"),
    "summary_coverage": ("count(*) filter (parsed and has_summary)", "count(*) filter (parsed)"),
    "chunk_coverage": ("count(*) filter (has_chunk)", "count(*) filter (parsed)"),
    "skip_rate": ("count(*) filter (fetch_status = 'skipped')", "count(*)"),
    "failure_rate": ("count(*) filter (fetch_status = 'failed')", "count(*)"),
    "boilerplate_ratio": ("count(*) filter (parsed and has_marker)", "count(*) filter (parsed)"),
    "truncation_rate": ("count(*) filter (parsed and list_contains(validation_violations, 'truncated_text'))", "count(*) filter (parsed)"),
    "repetition_rate": ("count(*) filter (parsed and list_contains(validation_violations, 'paragraph_duplicates_removed'))", "count(*) filter (parsed)"),
    "encoding_issue_rate": ("count(*) filter (parsed and encoding_issue)", "count(*) filter (parsed)"),
    "kind_coverage": ("count(*) filter (parsed and has_kind)", "count(*) filter (parsed)"),
    "violation_rate": ("count(*) filter (len(validation_violations) > 0)", "count(*)"),
}
_M = ", ".join(f"coalesce({a} / nullif({b}, 0), 0.0) as {m}" for m, (a, b) in _RATIO.items())
_FLAT = [
    "id", "corpus_id", "canonical_url", "url_hash", "title", "language", "content_text", "content_hash", "lead_text", "summary_ka", "summary_en", "locale_pair_doc_id", "page_kind", "quality_score",
    "validation_violations", "fetch_status", "http_status", "authority_score", "fetched_at", "published_at", "created_at", "updated_at",
]
_STRINGS = {"canonical_url", "url_hash", "title", "language", "content_text", "content_hash", "lead_text", "summary_ka", "summary_en", "page_kind", "quality_score", "fetch_status"}

QUERIES = {
    f.__name__: f
    for f in (
        quality_metrics, quality_advice, readiness, null_profile, duplicate_texts, duplicate_chunks, length_stats, status_counts, shortest_bodies, chunks_per_page, link_counts, embedded_pages,
        unlinked_pages, session_last_n, session_budget, session_encoding, eval_metrics, feedback_boost, star_join, random_sample, latest_version,
    )
}
SQL = {
    "quality_metrics": WITH + f", {_D} select corpus_id, count(*) as n_pages, " + ", ".join(f"round(coalesce({a} / nullif({b}, 0), 0.0), 6) as {m}" for m, (a, b) in _RATIO.items()) + " from d group by corpus_id",
    "quality_advice": WITH + f", {_D}, m as (select corpus_id, {_M} from d group by corpus_id) select corpus_id, coalesce(nullif(concat_ws(',', case when empty_body_rate > 0.1 + 1e-9 then 'CONSIDER_HEADLESS' end, case when failure_rate > 0.03 + 1e-9 then 'RECRAWL' end, case when chunk_coverage < 0.9 - 1e-9 then 'REINDEX' end), ''), 'OK') as advice from m",
    "readiness": WITH + f", {_D}, t as (select {_M}, count(*) as n_pages from d) select 'summary_coverage' as \"check\", round(cast(summary_coverage as double), 6) as value, cast(0.95 as double) as threshold, summary_coverage >= 0.95 - 1e-9 as passed from t union all select 'empty_body_rate', round(cast(empty_body_rate as double), 6), 0.05, empty_body_rate <= 0.05 + 1e-9 from t union all select 'n_pages', cast(n_pages as double), 150.0, n_pages >= 150 from t",
    "null_profile": " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_null, {f'count(*) filter (trim({c}) = {chr(39) * 2})' if c in _STRINGS else '0'} as n_blank, round(count(*) filter ({c} is null) / count(*), 6) as null_share from ingestion_document" for c in _FLAT),
    "duplicate_texts": "select sha256(p) as content_hash, count(*) as n, min(doc_id) as first_doc from (select doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as p from documents) where p <> '' group by 1 having count(*) > 1",
    "duplicate_chunks": WITH + "select document_id, sha256(text) as text_hash, count(*) as n from chunks where document_id is not null and text is not null group by 1, 2 having count(*) > 1",
    "length_stats": "select lang, count(*) as n, min(length(text)) as shortest, max(length(text)) as longest, round(avg(length(text)), 6) as mean_length from documents group by lang",
    "status_counts": WITH + "select corpus_id, count(*) as n_pages, count(*) filter (fetch_status = 'parsed') as n_parsed, count(*) filter (fetch_status = 'failed') as n_failed, count(*) filter (coalesce(trim(content_text), '') = '') as n_empty from pages group by corpus_id",
    "shortest_bodies": WITH + "select id, length(content_text) as length from pages where length(content_text) > 0 order by 2, canonical_url, id limit 50",
    "chunks_per_page": WITH + ", c as (select document_id, count(*) as n from chunks group by 1) select id, coalesce(n, 0) as n_chunks from pages left join c on document_id = id",
    "link_counts": WITH + "select target_url, count(*) as n_links, count(distinct source_doc_id) as n_sources, count(*) filter (target_doc_id is null) as n_unresolved from links group by 1",
    "embedded_pages": WITH + "select id from pages where id in (select document_id from chunks where embedding_status = 'embedded')",
    "unlinked_pages": WITH + "select id from pages where id not in (select cast(target_doc_id as bigint) from links where target_doc_id is not null)",
    "session_last_n": WITH + "select session_id, id, row_number() over (partition by session_id order by created_at desc, id desc) as place from turns qualify place <= 3",
    "session_budget": WITH + "select session_id, id, cast(sum(length(user_message)) over (partition by session_id order by created_at, id rows between unbounded preceding and current row) as bigint) as used from turns where length(user_message) > 0 qualify used <= 200",
    "session_encoding": WITH + ", b as (select turn_id, source_url, row_number() over (partition by turn_id order by score desc, hit_id) as place from hits qualify place <= 3) select turn_id, string_agg(lpad(cast(place as varchar), 2, '0') || ':' || substring(coalesce(source_url, ''), 1, 100), ' | ' order by place) as meta from b group by turn_id",
    "eval_metrics": "with s as (select q.vec_id as query_id, v.vec_id as id, q.label as wanted, v.label, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) as score from embeddings q, embeddings v where q.vec_id % 50 = 0), t as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10), r as (select query_id, cast(label = wanted as int) as ok, row_number() over (partition by query_id order by rank) as place from t where id <> query_id), p as (select query_id, max(ok) filter (place <= 1) as h1, max(ok) filter (place <= 5) as h5, coalesce(1.0 / min(place) filter (ok = 1), 0.0) as rr, sum(ok / log2(place + 1)) as dcg, sum(ok) as n from r group by query_id) select count(*) as n_queries, round(avg(h1), 6) as hit_1, round(avg(h5), 6) as hit_5, round(avg(rr), 6) as mrr, round(avg(dcg / list_sum(list_transform(range(1, cast(greatest(n, 1) as int) + 1), lambda i: 1.0 / log2(i + 1)))), 6) as ndcg_10, round(avg(dcg), 6) as ndcg_plain from p",
    "feedback_boost": "with c as (select user_id, count(*) as hits, count(*) filter (event_type = 'purchase') as up, count(*) filter (event_type = 'error') as down from events where ts > (select max(ts) from events) - interval 7 days group by 1 having count(*) >= 10) select user_id, hits, round(least(2.0, greatest(0.5, 1 + (up - down) / hits * 0.1)), 6) as boost from c",
    "star_join": "select n_name, year(o_orderdate)::int as order_year, count(distinct o_orderkey) as n_orders, cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    "random_sample": "select doc_id from documents where ('0x' || substring(sha256(cast(doc_id as varchar)), 1, 4))::int % 100 = 0",
    "latest_version": WITH + "select session_id, arg_max(prompt_version, (created_at, id)) as prompt_version, count(*) as n_turns from turns group by session_id",
}
