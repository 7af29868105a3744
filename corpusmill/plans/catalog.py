"""Catalog views and their relatives over whole tables. A page's corpus stands in for its topic cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.operators import catalog
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, hits_once, once, pages

PARSED = "fetch_status = 'parsed'"


def best_page_per_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, language, id, authority_score): the portal page of most authority of each corpus and language."""
    rows = pages(spark, root, "corpus_id", "language", "page_kind", "fetch_status", "authority_score", "fetched_at").where(PARSED).where("page_kind = 'portal'")
    return catalog.first_per_group(rows, ["corpus_id", "language"], [F.desc("authority_score"), F.desc_nulls_last("fetched_at"), F.asc("id")]).select("corpus_id", "language", "id", "authority_score")


def rank_in_kind(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, page_kind, id, rank): pages by authority within corpus, language and kind."""
    rows = pages(spark, root, "corpus_id", "language", "page_kind", "fetch_status", "authority_score", "fetched_at").where(PARSED)
    return catalog.ranked_whole(rows, ["corpus_id", "language", "page_kind"], [F.desc("authority_score"), F.desc_nulls_last("fetched_at"), F.asc("id")]).select("corpus_id", "page_kind", "id", "rank")


def dedupe_keep_highest(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, content_hash, id): of pages with one hash in a corpus, the one with the highest id."""
    rows = pages(spark, root, "corpus_id", "content_hash").where("content_hash is not null")
    return rows.groupBy("corpus_id", "content_hash").agg(F.max("id").alias("id"))


def topic_keywords(spark: SparkSession, root: str) -> DataFrame:
    """(cluster, language, keyword, frequency, clusters, score, rank): the 20 foremost words of each corpus, by TF-IDF."""
    rows = pages(spark, root, "corpus_id", text.language_code(F.col("language")).alias("language"), "content_text").where("language in ('ka', 'en')")
    terms = rows.select(F.col("corpus_id").alias("cluster"), "language", F.explode(text.terms(F.col("content_text"))).alias("keyword"))
    out = catalog.tfidf(terms, 20)
    return out.select("cluster", "language", "keyword", "frequency", "clusters", F.round("score", 6).alias("score"), "rank")


def topic_keywords_weighted(spark: SparkSession, root: str) -> DataFrame:
    """(cluster, language, keyword, frequency, rank): title words, with words of English summaries counted twice."""
    rows = pages(spark, root, "corpus_id", "title", "summary_en")
    def words(column: str, weight: int) -> DataFrame:
        return rows.select(F.col("corpus_id").alias("cluster"), F.lit("en").alias("language"), F.explode(text.terms(F.col(column))).alias("keyword"), F.lit(weight).alias("weight"))
    return catalog.tfidf(words("title", 1).unionByName(words("summary_en", 2)), 10, "weight").select("cluster", "language", "keyword", "frequency", "rank")


def topic_summary(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, n_pages, n_chunks): usable pages that are no portals, with the number of their chunks."""
    rows = pages(spark, root, "corpus_id", "page_kind", F.length("content_text").alias("length")).where(~F.col("page_kind").eqNullSafe("portal") & (F.col("length") >= 100))
    own = chunks(spark, root, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return rows.select("id", "corpus_id").join(own, "id", "left").groupBy("corpus_id").agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))


def _overrides(spark: SparkSession, root: str) -> DataFrame:
    """Deletions as curation overrides: the reason says what is done."""
    action = F.when(F.col("document_id") % 4 == 0, "exclude").when(F.col("document_id") % 4 == 1, "boost").when(F.col("document_id") % 4 == 2, "demote").otherwise("pin")
    return table(spark, root, "document_deletion", "document_id", "deleted_at").select(F.col("document_id").alias("target_id"), action.alias("action"), (F.col("deleted_at") + F.expr("interval 90 days")).alias("expires_at"))


def curation_overlay(spark: SparkSession, root: str) -> DataFrame:
    """(id, curated, pinned): pages' scores under the active overrides."""
    rows = pages(spark, root, "authority_score").withColumnRenamed("authority_score", "score")
    out = catalog.curate(rows, _overrides(spark, root), F.lit("2024-06-01").cast("timestamp_ntz"))
    return out.select("id", F.round("curated", 6).alias("curated"), "pinned")


def pinned_and_derived(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, id, source): pinned pages, and the best page of corpora without one."""
    active = _overrides(spark, root).where("action = 'pin'").select(F.col("target_id").alias("id")).distinct()
    rows = pages(spark, root, "corpus_id", "authority_score")
    pinned = rows.join(active, "id", "left_semi").groupBy("corpus_id").agg(F.min("id").alias("id")).withColumn("source", F.lit("pinned"))
    rest = rows.join(pinned.select("corpus_id"), "corpus_id", "left_anti")
    derived = catalog.first_per_group(rest, ["corpus_id"], [F.desc("authority_score"), F.asc("id")]).select("corpus_id", "id", F.lit("derived").alias("source"))
    return pinned.unionByName(derived)


def serve_states(spark: SparkSession, root: str) -> DataFrame:
    """(serve_state, n_pages): a summary is a page's summary run, a kind its kind run, a quality score its topic run."""
    rows = pages(spark, root, "fetch_status", "summary_ka", "summary_en", "page_kind", "quality_score")
    kinds = F.array(F.when(F.col("summary_ka").isNotNull() | F.col("summary_en").isNotNull(), "summary"), F.when(F.col("page_kind") != "unknown", "page_kind"), F.when(F.col("quality_score").isNotNull(), "topic"))
    runs = rows.select(F.col("id").alias("document_id"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    out = catalog.serve_state(rows.select("id", "fetch_status"), runs, table(spark, root, "document_deletion", "document_id"))
    return out.groupBy("serve_state").agg(F.count("*").alias("n_pages"))


def enrichment_backlog(spark: SparkSession, root: str) -> DataFrame:
    """(id): parsed pages without a summary or without a kind."""
    return pages(spark, root, "fetch_status", "summary_ka", "summary_en", "page_kind").where(PARSED).where("(summary_ka is null and summary_en is null) or page_kind = 'unknown'").select("id")


def orphan_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(id): embedded chunks of portals, of short pages and of pages whose score is neither good nor degraded; a null
    score is not counted."""
    rows = pages(spark, root, "quality_score", "page_kind", F.length("content_text").alias("length"))
    own = chunks(spark, root, "document_id", "embedding_status").where("embedding_status = 'embedded'")
    bad = (~F.col("quality_score").isin("good", "degraded")) | (F.col("page_kind") == "portal") | (F.col("length") < 100)
    return own.join(rows.withColumnRenamed("id", "document_id"), "document_id").where(bad).select("id")


def cluster_match(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, cluster, score, rank): the corpora whose foremost words each turn's message has."""
    rows = pages(spark, root, "corpus_id", text.language_code(F.col("language")).alias("language"), "title").where("language in ('ka', 'en')")
    keywords = catalog.tfidf(rows.select(F.col("corpus_id").alias("cluster"), "language", F.explode(text.terms(F.col("title"))).alias("keyword")), 30)
    queries = once(spark, root, "chat_turn", "id", "user_message").select(F.col("id").alias("query_id"), text.script_language(F.col("user_message")).alias("language"), F.col("user_message").alias("query"))
    matched = catalog.match_clusters(queries, keywords).withColumn("score", F.round(scores.saturated(F.col("raw")), 6))
    return catalog.ranked(matched, ["query_id"], [F.desc("score"), F.asc("cluster")], "rank", 3).select("query_id", "cluster", "score", "rank")


def label_match_capped(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, cluster, rank): per turn the cited pages, at most two with the same first words of their titles."""
    hits = hits_once(spark, root).where("doc is not null").select(F.col("turn_id").alias("query_id"), F.col("doc").alias("cluster"), "score").groupBy("query_id", "cluster").agg(F.max("score").alias("score"))
    titled = hits.join(pages(spark, root, "title").select(F.col("id").alias("cluster"), F.coalesce("title", F.lit("")).alias("label")), "cluster")
    return catalog.capped_matches(titled).select("query_id", "cluster", "rank")


def merged_links(spark: SparkSession, root: str) -> DataFrame:
    """(group, url, source, rank): per corpus its pages of most authority, then its most linked targets."""
    own = catalog.ranked(pages(spark, root, "corpus_id", "canonical_url", "authority_score"), ["corpus_id"], [F.desc("authority_score"), F.asc("id")], "place", 6)
    linked = once(spark, root, "document_link", "id", "corpus_id", "target_url").groupBy("corpus_id", "target_url").agg(F.count("*").alias("n"))
    other = catalog.ranked(linked, ["corpus_id"], [F.desc("n"), F.asc("target_url")], "place", 4)
    return catalog.merge_links(own.select(F.col("corpus_id").alias("group"), F.col("canonical_url").alias("url"), "place"), other.select(F.col("corpus_id").alias("group"), F.col("target_url").alias("url"), "place"))


def authority_normalized(spark: SparkSession, root: str) -> DataFrame:
    """(id, normalized): authority scaled over all pages."""
    return catalog.min_max(pages(spark, root, "authority_score"), "authority_score", "normalized").select("id", F.round("normalized", 6).alias("normalized"))


def lifecycle_report(spark: SparkSession, root: str) -> DataFrame:
    """(fetch_status, n_pages, n_changed): pages by status, and how many changed after they were created."""
    return pages(spark, root, "fetch_status", "created_at", "updated_at").groupBy("fetch_status").agg(F.count("*").alias("n_pages"), F.count_if(F.col("updated_at") > F.col("created_at")).alias("n_changed"))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3))"
_LANG = text.language_code_sql("language")
_OVERRIDES = "o as (select document_id as target_id, case document_id % 4 when 0 then 'exclude' when 1 then 'boost' when 2 then 'demote' else 'pin' end as action, deleted_at + interval 90 days as expires_at from document_deletion)"
_TFIDF = """own as (select cluster, language, keyword, {f} as frequency from terms group by all), scope as (select language, keyword, count(*) as clusters from own group by all),
scored as (select *, frequency / greatest(1, clusters) as score from own join scope using (language, keyword)), r as (select *, row_number() over (partition by cluster, language order by score desc, keyword) as rank from scored)"""

QUERIES = {
    f.__name__: f
    for f in (
        best_page_per_corpus, rank_in_kind, dedupe_keep_highest, topic_keywords, topic_keywords_weighted, topic_summary, curation_overlay, pinned_and_derived, serve_states,
        enrichment_backlog, orphan_vectors, cluster_match, label_match_capped, merged_links, authority_normalized, lifecycle_report,
    )
}
SQL = {
    "best_page_per_corpus": WITH + "select corpus_id, language, id, authority_score from pages where fetch_status = 'parsed' and page_kind = 'portal' qualify row_number() over (partition by corpus_id, language order by authority_score desc, fetched_at desc nulls last, id) = 1",
    "rank_in_kind": WITH + "select corpus_id, page_kind, id, row_number() over (partition by corpus_id, language, page_kind order by authority_score desc, fetched_at desc nulls last, id) as rank from pages where fetch_status = 'parsed'",
    "dedupe_keep_highest": WITH + "select corpus_id, content_hash, max(id) as id from pages where content_hash is not null group by all",
    "topic_keywords": WITH + ", terms as (select corpus_id as cluster, " + _LANG + " as language, unnest(" + _TERMS.format(c="content_text") + ") as keyword from pages where " + _LANG + " in ('ka', 'en')), " + _TFIDF.format(f="count(*)") + " select cluster, language, keyword, frequency, clusters, round(score, 6) as score, rank from r where rank <= 20",
    "topic_keywords_weighted": WITH + ", terms as (select corpus_id as cluster, 'en' as language, unnest(" + _TERMS.format(c="title") + ") as keyword, 1 as weight from pages union all select corpus_id, 'en', unnest(" + _TERMS.format(c="summary_en") + "), 2 from pages), " + _TFIDF.format(f="sum(weight)") + " select cluster, language, keyword, cast(frequency as bigint) as frequency, rank from r where rank <= 10",
    "topic_summary": WITH + ", c as (select document_id, count(*) as n from chunks group by all) select corpus_id, count(*) as n_pages, cast(coalesce(sum(n), 0) as bigint) as n_chunks from pages left join c on c.document_id = pages.id where page_kind is distinct from 'portal' and length(content_text) >= 100 group by corpus_id",
    "curation_overlay": WITH + f", {_OVERRIDES}, a as (select target_id, bool_or(action = 'exclude') as e, bool_or(action = 'boost') as b, bool_or(action = 'demote') as d, bool_or(action = 'pin') as p from o where expires_at is null or expires_at > timestamp '2024-06-01' group by 1) select id, round(least(2.0, greatest(0.5, authority_score * case when b then 1.2 else 1.0 end * case when d then 0.8 else 1.0 end)), 6) as curated, coalesce(p, false) as pinned from pages left join a on a.target_id = pages.id where not coalesce(e, false)",
    "pinned_and_derived": WITH + f", {_OVERRIDES}, p as (select corpus_id, min(id) as id from pages where id in (select target_id from o where action = 'pin') group by 1) select corpus_id, id, 'pinned' as source from p union all select corpus_id, id, 'derived' from (select corpus_id, id, row_number() over (partition by corpus_id order by authority_score desc, id) as n from pages where corpus_id not in (select corpus_id from p)) where n = 1",
    "serve_states": WITH + ", k as (select id, fetch_status, cast(summary_ka is not null or summary_en is not null as int) + cast(coalesce(page_kind <> 'unknown', false) as int) + cast(quality_score is not null as int) as kinds from pages) select case when not coalesce(fetch_status = 'parsed', false) or id in (select document_id from document_deletion) then 'dropped' when kinds = 0 or kinds = 3 then 'live' else 'partial_enriched' end as serve_state, count(*) as n_pages from k group by all",
    "enrichment_backlog": WITH + "select id from pages where fetch_status = 'parsed' and ((summary_ka is null and summary_en is null) or page_kind = 'unknown')",
    "orphan_vectors": WITH + "select c.id from chunks c join pages p on p.id = c.document_id where embedding_status = 'embedded' and (quality_score not in ('good', 'degraded') or page_kind = 'portal' or length(content_text) < 100)",
    "cluster_match": WITH + ", terms as (select corpus_id as cluster, " + _LANG + " as language, unnest(" + _TERMS.format(c="title") + ") as keyword from pages where " + _LANG + " in ('ka', 'en')), " + _TFIDF.format(f="count(*)") + ", q as (select id as query_id, case when length(user_message) - length(regexp_replace(user_message, '[ა-ჿ]', '', 'g')) >= length(user_message) - length(regexp_replace(user_message, '[A-Za-z]', '', 'g')) then 'ka' else 'en' end as language, unnest(" + _TERMS.format(c="user_message") + ") as keyword from turns), m as (select query_id, cluster, round(least(1.0, sum(score) / 5.0), 6) as score from q join r using (language, keyword) where rank <= 30 group by all) select query_id, cluster, score, row_number() over (partition by query_id order by score desc, cluster) as rank from m qualify rank <= 3",
    "label_match_capped": WITH + ", m as (select turn_id as query_id, try_cast(trim(document_id, E' \\t\\n\\r') as bigint) as cluster, max(score) as score from hits where try_cast(trim(document_id, E' \\t\\n\\r') as bigint) is not null group by all), t as (select m.*, array_to_string(string_split(lower(coalesce(title, '')), ' ')[1:2], ' ') as prefix from m join pages on pages.id = m.cluster where score >= 0.1), c as (select *, row_number() over (partition by query_id, prefix order by score desc, cluster) as n from t) select query_id, cluster, row_number() over (partition by query_id order by score desc, cluster) as rank from c where n <= 2 qualify rank <= 5",
    "merged_links": WITH + ", a as (select corpus_id, canonical_url as url, row_number() over (partition by corpus_id order by authority_score desc, id) as place, 0 as source from pages qualify place <= 6), n as (select corpus_id, target_url, count(*) as n from links group by all), b as (select corpus_id, target_url as url, row_number() over (partition by corpus_id order by n desc, target_url) as place, 1 as source from n qualify place <= 4), u as (select * from a union all select * from b), s as (select *, row_number() over (partition by corpus_id, lower(regexp_replace(url, '[/#]+$', '')) order by source, place, url) as n from u) select corpus_id as \"group\", url, source, row_number() over (partition by corpus_id order by source, place, url) as rank from s where n = 1 qualify rank <= 8",
    "authority_normalized": WITH + ", b as (select min(authority_score) as l, max(authority_score) as h from pages) select id, round(case when h > l then (authority_score - l) / (h - l) else 0.5 end, 6) as normalized from pages, b",
    "lifecycle_report": WITH + "select fetch_status, count(*) as n_pages, count(*) filter (updated_at > created_at) as n_changed from pages group by all",
}
