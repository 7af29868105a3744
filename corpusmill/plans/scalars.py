"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scores, text, urls
from corpusmill.operators.catalog import ranked
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, links, once, pages


def url_keys(spark: SparkSession, root: str) -> DataFrame:
    """(target_url, normalized, source_key, url_hash, locale, path_key, host, is_binary) of each distinct address."""
    u = F.col("target_url")
    return table(spark, root, "document_link", "target_url").distinct().select(
        u, urls.normalize_url(u).alias("normalized"), urls.source_key(u).alias("source_key"), urls.url_hash(u).alias("url_hash"),
        urls.url_locale(u).alias("locale"), urls.locale_path_key(u).alias("path_key"), urls.url_host(u).alias("host"), urls.is_binary_url(u).alias("is_binary"),
    )


def url_policy(spark: SparkSession, root: str) -> DataFrame:
    """(host_rule, allowed, n_urls): addresses by what a crawl policy says."""
    u = F.col("target_url")
    allowed = urls.url_allowed(u, ["stat-hub.example", "stat-b.example"], "all", exclude=["/print", "utm_source"], curated=["https://portal.stat-hub.example/ka"])
    rows = table(spark, root, "document_link", "target_url").distinct()
    return rows.groupBy(urls.host_allowed(u, ["stat-hub.example", "stat-b.example"], "all").alias("host_rule"), allowed.alias("allowed")).agg(F.count("*").alias("n_urls"))


def locale_rewrite(spark: SparkSession, root: str) -> DataFrame:
    """(id, canonical_url, en_url, ka_url, locale): each page's address in both languages."""
    u = F.col("canonical_url")
    return pages(spark, root, "canonical_url").select("id", u, urls.rewrite_locale(u, "en").alias("en_url"), urls.rewrite_locale(u, "ka").alias("ka_url"), urls.url_locale(u).alias("locale"))


def collection_names(spark: SparkSession, root: str) -> DataFrame:
    """(id, collection): the vector collection of each corpus."""
    name = F.concat(F.lit(" Corpus: "), F.col("corpus_name"), F.lit(" (ka/en) "))
    return table(spark, root, "ingestion_corpus", "id", "corpus_name").select("id", urls.collection_name(name).alias("collection"))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(id, text_hash, content_hash, token_estimate, n_chars) of each chunk."""
    t = F.col("text")
    return chunks(spark, root, "text").select("id", urls.url_hash(t).alias("text_hash"), text.content_hash(t).alias("content_hash"), text.token_estimate(t).alias("token_estimate"), F.length(t).alias("n_chars"))


def script_languages(spark: SparkSession, root: str) -> DataFrame:
    """(id, detected, hinted, mismatch) of each page."""
    t = F.col("content_text")
    return pages(spark, root, "content_text", "language", "canonical_url").select(
        "id", text.script_language(t).alias("detected"), text.script_language(t, F.coalesce("language", F.lit(""))).alias("hinted"), F.coalesce(text.encoding_mismatch(F.col("canonical_url"), t), F.lit(False)).alias("mismatch")
    )


def statistical_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(id, is_statistical) of each chunk."""
    return chunks(spark, root, "text").select("id", text.is_statistical(F.col("text")).alias("is_statistical"))


def display_texts(spark: SparkSession, root: str) -> DataFrame:
    """(id, description, excerpt, summary) of each page."""
    return pages(spark, root, "lead_text", "title", "summary_ka", "summary_en", "language").select(
        "id",
        text.display_description(F.lit(None).cast("string"), F.col("lead_text"), F.col("title"), F.lit("")).alias("description"),
        text.excerpt(F.col("lead_text"), 120).alias("excerpt"),
        F.when(F.col("language") == "en", text.first_non_blank(F.col("summary_en"), F.col("summary_ka"))).otherwise(text.first_non_blank(F.col("summary_ka"), F.col("summary_en"))).alias("summary"),
    )


def sanitized(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, sanitized, block) of each document."""
    t = F.col("text")
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", text.sanitize(t).alias("sanitized"), text.sanitize_block(t).alias("block"))


def normalized_queries(spark: SparkSession, root: str) -> DataFrame:
    """(id, query, patterns) of each chat turn: NFKC, single blanks, English ones in lower case; at most 8 search patterns."""
    plain = text.normalized_query(F.col("user_message"), text.script_language(F.col("user_message")))
    return once(spark, root, "chat_turn", "id", "user_message").select("id", plain.alias("query"), F.array_join(text.search_patterns(F.coalesce(plain, F.lit(""))), "|").alias("patterns"))


def seed_urls(spark: SparkSession, root: str) -> DataFrame:
    """(id, seed_no, seed_url): the JSON lists of seeds, one row a seed."""
    rows = table(spark, root, "ingestion_corpus", "id", "seed_urls")
    return rows.select("id", F.posexplode(F.from_json("seed_urls", "array<string>")).alias("seed_no", "seed_url"))


def freshness(spark: SparkSession, root: str) -> DataFrame:
    """(id, decay, boost, authority, locale_score) of each page as of a given time."""
    at, now = F.col("fetched_at"), as_of()
    decay = scores.freshness_decay(at, now)
    return pages(spark, root, "fetched_at", "authority_score", "page_kind").select(
        "id", F.round(decay, 6).alias("decay"), scores.freshness_boost(at, now).alias("boost"),
        F.round(scores.authority(F.col("authority_score"), decay, F.col("page_kind") == "navigation"), 6).alias("authority"),
    )


def confidence_tiers(spark: SparkSession, root: str) -> DataFrame:
    """(turn_id, top, tier, route): how sure each turn's results are."""
    hits = once(spark, root, "retrieval_hit", "hit_id", "turn_id", "score", key="hit_id")
    best = ranked(hits, ["turn_id"], [F.desc("score"), F.asc("hit_id")], "place", 2)
    rows = best.groupBy("turn_id").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    tier = scores.confidence(F.col("top"), F.col("second"))
    return rows.select("turn_id", F.round("top", 6).alias("top"), tier.alias("tier"), scores.route(tier).alias("route"))


def violation_codes(spark: SparkSession, root: str) -> DataFrame:
    """(code, n_pages): how many pages have each violation."""
    codes = pages(spark, root, "validation_violations").select("id", F.explode("validation_violations").alias("violation"))
    return codes.select("id", F.trim(F.substring_index("violation", ":", 1)).alias("code")).distinct().groupBy("code").agg(F.count("*").alias("n_pages"))


def cleaned_answers(spark: SparkSession, root: str) -> DataFrame:
    """(id, answer): chunk texts as an answer would show them."""
    return chunks(spark, root, "text").select("id", text.strip_markup(F.col("text"), fallback="-").alias("answer"))


_PATHS = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"
_TRACK = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
_SQL_URL = f"""select target_url, regexp_extract(target_url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) as scheme, lower(regexp_extract(target_url, '{_HOST}', 1)) as host,
 regexp_extract(target_url, '{_PATHS}', 1) as path, regexp_extract(target_url, '^[^?#]*\\?([^#]*)', 1) as query from (select distinct target_url from document_link)"""
_ALLOWED_HOST = "(host in ('stat-hub.example','stat-b.example') or ends_with(host,'.stat-hub.example') or ends_with(host,'.stat-b.example'))"
_WS = r"'[ \t\n\r\f]+'"
_INVISIBLE = text.INVISIBLE

QUERIES = {
    f.__name__: f
    for f in (url_keys, url_policy, locale_rewrite, collection_names, content_hashes, script_languages, statistical_chunks, display_texts, sanitized, normalized_queries, seed_urls, freshness, confidence_tiers, violation_codes, cleaned_answers)
}
SQL = {
    "cleaned_answers": WITH + f"""select id, case when length(p) >= 15 then p else '-' end as answer from (select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*[-*•]\\s*https?://\\S+\\s*$', '', 'g'), '\\[([^\\]]*)\\]\\(https?://[^)]*\\)', '\\1', 'g'), 'https?://\\S+', '', 'g'), {_WS}, ' ', 'g')) as p from chunks)""",
    "url_keys": f"""with u as ({_SQL_URL}), k as (select *, list_filter(string_split(query, '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_TRACK})) as kept from u)
select target_url, case when host = '' then target_url else lower(scheme) || '://' || host || case when regexp_replace(path, '/$', '') = '' then '/' else regexp_replace(path, '/$', '') end
 || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as normalized,
 lower(regexp_replace(regexp_replace(target_url, '#.*$', ''), '/+$', '')) as source_key, sha256(trim(coalesce(target_url, ''))) as url_hash,
 case when regexp_matches(path, '(^|/)en(/|$)') then 'en' when regexp_matches(path, '(^|/)ka(/|$)') then 'ka' end as locale,
 lower(regexp_replace(path, '^/(ka|en)(/|$)', '/')) as path_key, host, regexp_matches(lower(path), '\\.({"|".join(urls.BINARY_EXTENSIONS)})$') as is_binary from k""",
    "url_policy": f"""with u as ({_SQL_URL}) select {_ALLOWED_HOST} as host_rule, (lower(target_url) = 'https://portal.stat-hub.example/ka' or (lower(scheme) in ('http','https') and {_ALLOWED_HOST}
 and not contains(path || '?' || query, '/print') and not contains(path || '?' || query, 'utm_source'))) as allowed, count(*) as n_urls from u group by all""",
    "locale_rewrite": WITH + f"""select id, canonical_url, regexp_replace(replace(canonical_url, '/ka/', '/en/'), '/ka$', '/en') as en_url, regexp_replace(replace(canonical_url, '/en/', '/ka/'), '/en$', '/ka') as ka_url,
 case when regexp_matches(regexp_extract(canonical_url, '{_PATHS}', 1), '(^|/)en(/|$)') then 'en' when regexp_matches(regexp_extract(canonical_url, '{_PATHS}', 1), '(^|/)ka(/|$)') then 'ka' end as locale from pages""",
    "collection_names": """select id, regexp_replace(regexp_replace(regexp_replace(lower(trim(' Corpus: ' || corpus_name || ' (ka/en) ')), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as collection from ingestion_corpus""",
    "content_hashes": WITH + f"""select id, sha256(trim(coalesce(text, ''))) as text_hash, case when lower(trim(regexp_replace(text, {_WS}, ' ', 'g'))) <> '' then sha256(lower(trim(regexp_replace(text, {_WS}, ' ', 'g')))) end as content_hash,
 case when coalesce(trim(text), '') = '' then 0 else greatest(1, cast(ceil(length(text) / 4.0) as int)) end as token_estimate, length(text) as n_chars from chunks""",
    "script_languages": WITH + """, c as (select id, content_text as t, canonical_url, lower(split_part(coalesce(language, ''), '-', 1)) as h, length(content_text) - length(regexp_replace(content_text, '[ა-ჿ]', '', 'g')) as g, length(content_text) - length(regexp_replace(content_text, '[A-Za-z]', '', 'g')) as l from pages)
select id, case when coalesce(t, '') = '' then 'ka' when g >= l then 'ka' else 'en' end as detected,
 case when h in ('ka', 'en') and (coalesce(trim(t), '') = '' or (g = 0 and l = 0)) then h when coalesce(trim(t), '') = '' or (g = 0 and l = 0) then 'ka' when h = 'en' and l >= g then 'en' when h = 'ka' and g >= l then 'ka' when g >= l then 'ka' else 'en' end as hinted,
 coalesce(contains(canonical_url, '/ka/') and coalesce(trim(t), '') <> '' and not regexp_matches(t, '[Ⴀ-ჿⴀ-⴯]'), false) as mismatch from c""",
    "statistical_chunks": WITH + f"select id, coalesce(regexp_matches(text, '{text.STATISTICAL}'), false) as is_statistical from chunks",
    "display_texts": WITH + f"""select id, case when length(trim(lead_text)) >= 40 then case when length(trim(lead_text)) > 240 then substring(trim(lead_text), 1, 237) || '...' else trim(lead_text) end when length(trim(title)) > 240 then substring(trim(title), 1, 237) || '...' else trim(title) end as description,
 case when length(trim(regexp_replace(lead_text, {_WS}, ' ', 'g'))) <= 120 then trim(regexp_replace(lead_text, {_WS}, ' ', 'g')) else
  case when length(regexp_extract(substring(trim(regexp_replace(lead_text, {_WS}, ' ', 'g')), 1, 120), '^(.*) ', 1)) > 60 then regexp_extract(substring(trim(regexp_replace(lead_text, {_WS}, ' ', 'g')), 1, 120), '^(.*) ', 1) else substring(trim(regexp_replace(lead_text, {_WS}, ' ', 'g')), 1, 120) end || '...' end as excerpt,
 case when language = 'en' then coalesce(nullif(trim(summary_en), ''), nullif(trim(summary_ka), '')) else coalesce(nullif(trim(summary_ka), ''), nullif(trim(summary_en), '')) end as summary from pages""",
    "seed_urls": """select id, unnest(range(len(s))) as seed_no, unnest(s) as seed_url from (select id, from_json(seed_urls, '["VARCHAR"]') as s from ingestion_corpus)""",
    "freshness": WITH + f""", a as (select *, (epoch_us(timestamp '{AS_OF}') - epoch_us(fetched_at)) / 86400000000.0 as age from pages)
select id, round(case when age >= 0 then exp(-age / 365.0) else 0.0 end, 6) as decay, cast(case when floor(age) <= 30 then 0.08 when floor(age) <= 180 then 0.04 when floor(age) <= 365 then 0.02 else 0.0 end as double) as boost,
 round(case when coalesce(page_kind = 'navigation', false) then 0.0 else 0.7 * authority_score + 0.3 * case when age >= 0 then exp(-age / 365.0) else 0.0 end end, 6) as authority from a""",
    "confidence_tiers": WITH + """, r as (select turn_id, score, row_number() over (partition by turn_id order by score desc) as rn from hits), t as (select turn_id, max(score) filter (rn = 1) as top, max(score) filter (rn = 2) as second from r group by turn_id),
c as (select turn_id, top, case when top > 0.75 and top - coalesce(second, 0.0) > 0.05 then 'HIGH' when top > 0.55 then 'MEDIUM' when top > 0.35 then 'LOW' else 'NONE' end as tier from t)
select turn_id, round(top, 6) as top, tier, case tier when 'HIGH' then 'cite' when 'MEDIUM' then 'suggest' when 'LOW' then 'clarify' else 'refuse' end as route from c""",
    "violation_codes": WITH + """select code, count(*) as n_pages from (select distinct id, trim(split_part(v, ':', 1)) as code from (select id, unnest(validation_violations) as v from pages)) group by code""",
}
