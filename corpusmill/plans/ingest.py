"""Ingest operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text, urls
from corpusmill.operators import ingest
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, links, once, pages

MARKERS = ["cookie", "ქუქი", "all rights reserved", "ყველა უფლება", "newsletter", "გამოიწერეთ"]
HOSTS = ["stat-hub.example", "stat-b.example"]


def chunk_fixed_size(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, sequence_no, text, n_chars): every document's fixed-size chunks."""
    return ingest.chunk_texts(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")


def validation(spark: SparkSession, root: str) -> DataFrame:
    """(id, min_length, truncation, repetition, status): the validators' ordinals and the worst of them."""
    body, kind = F.col("content_text"), F.col("page_kind")
    rows = pages(spark, root, "content_text", "page_kind").select(
        "id", ingest.min_length_status(body, kind).alias("min_length"), ingest.truncation_status(body).alias("truncation"), F.coalesce(ingest.repetition_status(body), F.lit(0)).alias("repetition")
    )
    return rows.withColumn("status", ingest.worst_status(F.col("min_length"), F.col("truncation"), F.col("repetition")))


def quality_gate(spark: SparkSession, root: str) -> DataFrame:
    """(id, paragraphs, marked, verdict): the corpus gate."""
    body = F.col("content_text")
    parts, marked = ingest.boilerplate_counts(body, MARKERS)
    return pages(spark, root, "content_text").select("id", F.coalesce(parts, F.lit(0)).alias("paragraphs"), F.coalesce(marked, F.lit(0)).alias("marked"), F.coalesce(ingest.gate(body, MARKERS), F.lit("TOO_SHORT")).alias("verdict"))


def boilerplate_strip(spark: SparkSession, root: str) -> DataFrame:
    """(id, body): pages without marked paragraphs."""
    return pages(spark, root, "content_text").select("id", ingest.strip_boilerplate(F.col("content_text"), MARKERS).alias("body"))


def paragraph_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """(id, body): pages without repeated paragraphs."""
    return pages(spark, root, "content_text").select("id", ingest.distinct_paragraphs(F.col("content_text")).alias("body"))


def html_extract(spark: SparkSession, root: str) -> DataFrame:
    """(id, title, body, n_links, section, noindex, kind): pages rendered to HTML and extracted again."""
    rows = pages(spark, root, "title", "content_text", "canonical_url")
    html = F.concat(
        F.lit("<html lang='ka'><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav><a href='"), F.col("canonical_url"), F.lit("'>menu</a></nav><article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"),
        F.regexp_replace(F.regexp_replace(F.coalesce("content_text", F.lit("")), "[<>&]", " "), "\n+", "</p><p>"), F.lit("</p></article><footer>foot</footer></body></html>"),
    )
    got = rows.select("id", ingest.extract_html(html).alias("x"))
    return got.select("id", "x.title", "x.body", F.size("x.links").alias("n_links"), F.array_join("x.section_path", " > ").alias("section"), "x.noindex", "x.kind")


def page_kinds(spark: SparkSession, root: str) -> DataFrame:
    """(id, url_kind, sure, kind): by address, else as stored."""
    kind, sure = ingest.page_kind(F.col("canonical_url"))
    return pages(spark, root, "canonical_url", "page_kind").select("id", kind.alias("url_kind"), sure.alias("sure"), F.coalesce(kind, "page_kind").alias("kind"))


def link_discovery(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, url, url_hash, depth): each page's links to allowed hosts."""
    rows = links(spark, root, "source_doc_id", "target_url").groupBy(F.col("source_doc_id").alias("source_id")).agg(F.collect_set("target_url").alias("links"))
    return ingest.discovered_links(rows.withColumn("depth", F.lit(0)), HOSTS, 2)


def frontier_enqueue(spark: SparkSession, root: str) -> DataFrame:
    """(url, url_hash, verdict): link targets against the pages already there."""
    known = pages(spark, root, "canonical_url").select(urls.url_hash(urls.normalize_url(F.col("canonical_url"))).alias("url_hash"))
    return ingest.enqueue(table(spark, root, "document_link", F.col("target_url").alias("url")), known, HOSTS)


def frontier_resume(spark: SparkSession, root: str) -> DataFrame:
    """(url, url_hash): the 500 oldest unresolved targets."""
    u = urls.normalize_url(F.col("target_url"))
    queued = links(spark, root, "target_url", "target_doc_id", "discovered_at").where("target_doc_id is null").groupBy(u.alias("url"), urls.url_hash(u).alias("url_hash")).agg(F.min("discovered_at").alias("discovered_at"))
    known = pages(spark, root, "canonical_url").select(urls.url_hash(urls.normalize_url(F.col("canonical_url"))).alias("url_hash"))
    return ingest.resume_frontier(queued, known).select("url", "url_hash")


def change_detection(spark: SparkSession, root: str) -> DataFrame:
    """(change, n_pages): stored hashes against hashes of the stored texts."""
    rows = pages(spark, root, text.content_hash(F.col("content_text")).alias("fetched"), "content_hash")
    return ingest.changed_pages(rows.select("id", F.col("fetched").alias("content_hash")), rows).groupBy("change").agg(F.count("*").alias("n_pages"))


def late_link_resolution(spark: SparkSession, root: str) -> DataFrame:
    """(id, target_doc_id): links with unresolved targets filled in by address, the lowest id of several pages."""
    targets = pages(spark, root, "canonical_url").groupBy(urls.source_key(F.col("canonical_url")).alias("key")).agg(F.min("id").alias("found"))
    rows = links(spark, root, "target_url", "target_doc_id")
    open_ = rows.where("target_doc_id is null").withColumn("key", urls.source_key(urls.normalize_url(F.col("target_url")))).join(targets, "key", "left")
    done = rows.where("target_doc_id is not null").select("id", F.col("target_doc_id").cast("long").alias("target_doc_id"))
    return open_.select("id", F.col("found").alias("target_doc_id")).unionByName(done)


def stuck_recovery(spark: SparkSession, root: str) -> DataFrame:
    """(id, fetch_status): pages parsing for more than 30 minutes are pending again."""
    old = F.col("updated_at") < as_of() - F.expr("interval 30 minutes")
    status = F.when((F.col("fetch_status") == "parsing") & (old | F.col("updated_at").isNull()), "pending").otherwise(F.col("fetch_status"))
    return pages(spark, root, "fetch_status", "updated_at").select("id", status.alias("fetch_status"))


def stale_pages(spark: SparkSession, root: str) -> DataFrame:
    """(id, fetched_at): the 50 pages fetched longest ago, at least 24 hours."""
    rows = pages(spark, root, "fetched_at", "fetch_status").where((F.col("fetched_at") < as_of() - F.expr("interval 24 hours")) & (F.col("fetch_status") == "parsed"))
    return rows.orderBy("fetched_at", "id").limit(50).select("id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched_at"))


def embedding_queue(spark: SparkSession, root: str) -> DataFrame:
    """(id, reason): chunks to embed again: stuck for 10 minutes, or of no or another model."""
    stuck = (F.col("embedding_status") == "pending") & (F.col("created_at") < as_of() - F.expr("interval 10 minutes"))
    stale = F.col("embedding_model").isNull() | (F.col("embedding_model") != "hash-v1")
    reason = F.when(stuck, "stuck").when(stale, "stale_model")
    return chunks(spark, root, "embedding_status", "embedding_model", "created_at").select("id", reason.alias("reason")).where("reason is not null")


_NORM = """case when regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) = '' then {u} else lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))
 || case when regexp_replace(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') = '' then '/' else regexp_replace(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') end
 || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({t})), '&'), ''), '') end"""


def _normal(column: str) -> str:
    return _NORM.format(u=column, t=", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS))


_HOST_OK = "regexp_matches(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '(^|\\.)(stat-hub\\.example|stat-b\\.example)$')"
_BINARY = "regexp_matches(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '\\.(" + "|".join(urls.BINARY_EXTENSIONS) + ")$')"
_STAT = text.STATISTICAL
_MARKED = "|".join(MARKERS)
_PATH = "lower(regexp_extract(canonical_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"

QUERIES = {
    f.__name__: f
    for f in (chunk_fixed_size, validation, quality_gate, boilerplate_strip, paragraph_dedupe, html_extract, page_kinds, link_discovery, frontier_enqueue, frontier_resume, change_detection, late_link_resolution, stuck_recovery, stale_pages, embedding_queue)
}
#: A text without its outer white space, as Python sees it.
_STRIP = "regexp_replace(regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '')"
SQL = {
    "chunk_fixed_size": f"""with recursive t as (select doc_id, {_STRIP.format(x='text')} as t from documents where text is not null),
r as (select doc_id, t, -1::bigint as s, -1::bigint as e, 0::bigint as n from t where t <> '' union all
select doc_id, t, s, case when last then length(t) when p is not null then p + 2 when b is not null then b else s + 800 end as e, case when last then null when p is not null then p + 2 when b is not null then b + 1 else s + 680 end as n from (
select doc_id, t, n as s, length(t) - n <= 800 as last, case when regexp_matches(substring(t, n + 202, 601), '\n\n') then n + 201 + length(regexp_extract(substring(t, n + 202, 601), '(?s)^(.*)\n\n', 1)) end as p,
case when contains(substring(t, n + 202, 600), ' ') then n + 201 + length(regexp_extract(substring(t, n + 202, 600), '(?s)^(.*) ', 1)) end as b from r where n < length(t))),
c as (select doc_id, s, {_STRIP.format(x='substring(t, s + 1, e - s)')} as text from r where s >= 0)
select doc_id, row_number() over (partition by doc_id order by s) - 1 as sequence_no, text, length(text) as n_chars from c where text <> ''""",
    "quality_gate": WITH + f""", p as (select id, content_text, list_filter(regexp_split_to_array(content_text, '\\s{{2,}}|\\n+'), lambda p: trim(p) <> '') as parts from pages),
m as (select id, content_text, coalesce(len(parts), 0) as paragraphs, coalesce(len(list_filter(parts, lambda p: not regexp_matches(p, '{_STAT}') and regexp_matches(lower(p), '{_MARKED}'))), 0) as marked from p)
select id, paragraphs, marked, case when coalesce(length(trim(content_text)), 0) < 200 then 'TOO_SHORT' when marked > 0.6 * paragraphs then 'BOILERPLATE_ONLY' else 'ACCEPT' end as verdict from m""",
    "boilerplate_strip": WITH + f"""select id, array_to_string(list_filter(list_filter(list_transform(regexp_split_to_array(content_text, '\\s{{2,}}|\\n+'), lambda p: trim(p)), lambda p: p <> ''), lambda p: regexp_matches(p, '{_STAT}') or not regexp_matches(lower(p), '{_MARKED}')), ' ') as body from pages""",
    "validation": WITH + """, b as (select id, page_kind, coalesce(trim(content_text), '') as b, trim(content_text) as t, list_filter(list_transform(regexp_split_to_array(content_text, '[\\r\\n]{2,}'), lambda p: trim(p)), lambda p: p <> '') as parts from pages),
k as (select *, list_transform(parts, lambda p: lower(regexp_replace(p, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as keys from b),
v as (select id, case when length(b) < 30 then 3 when coalesce(page_kind = 'portal', false) then 2 when length(b) < 100 then 1 else 0 end as min_length,
 case when length(t) >= 200 and not (regexp_matches(right(t, 40), '[.!?…:;)\\]»”"]$') or regexp_matches(right(t, 40), '(^|\\s)\\S{1,4}$')) then 1 else 0 end as truncation,
 case when coalesce(len(list_filter(keys, lambda x, i: not (length(x) < 25 or list_position(keys, x) = i))), 0) > 0 then 1 else 0 end as repetition from k)
select id, min_length, truncation, repetition, ['GOOD', 'DEGRADED', 'SKIP', 'REJECT'][greatest(min_length, truncation, repetition) + 1] as status from v""",
    "page_kinds": WITH + f""", k as (select id, page_kind, {_PATH} as p from pages), u as (select id, page_kind, case when contains(p, '/news/') or contains(p, '/newsroom/') then 'news' when regexp_matches(p, '\\.(csv|xls|xlsx|json|xml|zip)$') or contains(p, '/download/') or contains(p, '/microdata/') then 'dataset'
 when regexp_matches(p, '\\.(pdf|doc|docx)$') or contains(p, '/publications/') or contains(p, '/publication/') then 'report' when contains(p, '/faq') or ends_with(p, '/questions') then 'faq' when regexp_matches(p, '/sitemap|/about-us|/about/|/contact|/privacy|/terms|/search$') then 'navigation'
 when regexp_matches(p, '^/(ka|en)/?$|^/(ka|en)/modules/categories/?$') then 'portal' end as url_kind from k)
select id, url_kind, cast(case url_kind when 'news' then 0.95 when 'dataset' then 0.95 when 'report' then 0.92 when 'faq' then 0.9 when 'navigation' then 0.9 when 'portal' then 0.88 end as double) as sure, coalesce(url_kind, page_kind) as kind from u""",
    "link_discovery": WITH + f"""select distinct source_doc_id as source_id, {_normal('target_url')} as url, sha256({_normal('target_url')}) as url_hash, 1 as depth from links where {_HOST_OK.format(u='target_url')} and regexp_matches(lower(target_url), '^https?://') and not {_BINARY.format(u='target_url')}""",
    "frontier_enqueue": WITH + f""", n as (select distinct target_url as url, sha256(trim({_normal('target_url')})) as url_hash from document_link), f as (select url_hash, min(url) as first_url from n group by all), k as (select distinct sha256(trim({_normal('canonical_url')})) as url_hash from pages)
select n.url, n.url_hash, case when not {_HOST_OK.format(u='n.url')} then 'rejected' when k.url_hash is not null or n.url <> f.first_url then 'duplicate' else 'enqueued' end as verdict from n join f using (url_hash) left join k on k.url_hash = n.url_hash""",
    "frontier_resume": WITH + f""", q as (select {_normal('target_url')} as url, min(discovered_at) as d from links where target_doc_id is null group by 1), k as (select {_normal('canonical_url')} as url from pages)
select url, sha256(url) as url_hash from q where url not in (select url from k) order by d, sha256(url) limit 500""",
    "change_detection": WITH + """select case when content_hash is not distinct from case when lower(trim(regexp_replace(content_text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) <> '' then sha256(lower(trim(regexp_replace(content_text, '[ \\t\\n\\r\\f]+', ' ', 'g')))) end then 'unchanged' else 'changed' end as change, count(*) as n_pages from pages group by all""",
    "late_link_resolution": WITH + f""", t as (select lower(regexp_replace(regexp_replace(canonical_url, '#.*$', ''), '/+$', '')) as key, min(id) as found from pages group by 1), l as (select *, lower(regexp_replace(regexp_replace({_normal('target_url')}, '#.*$', ''), '/+$', '')) as key from links)
select l.id, coalesce(cast(target_doc_id as bigint), t.found) as target_doc_id from l left join t on l.key = t.key""",
    "stuck_recovery": WITH + f"select id, case when fetch_status = 'parsing' and (updated_at < timestamp '{AS_OF}' - interval 30 minutes or updated_at is null) then 'pending' else fetch_status end as fetch_status from pages",
    "stale_pages": WITH + f"select id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') as fetched_at from pages where fetched_at < timestamp '{AS_OF}' - interval 24 hours and fetch_status = 'parsed' order by fetched_at, id limit 50",
    "embedding_queue": WITH + f"select id, case when embedding_status = 'pending' and created_at < timestamp '{AS_OF}' - interval 10 minutes then 'stuck' else 'stale_model' end as reason from chunks where (embedding_status = 'pending' and created_at < timestamp '{AS_OF}' - interval 10 minutes) or embedding_model is null or embedding_model <> 'hash-v1'",
    "paragraph_dedupe": WITH + """, b as (select id, content_text, list_filter(list_transform(regexp_split_to_array(content_text, '[\\r\\n]{2,}'), lambda p: trim(p)), lambda p: p <> '') as parts from pages),
k as (select *, list_transform(parts, lambda p: lower(regexp_replace(p, '[ \\t\\n\\r\\f]+', ' ', 'g'))) as keys from b)
select id, array_to_string(list_filter(parts, lambda p, i: length(keys[i]) < 25 or list_position(keys, keys[i]) = i), chr(10) || chr(10)) as body from k""",
}
