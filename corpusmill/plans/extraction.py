"""Extraction over whole tables: pages rendered to HTML in several forms, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import extraction
from corpusmill.sources.views import WITH, chunks, pages


def _rendered(spark: SparkSession, root: str) -> DataFrame:
    rows = pages(spark, root, "title", "lead_text", F.col("canonical_url").alias("url"), F.col("page_kind").alias("kind"), F.date_format("published_at", "yyyy-MM-dd").alias("day"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>&"\\\p{Cntrl}]', " ")
    title, lead = plain(F.col("title")), plain(F.col("lead_text"))
    data = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"x": 1}, {"@type": "NewsArticle", "datePublished": "'), F.col("day"), F.lit('", "breadcrumb": {"itemListElement": [{"name": "Home"}, {"name": "News"}]}}]}</script>'))
    time = F.concat(F.lit('<time datetime="'), F.col("day"), F.lit('">day</time>'))
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit(" - site</title>"), F.when(F.col("id") % 11 == 0, '<meta name="robots" content="NOINDEX">').otherwise(""), F.when(F.col("id") % 3 == 0, F.coalesce(data, F.lit(""))).otherwise(""),
        F.lit('</head><body><nav><p>menu</p></nav><div class="breadcrumb"><a>A</a><a>B</a></div><article><h1>'), title, F.lit("</h1>"), F.when(F.col("id") % 3 == 1, F.coalesce(time, F.lit(""))).otherwise(""), F.lit("<p>"), lead, F.lit("<p>second<ul><li><p>item</p></ul></article><p>after</p><footer><p>foot</p></footer></body></html>"),
    )
    return rows.select("id", html.alias("html"), "url", F.lit("").alias("corpus"), "kind")


def extraction_strategies(spark: SparkSession, root: str) -> DataFrame:
    """(id, strategy, title, body, n_blocks, breadcrumb, language, noindex, type, published): each page under its kind's
    strategy; datasets by the legacy profile."""
    registry = extraction.Registry((("", "news", extraction.NEWS), ("", "dataset", extraction.LEGACY)))
    rows = extraction.extracted(_rendered(spark, root), registry)
    return rows.select("id", *(F.col(f"x.{n}").alias(n) for n in ("strategy", "title", "body", "n_blocks", "breadcrumb", "language", "noindex", "type", "published")))


def chunk_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_id, metadata): what goes with each chunk."""
    documents = pages(spark, root, "language", "page_kind", "title", F.substring(F.trim("lead_text"), 1, 80).alias("description"))
    documents = documents.select(F.col("id").alias("document_id"), "language", F.col("page_kind").alias("section_path"), F.lit(None).cast("string").alias("breadcrumb"), "title", "description")
    out = extraction.chunk_metadata(chunks(spark, root, "document_id").withColumnRenamed("id", "chunk_id"), documents)
    return out.select("chunk_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("metadata"))


def language_fallbacks(spark: SparkSession, root: str) -> DataFrame:
    """(id, language, status): pages without a label get the default one and are degraded."""
    language, status = extraction.language_fallback(F.col("language"))
    return pages(spark, root, "language").select("id", language.alias("language"), status.alias("status"))


QUERIES = {f.__name__: f for f in (extraction_strategies, chunk_metadata, language_fallbacks)}
_PLAIN = "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[<>&\"\\\\[:cntrl:]]', ' ', 'g'), '\\s+', ' ', 'g'))"
_EXPECTED = f"""e as (select id, page_kind as kind, canonical_url as url, strftime(published_at, '%Y-%m-%d') as day, {_PLAIN.format(c='title')} as t, {_PLAIN.format(c='lead_text')} as l, id % 11 = 0 as noindex from pages),
b as (select *, case when kind = 'news' then 'news' when kind = 'dataset' then 'legacy' else 'default' end as strategy, list_filter(list_concat([t, l, 'second', 'item'], case when kind = 'dataset' then ['after'] else [] end), lambda x: x <> '') as blocks from e)"""
SQL = {
    "extraction_strategies": WITH + f""", {_EXPECTED} select id, strategy, case when noindex then null when strategy = 'legacy' or t = '' then trim(t || ' - site') else t end as title, case when not noindex then array_to_string(blocks, chr(10) || chr(10)) end as body, case when noindex then 0 else len(blocks) end as n_blocks, case when not noindex then 'A > B' end as breadcrumb,
case when not noindex then coalesce(nullif(regexp_extract(url, '/(ka|en)(?:/|$)', 1), ''), 'ka') end as language, noindex, case when not noindex and id % 3 = 0 and day is not null then 'NewsArticle' end as type, case when not noindex and id % 3 < 2 then day end as published from b""",
    "language_fallbacks": WITH + "select id, case when coalesce(trim(language), '') = '' then 'ka' else language end as language, case when coalesce(trim(language), '') = '' then 1 else 0 end as status from pages",
    "chunk_metadata": WITH + "select c.id as chunk_id, concat_ws('|', 'description=' || nullif(trim(substring(trim(lead_text), 1, 80)), ''), 'language=' || nullif(trim(language), ''), 'section_path=' || nullif(trim(page_kind), ''), 'title=' || nullif(trim(title), '')) as metadata from chunks c join pages p on p.id = c.document_id",
}
