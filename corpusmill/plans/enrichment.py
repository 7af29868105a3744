"""Enrichment over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import scores
from corpusmill.operators import enrichment
from corpusmill.operators.catalog import first_per_group
from corpusmill.session import materialize
from corpusmill.sources.tables import table
from corpusmill.sources.views import WITH, links, once, pages

ROUNDS = 20


def keywords(spark: SparkSession, root: str) -> DataFrame:
    """(id, place, keyword, score): the keyphrases of each page's whole text, then of its locale pair's, those fit for a
    catalog."""
    rows = pages(spark, root, "content_text", "locale_pair_doc_id").where(F.col("content_text").rlike(r"\S"))
    found = materialize(enrichment.keywords(rows, "id", "content_text"), "keywords")
    merged = enrichment.merged_keywords(found, rows.select("id", F.col("locale_pair_doc_id").cast("long").alias("pair")))
    return merged.where(enrichment.kept_keywords(F.col("keyword"), ["the", "and", "for", "და", "რომ"])).select("id", "place", "keyword", F.round("score", 6).alias("score"))


def page_rank(spark: SparkSession, root: str) -> DataFrame:
    """(id, rank): twenty rounds over resolved links between parsed pages that are no navigation."""
    nodes = pages(spark, root, "fetch_status", "page_kind").where("fetch_status = 'parsed' and page_kind <> 'navigation'").select("id")
    edges = links(spark, root, "source_doc_id", "target_doc_id").where("target_doc_id is not null").select(F.col("source_doc_id").alias("src"), F.col("target_doc_id").cast("long").alias("dst"))
    return enrichment.page_rank(edges, nodes, ROUNDS).select("id", F.round("rank", 9).alias("rank"))


def authority(spark: SparkSession, root: str) -> DataFrame:
    """(id, authority): link rank and freshness, composed."""
    from corpusmill.operators.catalog import min_max
    from corpusmill.sources.views import as_of

    ranks = min_max(page_rank(spark, root), "rank", "scaled")
    rows = pages(spark, root, "fetched_at", "page_kind").join(ranks, "id", "left")
    fresh = scores.freshness_decay(F.col("fetched_at"), as_of())
    return rows.select("id", F.round(scores.authority(F.coalesce("scaled", F.lit(0.0)), fresh, F.col("page_kind") == "navigation"), 6).alias("authority"))


def kmeans_topics(spark: SparkSession, root: str) -> DataFrame:
    """(cluster, n, mean_cost): k-means over all vectors."""
    vectors = table(spark, root, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    assigned, _ = enrichment.topics(vectors)
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 6).alias("mean_cost"))


def locale_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(host, path_key, ka_id, en_id): pages paired by their paths."""
    return enrichment.locale_pairs(pages(spark, root, F.col("canonical_url").alias("url"))).select("host", "path_key", "ka_id", "en_id")


def locale_symmetric(spark: SparkSession, root: str) -> DataFrame:
    """(id, pair_id): the pair table written to both pages, the lowest counterpart of each."""
    rows = once(spark, root, "document_locale_pair", "id", "ka_document_id", "en_document_id").where("ka_document_id is not null and en_document_id is not null")
    ka, en = F.col("ka_document_id").cast("long"), F.col("en_document_id").cast("long")
    both = rows.select(ka.alias("id"), en.alias("pair_id")).unionByName(rows.select(en.alias("id"), ka.alias("pair_id")))
    return both.groupBy("id").agg(F.min("pair_id").alias("pair_id"))


def pair_cascade(spark: SparkSession, root: str) -> DataFrame:
    """(id, counterpart, method): by path, else by pair table, else by the page's own column."""
    by_path = locale_pairs(spark, root)
    by_url = by_path.select(F.col("ka_id").alias("id"), F.col("en_id").alias("counterpart")).unionByName(by_path.select(F.col("en_id").alias("id"), F.col("ka_id").alias("counterpart")))
    by_table = locale_symmetric(spark, root).withColumnRenamed("pair_id", "counterpart")
    rows = pages(spark, root, "locale_pair_doc_id")
    own = rows.where("locale_pair_doc_id is not null").select("id", F.col("locale_pair_doc_id").cast("long").alias("counterpart"))
    return enrichment.pair_cascade(rows, by_url, by_table, own)


def title_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """(title, language, n, first_id): titles that several pages of a language have."""
    rows = pages(spark, root, "title", "language").where("trim(title) <> ''")
    return rows.groupBy("title", "language").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def best_title_page(spark: SparkSession, root: str) -> DataFrame:
    """(title, id): of pages with one title, the one of most authority."""
    rows = pages(spark, root, "title", "authority_score").where("title is not null")
    return first_per_group(rows, ["title"], [F.desc("authority_score"), F.asc("id")]).select("title", "id")


_PATH = "regexp_extract(canonical_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PAIRS = f"lp as (select host, path_key, min(id) filter (lang = 'ka') as ka_id, min(id) filter (lang = 'en') as en_id from (select id, lower(regexp_extract(canonical_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)) as host, lower(regexp_replace({_PATH}, '^/(ka|en)(/|$)', '/')) as path_key, case when regexp_matches({_PATH}, '(^|/)en(/|$)') then 'en' when regexp_matches({_PATH}, '(^|/)ka(/|$)') then 'ka' end as lang from pages) group by host, path_key having min(id) filter (lang = 'ka') is not null and min(id) filter (lang = 'en') is not null)"
_SYMMETRIC = "sy as (select id, min(p) as pair_id from (select cast(ka_document_id as bigint) as id, cast(en_document_id as bigint) as p from pairs where ka_document_id is not null and en_document_id is not null union all select cast(en_document_id as bigint), cast(ka_document_id as bigint) from pairs where ka_document_id is not null and en_document_id is not null) group by id)"
_RANKS = (
    WITH
    + ", nodes as (select id from pages where fetch_status = 'parsed' and page_kind <> 'navigation'), e as (select distinct source_doc_id as src, cast(target_doc_id as bigint) as dst from links where target_doc_id is not null and source_doc_id <> target_doc_id and source_doc_id in (select id from nodes) and cast(target_doc_id as bigint) in (select id from nodes)), d as (select src, count(*) as degree from e group by src), n as (select count(*) as n from nodes), r0 as (select id, 1.0::double / n as rank from nodes, n)"
    + "".join(
        f", g{i} as (select dst, sum(rank / degree) as given from e join d using (src) join r{i - 1} on r{i - 1}.id = src group by dst), l{i} as (select coalesce(sum(rank), 0.0) as lost from r{i - 1} where id not in (select src from d)), r{i} as (select nodes.id, 0.15::double / n + 0.85::double * (coalesce(given, 0.0) + lost / n) as rank from nodes left join g{i} on dst = nodes.id, l{i}, n)"
        for i in range(1, ROUNDS + 1)
    )
)

QUERIES = {f.__name__: f for f in (keywords, page_rank, authority, kmeans_topics, locale_pairs, locale_symmetric, pair_cascade, title_duplicates, best_title_page)}
SQL = {
    "page_rank": _RANKS + f" select id, round(rank, 9) as rank from r{ROUNDS}",
    "authority": _RANKS
    + f", k as (select id, round(rank, 9) as rank from r{ROUNDS}), b as (select min(rank) as l, max(rank) as h from k), s as (select id, case when h > l then (rank - l) / (h - l) else 0.5 end as scaled from k, b), a as (select pages.id, page_kind, coalesce(scaled, 0.0) as scaled, (epoch_us(timestamp '2025-01-01') - epoch_us(fetched_at)) / 86400000000.0 as age from pages left join s on s.id = pages.id) select id, round(case when coalesce(page_kind = 'navigation', false) then 0.0 else 0.7 * scaled + 0.3 * case when age >= 0 then exp(-age / 365.0) else 0.0 end end, 6) as authority from a",
    "locale_pairs": WITH + f", {_PAIRS} select host, path_key, ka_id, en_id from lp",
    "locale_symmetric": WITH + f", {_SYMMETRIC} select id, pair_id from sy",
    "pair_cascade": WITH + f", {_PAIRS}, {_SYMMETRIC}, u as (select id, min(c) as c from (select ka_id as id, en_id as c from lp union all select en_id, ka_id from lp) group by id) select p.id, coalesce(u.c, sy.pair_id, cast(p.locale_pair_doc_id as bigint)) as counterpart, case when u.c is not null then 'url' when sy.pair_id is not null then 'table' when p.locale_pair_doc_id is not null then 'title' end as method from pages p left join u on u.id = p.id left join sy on sy.id = p.id",
    "title_duplicates": WITH + "select title, language, count(*) as n, min(id) as first_id from pages where trim(title) <> '' group by title, language having count(*) > 1",
    "best_title_page": WITH + "select title, id from pages where title is not null qualify row_number() over (partition by title order by authority_score desc, id) = 1",
}
