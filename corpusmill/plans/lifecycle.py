"""Runs, views and policies over whole tables. A corpus's status stands for its run, its link targets for its frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.operators import catalog, lifecycle
from corpusmill.operators.lifecycle import CrawlPolicy
from corpusmill.plans.ingest import _normal
from corpusmill.sources.tables import table
from corpusmill.sources.views import AS_OF, WITH, as_of, chunks, links, pages


def crawl_policy(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, url, place, wait_ms): the first 50 targets of each corpus, with the default depth, rate and workers."""
    found = links(spark, root, "corpus_id", "target_url", "target_doc_id", "discovered_at").groupBy("corpus_id", F.col("target_url").alias("url")).agg(F.min("discovered_at").alias("found_at"), F.min(F.when(F.col("target_doc_id").isNull(), 3).otherwise(1)).alias("depth"))
    return lifecycle.within_policy(found, CrawlPolicy()).select("corpus_id", "url", "place", "wait_ms")


def _runs(spark: SparkSession, root: str) -> DataFrame:
    """(id, corpus_id, status): a page that is parsing is a running run, a fetched one a pending, others are done."""
    status = F.when(F.col("fetch_status") == "parsing", "running").when(F.col("fetch_status") == "fetched", "pending").otherwise("completed")
    return pages(spark, root, "corpus_id", "fetch_status").select("id", "corpus_id", status.alias("status"))


def stale_runs(spark: SparkSession, root: str) -> DataFrame:
    """(status, n): runs after those that were cut off are cancelled."""
    return lifecycle.cancelled_stale(_runs(spark, root)).groupBy("status").agg(F.count("*").alias("n"))


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ingestion_corpus", F.col("id").alias("corpus_id"), F.explode(F.from_json("seed_urls", "array<string>")).alias("url"))


def job_start(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, mode, url, url_hash, depth): what a job of each corpus starts with; those of even ids are full."""
    jobs = table(spark, root, "ingestion_corpus", F.col("id").alias("corpus_id")).select("corpus_id", (F.col("corpus_id") % 4 == 0).alias("full"), F.lit(None).cast("string").alias("seed_url"))
    active = _runs(spark, root).where("id % 7 = 0")
    queued = links(spark, root, "corpus_id", "target_url", "target_doc_id", "discovered_at").where("target_doc_id is null").groupBy("corpus_id", F.col("target_url").alias("url")).agg(F.min("discovered_at").alias("found_at")).withColumn("depth", F.lit(1))
    return lifecycle.started(jobs, active, _seeds(spark, root), queued)


def corpus_waves(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, wave): two corpora at once."""
    return lifecycle.waves(table(spark, root, "ingestion_corpus", F.col("id").alias("corpus_id")))


def policy_sync(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, seeds, policy, changed): each third corpus has a policy with one more address and another rate."""
    corpora = table(spark, root, "ingestion_corpus", F.col("id").alias("corpus_id"), F.from_json("seed_urls", "array<string>").alias("seed_urls")).withColumn("policy", F.create_map(F.lit("rate_ms"), F.lit("500"), F.lit("mode"), F.lit("seed")))
    policies = corpora.where("corpus_id % 3 = 0").select("corpus_id", F.col("seed_urls").alias("seeds"), F.when(F.col("corpus_id") % 2 == 0, F.array(F.lit("https://curated.example/"))).otherwise(F.array().cast("array<string>")).alias("curated"), F.when(F.col("corpus_id") % 9 == 0, F.create_map(F.lit("rate_ms"), F.lit("250"))).otherwise(F.create_map().cast("map<string,string>")).alias("limits"))
    out = lifecycle.synced_policies(corpora, policies)
    return out.select("corpus_id", F.array_join(F.array_sort("seed_urls"), " ").alias("seeds"), F.array_join(F.array_sort(F.transform(F.map_entries("policy"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("policy"), "changed")


def view_staleness(spark: SparkSession, root: str) -> DataFrame:
    """(view, refreshed_at, rows, stale): each corpus as a view, last refreshed when a page of it was parsed."""
    audit = pages(spark, root, "corpus_id", "updated_at", "fetch_status").select(F.col("corpus_id").alias("view"), F.col("updated_at").alias("refreshed_at"), F.col("id").alias("rows"), (F.coalesce(F.col("fetch_status") == "parsed", F.lit(False)) & F.col("updated_at").isNotNull()).alias("ok"))
    return lifecycle.stale_views(audit, as_of(), 24 * 60.0).select("view", F.date_format("refreshed_at", "yyyy-MM-dd HH:mm:ss").alias("refreshed_at"), "rows", "stale")


def _documents(spark: SparkSession, root: str) -> DataFrame:
    n = chunks(spark, root, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    return pages(spark, root, "fetch_status", "fetched_at", "content_text").join(n, "id", "left")


def rerun_selection(spark: SparkSession, root: str) -> DataFrame:
    """(what, id): the pages that each of the three re-runs takes."""
    documents, out = _documents(spark, root), None
    for what in ("reindex", "reparse", "refresh"):
        part = lifecycle.to_rerun(documents, what, as_of()).select(F.lit(what).alias("what"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def approved_topics(spark: SparkSession, root: str) -> DataFrame:
    """(cluster, n_pages): corpora that the newest of their pages with a score approves, by being good."""
    rows = pages(spark, root, "corpus_id", "quality_score", "updated_at")
    decisions = rows.where("quality_score is not null").select(F.col("corpus_id").alias("cluster"), (F.col("quality_score") == "good").alias("approved"), F.struct("updated_at", "id").alias("decided_at"))
    return lifecycle.approved_only(rows.groupBy(F.col("corpus_id").alias("cluster")).agg(F.count("*").alias("n_pages")), decisions)


def approval_counts(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, n_approved, n_pending): pages with a good score, and without one."""
    return pages(spark, root, "corpus_id", "quality_score").groupBy("corpus_id").agg(F.count_if(F.coalesce(F.col("quality_score") == "good", F.lit(False))).alias("n_approved"), F.count_if(F.col("quality_score").isNull()).alias("n_pending"))


def expired_overrides(spark: SparkSession, root: str) -> DataFrame:
    """(target_id, action): removals as overrides of 90 days, without those that ended over a week ago."""
    from corpusmill.plans.catalog import _overrides

    return catalog.kept_overrides(_overrides(spark, root), F.lit("2024-06-01").cast("timestamp_ntz")).select("target_id", "action")


def page_archive(spark: SparkSession, root: str) -> DataFrame:
    """(url_hash, bucket, url, n_chars): each address's last text as its archived page."""
    rows = pages(spark, root, F.col("canonical_url").alias("url"), F.col("content_text").alias("html"), "fetched_at")
    return lifecycle.stored_page(rows).select("url_hash", "bucket", "url", F.length("html").alias("n_chars"))


QUERIES = {f.__name__: f for f in (crawl_policy, stale_runs, job_start, corpus_waves, policy_sync, view_staleness, rerun_selection, approved_topics, approval_counts, expired_overrides, page_archive)}
_RUNS = "runs as (select id, corpus_id, case fetch_status when 'parsing' then 'running' when 'fetched' then 'pending' else 'completed' end as status from pages)"
SQL = {
    "crawl_policy": WITH + ", f as (select corpus_id, target_url as url, min(discovered_at) as found_at, min(case when target_doc_id is null then 3 else 1 end) as depth from links group by all), r as (select corpus_id, url, row_number() over (partition by corpus_id order by depth, found_at, url) as place from f where depth <= 2 qualify place <= 50) select corpus_id, url, place, cast(floor((place - 1) / 5) * 500 as bigint) as wait_ms from r",
    "stale_runs": WITH + f", {_RUNS} select case when status in ('pending', 'running') then 'cancelled' else status end as status, count(*) as n from runs group by 1",
    "job_start": WITH + f""", {_RUNS}, act as (select distinct corpus_id from runs where id % 7 = 0 and status in ('pending', 'running')), sd as (select id as corpus_id, unnest(from_json(seed_urls, '["VARCHAR"]')) as url from ingestion_corpus),
qd as (select corpus_id, target_url as url, min(discovered_at) as found_at from links where target_doc_id is null group by all),
t as (select id as corpus_id, case when id in (select corpus_id from act) then 'rejected' when id % 4 = 0 or id not in (select corpus_id from qd) then 'seeded' else 'resumed' end as mode from ingestion_corpus),
u as (select t.corpus_id, mode, url, 0 as depth, null::timestamp as found_at from t join sd using (corpus_id) where mode = 'seeded' union all select t.corpus_id, mode, url, 1, found_at from t join qd using (corpus_id) where mode = 'resumed'),
h as (select *, sha256(trim({_normal('url')})) as url_hash from u), s as (select * from h qualify row_number() over (partition by corpus_id, url_hash order by depth, found_at nulls first, url) = 1),
k as (select * from s qualify row_number() over (partition by corpus_id order by found_at nulls first, url_hash) <= 500 or mode = 'seeded')
select corpus_id, mode, url, url_hash, depth from k union all select corpus_id, mode, null, null, null from t where mode = 'rejected'""",
    "corpus_waves": "select id as corpus_id, cast(floor((row_number() over (order by id) - 1) / 2) as int) as wave from ingestion_corpus",
    "policy_sync": """with c as (select id, from_json(seed_urls, '["VARCHAR"]') as s from ingestion_corpus), n as (select id, s, case when id % 3 = 0 and len(list_distinct(list_concat(s, case when id % 2 = 0 then ['https://curated.example/'] else [] end))) > 0 then list_distinct(list_concat(s, case when id % 2 = 0 then ['https://curated.example/'] else [] end)) else s end as w from c)
select id as corpus_id, array_to_string(list_sort(w), ' ') as seeds, 'mode=seed,rate_ms=' || case when id % 9 = 0 then '250' else '500' end as policy, id % 3 = 0 and (list_sort(s) is distinct from list_sort(w) or id % 9 = 0) as changed from n""",
    "view_staleness": WITH + f", l as (select corpus_id as view, max((updated_at, id)) filter (fetch_status = 'parsed' and updated_at is not null) as l from pages group by 1) select view, strftime(l[1], '%Y-%m-%d %H:%M:%S') as refreshed_at, l[2] as rows, coalesce(l[1] < timestamp '{AS_OF}' - interval 1440 hours, true) as stale from l",
    "rerun_selection": WITH + f", d as (select *, id in (select document_id from chunks) as has from pages) select 'reindex' as what, id from d where coalesce(trim(content_text), '') <> '' and not has and fetch_status <> 'failed' union all select 'reparse', id from d where fetch_status in ('parsed', 'skipped') union all select 'refresh', id from d where fetch_status = 'parsed' and fetched_at < timestamp '{AS_OF}' - interval 24 hours",
    "approved_topics": WITH + ", l as (select corpus_id, arg_max(quality_score = 'good', (updated_at, id)) as ok from pages where quality_score is not null group by 1) select corpus_id as cluster, count(*) as n_pages from pages where corpus_id in (select corpus_id from l where ok) group by 1",
    "approval_counts": WITH + "select corpus_id, count(*) filter (quality_score = 'good') as n_approved, count(*) filter (quality_score is null) as n_pending from pages group by 1",
    "expired_overrides": "select document_id as target_id, case document_id % 4 when 0 then 'exclude' when 1 then 'boost' when 2 then 'demote' else 'pin' end as action from document_deletion where deleted_at + interval 90 days >= timestamp '2024-06-01' - interval 7 days or deleted_at is null",
    "page_archive": WITH + f", h as (select sha256(trim({_normal('canonical_url')})) as url_hash, canonical_url, content_text, fetched_at from pages where content_text is not null and canonical_url is not null), l as (select * from h qualify row_number() over (partition by url_hash order by fetched_at desc nulls last, canonical_url desc, content_text desc) = 1) select url_hash, substring(url_hash, 1, 2) as bucket, canonical_url as url, length(content_text) as n_chars from l",
}
