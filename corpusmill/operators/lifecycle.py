"""Runs, views and policies: what starts, restarts, refreshes and expires. "Now" is a parameter everywhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.operators.catalog import first_per_group, ranked


@dataclass(frozen=True)
class CrawlPolicy:
    """How far and how fast a site is read. The defaults."""

    full_site: bool = False
    max_depth: int | None = None
    max_pages: int | None = None
    workers: int = 5
    rate_ms: int = 500

    @property
    def depth(self) -> int:
        return self.max_depth if self.max_depth is not None else 12 if self.full_site else 2

    @property
    def pages(self) -> int | None:
        """None is no limit."""
        return self.max_pages if self.max_pages is not None else None if self.full_site else 50


def within_policy(found: DataFrame, policy: CrawlPolicy) -> DataFrame:
    """``found`` (corpus_id, url, depth, found_at) that a policy lets in: not too deep, the first of each corpus up to its
    number of pages, with the wait in ms before each at the policy's rate and workers."""
    shallow = found.where(F.col("depth") <= policy.depth)
    numbered = ranked(shallow, ["corpus_id"], [F.asc("depth"), F.asc("found_at"), F.asc("url")], "place", policy.pages) if policy.pages is not None else _numbered(shallow)
    return numbered.withColumn("wait_ms", (F.floor((F.col("place") - 1) / policy.workers) * policy.rate_ms).cast("long"))


def _numbered(found: DataFrame) -> DataFrame:
    from corpusmill.operators.catalog import ranked_whole

    return ranked_whole(found, ["corpus_id"], [F.asc("depth"), F.asc("found_at"), F.asc("url")], "place")


def cancelled_stale(runs: DataFrame) -> DataFrame:
    """``runs`` (id, status, ...) at start-up: pending and running ones were cut off, so they are cancelled."""
    return runs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "cancelled").otherwise(F.col("status")))


def started(jobs: DataFrame, runs: DataFrame, seeds: DataFrame, queued: DataFrame, most: int = 500) -> DataFrame:
    """(corpus_id, mode, url, url_hash, depth) of ``jobs`` (corpus_id, full, seed_url): rejected, without addresses, if
    ``runs`` (corpus_id, status) have an active one; seeded by ``seeds`` (corpus_id, url), or its own seed_url, if it is full
    or has a seed_url or nothing is queued; else resumed by the first ``most`` ``queued`` (corpus_id, url, depth, found_at).
    An address is in a run once, by the hash of its normal form."""
    active = runs.where(F.col("status").isin("pending", "running")).select("corpus_id").distinct().withColumn("active", F.lit(True))
    waiting = queued.select("corpus_id").distinct().withColumn("waiting", F.lit(True))
    mode = F.when(F.col("active"), "rejected").when(F.col("full") | F.col("seed_url").isNotNull() | F.col("waiting").isNull(), "seeded").otherwise("resumed")
    told = jobs.join(active, "corpus_id", "left").join(waiting, "corpus_id", "left").select("corpus_id", "seed_url", mode.alias("mode"))
    rejected = told.where("mode = 'rejected'").select("corpus_id", "mode", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("url_hash"), F.lit(None).cast("int").alias("depth"))
    fresh = told.where("mode = 'seeded'")
    own = fresh.where("seed_url is not null").select("corpus_id", "mode", F.col("seed_url").alias("url"))
    own = own.unionByName(fresh.where("seed_url is null").join(seeds, "corpus_id").select("corpus_id", "mode", "url")).withColumns({"depth": F.lit(0), "found_at": F.lit(None).cast("timestamp_ntz")})
    rest = told.where("mode = 'resumed'").join(queued, "corpus_id").select("corpus_id", "mode", "url", F.col("depth").cast("int").alias("depth"), F.col("found_at").cast("timestamp_ntz").alias("found_at"))
    both = own.unionByName(rest).withColumn("url_hash", urls.url_hash(urls.normalize_url(F.col("url"))))
    single = first_per_group(both, ["corpus_id", "url_hash"], [F.asc("depth"), F.asc("found_at"), F.asc("url")])
    few = ranked(single.where("mode = 'resumed'"), ["corpus_id"], [F.asc("found_at"), F.asc("url_hash")], "_n", most).drop("_n").unionByName(single.where("mode = 'seeded'"))
    return few.select("corpus_id", "mode", "url", "url_hash", "depth").unionByName(rejected)


def waves(corpora: DataFrame, at_once: int = 2) -> DataFrame:
    """``corpora`` (corpus_id) with the wave in which each is run, ``at_once`` in one; corpora are few by what they are."""
    place = F.row_number().over(Window.orderBy("corpus_id"))
    return corpora.select("corpus_id").distinct().withColumn("wave", F.floor((place - 1) / at_once).cast("int"))


def synced_policies(corpora: DataFrame, policies: DataFrame) -> DataFrame:
    """(corpus_id, seed_urls, policy, changed) of ``corpora`` (corpus_id, seed_urls array, policy map) under ``policies``
    (corpus_id, seeds, curated, limits map): seeds and curated addresses as one set, sorted, stand for the seeds, unless
    there are none; limits are merged into the policy, and win. Corpora without a policy stay as they are."""
    joined = corpora.join(policies.withColumn("_known", F.lit(True)), "corpus_id", "left")
    wanted = F.array_sort(F.array_union(F.coalesce("seeds", F.array().cast("array<string>")), F.coalesce("curated", F.array().cast("array<string>"))))
    new_seeds = F.when(F.size(wanted) > 0, wanted).otherwise(F.col("seed_urls"))
    old = F.coalesce("policy", F.create_map().cast("map<string,string>"))
    limits = F.coalesce("limits", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(limits, k)), limits)
    changed = F.col("_known").isNotNull() & (~F.array_sort("seed_urls").eqNullSafe(F.array_sort(new_seeds)) | (F.array_sort(F.map_entries(merged)) != F.array_sort(F.map_entries(old))))
    return joined.select("corpus_id", new_seeds.alias("seed_urls"), merged.alias("policy"), changed.alias("changed"))


def stale_views(audit: DataFrame, now: Column, hours: float = 25.0) -> DataFrame:
    """(view, refreshed_at, rows, stale) of ``audit`` (view, refreshed_at, rows, ok): each view's last good refresh, and
    whether it is older than ``hours``; a view without one is stale."""
    last = audit.groupBy("view").agg(F.max(F.when(F.col("ok"), F.struct("refreshed_at", "rows"))).alias("last"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last.refreshed_at").cast("timestamp"))) / 3.6e9
    return last.select("view", F.col("last.refreshed_at").alias("refreshed_at"), F.col("last.rows").alias("rows"), F.coalesce(age > hours, F.lit(True)).alias("stale"))


def refresh_view(view: DataFrame, path: str) -> int:
    """The view written over what is at ``path``; the number of its rows."""
    view.write.mode("overwrite").parquet(path)
    return view.sparkSession.read.parquet(path).count()


def run_chain(steps: list[tuple[str, Callable[[], object]]]) -> list[tuple[str, bool, str]]:
    """(step, went well, error): the steps one after the other; one that fails does not keep the next from running."""
    out = []
    for name, step in steps:
        try:
            step()
            out.append((name, True, ""))
        except Exception as error:  # noqa: BLE001
            out.append((name, False, f"{type(error).__name__}: {error}"))
    return out


def to_rerun(documents: DataFrame, what: str, now: Column, hours: float = 24.0, gone: tuple[str, ...] = ("failed",)) -> DataFrame:
    """``documents`` (id, fetch_status, fetched_at, content_text, n_chunks) that a re-run takes: ``reindex`` those with a text
    and no chunk, ``reparse`` those parsed or skipped, ``refresh`` those parsed and fetched more than ``hours`` ago."""
    has_text = F.coalesce(F.trim("content_text"), F.lit("")) != ""
    old = F.col("fetched_at") < now - F.make_dt_interval(hours=F.lit(int(hours)))
    rule = {
        "reindex": has_text & (F.coalesce("n_chunks", F.lit(0)) == 0) & ~F.col("fetch_status").isin(*gone),
        "reparse": F.col("fetch_status").isin("parsed", "skipped"),
        "refresh": (F.col("fetch_status") == "parsed") & old,
    }[what]
    return documents.where(rule)


def approved_only(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """``clusters`` (cluster, ...) whose latest of ``decisions`` (cluster, approved, decided_at) approves them."""
    last = decisions.groupBy("cluster").agg(F.max_by("approved", F.struct("decided_at", "approved")).alias("approved"))
    return clusters.join(last.where("approved").select("cluster"), "cluster", "left_semi")


def stored_page(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html, fetched_at) as they are kept in an archive: by the hash of the address, of several the latest;
    pages without html are not kept. ``bucket`` is a folder of about a 256th."""
    kept = pages.where("html is not null and url is not null").withColumn("url_hash", urls.url_hash(urls.normalize_url(F.col("url"))))
    last = kept.groupBy("url_hash").agg(F.max(F.struct("fetched_at", "url", "html")).alias("p"))
    return last.select("url_hash", F.substring("url_hash", 1, 2).alias("bucket"), "p.url", "p.html", "p.fetched_at")


def log_events(events: DataFrame, path: str) -> None:
    """``events`` added as JSON lines: what is left of telemetry when its store is away."""
    events.write.mode("append").json(path)


def to_both(first: Callable[[DataFrame, int], None], then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to ``first`` and, even if that fails, to ``then``; the error is raised
    after both."""

    def each(batch: DataFrame, number: int) -> None:
        results = run_chain([("first", lambda: first(batch, number)), ("then", lambda: then(batch, number))])
        failed = [f"{name}: {error}" for name, fine, error in results if not fine]
        if failed:
            raise RuntimeError("; ".join(failed))

    return each
