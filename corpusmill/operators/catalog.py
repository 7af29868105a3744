"""Catalog views, curation, serve state and cluster matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import scores, text
from corpusmill.session import materialize


def first_per_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; ``order`` has to be total. Row numbers are cut at 1 before the shuffle, so a group
    with a third of all rows sends one row a task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """Rows with their number within their group; with ``most``, only the first so many, which Spark cuts before the
    shuffle too. Without ``most`` groups have to be of bounded size; else ``ranked_whole``."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered if most is None else numbered.where(F.col(name) <= most)


def ranked_whole(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Every row with its number within its group, for groups that may be too large for one task; ``order`` has to be
    total. Rows are sorted over all tasks by group and order and written to the shared folder; each stretch of a group
    in one task is numbered by itself, from where the stretches before it end."""
    placed = rows.repartitionByRange(*(F.col(c) for c in by), *order).sortWithinPartitions(*(F.col(c) for c in by), *order)
    stretches = materialize(placed.withColumn("_part", F.spark_partition_id()), "ranked")
    counts = stretches.groupBy(*by, "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    numbered = stretches.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    joined = numbered.join(offsets.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), "_offset"), [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)])
    return joined.withColumn(name, F.col(name) + F.col("_offset")).select(*rows.columns, name)


def tfidf(terms: DataFrame, most: int | None = None, weight: str | None = None) -> DataFrame:
    """(cluster, language, keyword, frequency, clusters, score, rank) of ``terms`` (cluster, language, keyword): how
    often a cluster has a word over how many clusters have it. Ties go by word."""
    frequency = F.sum(weight) if weight else F.count("*")
    own = terms.groupBy("cluster", "language", "keyword").agg(frequency.alias("frequency"))
    scope = own.groupBy("language", "keyword").agg(F.count("*").alias("clusters"))
    scored = own.join(scope, ["language", "keyword"]).withColumn("score", F.col("frequency") / F.greatest(F.lit(1), F.col("clusters")))
    return ranked(scored, ["cluster", "language"], [F.desc("score"), F.asc("keyword")], most=most)


def curate(rows: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """``rows`` (id, score) under the active ``overrides`` (target_id, action, expires_at, created_at): excluded rows go,
    boost and demote change the score by a fifth within [0.5, 2], pinned rows are marked. Any active override of an action
    counts. If ``overrides`` have a ``label`` too, rows get ``renamed``: that of the latest active rename, or null."""
    active = overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    rename = [F.max_by(F.when(F.col("action") == "rename", F.col("label")), F.when(F.col("action") == "rename", F.struct("created_at", "label"))).alias("renamed")] if "label" in overrides.columns else []
    flags = active.groupBy(F.col("target_id").alias("id")).agg(
        *(F.max(F.col("action") == a).alias(a) for a in ("exclude", "boost", "demote", "pin")), *rename,
    )
    joined = rows.join(flags, "id", "left").where(~F.coalesce("exclude", F.lit(False)))
    factor = F.when(F.coalesce("boost", F.lit(False)), 1.2).otherwise(1.0) * F.when(F.coalesce("demote", F.lit(False)), 0.8).otherwise(1.0)
    return joined.withColumn("curated", scores.clamp_boost(F.col("score") * factor)).withColumn("pinned", F.coalesce("pin", F.lit(False))).drop("exclude", "boost", "demote", "pin")


def kept_overrides(overrides: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """``overrides`` without those that expired more than ``days`` days ago; those without an end stay."""
    return overrides.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now - F.make_dt_interval(F.lit(days))))


def reverted(overrides: DataFrame, deleted: DataFrame) -> DataFrame:
    """(target_id, action) that ``deleted`` overrides (target_id, action) leave without any in ``overrides``: what has to
    be undone."""
    return deleted.select("target_id", "action").distinct().join(overrides.select("target_id", "action"), ["target_id", "action"], "left_anti")


def serve_state(documents: DataFrame, runs: DataFrame, excluded: DataFrame) -> DataFrame:
    """(id, serve_state) of ``documents`` (id, fetch_status), ``runs`` (document_id, kind) completed and ``excluded``
    (document_id): dropped unless parsed and not excluded; live without any run or with all three kinds; else partial."""
    done = runs.groupBy(F.col("document_id").alias("id")).agg(F.countDistinct(F.when(F.col("kind").isin("summary", "page_kind", "topic"), F.col("kind"))).alias("kinds"))
    gone = excluded.select(F.col("document_id").alias("id"), F.lit(True).alias("gone")).distinct()
    joined = documents.join(done, "id", "left").join(gone, "id", "left")
    state = F.when(~F.coalesce(F.col("fetch_status") == "parsed", F.lit(False)) | F.col("gone").isNotNull(), "dropped").when(F.col("kinds").isNull() | (F.col("kinds") == 3), "live").otherwise("partial_enriched")
    return joined.select("id", state.alias("serve_state"))


def match_clusters(queries: DataFrame, keywords: DataFrame, rank_most: int = 30) -> DataFrame:
    """(query_id, cluster, raw) of ``queries`` (query_id, language, query) and ``keywords`` (cluster, language, keyword,
    rank, score): the sum of the scores of the cluster's foremost keywords that the query has as a word. Words meet by an
    equi-join, so no query is held against every keyword."""
    words = queries.select("query_id", "language", F.explode(text.terms(F.col("query"), 3)).alias("keyword"))
    return words.join(keywords.where(F.col("rank") <= rank_most), ["language", "keyword"]).groupBy("query_id", "cluster").agg(F.sum("score").alias("raw"))


def match_signals(queries: DataFrame, keywords: DataFrame, labels: DataFrame, forms: DataFrame, rank_most: int = 30) -> DataFrame:
    """(query_id, cluster, keyword, label, entity, expansion): the four signals of clusters for ``queries`` (query_id,
    language, query, in lower case): the scores of ``keywords`` (cluster, language, keyword, rank, score) that the query
    contains; 1 if it contains one of the cluster's ``labels`` (cluster, label); the scores of keywords that contain one of
    the query's ``forms`` (query_id, language, kind: entity or expansion, form). Signals that a cluster lacks are 0.

    What contains what is found by equi-joins on characters in a row (``points.contained``), not by comparing all pairs."""
    from corpusmill.operators.points import contained

    top = keywords.where(F.col("rank") <= rank_most)
    asked = queries.where(F.length("query") >= 3)
    named = contained(asked.select("query_id", "query"), top.select("keyword")).join(asked.select("query_id", "language"), "query_id").join(top, ["language", "keyword"])
    parts = [named.select("query_id", "cluster", F.lit("keyword").alias("signal"), "score")]
    low = labels.select("cluster", F.lower("label").alias("label")).where("label <> ''")
    called = contained(asked.select("query_id", "query"), low.select(F.col("label").alias("keyword"))).join(low, F.col("keyword") == F.col("label"))
    parts.append(called.select("query_id", "cluster").distinct().select("query_id", "cluster", F.lit("label").alias("signal"), F.lit(1.0).alias("score")))
    own = forms.select("query_id", "language", "kind", F.lower("form").alias("form")).where(F.length("form") >= 3).distinct()
    words = top.select(F.col("keyword")).distinct()
    inside = contained(words.select(F.col("keyword").alias("query_id"), F.col("keyword").alias("query")), own.select(F.col("form").alias("keyword"))).toDF("keyword", "form")
    shaped = own.join(inside, "form").join(top, ["language", "keyword"])
    parts.append(shaped.select("query_id", "cluster", F.col("kind").alias("signal"), "score"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("query_id", "cluster").pivot("signal", ["keyword", "label", "entity", "expansion"]).agg(F.sum("score")).fillna(0.0)


def signal_score(weights: tuple[float, float, float, float] = (0.35, 0.25, 0.3, 0.1), at: float = 5.0) -> Column:
    """The weighted sum of the four signals, each saturated."""
    return sum((scores.saturated(F.col(name), at) * weight for name, weight in zip(("keyword", "label", "entity", "expansion"), weights, strict=True)), F.lit(0.0))


def best_of_signals(parts: list[DataFrame], most: int) -> DataFrame:
    """(query_id, cluster, score, rank) of several lists (query_id, cluster, score): each cluster's best score."""
    union = parts[0].select("query_id", "cluster", "score")
    for part in parts[1:]:
        union = union.unionByName(part.select("query_id", "cluster", "score"))
    best = union.groupBy("query_id", "cluster").agg(F.max("score").alias("score"))
    return ranked(best, ["query_id"], [F.desc("score"), F.asc("cluster")], "rank", most)


# The kinds of a topic's static links in their order, and how many of each count.
STATIC_LINKS = {"specific": 6, "portal": 2, "statistics": 8, "metadata": 8, "methodology": 8, "sectoral": 8, "news": 8}


def static_links(topics: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, url, kind, rank) of ``topics`` (query_id, topic, latest) by ``links`` (topic, kind, url, place): kinds in
    their order, news first for queries for the latest, at most so many of a kind, an address once, at most ``most``."""
    order, allowed = F.lit(len(STATIC_LINKS)), F.lit(0)
    for n, (kind, few) in enumerate(STATIC_LINKS.items()):
        order, allowed = F.when(F.col("kind") == kind, n).otherwise(order), F.when(F.col("kind") == kind, few).otherwise(allowed)
    few = ranked(links, ["topic", "kind"], [F.asc("place"), F.asc("url")], "_place", max(STATIC_LINKS.values())).where(F.col("_place") <= allowed)
    joined = topics.join(few, "topic").withColumn("_order", F.when(F.col("latest") & (F.col("kind") == "news"), -1).otherwise(order))
    single = first_per_group(joined.withColumn("_key", F.lower(F.regexp_replace("url", "[/#]+$", ""))), ["query_id", "_key"], [F.asc("_order"), F.asc("_place"), F.asc("url")])
    return ranked(single, ["query_id"], [F.asc("_order"), F.asc("_place"), F.asc("url")], "rank", most).select("query_id", "url", "kind", "rank")


def capped_matches(matches: DataFrame, label: str = "label", per_prefix: int = 2, most: int = 5, least: float = 0.1) -> DataFrame:
    """``matches`` (query_id, cluster, label, score): at most ``per_prefix`` of labels with the same first two words,
    then at most ``most`` a query; ties by cluster."""
    prefix = F.array_join(F.slice(F.split(F.lower(label), " "), 1, 2), " ")
    rows = matches.where(F.col("score") >= least).withColumn("prefix", prefix)
    kept = ranked(rows, ["query_id", "prefix"], [F.desc("score"), F.asc("cluster")], "in_prefix", per_prefix)
    return ranked(kept, ["query_id"], [F.desc("score"), F.asc("cluster")], "rank", most).drop("in_prefix", "prefix")


def merge_links(first: DataFrame, second: DataFrame, second_most: int = 4, most: int = 8) -> DataFrame:
    """(group, url, source, rank): links (group, url, place) of ``first``, then up to ``second_most`` of ``second``, an
    address once, at most ``most`` a group."""
    both = first.select("group", "url", "place", F.lit(0).alias("source")).unionByName(second.where(F.col("place") <= second_most).select("group", "url", "place", F.lit(1).alias("source")))
    single = first_per_group(both.withColumn("key", F.lower(F.regexp_replace("url", "[/#]+$", ""))), ["group", "key"], [F.asc("source"), F.asc("place"), F.asc("url")])
    return ranked(single, ["group"], [F.asc("source"), F.asc("place"), F.asc("url")], "rank", most).select("group", "url", "source", "rank")


def min_max(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` scaled to [0, 1]; 0.5 if all are equal. The two bounds are one row, which is broadcast."""
    bounds = rows.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.5)
    return rows.join(F.broadcast(bounds)).withColumn(name, scaled).drop("_low", "_high")
