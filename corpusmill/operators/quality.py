"""Corpus quality: profiles, duplicates, metrics, gates and recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


#: Plug-in metrics: name -> an aggregate over pages (parsed, body_length, violations, has_summary, has_chunk, has_kind,
#: has_marker, encoding_issue).
METRICS: dict[str, Callable[[], Column]] = {
    "empty_body_rate": lambda: ratio(F.count_if(F.col("parsed") & (F.col("body_length") < 30)), F.count_if("parsed")),
    "summary_coverage": lambda: ratio(F.count_if(F.col("parsed") & F.col("has_summary")), F.count_if("parsed")),
    "chunk_coverage": lambda: ratio(F.count_if("has_chunk"), F.count_if("parsed")),
    "skip_rate": lambda: ratio(F.count_if(F.col("fetch_status") == "skipped"), F.count("*")),
    "failure_rate": lambda: ratio(F.count_if(F.col("fetch_status") == "failed"), F.count("*")),
    "boilerplate_ratio": lambda: ratio(F.count_if(F.col("parsed") & F.col("has_marker")), F.count_if("parsed")),
    "truncation_rate": lambda: ratio(F.count_if(F.col("parsed") & F.coalesce(F.array_contains("violations", "truncated_text"), F.lit(False))), F.count_if("parsed")),
    "repetition_rate": lambda: ratio(F.count_if(F.col("parsed") & F.coalesce(F.array_contains("violations", "paragraph_duplicates_removed"), F.lit(False))), F.count_if("parsed")),
    "encoding_issue_rate": lambda: ratio(F.count_if(F.col("parsed") & F.col("encoding_issue")), F.count_if("parsed")),
    "kind_coverage": lambda: ratio(F.count_if(F.col("parsed") & F.col("has_kind")), F.count_if("parsed")),
    "violation_rate": lambda: ratio(F.count_if(F.coalesce(F.size("violations"), F.lit(0)) > 0), F.count("*")),
}


def corpus_metrics(pages: DataFrame, by: str = "corpus_id", metrics: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(by, n_pages, one column a metric), in one pass with partial sums."""
    chosen = metrics or METRICS
    return pages.groupBy(by).agg(F.count("*").alias("n_pages"), *(make().alias(name) for name, make in chosen.items()))


def recommendations(metrics: DataFrame, limits: dict[str, tuple[str, float, str]]) -> DataFrame:
    """``metrics`` with ``advice``: the advice of each limit (metric -> comparison, threshold, advice) that does not hold,
    NO_DATA without pages, OK where all hold."""
    from corpusmill.operators.ingest import compare

    failed = F.array_compact(F.array(*(F.when(~compare(F.col(m), spec, at), advice) for m, (spec, at, advice) in limits.items())))
    advice = F.when(F.col("n_pages") == 0, F.array(F.lit("NO_DATA"))).when(F.size(failed) == 0, F.array(F.lit("OK"))).otherwise(F.array_distinct(failed))
    return metrics.withColumn("advice", advice)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, n_blank, null_share): of every column, in one pass."""
    columns = [f.name for f in df.schema.fields]
    blank = {f.name: (F.trim(F.col(f"`{f.name}`")) == "") if f.dataType.simpleString() == "string" else F.lit(False) for f in df.schema.fields}
    counts = df.agg(
        F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(columns)), *(F.count_if(blank[c]).alias(f"blank_{i}") for i, c in enumerate(columns))
    )
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"null_{i}").alias("n_null"), F.col(f"blank_{i}").alias("n_blank"), F.round(ratio(F.col(f"null_{i}"), F.col("n")), 6).alias("null_share")) for i, c in enumerate(columns))))
    return counts.select(rows.alias("r")).select("r.*")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): groups of several rows with equal, not null keys."""
    return df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checks(totals: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(check, value, threshold, passed) of the one row in ``totals``: a row for each limit (column -> comparison,
    threshold)."""
    from corpusmill.operators.ingest import compare

    rows = [F.struct(F.lit(c).alias("check"), F.round(F.col(c).cast("double"), 6).alias("value"), F.lit(float(at)).alias("threshold"), compare(F.col(c).cast("double"), spec, at).alias("passed")) for c, (spec, at) in limits.items()]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
