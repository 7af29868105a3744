"""References to records that do not exist (problem 5).

Parent keys are compressed into runs of contiguous integers, a bucket of the key space at a time. Each distinct
referenced key is matched as of the start of the run before it; a key beyond that run's end has no parent. Keys whose
parent exists are then held against the parent's creation and deletion times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize
from corpusmill.sources.tables import table

#: Keys of one bucket are sorted together: at most this many distinct keys a task group, so no group is unbounded.
BUCKET_BITS = 14
#: A key with more than one in HOT_SHARE of all references counts as hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 512


def decimal_id(value: Column) -> Column:
    """The integer that a text names: surrounding blanks, a sign and leading zeros do not count; else null."""
    text = F.regexp_replace(value, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")
    return F.when(text.rlike(r"^\+?0*[0-9]{1,18}$|^-0*[0-9]{1,18}$"), text.cast("decimal(38,0)").try_cast("bigint"))


def is_blank(value: Column) -> Column:
    """Null and blank mean the same."""
    return F.coalesce(~value.rlike(r"[^\s\p{Z}\p{Cf}]"), F.lit(True))


def key_runs(keys: DataFrame, key: str = "key") -> DataFrame:
    """(bucket, run_start, run_end) of the distinct integers in ``key``; nulls are left out, no keys give no runs.

    A run ends at its bucket's end, so runs of one bucket never need another task.
    """
    k = F.col(key)
    distinct = keys.select(k.cast("bigint").alias("k")).where("k is not null").distinct()
    distinct = distinct.withColumn("bucket", F.shiftright("k", BUCKET_BITS))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("k"))
    return (
        distinct.withColumn("island", F.col("k") - rank)
        .groupBy("bucket", "island")
        .agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"))
        .drop("island")
    )


def missing_keys(references: DataFrame, runs: DataFrame) -> DataFrame:
    """``references`` (a distinct bigint ``key`` and any other columns) with ``missing``: no run holds the key.

    As-of match: each key takes the last run that starts at or before it in its bucket; it is missing where there is
    none or where it lies beyond that run's end. Empty tables of runs make every key missing.
    """
    rest = [c for c in references.columns if c != "key"]
    left = references.select(
        F.shiftright("key", BUCKET_BITS).alias("bucket"), F.col("key").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("run_end"), F.struct(F.col("key"), *[F.col(c) for c in rest]).alias("row"),
    )
    starts = runs.select(
        "bucket", F.col("run_start").alias("at"), F.lit(0).alias("kind"), "run_end",
        F.lit(None).cast(left.schema["row"].dataType).alias("row"),
    )
    before = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        starts.unionByName(left)
        .withColumn("end", F.last("run_end", ignorenulls=True).over(before))
        .where("kind = 1")
        .select("row.*", (F.col("end").isNull() | (F.col("at") > F.col("end"))).alias("missing"))
    )


@dataclass(frozen=True)
class ReferenceSource:
    """A table's references: ``rows`` has ref_id bigint, key bigint (null: no id at all), ref_time timestamp."""

    name: str
    rows: DataFrame


def orphan_references(sources: list[ReferenceSource], parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """(ref_table, ref_month, ref_id, reason): references whose parent is missing, later or deleted.

    ``parents`` has id, created_at; ``deletions`` document_id, deleted_at. A row that comes twice counts once. The
    sources must hold non-blank references only. A null time of a reference is neither before nor after anything, so
    such a reference is a case only if its parent is missing; its ref_month is null. Reasons: ``no_id`` (the text is no
    id), ``missing``, ``later``, ``deleted``; the first that holds is given.

    Per distinct key only its count and its first and last reference time are shuffled, so a key with a third of all
    references costs one row a task. Only keys that may have a case go back to the references; the hot ones among them
    (at most ``HOT_SHARE`` keys, by pigeonhole) are broadcast, the rest join by a shuffle.
    """
    refs = None
    for source in sources:
        rows = source.rows.select(F.lit(source.name).alias("ref_table"), "ref_id", "key", "ref_time")
        refs = rows if refs is None else refs.unionByName(rows)
    refs = materialize(refs.distinct(), "references")
    no_id = refs.where("key is null").select("ref_table", "ref_id", "ref_time", F.lit("no_id").alias("reason"))
    named = refs.where("key is not null")

    keys = named.groupBy("key").agg(F.count("*").alias("n"), F.min("ref_time").alias("first"), F.max("ref_time").alias("last"))
    born = parents.where("id is not null").groupBy(F.col("id").alias("key")).agg(F.min("created_at").alias("born"))
    died = deletions.where("document_id is not null").groupBy(F.col("document_id").alias("key")).agg(F.min("deleted_at").alias("died"))
    state = missing_keys(keys, key_runs(born)).join(born, "key", "left").join(died, "key", "left")
    suspect = materialize(state.where("missing or born > first or died <= last"), "suspect-keys")

    spark = parents.sparkSession
    total = named.count()
    hot_part = suspect.where(F.col("n") * HOT_SHARE > F.lit(total)).select("key", "missing", "born", "died")
    hot_rows = hot_part.collect()
    hot = spark.createDataFrame(hot_rows, hot_part.schema)
    rest = suspect.where(F.col("n") * HOT_SHARE <= F.lit(total)).select("key", "missing", "born", "died")
    hot_keys = [row.key for row in hot_rows]
    joined = named.where(~F.col("key").isin(hot_keys)).join(rest, "key")
    if hot_rows:
        joined = joined.unionByName(named.join(F.broadcast(hot), "key"))
    reason = F.when(F.col("missing"), "missing").when(F.col("born") > F.col("ref_time"), "later").when(F.col("died") <= F.col("ref_time"), "deleted")
    found = joined.select("ref_table", "ref_id", "ref_time", reason.alias("reason")).where("reason is not null")
    return found.unionByName(no_id).select("ref_table", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "ref_id", "reason")


def reference_sources(spark: SparkSession, root: str) -> list[ReferenceSource]:
    """The three referring tables."""
    links = table(spark, root, "document_link", "id", "target_doc_id", "discovered_at").where("target_doc_id is not null")
    pairs = table(spark, root, "document_locale_pair", "id", "en_document_id", "created_at").where("en_document_id is not null")
    turns = table(spark, root, "chat_turn", "id", "created_at").groupBy(F.col("id").alias("turn_id")).agg(F.min("created_at").alias("ref_time"))
    hits = table(spark, root, "retrieval_hit", "hit_id", "turn_id", "document_id").where(~is_blank(F.col("document_id")))
    hits = hits.select(F.col("hit_id").alias("ref_id"), "turn_id", decimal_id(F.col("document_id")).alias("key")).distinct()
    return [
        ReferenceSource("document_link", links.toDF("ref_id", "key", "ref_time")),
        ReferenceSource("document_locale_pair", pairs.toDF("ref_id", "key", "ref_time")),
        ReferenceSource("retrieval_hit", hits.join(turns, "turn_id", "left").select("ref_id", "key", "ref_time")),
    ]


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    parents = table(spark, root, "ingestion_document", "id", "created_at")
    deletions = table(spark, root, "document_deletion", "document_id", "deleted_at")
    return orphan_references(reference_sources(spark, root), parents, deletions)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(ref_table, ref_month, ref_id): every orphan reference, once."""
    return _orphans(spark, root).select("ref_table", "ref_month", "ref_id").distinct()


def p5_per_month(spark: SparkSession, root: str) -> DataFrame:
    """(ref_table, ref_month, n_orphans): how many there are per table and month."""
    return p5_found(spark, root).groupBy("ref_table", "ref_month").agg(F.count("*").alias("n_orphans"))


_P5_SQL = """
with born as (select id, min(created_at) as born from ingestion_document group by id),
died as (select document_id, min(deleted_at) as died from document_deletion group by document_id),
turns as (select id, min(created_at) as created_at from chat_turn group by id),
refs as (
  select 'document_link' as ref_table, id as ref_id, cast(target_doc_id as bigint) as k, discovered_at as t from document_link where target_doc_id is not null
  union select 'document_locale_pair', id, cast(en_document_id as bigint), created_at from document_locale_pair where en_document_id is not null
  union select 'retrieval_hit', h.hit_id, try_cast(trim(h.document_id, E' \\t\\n\\r') as bigint), c.created_at
  from retrieval_hit h left join turns c on c.id = h.turn_id where trim(coalesce(h.document_id, ''), E' \\t\\n\\r') <> ''),
found as (
  select distinct r.ref_table, strftime(r.t, '%Y-%m') as ref_month, r.ref_id
  from refs r left join born b on b.id = r.k left join died d on d.document_id = r.k
  where b.id is null or b.born > r.t or d.died <= r.t)
"""

QUERIES = {"p5_found": p5_found, "p5_per_month": p5_per_month}
SQL = {
    "p5_found": _P5_SQL + "select ref_table, ref_month, ref_id from found",
    "p5_per_month": _P5_SQL + "select ref_table, ref_month, count(*) as n_orphans from found group by all",
}
