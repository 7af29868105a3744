"""Deduplicated views of the corpus tables, and the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import materialize, ship, spread
from corpusmill.sources.tables import table

#: "Now" of every time-dependent query; operators take it as a parameter.
AS_OF = "2025-01-01 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


#: Columns that hold whole texts; rows with them are not shuffled to drop repeats.
TEXTS = {"content_text", "lead_text", "text", "summary_ka", "summary_en"}
#: Up to so many places of repeated rows are broadcast (16 bytes each); beyond, rows are shuffled by key.
REPEATS_MOST = 2_000_000


def once(spark: SparkSession, root: str, name: str, *columns: str, key: str = "id") -> DataFrame:
    """Rows of a table that may be delivered twice, once each; rows with one key are equal in every column.

    Narrow rows are deduplicated by key. Rows with a whole text stay where they are: ``single_rows`` drops the repeats.
    """
    if TEXTS & {c for c in columns if isinstance(c, str)}:
        return single_rows(spark, root, name, *columns, key=key)
    return table(spark, root, name, *columns).dropDuplicates([key])


def single_rows(spark: SparkSession, root: str, name: str, *columns: str, key: str = "id", most: int = REPEATS_MOST) -> DataFrame:
    """``columns`` of the first row of each key, by file and place in the file. Only keys and places are shuffled: the
    places of repeats are written out, and if they are no more than ``most``, each task leaves them out of its scan;
    beyond that, rows are shuffled by key."""
    ship(spark)
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    file, at = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
    places = rows.select(F.col(key).alias("key"), F.struct(file.alias("file"), at.alias("row")).alias("place"))
    first = places.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = materialize(places.alias("p").join(first.alias("k"), F.col("p.key").eqNullSafe(F.col("k.key"))).where("p.place <> k.first").select("p.place.file", "p.place.row"), "repeats")
    wanted = columns or tuple(rows.columns)
    if repeats.count() > most:
        return rows.select(*wanted, *([key] if key not in wanted else [])).dropDuplicates([key]).select(*wanted)
    kept = spread(rows.select(*wanted, file.alias("_file"), at.alias("_row"))).join(F.broadcast(repeats.toDF("_file", "_row")), ["_file", "_row"], "left_anti")
    return kept.drop("_file", "_row")


def pages(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return once(spark, root, "ingestion_document", "id", *columns)


def chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return once(spark, root, "ingestion_chunk", "id", *columns)


def links(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return once(spark, root, "document_link", "id", *columns)


#: Common table expressions of the same views.
WITH = """with pages as (select distinct on (id) * from ingestion_document),
chunks as (select distinct on (id) * from ingestion_chunk),
links as (select distinct on (id) * from document_link),
turns as (select distinct on (id) * from chat_turn),
hits as (select distinct on (hit_id) * from retrieval_hit),
pairs as (select distinct on (id) * from document_locale_pair)
"""


def hits_once(spark: SparkSession, root: str) -> DataFrame:
    """(hit_id, turn_id, doc, score, source_url): hits once each, with the page id their text names or null."""
    from corpusmill.operators.references import decimal_id

    rows = once(spark, root, "retrieval_hit", "hit_id", "turn_id", "document_id", "score", "source_url", key="hit_id")
    return rows.withColumn("doc", decimal_id(F.col("document_id"))).drop("document_id")
