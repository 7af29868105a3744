"""The engine's entry points over one folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import catalog, lifecycle
from corpusmill.plans import hybrid
from corpusmill.plans.catalog import best_page_per_corpus, merged_links, topic_keywords
from corpusmill.plans.quality import quality_advice
from corpusmill.sources.tables import table
from corpusmill.sources.views import pages


class Engine:
    """Searches, corpora, catalog, curation and jobs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def search(self, query: str | DataFrame, locale: str | None = None, most: int = 8, corpus: int | None = None) -> DataFrame:
        """The best chunks for a query, or for a DataFrame of them (query_id, query, locale), as in ``hybrid.search``; only of
        the locale, whatever its spelling, and of the corpus, if they are given."""
        queries = query
        if isinstance(query, str):
            queries = self.spark.createDataFrame([(0, query, locale)], "query_id long, query string, locale string")
        return hybrid.search(self.spark, self.root, queries.withColumn("locale", text.language_code(F.col("locale"))), most, corpus)

    def corpora(self) -> DataFrame:
        """(corpus_id, corpus_name, status, n_pages, advice): every corpus, with what to do about it."""
        rows = table(self.spark, self.root, "ingestion_corpus", F.col("id").alias("corpus_id"), "corpus_name", "status")
        counts = pages(self.spark, self.root, "corpus_id").groupBy("corpus_id").agg(F.count("*").alias("n_pages"))
        return rows.join(counts, "corpus_id", "left").join(quality_advice(self.spark, self.root), "corpus_id", "left").fillna({"n_pages": 0, "advice": "NO_DATA"})

    def catalog(self) -> dict[str, DataFrame]:
        """The catalog's views by name."""
        return {"portals": best_page_per_corpus(self.spark, self.root), "links": merged_links(self.spark, self.root), "keywords": topic_keywords(self.spark, self.root)}

    def curate(self, rows: DataFrame, overrides: DataFrame, now) -> DataFrame:
        """``catalog.curate``."""
        return catalog.curate(rows, overrides, now)

    def start(self, jobs: DataFrame, runs: DataFrame, seeds: DataFrame, queued: DataFrame) -> DataFrame:
        """``lifecycle.started``."""
        return lifecycle.started(jobs, runs, seeds, queued)
