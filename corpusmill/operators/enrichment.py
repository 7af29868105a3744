"""Keywords, authority, topics and locale pairs."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.functions import scores, urls
from corpusmill.operators.catalog import first_per_group, ranked
from corpusmill.session import materialize

_SENTENCES, _TOKEN = re.compile(r"[.!?\n]+"), re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def similar(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 0.0
    row = np.zeros(len(b) + 1, np.int32)
    codes = np.frombuffer(b.encode("utf-32-le"), "<u4")
    for c in map(ord, a):
        match = np.concatenate([[0], np.where(codes == c, row[:-1] + 1, 0)])
        row = np.maximum.accumulate(np.maximum(row, match))
    return 2.0 * int(row[-1]) / (len(a) + len(b))


def _repeats(term: str, kept: list[str], alike: float) -> bool:
    """Is a phrase contained in one of ``kept``, or one of these in it, or nearly the same?"""
    if any(term in other or other in term for other in kept):
        return True
    longest = [o for o in kept if 2 * min(len(term), len(o)) >= alike * (len(term) + len(o))]  # others cannot be alike
    return any(similar(term, other) >= alike for other in longest)


def keyphrases(text: str | None, most: int = 15, longest: int = 3, alike: float = 0.9) -> list[tuple[str, float]]:
    """Phrases of up to ``longest`` words within a sentence, ascending by casing, place, frequency, length, share and
    spread; one that contains, is contained in or is like an earlier one is left out."""
    listed = ([w for w in _TOKEN.findall(s) if len(w) > 1 or w.isdigit()] for s in _SENTENCES.split(text or "") if s.strip())
    # one entry an occurrence, in the order of the text: the phrase, the number of its sentence and that sentence's length
    found = [(" ".join(words[i : i + n]), number, len(words)) for number, words in enumerate(listed) for i in range(len(words)) for n in range(1, min(longest, len(words) - i) + 1)]
    if not found:
        return []
    total = sum({number: size for _, number, size in found}.values())
    phrases: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for phrase, number, size in found:
        phrases[phrase].append((number, size))
    often = max(map(len, phrases.values()))

    def score(phrase: str, places: list[tuple[int, int]]) -> float:
        n, letters = len(places), [c for c in phrase if c.isalpha()]
        casing = 1.0 + sum(map(str.isupper, letters)) / max(1, len(letters))
        related = sum(1.0 / size for _, size in places) / n
        return casing / (1.0 + places[0][0]) * (1 + n / often) * (1 + related) * (1 + n / total) * (1 + len({number for number, _ in places}) / n)

    out: list[tuple[str, float]] = []
    for value, phrase in sorted(((score(p, places), p) for p, places in phrases.items()), key=lambda x: x[0]):
        if not _repeats(phrase.lower(), [o.lower() for o, _ in out], alike):
            out.append((phrase, value))
            if len(out) == most:
                break
    return out


def keywords(documents: DataFrame, key: str, column: str, most: int = 15) -> DataFrame:
    """(key, place, keyword, score): each document's phrases; documents without a word have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [(k, n, term, score) for k, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for n, (term, score) in enumerate(keyphrases(text, most), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.float64()))], names=[key, "place", "keyword", "score"])

    return documents.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, place int, keyword string, score double")


def merged_keywords(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, place, keyword, score) of ``found`` (id, place, keyword, score) for ``pairs`` (id, pair): a document's phrases,
    then those of its pair, if it has one; a phrase once whatever its case."""
    own = found.join(pairs.select("id"), "id", "left_semi").withColumn("source", F.lit(0))
    others = pairs.where("pair is not null").join(found.withColumnRenamed("id", "pair"), "pair").select("id", "place", "keyword", "score", F.lit(1).alias("source"))
    single = first_per_group(own.unionByName(others).withColumn("low", F.lower("keyword")), ["id", "low"], [F.asc("source"), F.asc("place")])
    return ranked(single.withColumnRenamed("place", "own_place"), ["id"], [F.asc("source"), F.asc("own_place")], "place").select("id", "place", "keyword", "score")


def kept_keywords(keyword: Column, stop_words: list[str]) -> Column:
    """Not short, not a stop word, not all digits."""
    return (F.length(keyword) >= 3) & ~F.lower(keyword).isin(stop_words) & ~keyword.rlike("^[0-9]+$")


def page_rank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(id, rank) of ``nodes`` (id) by ``edges`` (src, dst) between them; repeated edges and loops count once and not at
    all; the rank of nodes without an edge out is spread over all. Ranks sum to 1. With a ``tolerance`` rounds end when
    ranks change by no more in all.

    Nodes and edges are written once, and each round's ranks are written to the shared folder, so a round reads two tables
    and no plan grows. A page that a third of all edges lead to gets one partial sum a task.
    """
    known = materialize(nodes.select("id").distinct(), "nodes")
    inside = edges.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").distinct()
    inside = materialize(inside, "edges-inside")
    linked = materialize(inside.join(inside.groupBy("src").agg(F.count("*").alias("degree")), "src"), "edges")
    n = max(known.count(), 1)
    ranks = known.withColumn("rank", F.lit(1.0 / n))
    for number in range(1, rounds + 1):
        given = linked.join(ranks, linked["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        seen = Observation()
        given = materialize(given.observe(seen, F.coalesce(F.sum("given"), F.lit(0.0)).alias("passed")), f"given-{number}")
        passed_on = seen.get["passed"]  # what sinks keep is the rest of 1
        own = (1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + F.lit((1.0 - passed_on) / n))
        new = known.join(given, "id", "left").select("id", own.alias("rank"))
        if tolerance is not None:
            new = materialize(new, f"ranks-{number}")
            moved = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0)).alias("moved")).first().moved
            ranks = new
            if moved <= tolerance:
                break
        else:
            ranks = new
    return ranks


def topic_count(n: int) -> int:
    return max(2, min(n, round((n / 10) ** 0.5)))


def topics(vectors: DataFrame, clusters: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, cost) of ``vectors`` (id, vector) and (cluster, vector) of the centroids, by k-means with 100
    rounds and tolerance 1e-4."""
    data = vectors.select("id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=clusters or topic_count(vectors.count()), maxIter=100, tol=1e-4, seed=seed).fit(data)
    centers = vectors.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "cluster int, vector array<double>")
    assigned = model.transform(data).select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    cost = assigned.join(F.broadcast(centers), "cluster").select("id", "cluster", scores.dot(F.zip_with("v", "vector", lambda a, b: a - b), F.zip_with("v", "vector", lambda a, b: a - b)).alias("cost"))
    return cost, centers


def locale_pairs(documents: DataFrame) -> DataFrame:
    """(path_key, host, ka_id, en_id) of ``documents`` (id, url): pages of one host whose paths differ in the language
    alone; of several in one language, the lowest id."""
    rows = documents.select("id", urls.url_host(F.col("url")).alias("host"), urls.locale_path_key(F.col("url")).alias("path_key"), urls.url_locale(F.col("url")).alias("lang"))
    sides = rows.groupBy("host", "path_key").agg(*(F.min(F.when(F.col("lang") == lang, F.col("id"))).alias(f"{lang}_id") for lang in ("ka", "en")))
    return sides.where("ka_id is not null and en_id is not null")


def pair_cascade(documents: DataFrame, by_url: DataFrame, by_table: DataFrame, by_title: DataFrame) -> DataFrame:
    """(id, counterpart, method) of ``documents`` (id): the first counterpart (id, counterpart) of three sources."""
    joined = documents.select("id")
    names = ("url", "table", "title")
    for name, source in zip(names, (by_url, by_table, by_title), strict=True):
        joined = joined.join(source.groupBy("id").agg(F.min("counterpart").alias(name)), "id", "left")
    method = F.coalesce(*(F.when(F.col(name).isNotNull(), name) for name in names))
    return joined.select("id", F.coalesce(*names).alias("counterpart"), method.alias("method"))
