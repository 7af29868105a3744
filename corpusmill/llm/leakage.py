"""Evaluation texts leaking into training text (problem 9).

A quotation of SPAN words with at most one edit in any EVERY of them keeps at least KEPT of its five-word shingles
whole. So of each span of an item it is enough to look for all but KEPT - 1 of its shingles, the rarest ones: its
prefix. A document that shares a prefix shingle is a candidate, what lies before and after the shingle in both texts bounds
the span, and an exact alignment of windows around it verifies, where the document is: no document is sent anywhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, map_batches, words
from corpusmill.session import materialize, spread
from corpusmill.sources.tables import table

SPAN, EVERY, SHINGLE = 18, 8, 5
#: Items are sent to the executors in blocks of so many; each block is held against all documents.
ITEM_BLOCK = 20_000
#: Words before and after a match that are aligned.
REACH = 2 * SPAN
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def kept_shingles(span: int = SPAN, every: int = EVERY, shingle: int = SHINGLE) -> int:
    """The least number of shingles that survive the worst allowed edits of a span."""
    total = span - shingle + 1
    least = total
    for first in range(1, every + 1):
        edits = range(first, span - 1, every)
        least = min(least, sum(all(not start <= e < start + shingle for e in edits) for start in range(total)))
    return least


KEPT = kept_shingles()


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """The hash of each SHINGLE numbers in a row."""
    if len(ids) < SHINGLE:
        return np.zeros(0, np.int64)
    value = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        value = value * _PRIME + ids[k : k + len(value)].astype(np.uint64)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def longest_span(item: list[int], doc: list[int], at: int, place: int, every: int = EVERY) -> int:
    """How many words of ``item`` in a row, with whole words at both ends, ``doc`` holds around the match of item[at]
    and doc[place]: single words replaced, left out or added at least ``every`` apart."""

    def same(i: int, p: int, step: int) -> int:
        n = 0
        while 0 <= i < len(item) and 0 <= p < len(doc) and item[i] == doc[p]:
            n, i, p = n + 1, i + step, p + step
        return n

    known: dict[tuple[int, int, int], int] = {}

    def edited(i: int, p: int, step: int) -> int:
        """The most words beyond an edit at item[i], doc[p]; 0 if none follows it."""
        best = 0
        for di, dp in ((1, 1), (1, 0), (0, 1)):
            j, q = i + di * step, p + dp * step
            if 0 <= j < len(item) and 0 <= q < len(doc) and item[j] == doc[q]:
                best = max(best, di + after(j, q, step))
        return best

    def after(i: int, p: int, step: int) -> int:
        """The most words from the intact word item[i], doc[p] on, if an edit comes just before it."""
        if (i, p, step) not in known:
            run = known[i, p, step] = same(i, p, step)
            for n in range(every - 1, run + 1):
                more = edited(i + n * step, p + n * step, step)
                if more:
                    known[i, p, step] = max(known[i, p, step], n + more)
        return known[i, p, step]

    right, left = same(at, place, 1), same(at - 1, place - 1, -1)
    ahead = [edited(at + n, place + n, 1) if n else 0 for n in range(right + 1)]
    behind = [edited(at - 1 - n, place - 1 - n, -1) for n in range(left + 1)]
    best = right + left
    for n, more in enumerate(ahead):
        if more:
            best = max(best, left + n + more)
    for n, more in enumerate(behind):
        if more:
            best = max(best, right + n + more, *(n + more + m + other for m, other in enumerate(ahead) if other and n + m >= every - 1))
    return best


def holds(item: list[int], doc: list[int], at: int, place: int) -> bool:
    """Does ``doc`` hold SPAN words of ``item`` around the match of item[at] and doc[place]? What lies before and after the
    match bounds the span; and since a span that has the match has one of at most SPAN + 2 words around it, with whole words
    at both ends, only windows of the two are aligned."""
    before, after = min(at, place + place // EVERY + 1), min(len(item) - at, len(doc) - place + (len(doc) - place) // EVERY + 1)
    if before + after < SPAN:
        return False
    low, first = max(0, at - REACH), max(0, place - REACH)
    return longest_span(item[low : at + REACH], doc[first : place + REACH], at - low, place - first) >= SPAN


def _match_block(documents: DataFrame, items: dict[int, list[str]]) -> DataFrame:
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    coded = {item: [vocabulary.setdefault(word, len(vocabulary) + 1) for word in own] for item, own in items.items()}
    hashes = {item: shingle_hashes(np.array(own, np.int64)) for item, own in coded.items()}
    wanted = np.unique(np.concatenate([*hashes.values(), np.zeros(0, np.int64)]))
    shared = spark.sparkContext.broadcast((vocabulary, wanted))
    schema = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int64()))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sought = shared.value
        get = known.get
        for rows in batches:
            columns: list[list] = [[], [], [], []]
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                ids = np.array([get(word, 0) for word in words(text)], np.int64)
                if len(ids) < SPAN - len(ids) // EVERY - 2:
                    continue
                whole = np.convolve(ids > 0, np.ones(SHINGLE, int), "valid") == SHINGLE if len(ids) >= SHINGLE else np.zeros(0, bool)
                starts = np.flatnonzero(whole)
                if not len(starts):
                    continue
                own = shingle_hashes(ids)[starts]
                hit = sought[np.minimum(np.searchsorted(sought, own), len(sought) - 1)] == own
                if hit.any():
                    for column, value in zip(columns, (doc, ids, starts[hit], own[hit]), strict=True):
                        column.append(value)
            yield batch(schema, columns)

    scanned = materialize(map_batches(documents.select("doc_id", "text"), scan, "doc_id long, ids array<int>, places array<int>, shingles array<long>"), "leak-hits")
    postings = scanned.select("doc_id", F.explode(F.arrays_zip("places", "shingles")).alias("hit")).select("doc_id", "hit.places", "hit.shingles").toDF("doc_id", "place", "shingle")
    rarity = dict(postings.groupBy("shingle").agg(F.countDistinct("doc_id").alias("n")).collect())

    prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item, own in hashes.items():
        listed = own.tolist()
        size = SPAN - SHINGLE + 1
        chosen = set()
        for start in range(len(listed) - size + 1):
            chosen.update(sorted(range(start, start + size), key=lambda k: (rarity.get(listed[k], 0), listed[k], k))[: size - KEPT + 1])
        for k in sorted(chosen):
            if listed[k] in rarity:
                prefix[listed[k]].append((item, k))
    seeds = spark.sparkContext.broadcast((coded, dict(prefix)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, known = seeds.value
        for rows in batches:
            docs, found = [], []
            for doc, ids, places, shingles in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                own, seen = set(), set()
                for place, shingle in zip(places, shingles, strict=True):
                    for item, at in known.get(shingle, ()):
                        if item in own or (item, at - 1, place - 1) in seen:
                            seen.add((item, at, place))
                            continue
                        seen.add((item, at, place))
                        if holds(items_[item], ids, at, place):
                            own.add(item)
                docs += [doc] * len(own)
                found += own
            yield batch([("doc_id", pa.int64()), ("item_id", pa.int64())], (docs, found))

    return map_batches(scanned, verify, "doc_id long, item_id long")


def leaked_items(documents: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id), once each: ``documents`` (doc_id, text) that hold a passage of ``items`` (item_id, passage).

    Items are a stated query set: they are read by the driver a block of ``block`` at a time and each block is held
    against all documents, so what is broadcast never grows with the corpus. Null and empty texts and passages of fewer
    than SPAN words have no case. The same passage under two ids gives a case for each.
    """
    spark = documents.sparkSession
    found, own = None, {}

    def close() -> None:
        nonlocal found, own
        if own:
            part = _match_block(documents, own)
            found, own = part if found is None else found.unionByName(part), {}

    for row in items.select("item_id", "passage").where("item_id is not null and passage is not null").toLocalIterator():
        listed = words(row.passage)
        if len(listed) >= SPAN:
            own[row.item_id] = listed
        if len(own) == block:
            close()
    close()
    return spark.createDataFrame([], "doc_id long, item_id long") if found is None else found.distinct()


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, item_id): each document that quotes an evaluation passage, with the item."""
    return leaked_items(spread(table(spark, root, "documents", "doc_id", "text")), table(spark, root, "eval_item", "item_id", "passage"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, n_documents): the items that leaked and how many documents hold them."""
    return p9_found(spark, root).groupBy("item_id").agg(F.count("*").alias("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL: dict[str, str] = {}
