"""Lines repeated across one site's documents (problem 7).

Each line's pages are a compressed bitmap per site: containers of 65,536 ids, each a sorted list of 16-bit numbers or,
beyond 4,096 of them, 8 KB of bits. Variants of a line share a key, so their bitmaps are united; the cardinality of
the union is exact. Bitmaps of repeated lines, read back as pages, say which lines go from which page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, hash64, letters_key, map_batches, page_lines
from corpusmill.session import materialize, spread
from corpusmill.sources.tables import table
from corpusmill.sources.views import single_rows

MIN_PAGES = 4
#: A repeated line stands in at least one of so many pages of its site.
ONE_IN = 10
#: The key under which a site's bitmap of all its pages is kept; also that of lines without letters, which do not count.
PAGES = 0
_LIST_MOST = 4096
_MEMO = 100_000


def pack(low: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a container."""
    if len(low) <= _LIST_MOST:
        return b"\0" + low.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The numbers in a container, sorted."""
    if container[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little")).astype(np.uint16)
    return np.frombuffer(container, "<u2", offset=1)


def unite(containers: list[bytes]) -> tuple[bytes, int]:
    """The union of containers and how many numbers it has."""
    if len(containers) == 1:
        only = containers[0]
        return only, len(unpack(only)) if only[0] else (len(only) - 1) // 2
    low = np.unique(np.concatenate([unpack(c) for c in containers]))
    return pack(low), len(low)


def line_keys(pages: DataFrame) -> DataFrame:
    """(document_id, corpus_id, keys array<bigint>) of ``pages`` (id, corpus_id, content_text): the key of each line.

    Pages with a null id, no site or a null or blank text are left out; a line without letters has key 0.
    """
    schema = [("document_id", pa.int64()), ("corpus_id", pa.int64()), ("keys", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for rows in batches:
            ids, sites, keys = [], [], []
            for page, site, text in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                if page is None or site is None or not text or text.isspace():
                    continue
                if len(memo) > _MEMO:
                    memo.clear()
                own = []
                for line in page_lines(text):
                    key = memo.get(line)
                    if key is None:
                        plain = letters_key(line)
                        key = memo[line] = (hash64(plain) or 1) if plain else PAGES
                    own.append(key)
                ids.append(page)
                sites.append(site)
                keys.append(own)
            yield batch(schema, (ids, sites, keys))

    return map_batches(pages.select("id", "corpus_id", "content_text"), run, "document_id long, corpus_id long, keys array<long>")


def line_bitmaps(keyed: DataFrame) -> DataFrame:
    """(corpus_id, line_key, container, bits, n): per site and line the bitmap of its pages, and that of all pages.

    Bitmaps are built and united within each batch before the shuffle; a group after it is one container of one line,
    at most 65,536 pages, whatever share of all rows one site or line has.
    """
    schema = [("corpus_id", pa.int64()), ("line_key", pa.int64()), ("container", pa.int64()), ("bits", pa.binary())]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            page, site = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            lists = rows.column(2)
            size = np.diff(lists.offsets.to_numpy())
            line = lists.flatten().to_numpy()
            page, site, line = np.concatenate([np.repeat(page, size), page]), np.concatenate([np.repeat(site, size), site]), np.concatenate([line, np.zeros(len(page), np.int64)])
            keep = (line != PAGES) | (np.arange(len(line)) >= len(line) - rows.num_rows)
            page, site, line = page[keep], site[keep], line[keep]
            order = np.lexsort((page, line, site))
            page, site, line = page[order], site[order], line[order]
            same = (page[1:] == page[:-1]) & (line[1:] == line[:-1]) & (site[1:] == site[:-1])
            keep = np.concatenate([[True], ~same]) if len(page) else np.zeros(0, bool)
            page, site, line = page[keep], site[keep], line[keep]
            high, low = page >> 16, (page & 0xFFFF).astype(np.uint16)
            if not len(page):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (line[1:] != line[:-1]) | (site[1:] != site[:-1])]))
            ends = np.append(starts[1:], len(page))
            packed = [pack(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(site[starts]), pa.array(line[starts]), pa.array(high[starts]), pa.array(packed, pa.binary())], names=[name for name, _ in schema])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            united = [unite(parts) for parts in rows.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([b for b, _ in united], pa.binary()), pa.array([n for _, n in united], pa.int32())], names=["corpus_id", "line_key", "container", "bits", "n"])

    parts = map_batches(keyed, build, "corpus_id long, line_key long, container long, bits binary")
    grouped = parts.groupBy("corpus_id", "line_key", "container").agg(F.collect_list("bits").alias("parts"))
    return map_batches(grouped, merge, "corpus_id long, line_key long, container long, bits binary, n int")


def repeated_lines(bitmaps: DataFrame, min_pages: int = MIN_PAGES, one_in: int = ONE_IN) -> DataFrame:
    """(corpus_id, line_key, n_pages, n_site_pages) of the lines that stand in enough of their site's pages."""
    counts = bitmaps.groupBy("corpus_id", "line_key").agg(F.sum("n").alias("n_pages"))
    sites = counts.where(f"line_key = {PAGES}").select("corpus_id", F.col("n_pages").alias("n_site_pages"))
    often = counts.where(f"line_key <> {PAGES} and n_pages >= {min_pages}")
    return often.join(sites, "corpus_id").where(F.col("n_pages") * one_in >= F.col("n_site_pages"))


def lines_to_delete(bitmaps: DataFrame, repeated: DataFrame) -> DataFrame:
    """(document_id, line_keys): the repeated lines of each page, read from the lines' bitmaps."""
    schema = [("document_id", pa.int64()), ("line_key", pa.int64())]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, keys = [], []
            for key, high, bits in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                low = unpack(bits).astype(np.int64) + (high << 16)
                ids.append(low)
                keys.append(np.full(len(low), key, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=[name for name, _ in schema])

    hot = bitmaps.join(repeated.select("corpus_id", "line_key"), ["corpus_id", "line_key"])
    listed = map_batches(hot.select("line_key", "container", "bits"), pages, "document_id long, line_key long")
    return listed.groupBy("document_id").agg(F.collect_set("line_key").alias("line_keys"))


def repeated_in_pages(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The repeated lines, and (document_id, line_no) wherever they stand."""
    pages = spread(table(spark, root, "ingestion_document", "id", "corpus_id", "content_text"))
    keyed = materialize(line_keys(pages), "line-keys")
    bitmaps = materialize(line_bitmaps(keyed), "line-bitmaps")
    repeated = repeated_lines(bitmaps)
    marked = keyed.join(lines_to_delete(bitmaps, repeated), "document_id")
    places = F.expr("filter(transform(keys, (k, i) -> if(array_contains(line_keys, k), i, -1)), i -> i >= 0)")
    return repeated, marked.select("document_id", F.explode(places).alias("line_no")).distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, line_no): every place of a repeated line."""
    return repeated_in_pages(spark, root)[1]


def p7_lines(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, line_key, n_pages, n_site_pages): the repeated lines of each site, with their exact page counts."""
    return repeated_in_pages(spark, root)[0].select("corpus_id", "line_key", "n_pages", "n_site_pages")


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, content_text): each page's text without its repeated lines; null and blank texts stay as they are."""
    found = p7_found(spark, root).groupBy("document_id").agg(F.collect_list("line_no").alias("gone"))
    pages = single_rows(spark, root, "ingestion_document", "id", "content_text").withColumnRenamed("id", "document_id")
    kept = F.expr("array_join(filter(split(content_text, '\n', -1), (line, i) -> not array_contains(gone, i)), '\n')")
    return pages.join(found, "document_id", "left").select("document_id", F.when(F.col("gone").isNull(), F.col("content_text")).otherwise(kept).alias("content_text"))


QUERIES = {"p7_found": p7_found, "p7_lines": p7_lines, "p7_clean": p7_clean}
SQL: dict[str, str] = {}
