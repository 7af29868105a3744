"""Splitting oversized items at natural boundaries (problem 2).

Recursive bisection: a stretch over the allowance (limit less overlap) is cut at the strongest boundary near its
midpoint and both halves are treated alike; then each piece gets the end of the one before as its overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, map_batches
from corpusmill.sources.views import single_rows

OVERLAP = 120
#: table -> (text column, limit in characters).
LIMITS = {"ingestion_document": ("content_text", 2000), "ingestion_chunk": ("text", 800)}
_GAP = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？]['\"»”’)\]]*$")
WORD_END, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4


def boundaries(text: str) -> dict[int, list[int]]:
    """Strength -> sorted places (the start of what follows) where a cut of at least that strength may be."""
    places: list[tuple[int, int]] = []
    for gap in _GAP.finditer(text):
        newlines = gap.group().count("\n")
        if newlines:
            strength = PARAGRAPH if newlines > 1 else LINE
        else:
            strength = SENTENCE if _SENTENCE_END.search(text, max(0, gap.start() - 6), gap.start()) else WORD_END
        places.append((gap.end(), strength))
        if gap.end() - gap.start() > 1:
            places.append((gap.start(), WORD_END))
    places.sort()
    return {s: [p for p, strength in places if strength >= s] for s in (PARAGRAPH, LINE, SENTENCE, WORD_END)}


def cut_between(start: int, end: int, places: dict[int, list[int]]) -> int:
    """The strongest boundary in the middle half of [start, end), the nearest to the midpoint among equals; if the
    middle half has none, the nearest of any strength in all of it; if there is none at all, the midpoint."""
    middle, reach = (start + end) // 2, max(1, (end - start) // 4)
    for strength, low, high in [*((s, middle - reach, middle + reach) for s in places), (WORD_END, start + 1, end - 1)]:
        at = places[strength]
        i, j = bisect_left(at, max(low, start + 1)), bisect_right(at, min(high, end - 1))
        if i < j:
            k = bisect_left(at, middle, i, j)
            return min(at[max(i, k - 1) : min(j, k + 1)], key=lambda p: (abs(p - middle), p))
    return middle


def pieces(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) of each piece of the text without its outer whitespace; the stretches [start, end)
    lie side by side and give back all of it. A text within the limit is one piece; a blank text is none."""
    left = len(text) - len(text.lstrip())
    right = len(text.rstrip())
    if right <= left:
        return []
    if right - left <= limit:
        return [(left, left, right)]
    places, allowance, stack, out = boundaries(text), limit - overlap, [(left, right)], []
    while stack:
        start, end = stack.pop()
        if end - start <= allowance:
            out.append((start, end))
            continue
        cut = cut_between(start, end, places)
        stack += [(cut, end), (start, cut)]
    result = []
    for start, end in out:
        back = start
        if start > left:
            back = max(left, start - overlap)
            if back > left and not text[back - 1].isspace() and not text[back].isspace():
                while back < start and not text[back].isspace():
                    back += 1
            while back < start and text[back].isspace():
                back += 1
        result.append((back, start, end))
    return result


def split_items(items: DataFrame, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """(item_id, piece_no, n_pieces, start_at, own_at, end_at, text) of ``items`` (item_id, text) over the limit.

    Characters are code points. Items within the limit, null and blank texts give no row. ``text`` is characters
    start_at to end_at of the item, of which those before own_at repeat the piece before. ``items`` has each id once. No row
    needs another, so nothing is shuffled.
    """
    schema = [("item_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_at", pa.int32()), ("own_at", pa.int32()), ("end_at", pa.int32()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns: list[list] = [[] for _ in schema]
            for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                cuts = pieces(text, limit, overlap)
                if len(cuts) < 2:
                    continue
                for n, (back, start, end) in enumerate(cuts):
                    for column, value in zip(columns, (item, n, len(cuts), back, start, end, text[back:end]), strict=True):
                        column.append(value)
            yield batch(schema, columns)

    long = items.select("item_id", "text").where(F.length("text") > limit)
    return map_batches(long, run, "item_id long, piece_no int, n_pieces int, start_at int, own_at int, end_at int, text string")


def _all_pieces(spark: SparkSession, root: str) -> DataFrame:
    out = None
    for name, (column, limit) in LIMITS.items():
        items = single_rows(spark, root, name, "id", column).toDF("item_id", "text")
        cut = split_items(items, limit).select(F.lit(name).alias("item_table"), "*")
        out = cut if out is None else out.unionByName(cut)
    return out


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(item_table, item_id): the items that had to be cut."""
    return _all_pieces(spark, root).where("piece_no = 1").select("item_table", "item_id")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """(item_table, item_id, piece_no, n_pieces, start_at, own_at, end_at, text): all pieces of all oversized items."""
    return _all_pieces(spark, root)


_WHITE = r"E' \t\n\r\f\v' || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || chr(28) || chr(29) || chr(30) || chr(31) || " + " || ".join(f"chr({n})" for n in range(8192, 8203))
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {
    "p2_found": " union all ".join(
        f"select distinct '{name}' as item_table, id as item_id from {name} where length(trim({column}, {_WHITE})) > {limit}" for name, (column, limit) in LIMITS.items()
    ),
}
