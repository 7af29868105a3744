"""From fetched pages to chunks: extraction, validation, gates, chunking, links and the frontier."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text, urls

CHUNK_CHARS, CHUNK_OVERLAP = 800, 120
_BLANK_LINE, _BLANK = re.compile(r"\n(?=\n)"), re.compile(" ")


def fixed_size_pieces(value: str | None, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Pieces of about ``size`` characters: cut after the last blank line, else at the last blank, if past a quarter of
    the piece; else hard, and only then with an overlap. Null and blank texts have none."""
    whole = (value or "").strip()
    if len(whole) <= size:
        return [whole] if whole else []
    # candidate boundaries of the whole text: where they are, how much of them stays with the piece, how much is skipped
    kinds = [([m.start() for m in _BLANK_LINE.finditer(whole)], 2, 2), ([m.start() for m in _BLANK.finditer(whole)], 0, 1)]

    def boundary(start: int) -> tuple[int, int]:
        """Where the piece from ``start`` ends and where the next one starts."""
        limit, found = start + size, []
        for places, kept, skipped in kinds:
            before = bisect_right(places, limit)
            found += [(places[before - 1] + kept, places[before - 1] + skipped)] if before and places[before - 1] > start + size // 4 else []
        return found[0] if found else (limit, max(limit - overlap, start + 1))

    cuts = [(0, *boundary(0))]
    while len(whole) - cuts[-1][2] > size:
        cuts.append((cuts[-1][2], *boundary(cuts[-1][2])))
    spans = [(start, end) for start, end, _ in cuts] + [(cuts[-1][2], len(whole))]
    return [piece for start, end in spans if start < len(whole) and (piece := whole[start:end].strip())]


def chunk_texts(documents: DataFrame, key: str, column: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, sequence_no, text, n_chars) of the pieces of every row; rows are cut one by one, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, numbers, pieces = [], [], []
            for row, value in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                own = fixed_size_pieces(value, size, overlap)
                keys += [row] * len(own)
                numbers += range(len(own))
                pieces += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, rows.column(0).type), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], names=[key, "sequence_no", "text"])

    kind = dict(documents.dtypes)[key]
    return documents.select(key, column).mapInArrow(run, f"{key} {kind}, sequence_no int, text string").withColumn("n_chars", F.length("text"))


# ---- validation and gates


@dataclass(frozen=True)
class Limits:
    """Lengths of the validators and the gate."""

    reject: int = 30
    degrade: int = 100
    truncation: int = 200
    look_back: int = 40
    paragraph: int = 25
    gate_length: int = 200
    gate_ratio: float = 0.6


STATUSES = ("GOOD", "DEGRADED", "SKIP", "REJECT")


def min_length_status(body: Column, kind: Column, limits: Limits = Limits()) -> Column:
    """Ordinal in STATUSES: too short is rejected, short degraded; a portal is skipped."""
    n = F.length(F.trim(F.coalesce(body, F.lit(""))))
    return F.when(n < limits.reject, 3).when(F.coalesce(kind == "portal", F.lit(False)), 2).when(n < limits.degrade, 1).otherwise(0)


def truncation_status(body: Column, limits: Limits = Limits()) -> Column:
    """A long body whose end has neither a full stop nor a short last word is degraded."""
    tail = F.right(F.trim(body), F.lit(limits.look_back))
    whole = tail.rlike(r"[.!?…:;)\]»”\"]$") | tail.rlike(r"(^|\s)\S{1,4}$")
    return F.when((F.length(F.trim(body)) >= limits.truncation) & ~whole, 1).otherwise(0)


def distinct_paragraphs(body: Column, limits: Limits = Limits()) -> Column:
    """The body's paragraphs without later ones that equal an earlier one but for case and spacing; short ones stay."""
    parts = F.filter(F.transform(F.split(body, r"[\r\n]{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    keys = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, text.SPACES, " ")))
    kept = F.filter(
        F.arrays_zip(parts.alias("part"), keys.alias("key"), F.transform(parts, lambda p, i: i).alias("at")),
        lambda x: (F.length(x["key"]) < limits.paragraph) | (F.array_position(keys, x["key"]) == x["at"] + 1),
    )
    return F.array_join(F.transform(kept, lambda x: x["part"]), "\n\n")


def repetition_status(body: Column, limits: Limits = Limits()) -> Column:
    return F.when(F.length(distinct_paragraphs(body, limits)) < F.length(F.array_join(F.filter(F.transform(F.split(body, r"[\r\n]{2,}"), lambda p: F.trim(p)), lambda p: p != ""), "\n\n")), 1).otherwise(0)


def worst_status(*ordinals: Column) -> Column:
    """The name of the worst of several validators' ordinals."""
    return F.element_at(F.array(*map(F.lit, STATUSES)), F.greatest(*ordinals) + 1 if len(ordinals) > 1 else ordinals[0] + 1)


def boilerplate_counts(body: Column, markers: list[str]) -> tuple[Column, Column]:
    """How many paragraphs (cut at line breaks and runs of blanks) a body has, and how many hold a marker; those with
    statistics never count as boilerplate."""
    parts = F.filter(F.split(body, r"\s{2,}|\n+"), lambda p: F.trim(p) != "")
    marked = F.filter(parts, lambda p: ~text.is_statistical(p) & F.lower(p).rlike("|".join(m.lower() for m in markers)))
    return F.size(parts), F.size(marked)


def gate(body: Column, markers: list[str], limits: Limits = Limits()) -> Column:
    """ACCEPT, TOO_SHORT or BOILERPLATE_ONLY."""
    parts, marked = boilerplate_counts(body, markers)
    short = F.coalesce(F.length(F.trim(body)), F.lit(0)) < limits.gate_length
    return F.when(short, "TOO_SHORT").when(marked > limits.gate_ratio * parts, "BOILERPLATE_ONLY").otherwise("ACCEPT")


def strip_boilerplate(body: Column, markers: list[str]) -> Column:
    """The paragraphs without a marker, or with statistics, joined by single blanks."""
    parts = F.filter(F.transform(F.split(body, r"\s{2,}|\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.filter(parts, lambda p: text.is_statistical(p) | ~F.lower(p).rlike("|".join(m.lower() for m in markers))), " ")


def compare(value: Column, spec: str, threshold: float) -> Column:
    """A gate's comparison: <=, >=, <, > or =, with a tolerance of 1e-9."""
    e = 1e-9
    return {"<=": value <= threshold + e, ">=": value >= threshold - e, "<": value < threshold - e, ">": value > threshold + e, "=": F.abs(value - threshold) <= e}[spec]


# ---- HTML


class _Page(HTMLParser):
    """Collects the title, text blocks, links, headings and marks of one page; repairs nothing."""

    BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "blockquote"}
    REMOVED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.links, self.headings, self.meta, self.json_ld, self.tables = "", [], [], [], {}, [], 0
        self._open: list[str] = []
        self._removed = 0
        self._parts: list[str] = []
        self._block = ""
        self._script = False
        self.lang = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = values.get("lang", "")[:2].lower()
        if tag == "meta":
            self.meta[(values.get("name") or values.get("property") or "").lower()] = values.get("content", "")
        if tag == "a" and values.get("href"):
            self.links.append(values["href"])
        if tag == "script" and "ld+json" in values.get("type", ""):
            self._script = True
        if tag == "table":
            self.tables += 1
        if tag in self.REMOVED:
            self._removed += 1
        elif tag in self.BLOCKS and not self._removed:
            self._flush()
            self._block = tag
        if tag == "title":
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.REMOVED:
            self._removed = max(0, self._removed - 1)
            self._script = False
        elif tag in self.BLOCKS:
            self._flush()
        if tag == "title" and self._open:
            self._open.pop()

    def handle_data(self, data: str) -> None:
        if self._open:
            self.title += data
        elif self._script:
            self.json_ld.append(data)
        elif self._block and not self._removed:
            self._parts.append(data)

    def _flush(self) -> None:
        value = " ".join("".join(self._parts).split())
        if value and self._block:
            self.blocks.append(value)
            if self._block in ("h1", "h2", "h3") and len(self.headings) < 5:
                self.headings.append(value[:120])
        self._parts, self._block = [], ""


_TEXT, _LIST = T.StringType(), T.ArrayType(T.StringType())
_EXTRACTED = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("title", _TEXT), ("body", _TEXT), ("blocks", T.IntegerType()), ("links", _LIST), ("section_path", _LIST),
            ("language", _TEXT), ("noindex", T.BooleanType()), ("description", _TEXT), ("kind", _TEXT), ("published", _TEXT),
        )
    ]
)


@F.pandas_udf(_EXTRACTED)
def extract_html(pages: pd.Series) -> pd.DataFrame:
    """What a page's HTML says: title, body (blocks joined by blank lines), links, headings, language, marks and kind.
    Navigation, headers, footers, asides and forms are left out. Null pages give nulls and empty lists."""
    import json

    rows = []
    for html in pages:
        page = _Page()
        if html:
            page.feed(html)
            page.close()
            page._flush()
        data: dict = {}
        for own in page.json_ld:
            try:
                node = json.loads(own)
            except ValueError:
                continue
            nodes = node.get("@graph", [node]) if isinstance(node, dict) else node
            data = next((n for n in nodes if isinstance(n, dict) and (n.get("datePublished") or n.get("@type"))), data)
        robots = page.meta.get("robots", "") + page.meta.get("googlebot", "")
        kind = "news" if data.get("@type") in ("NewsArticle", "Article") or page.meta.get("og:type") == "article" else "dataset" if data.get("@type") == "Dataset" or page.tables >= 2 else "unknown"
        rows.append((page.title.strip() or None if html else None, "\n\n".join(page.blocks) if html else None, len(page.blocks), page.links, page.headings, page.lang or None, "noindex" in robots.lower(), page.meta.get("description") or None, kind, data.get("datePublished") or page.meta.get("article:published_time") or None))
    return pd.DataFrame(rows, columns=["title", "body", "blocks", "links", "section_path", "language", "noindex", "description", "kind", "published"])


# ---- links and the frontier


def discovered_links(pages: DataFrame, hosts: list[str], max_depth: int) -> DataFrame:
    """(source_id, url, url_hash, depth) of ``pages`` (source_id, depth, links): absolute links to allowed hosts, each
    once a page, in normal form, one deeper; none beyond ``max_depth``."""
    rows = pages.where(F.col("depth") < max_depth).select("source_id", (F.col("depth") + 1).alias("depth"), F.explode("links").alias("link"))
    url = urls.normalize_url(F.col("link"))
    rows = rows.where(urls.url_allowed(F.col("link"), hosts, "all") & ~urls.is_binary_url(F.col("link")))
    return rows.select("source_id", url.alias("url"), urls.url_hash(url).alias("url_hash"), "depth").distinct()


def enqueue(candidates: DataFrame, frontier: DataFrame, hosts: list[str]) -> DataFrame:
    """``candidates`` (url) with url_hash and verdict: rejected by host, duplicate of the frontier (url_hash) or of an
    earlier candidate, else enqueued."""
    named = candidates.select("url").withColumn("url_hash", urls.url_hash(urls.normalize_url(F.col("url"))))
    known = frontier.select("url_hash").distinct().withColumn("known", F.lit(True))
    first = named.groupBy("url_hash").agg(F.min("url").alias("first_url"), F.count("*").alias("n"))
    joined = named.distinct().join(first, "url_hash").join(known, "url_hash", "left")
    verdict = F.when(~urls.host_allowed(F.col("url"), hosts, "all"), "rejected").when(F.col("known") | (F.col("url") != F.col("first_url")), "duplicate").otherwise("enqueued")
    return joined.select("url", "url_hash", verdict.alias("verdict"))


def resume_frontier(queued: DataFrame, existing: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` queued entries (url, url_hash, discovered_at) of an old run that the new run does not have."""
    return queued.join(existing.select("url_hash"), "url_hash", "left_anti").orderBy("discovered_at", "url_hash").limit(most)


def page_kind(url: Column) -> tuple[Column, Column]:
    """A page's kind by its address and how sure that is; null where the address says nothing."""
    # The kinds, their order and how sure each is.
    path = F.lower(urls.url_path(url))
    rules = [
        (path.contains("/news/") | path.contains("/newsroom/"), "news", 0.95),
        (path.rlike(r"\.(csv|xls|xlsx|json|xml|zip)$") | path.contains("/download/") | path.contains("/microdata/"), "dataset", 0.95),
        (path.rlike(r"\.(pdf|doc|docx)$") | path.contains("/publications/") | path.contains("/publication/"), "report", 0.92),
        (path.contains("/faq") | path.endswith("/questions"), "faq", 0.9),
        (path.rlike("/sitemap|/about-us|/about/|/contact|/privacy|/terms|/search$"), "navigation", 0.9),
        (path.rlike("^/(ka|en)/?$|^/(ka|en)/modules/categories/?$"), "portal", 0.88),
    ]
    kind, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rule, name, p in reversed(rules):
        kind, sure = F.when(rule, name).otherwise(kind), F.when(rule, p).otherwise(sure)
    return kind, sure


def changed_pages(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, change) of ``fetched`` (id, content_hash) against ``stored`` (id, content_hash): new, changed or unchanged."""
    old = stored.select("id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    change = F.when(F.col("known").isNull(), "new").when(F.col("content_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return fetched.join(old, "id", "left").select("id", change.alias("change"))
