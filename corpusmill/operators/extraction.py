"""HTML to documents under profiles: what is removed, where the body is, which blocks it has, and strategies by page kind.

Pages come in Arrow batches; each is parsed once into a small tree. Selectors are single compounds of a tag, .class, #id and
[attribute=value].
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSED_BY_SELF = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_SELECTOR = re.compile(r"^([a-z0-9]*)((?:[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)$", re.I)
_PART = re.compile(r"[.#][\w-]+|\[[\w-]+(?:=[^\]]*)?\]")


class Node:
    """An element: its tag, attributes and children, which are elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def raw(self) -> str:
        parts, stack = [], [self]
        while stack:
            own = stack.pop()
            if isinstance(own, str):
                parts.append(own)
            else:
                stack += reversed(own.children)
                parts.append(" " if own.tag in ("br", "p", "li", "td", "div") else "")
        return "".join(parts)

    def text(self) -> str:
        return " ".join(self.raw().split())

    def fits(self, selector: str) -> bool:
        found = _SELECTOR.match(selector)
        if not found or found.group(1) and found.group(1).lower() != self.tag:
            return False
        for part in _PART.findall(found.group(2)):
            if part[0] == ".":
                fine = part[1:] in self.attrs.get("class", "").split()
            elif part[0] == "#":
                fine = self.attrs.get("id") == part[1:]
            else:
                name, _, value = part[1:-1].partition("=")
                fine = name in self.attrs and (not value or self.attrs[name] == value.strip("\"'"))
            if not fine:
                return False
        return True

    def first(self, *selectors: str) -> Node | None:
        """The first element that fits the first selector that any fits."""
        return next((node for s in selectors for node in self.walk() if node.fits(s)), None)

    def all(self, *selectors: str) -> list[Node]:
        return [node for node in self.walk() if any(node.fits(s) for s in selectors)]

    def without(self, selectors: tuple[str, ...]) -> Node:
        """A copy without the elements that fit."""
        out = Node(self.tag, self.attrs)
        out.children = [c if isinstance(c, str) else c.without(selectors) for c in self.children if isinstance(c, str) or not any(c.fits(s) for s in selectors)]
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSED_BY_SELF and self.open[-1].tag == tag or tag in _CLOSES_P and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def linked_data(page: Node) -> dict[str, str]:
    """date, description, type and breadcrumb of the first JSON-LD node that has any; broken JSON is passed over."""
    for script in page.all("script[type=application/ld+json]"):
        try:
            found = json.loads(script.raw())
        except ValueError:
            continue
        graph = found.get("@graph") if isinstance(found, dict) else found
        for node in [*(graph if isinstance(graph, list) else []), found]:
            if not isinstance(node, dict):
                continue
            told = {name: node[key] for name, key in (("date", "datePublished"), ("description", "description"), ("type", "@type")) if isinstance(node.get(key), str) and node[key].strip()}
            items = (node.get("breadcrumb") if isinstance(node.get("breadcrumb"), dict) else node).get("itemListElement")
            names = [i["name"].strip() for i in items if isinstance(i, dict) and isinstance(i.get("name"), str) and i["name"].strip()] if isinstance(items, list) else []
            if names:
                told["breadcrumb"] = " > ".join(names)
            if told:
                return told
    return {}


@dataclass(frozen=True)
class Profile:
    """How a site's pages are read."""

    name: str = "default"
    removed: tuple[str, ...] = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", ".breadcrumb", ".cookie")
    roots: tuple[str, ...] = ("main", "article", "[role=main]", "#content")
    blocks: tuple[str, ...] = ("h1", "h2", "h3", "h4", "p", "li", "td", "th", "blockquote")
    titles: tuple[str, ...] = ("h1",)
    language: str = "ka"
    headings: bool = True


#: The fixed profile without roots, for pages of sites that have none.
LEGACY = Profile(name="legacy", removed=("script", "style", "nav", "footer", "header", "noscript"), roots=(), titles=(), headings=False)
#: News: the body is the article's, and so is the title.
NEWS = Profile(name="news", roots=("article", ".news-body", "main"), titles=("h1", ".news-title"))


@dataclass(frozen=True)
class Registry:
    """Which profile reads a page: the first rule (corpus or '', page kind or '', profile) that fits, else the default."""

    rules: tuple[tuple[str, str, Profile], ...] = (("", "news", NEWS),)
    default: Profile = field(default_factory=Profile)

    def resolve(self, corpus: str | None, kind: str | None) -> Profile:
        return next((p for c, k, p in self.rules if c in ("", corpus) and k in ("", kind)), self.default)


def extract(html: str | None, url: str | None, profile: Profile) -> tuple:
    """(strategy, title, body, n_blocks, section_path, breadcrumb, language, noindex, description, lead, type, published) of
    a page. A page that must not be indexed has no more than that; a null page has nothing."""
    if html is None:
        return (profile.name, None, None, 0, [], None, None, False, None, None, None, None)
    page = parse(html)
    meta = {(m.attrs.get("name") or m.attrs.get("property") or "").lower(): m.attrs.get("content", "") for m in page.all("meta")}
    if "noindex" in (meta.get("robots", "") + meta.get("googlebot", "")).lower():
        return (profile.name, None, None, 0, [], None, None, True, None, None, None, None)
    told = linked_data(page)
    body = page.first("body") or page
    root = body.without(profile.removed)
    root = (root.first(*profile.roots) if profile.roots else None) or root
    taken, blocks = set(), []
    for node in root.walk():
        if id(node) not in taken and any(node.fits(b) for b in profile.blocks):
            taken.update(map(id, node.walk()))
            if value := node.text():
                blocks.append((node.tag, value))
    own = root.first(*profile.titles) if profile.titles else None
    head = page.first("title")
    title = next((t for t in (own.text() if own else "", head.text() if head else "") if t), None)
    crumbs = page.first(".breadcrumb", "[aria-label=breadcrumb]")
    crumb = " > ".join(t for t in (c.text() for c in crumbs.all("a", "li", "span")) if t) if crumbs else ""
    named = page.first("html")
    path = re.search(r"/(ka|en)(?:/|$)", url or "")
    language = (named.attrs.get("lang", "")[:2].lower() if named else "") or (path.group(1) if path else "") or profile.language
    time = page.first("time[datetime]")
    published = told.get("date") or (time.attrs["datetime"] if time else "") or meta.get("article:published_time") or None
    lead = next((v for tag, v in blocks if tag == "p" and len(v) >= 40 and sum(map(str.isalpha, v)) >= 20), None)
    return (
        profile.name, title, "\n\n".join(v for _, v in blocks), len(blocks), [v[:120] for tag, v in blocks if tag in ("h1", "h2", "h3")][:5] if profile.headings else [],
        crumb or told.get("breadcrumb"), language, False, meta.get("description") or told.get("description") or None, lead, told.get("type"), published,
    )


_FIELDS = [("strategy", T.StringType()), ("title", T.StringType()), ("body", T.StringType()), ("n_blocks", T.IntegerType()), ("section_path", T.ArrayType(T.StringType())), ("breadcrumb", T.StringType()), ("language", T.StringType()), ("noindex", T.BooleanType()), ("description", T.StringType()), ("lead", T.StringType()), ("type", T.StringType()), ("published", T.StringType())]


def extracted(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """``pages`` (id, html, url, corpus, kind) with ``x``, the fields of ``extract`` under the registry's profile."""
    known = registry or Registry()

    @F.pandas_udf(T.StructType([T.StructField(n, k) for n, k in _FIELDS]))
    def run(html: pd.Series, url: pd.Series, corpus: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = [extract(h, u, known.resolve(c, k)) for h, u, c, k in zip(html, url, corpus, kind, strict=True)]
        return pd.DataFrame(rows, columns=[n for n, _ in _FIELDS])

    return pages.withColumn("x", run("html", "url", "corpus", "kind"))


def registry_of(config: dict) -> Registry:
    """A registry of plain data, as a JSON or YAML file gives it: {"default": {...}, "rules": [{"corpus": , "kind": ,
    "profile": {...}}]}; a profile's fields that are not given are those of the default one."""

    def profile(own: dict, base: Profile) -> Profile:
        return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})

    default = profile(config.get("default", {}), Profile())
    return Registry(tuple((r.get("corpus", ""), r.get("kind", ""), profile(r.get("profile", {}), default)) for r in config.get("rules", [])), default)


def chunk_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, metadata) of ``chunks`` (chunk_id, document_id) and ``documents`` (document_id, language, section_path,
    breadcrumb, title, description): what goes with a chunk into the index; fields that are null or blank are left out."""
    names = ("language", "section_path", "breadcrumb", "title", "description")
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.trim(F.col(n)).alias("value")) for n in names)), lambda p: F.coalesce(p["value"], F.lit("")) != "")
    return chunks.join(documents, "document_id").select("chunk_id", F.map_from_entries(pairs).alias("metadata"))


def language_fallback(language: Column, default: str = "ka") -> tuple[Column, Column]:
    """The language, the default where there is none, and the validator's ordinal: a default is DEGRADED."""
    missing = F.coalesce(F.trim(language), F.lit("")) == ""
    return F.when(missing, default).otherwise(language), F.when(missing, 1).otherwise(0)
