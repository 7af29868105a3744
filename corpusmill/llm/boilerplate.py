"""Page furniture mixed with the article (problem 1).

Template deduction over the lines of same-host pages. A token is a line, a segment or clause of one, its first or last
words, or the mark before its first word, without case, spacing, digits and decoration. Tokens with the same occurrence
vector over a host's pages are an equivalence class.

Classes are nested: a page is an article, with a frame around it on some pages. Pages whose first line is their title have
no frame above it, and these are the control group. A class that such pages hardly ever have is nested in the frame: it is
furniture, wherever on the page it lies. A class that they have as well lies in the article's slot: what a site sets into
its articles, or phrases of the articles themselves. The template's other slots are what changes within a line
of the frame, as the last part of a menu path, and the lines that follow a heading of the frame.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, hash64, map_batches, page_lines
from corpusmill.session import materialize
from corpusmill.sources.views import single_rows

#: A class needs so many pages of its host.
MIN_PAGES = 3
#: A token of several hosts is known by its pages on all of them, from so many pages and hosts on; on other hosts too.
POOLED_PAGES, POOLED_HOSTS = 5, 2
#: Shares of a class's pages that are outside the frame: of classes nested in it, and of those in the article's slot. First
#: for pages with nothing above their title, some of which have a footer; then for pages without any line of the frame.
FIRST_SHARES, SHARES = (0.02, 0.15), (0.003, 0.06)
#: The first round needs such log-odds; in the second, a token with these stands for a line's other tokens.
FIRST_ODDS, STRONG_ODDS = 3.0, 1.0
#: A token that is the title of such a share of its pages is a headline, not template.
TITLE_SHARE = 0.02
#: A token followed by a marked headline this often opens a slot of headlines.
OPENS = 0.35
#: Up to so many template tokens are broadcast (9 bytes each); beyond, they are joined.
BROADCAST_MOST = 2_000_000
_MEMO_CHARS = 300

_SPACE, _NUMBER = re.compile(r"\s+"), re.compile(r"\d+")
_SEPARATOR = re.compile(r"\s+[|/»›>→•·—–;]\s+|\t+|\s{3,}")
_MARK = re.compile(r"^\s*((?:\d+[^\w\s]+|[^\w\s])[\d\W]*?)\s+(?=[^\W\d_])")
_DATE = re.compile(r"\d\W\d")
_SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*[\s\ufe0f\u200d\u2600-\u27bf\U0001f000-\U0001faff]*$")
_CLAUSE = re.compile(r"\s+[|/·•]\s+|(?<=[.!?])\s+")
_CELL = re.compile(r"^[\d\s.,%+-]+$")
_DOUBLE = re.compile(r"(?<=\S)  (?=\S)")

#: Flags of a line. A line of SEGMENTS has a token of each, one of CLAUSES too; a FRAMED line those of its first and last
#: words; in a MARKED line the second token is that of its mark.
BLANK, SENTENCE, ROW, HEADLINE, MARKED, DATED, SEGMENTS, CLAUSES, FRAMED = (1 << k for k in range(9))
#: A line of more words than this also has the token of its first words and that of its last.
FRAME = 3


def skeleton(text: str) -> str:
    """A text without case, spacing, digits and trailing decoration."""
    plain = _NUMBER.sub("#", _SPACE.sub(" ", unicodedata.normalize("NFKC", text).lower())).strip()
    return plain.strip(" .!»↑•·*")


def describe(line: str) -> tuple[int, list[int]]:
    """The flags and the tokens of a line: that of the whole line, that of its mark, then those of its parts."""
    if not line.strip():
        return BLANK, []
    spaced = line.strip()
    if _DOUBLE.search(spaced) and not re.search(r"(?<=\S) (?=\S)", spaced):
        spaced = _DOUBLE.sub(" ", spaced)
    mark = _MARK.match(line)
    whole = skeleton(spaced)
    if not whole:
        return HEADLINE, []
    flags, listed = 0, whole.split()
    if _SENTENCE.search(spaced) and len(listed) > 3:
        flags |= SENTENCE
    parts = [p for p in _SEPARATOR.split(line[mark.end() :] if mark else spaced) if p and p.strip()]
    if len(parts) > 1 and any(_CELL.match(p) for p in parts[1:]):
        flags |= ROW
    if not flags & (SENTENCE | ROW):
        flags |= HEADLINE
    tokens = [hash64(whole)]
    if mark and not flags & ROW:
        flags |= MARKED | (DATED if _DATE.search(mark.group(1)) else 0)
        tokens.append(hash64(f"mark {flags & HEADLINE} {_NUMBER.sub('#', _SPACE.sub(' ', mark.group(1)))}"))
    clauses = [p for p in _CLAUSE.split(spaced) if p.strip()]
    label = lambda text: [skeleton(p) if k == 0 else ": " + skeleton(p) for k, p in enumerate(text.split(": ", 1))]
    if flags & ROW:
        pass
    elif len(clauses) > 1 and (flags & SENTENCE or any(_SENTENCE.search(c) for c in clauses[:-1])):
        flags |= CLAUSES
        tokens += [hash64(s) for s in [*label(clauses[0]), *map(skeleton, clauses[1:])] if s]
    elif len(parts) > 1 and not mark and not flags & SENTENCE or len(listed) <= FRAME and ": " in spaced and not mark:
        flags |= SEGMENTS
        tokens += [hash64(s) for s in [*label(parts[0]), *map(skeleton, parts[1:])] if s]
    if not flags & (ROW | SEGMENTS) and len(listed) > FRAME and (flags & HEADLINE or not flags & CLAUSES):
        flags |= FRAMED
        tokens += [hash64("^" + " ".join(listed[:FRAME])), hash64(" ".join(listed[-FRAME:]) + "$")]
    return flags, tokens


def described_pages(pages: DataFrame) -> DataFrame:
    """(document_id, host, titles, content, lead) of ``pages`` (id, canonical_url, title, content_text, lead_text).

    content and lead have the flags and tokens of every line of the two texts; titles the tokens of the title, the whole
    one first. Null and blank texts have no lines; a page without an address has host ''.
    """
    line = pa.struct([("flags", pa.int32()), ("tokens", pa.list_(pa.int64()))])
    schema = [("document_id", pa.int64()), ("host", pa.string()), ("titles", pa.list_(pa.int64())), ("content", pa.list_(line)), ("lead", pa.list_(line))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict] = {}

        def lines(text: str | None) -> list[dict]:
            out = []
            for own in page_lines(text) if text and not text.isspace() else []:
                known = memo.get(own)
                if known is None:
                    flags, tokens = describe(own)
                    known = {"flags": flags, "tokens": tokens}
                    if len(own) <= _MEMO_CHARS:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[own] = known
                out.append(known)
            return out

        for rows in batches:
            ids, urls, titles, texts, leads = (column.to_pylist() for column in rows.columns)
            hosts = [m.group(1).lower() if (m := re.match(r"[a-zA-Z][\w+.-]*://([^/?#]+)", u or "")) else "" for u in urls]
            names = [[hash64(s) for s in dict.fromkeys([skeleton(t), *map(skeleton, _SEPARATOR.split(t)), *map(skeleton, t.split(": ", 1))]) if s] if t else [] for t in titles]
            yield batch(schema, (ids, hosts, names, [lines(t) for t in texts], [lines(t) for t in leads]))

    kind = "array<struct<flags: int, tokens: array<long>>>"
    return map_batches(pages.select("id", "canonical_url", "title", "content_text", "lead_text").where("id is not null"), run, f"document_id long, host string, titles array<long>, content {kind}, lead {kind}")


def with_frame(described: DataFrame, frame: DataFrame) -> DataFrame:
    """(document_id, host, titles, content, frame): the numbers of each page's lines that have a token of ``frame``
    (token). Up to BROADCAST_MOST tokens are sent to all tasks; more are joined to the pages' tokens."""
    if frame.count() <= BROADCAST_MOST:
        shared = described.sparkSession.sparkContext.broadcast(np.sort(frame.toArrow().column("token").to_numpy()))

        @F.pandas_udf("array<int>")
        def lines_of(tokens: pd.Series) -> pd.Series:
            sought = shared.value
            flat = np.array([t for own in tokens for line in own for t in line], np.int64)
            hit = sought[np.minimum(np.searchsorted(sought, flat), len(sought) - 1)] == flat if len(sought) else np.zeros(len(flat), bool)
            at, out = 0, []
            for own in tokens:
                found = []
                for i, line in enumerate(own):
                    if hit[at : at + len(line)].any():
                        found.append(i)
                    at += len(line)
                out.append(found)
            return pd.Series(out)

        return described.select("document_id", "host", "titles", "content", lines_of(F.transform("content", lambda line: line["tokens"])).alias("frame"))
    tokens = described.select("document_id", F.posexplode("content").alias("line", "own")).select("document_id", "line", F.explode("own.tokens").alias("token"))
    found = tokens.join(frame, "token").groupBy("document_id").agg(F.array_sort(F.collect_set("line")).alias("frame"))
    return described.join(found, "document_id", "left").select("document_id", "host", "titles", "content", F.coalesce("frame", F.array().cast("array<int>")).alias("frame"))


def token_classes(framed: DataFrame, control: bool = False) -> DataFrame:
    """(host, token, n_pages, vector, n_titled, n_outside, n_opens) of pages ``framed`` (document_id, host, titles, content,
    frame): the occurrence vector of each token over its host's pages, as a count and a fingerprint of the set of pages;
    equal vectors are one class. n_titled of the pages have their title as a line; on n_outside of these it is the first
    line, so no frame stands above it, and no other line is of the frame. Table rows have no tokens. ``control``: only
    pages with their title, and no sentences. Each batch sends one row a token."""
    schema = [("host", pa.string()), ("token", pa.int64()), ("n_pages", pa.int64()), ("vector", pa.int64()), ("n_titled", pa.int64()), ("n_outside", pa.int64()), ("n_opens", pa.int64())]
    skipped = BLANK | ROW | (SENTENCE if control else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts: dict[str, dict[int, list[int]]] = {}
            for page, host, titles, content, frame in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                full = [line for line in content if not line["flags"] & BLANK]
                titled = [bool(line["tokens"]) and line["tokens"][0] == titles[0] for line in full] if titles else []
                n_titled = int(any(titled))
                if control and not n_titled:
                    continue
                bare = bool(titled) and titled[0]
                seen: dict[int, tuple[bool, bool]] = {}
                for i, line in enumerate(content):
                    if line["flags"] & skipped:
                        continue
                    after = content[i + 1]["flags"] if i + 1 < len(content) else 0
                    opens = bool(after & MARKED and after & HEADLINE and not after & DATED)
                    outside = bare and all(j == i for j in frame)
                    for token in line["tokens"]:
                        old = seen.get(token)
                        seen[token] = (opens, outside) if old is None else (opens or old[0], outside and old[1])
                own, print_ = counts.setdefault(host, {}), hash64(str(page))
                for token, (opens, outside) in seen.items():
                    old = own.get(token)
                    if old is None:
                        own[token] = [1, print_, n_titled, int(outside), int(opens)]
                    else:
                        old[0] += 1
                        old[1] ^= print_
                        old[2] += n_titled
                        old[3] += outside
                        old[4] += opens
            listed = [(host, token, *c) for host, own in counts.items() for token, c in own.items()]
            yield batch(schema, ([r[k] for r in listed] for k in range(len(schema))))

    parts = map_batches(framed.select("document_id", "host", "titles", "content", "frame"), run, "host string, token long, n_pages long, vector long, n_titled long, n_outside long, n_opens long")
    return parts.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), *(F.sum(n).alias(n) for n in ("n_pages", "n_titled", "n_outside", "n_opens")))


def article_odds(titled: str, outside: str, frame_share: float, article_share: float) -> Column:
    """The log-odds that a class lies in the article's slot against the frame, by how many of its ``titled`` pages are
    ``outside`` the frame: of a frame's class the one share would be, of an article's the other."""
    inside = math.log((1 - article_share) / (1 - frame_share))
    return F.col(outside) * math.log(article_share / frame_share) + (F.col(titled) - F.col(outside)) * inside


def frame_tokens(described: DataFrame) -> DataFrame:
    """(token): what pages without anything above their title hardly ever have; some of these have a frame below it."""
    none = described.withColumn("frame", F.array().cast("array<int>"))
    counts = token_classes(none, control=True).groupBy("token").agg(F.sum("n_titled").alias("n"), F.sum("n_outside").alias("outside"))
    return materialize(counts.where(article_odds("n", "outside", *FIRST_SHARES) <= -FIRST_ODDS).select("token"), "frame-tokens")


#: Roles of a token on a page: of no class, of the article's slot, of the frame, of the frame and seen often; OPENER is
#: added if it opens a slot of headlines.
NONE, FREE, PART, STRONG, OPENER = 0, 1, 2, 3, 4


def template(described: DataFrame) -> DataFrame:
    """(host, token, role, n_pages, vector) of the tokens of each host's template; host is null for tokens that several
    hosts have, which are known by their pages on all of them, so that a host with few pages has a template too."""
    classes = materialize(token_classes(with_frame(described, frame_tokens(described))).where("n_pages > 1"), "token-classes")
    titles = described.select(F.explode("titles").alias("token")).groupBy("token").agg(F.count("*").alias("n_titles"))
    every = (
        classes.groupBy("token")
        .agg(F.count("*").alias("n_hosts"), *(F.sum(f"n_{n}").alias(f"all_{n}") for n in ("pages", "titled", "outside", "opens")))
        .where(f"all_pages >= {MIN_PAGES}")
        .join(titles, "token", "left")
    )
    odds = article_odds("all_titled", "all_outside", *SHARES)
    slot = F.coalesce("n_titles", F.lit(0)) > TITLE_SHARE * F.col("all_pages")
    nested = F.when(odds <= -STRONG_ODDS, STRONG).when(odds < 0, PART).otherwise(NONE) + F.when((odds < 0) & (F.col("all_opens") >= OPENS * F.col("all_pages")), OPENER).otherwise(0)
    every = every.withColumn("role", F.when(slot | (odds > 0), FREE).otherwise(nested).cast("tinyint")).withColumn("pooled", (F.col("all_pages") >= POOLED_PAGES) & (F.col("n_hosts") >= POOLED_HOSTS))
    pooled = every.where("pooled").select(F.lit(None).cast("string").alias("host"), "token", "role", F.col("all_pages").alias("n_pages"), F.lit(None).cast("long").alias("vector"))
    own = classes.where(f"n_pages >= {MIN_PAGES}").join(every.where("not pooled").select("token", "role"), "token")
    return own.select("host", "token", "role", "n_pages", "vector").unionByName(pooled)


def furniture(lines: list[dict], role: list[list[int]]) -> list[int]:
    """The numbers of the lines that belong to the page: ``role`` has the roles of each line's tokens.

    A line belongs to the frame if it is a token of it, or all its parts are; a line whose first part or whose first or
    last words are, with a slot beside them; and a headline in a slot that a token of the frame has opened.
    """
    out, slot = [], False
    for i, (line, roles) in enumerate(zip(lines, role, strict=True)):
        flags = line["flags"]
        if flags & BLANK or flags & ROW or not roles:
            slot = False
            continue
        kind = [r & 3 for r in roles]
        whole, parts = kind[0], kind[2:] if flags & MARKED else kind[1:]
        mark = kind[1] if flags & MARKED else NONE
        if flags & SEGMENTS:
            known = FREE not in (whole, *parts[:1]) and (any((whole, *parts[:1])) or 2 * sum(p > FREE for p in parts) > len(parts))
        elif FREE in (whole, *parts):
            known = False
        else:
            known = STRONG in (whole, *parts) and (not flags & CLAUSES or whole != NONE or all(parts) or bool(flags & FRAMED)) or (whole == PART and not flags & SENTENCE)
        if known:
            out.append(i)
            slot = bool(roles[0] & OPENER)
        elif flags & HEADLINE and mark >= PART:
            out.append(i)
            slot = not flags & DATED
        elif flags & HEADLINE and slot:
            out.append(i)
        else:
            slot = False
    return out


def furniture_lines(described: DataFrame, known: DataFrame) -> DataFrame:
    """(document_id, field, line_no) of the lines that are furniture by the template ``known``."""
    schema = [("document_id", pa.int64()), ("field", pa.string()), ("line_no", pa.int32())]
    kinds = "document_id long, field string, line_no int"

    def results(rows: list[tuple[int, list[dict], list[dict]]], role_of) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in schema]
        for page, host, content, lead in rows:
            for field, lines in (("content_text", content), ("lead_text", lead)):
                for i in furniture(lines, [[role_of(host, t) for t in line["tokens"]] for line in lines]):
                    for column, value in zip(columns, (page, field, i), strict=True):
                        column.append(value)
        return batch(schema, columns)

    keyed = known.select(F.when(F.col("host").isNull(), F.col("token")).otherwise(F.xxhash64("host", "token")).alias("key"), "role").groupBy("key").agg(F.max("role").alias("role"))
    keyed = materialize(keyed, "template-keys")
    pages = described.withColumn("host_keys", F.transform(F.flatten(F.concat(F.transform("content", lambda x: x["tokens"]), F.transform("lead", lambda x: x["tokens"]))), lambda t: F.xxhash64("host", t)))
    if keyed.count() <= BROADCAST_MOST:
        rows = keyed.orderBy("key").toArrow()
        shared = described.sparkSession.sparkContext.broadcast((rows.column("key").to_numpy(), rows.column("role").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, roles = shared.value

            def found(wanted: np.ndarray) -> np.ndarray:
                if not len(keys):
                    return np.zeros(len(wanted), np.int8)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                return np.where(keys[at] == wanted, roles[at], 0).astype(np.int8)

            for rows in batches:
                columns: list[list] = [[] for _ in schema]
                for page, content, lead, host_keys in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
                    plain = np.array([t for line in (*content, *lead) for t in line["tokens"]], np.int64)
                    role = np.maximum(found(plain), found(host_keys.values.to_numpy()) if len(plain) else plain.astype(np.int8)).tolist()
                    k = 0
                    for field, lines in (("content_text", content), ("lead_text", lead)):
                        own = []
                        for line in lines:
                            n = len(line["tokens"])
                            own.append(role[k : k + n])
                            k += n
                        for i in furniture(lines, own):
                            for column, value in zip(columns, (page, field, i), strict=True):
                                column.append(value)
                yield batch(schema, columns)

        return map_batches(pages.select("document_id", "content", "lead", "host_keys"), run, kinds)

    plain = described.select("document_id", F.explode(F.flatten(F.concat(F.transform("content", lambda x: x["tokens"]), F.transform("lead", lambda x: x["tokens"])))).alias("token"), "host")
    both = plain.select("document_id", "token", F.explode(F.array(F.col("token"), F.xxhash64("host", "token"))).alias("key")).distinct()
    roles = both.join(keyed, "key").groupBy("document_id", "token").agg(F.max("role").alias("role")).groupBy("document_id").agg(F.collect_list(F.struct("token", "role")).alias("roles"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield from (
                results([(page, "", content, lead)], lambda _, t, own={r["token"]: r["role"] for r in known_roles or []}: own.get(t, NONE))
                for page, content, lead, known_roles in zip(*(column.to_pylist() for column in rows.columns), strict=True)
            )

    return map_batches(described.select("document_id", "content", "lead").join(roles, "document_id", "left").select("document_id", "content", "lead", "roles"), look_up, kinds)


def _described(spark: SparkSession, root: str) -> DataFrame:
    return materialize(described_pages(single_rows(spark, root, "ingestion_document", "id", "canonical_url", "title", "content_text", "lead_text")), "described")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, field, line_no): the lines of pages and leads that are not the article's."""
    described = _described(spark, root)
    return furniture_lines(described, template(described))


def p1_template(spark: SparkSession, root: str) -> DataFrame:
    """(host, n_pages, n_tokens, nested): the equivalence classes of each host's own template, by their pages and tokens,
    and whether they are nested in the frame or in the article's slot."""
    known = template(_described(spark, root)).where("host is not null")
    classes = known.groupBy("host", "n_pages", "vector").agg(F.count("*").alias("n_tokens"), (F.max("role") > FREE).alias("in_frame"))
    return classes.select("host", "n_pages", "n_tokens", F.when(F.col("in_frame"), "frame").otherwise("article").alias("nested"))


def p1_article(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, content_text, lead_text): each page once, the article alone; null texts stay null."""
    found = p1_found(spark, root).groupBy("document_id").pivot("field", ["content_text", "lead_text"]).agg(F.collect_list("line_no"))
    gone = found.toDF("document_id", "content_gone", "lead_gone")
    pages = single_rows(spark, root, "ingestion_document", "id", "content_text", "lead_text").where("id is not null").withColumnRenamed("id", "document_id")
    kept = {f: F.expr(f"if({f[:-5]}_gone is null, {f}, array_join(filter(split({f}, '\n', -1), (line, i) -> not array_contains({f[:-5]}_gone, i)), '\n'))") for f in ("content_text", "lead_text")}
    return pages.join(gone, "document_id", "left").select("document_id", *(c.alias(f) for f, c in kept.items()))


QUERIES = {"p1_found": p1_found, "p1_article": p1_article, "p1_template": p1_template}
SQL: dict[str, str] = {}
