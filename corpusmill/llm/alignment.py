"""Sentence alignment in bilingual documents (problem 4).

Target sentences are emissions from source states of a hidden Markov model: a state is a source sentence, a span of two,
or null; jumps between states have probabilities. Emission uses a word lexicon, equal numbers and names that sound
alike. The lexicon is fitted on all pairs: each round links the sentences of every pair with the lexicon so far and sums
up which words stand in linked sentences.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, map_batches
from corpusmill.llm.language import romanize
from corpusmill.session import materialize, spread
from corpusmill.sources.tables import table

#: Rounds of fitting: the first links sentences by numbers and names, the others decode.
ROUNDS = 2
#: Translations kept for a word, and the least probability of one.
TRANSLATIONS, LEAST = 14, 0.04
#: Up to so many rows of the lexicon are sent to all tasks; of a larger one each pair gets the rows of its own words.
LEXICON_MOST = 1_000_000
#: Up to so many page ids of pairs are sent to all tasks, so that other pages' texts are not shuffled.
PAGES_MOST = 2_000_000
#: Share of a word's probability that its state explains; the rest is the word's general frequency.
EXPLAINED = 0.6
#: Logarithms of the jumps' probabilities, by how far the next source sentence is; any farther, FAR.
JUMPS = {1: -0.25, 0: -3.2, 2: -2.6, -1: -4.0, 3: -3.6, 4: -4.2, -2: -4.6, 5: -4.8, -3: -5.2, -4: -5.6}
FAR, TO_NULL, SPAN_STATE = -7.0, -2.2, -3.0
#: A link needs so much evidence. Of the words of one of its sentences, weighed by rarity, it needs to explain the first
#: share, and of the other's the second: a sentence may translate a part of the other.
LEAST_EVIDENCE, COVERED, OTHER_COVERED = 6.0, 0.82, 0.3
#: A translation at least so probable explains a word; a number weighs as much as a word of this rarity.
EXPLAINS, NUMBER_WEIGHT = 0.1, 3.0
#: Each sentence of a span needs so much more evidence with it than the span without.
SPAN_GAIN = 4.0
#: Log-odds for texts that belong together: of a link that explains at least the first share of both sentences, the second,
#: and less; of a link where the one before leads, farther on and back; what they need in all.
WHOLE_SHARE, MOSTLY_SHARE = 0.9, 0.8
WHOLE, MOSTLY, PARTLY = 3.0, 0.0, -1.5
NEXT, ONWARD, BACKWARD, TOGETHER = 1.2, 0.3, -1.5, 2.5
#: Back pointers are kept for stretches of target sentences of about so many states; a longer text is gone through twice.
_STATES = 1 << 21
#: Up to so many source sentences all jumps are one matrix.
_MATRIX = 256

_SENTENCE = re.compile(r"\n|(?<=[.!?])\s+")
_THOUSANDS = re.compile(r"(?<![\d.,])(\d{1,3}(?:[   ,.]\d{3})+)(?![\d])")
_DECIMAL = re.compile(r"(?<=\d),(?=\d)")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+")
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])['’ʼ`](?=[^\W\d_])|['’ʼ`]")


def sentences(text: str) -> list[str]:
    """Cut at each newline and at white space after a sentence's end; trimmed, without empty ones."""
    return [s for s in (part.strip() for part in _SENTENCE.split(text)) if s]


def tokens(sentence: str) -> list[str]:
    """Distinct words in Latin letters and numbers in one spelling."""
    text = unicodedata.normalize("NFKC", sentence).lower()
    text = _THOUSANDS.sub(lambda m: re.sub(r"\D", "", m.group(1)), text)
    text = _APOSTROPHE.sub("", romanize(_DECIMAL.sub(".", text)))
    return list(dict.fromkeys(t + "#" if t[0].isdigit() else t for t in _TOKEN.findall(text)))


class Lexicon:
    """Translations of words, and the general frequency of target words, by sentences."""

    def __init__(self, translations: dict[str, list[tuple[str, float]]], frequency: dict[str, float], rare: float, sources: dict[str, float] | None = None):
        self.translations, self.frequency, self.rare, self.sources = translations, frequency, rare, sources or {}

    def coverage(self, source: list[str], target: list[str]) -> tuple[float, float]:
        """The shares of the two sentences' words, weighed by rarity, that the other one explains."""
        names = [{w[:5] for w in own if w[-1] != "#" and len(w) > 4} for own in (source, target)]
        there, given = set(target), set(source)
        for word in source:
            given.update(other for other, p in self.translations.get(word, ()) if p >= EXPLAINS)
        shares = []
        for own, general, met in (
            (target, self.frequency, lambda w: w in given or w[:5] in names[0]),
            (source, self.sources, lambda w: w in there or w[:5] in names[1] or any(o in there for o, p in self.translations.get(w, ()) if p >= EXPLAINS)),
        ):
            weights = [NUMBER_WEIGHT if w[-1] == "#" else -math.log(general.get(w, self.rare)) for w in own]
            shares.append(sum(x for w, x in zip(own, weights, strict=True) if met(w)) / (sum(weights) or 1.0))
        return shares[0], shares[1]


class Emissions:
    """How probable the target sentences are in each source sentence or span, a stretch of them at a time."""

    def __init__(self, lexicon: Lexicon, source: list[list[str]], target: list[list[str]]):
        self.n = len(source)
        place: dict[str, int] = {}
        self.lists = [[place.setdefault(t, len(place)) for t in own] for own in target]
        alike = defaultdict(list)
        for word in place:
            if word[-1] != "#" and len(word) >= 4:
                alike[word[:4]].append(word)
        best: dict[tuple[int, int], float] = {}
        explained: dict[str, list[tuple[int, float]]] = {}
        for i, own in enumerate(source):
            for word in own:
                known = explained.get(word)
                if known is None:
                    known = explained[word] = self._explained(word, place, alike, lexicon)
                for at, p in known:
                    if best.get((at, i), 0.0) < p:
                        best[at, i] = p
        keys = np.array(list(best), np.int64).reshape(-1, 2)
        order = np.argsort(keys[:, 0], kind="stable")
        self.column, self.p = keys[order, 1], np.array(list(best.values()), np.float64)[order]
        self.first = np.searchsorted(keys[order, 0], np.arange(len(place) + 1))
        self.general = np.array([0.002 if w[-1] == "#" else lexicon.frequency.get(w, lexicon.rare) for w in place])

    @staticmethod
    def _explained(word: str, place: dict[str, int], alike: dict[str, list[str]], lexicon: Lexicon) -> list[tuple[int, float]]:
        """The target words that a source word explains, with their probabilities."""
        out = [(place[word], 0.95)] if word in place else []
        out += [(place[other], p) for other, p in lexicon.translations.get(word, ()) if other in place]
        if word[-1] != "#":
            for other in alike.get(word[:4], ()):
                shorter = min(len(word), len(other))
                same = next((n for n, (a, b) in enumerate(zip(word, other)) if a != b), shorter)
                if same >= shorter - 1 and same >= 5:
                    out.append((place[other], 0.6))
        return out

    def stretch(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For target sentences low ... high - 1 the log-ratios of their words' probabilities to the general ones, by
        source sentence and by span of two."""
        own = self.lists[low:high]
        used, flat = np.unique(np.array([w for x in own for w in x], np.int64), return_inverse=True)
        dense = np.zeros((len(used), self.n))
        counts = self.first[used + 1] - self.first[used] if len(used) else np.zeros(0, np.int64)
        at = np.repeat(self.first[used] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum()) if len(used) else np.zeros(0, np.int64)
        dense[np.repeat(np.arange(len(used)), counts), self.column[at]] = self.p[at]
        general = self.general[used][:, None]
        ratio = np.log(EXPLAINED * dense + (1 - EXPLAINED) * general) - np.log(general)
        pair = np.maximum(ratio[:, :-1], ratio[:, 1:])
        single, double = np.zeros((len(own), self.n)), np.zeros((len(own), self.n - 1))
        start = 0
        for j, words in enumerate(own):
            rows = flat[start : start + len(words)]
            single[j], double[j] = ratio[rows].sum(axis=0), pair[rows].sum(axis=0)
            start += len(words)
        return single, double


@lru_cache(maxsize=512)
def _jump_matrix(n: int) -> np.ndarray:
    """Row s, column e: the logarithm of the jump from a state that ends at e to one that starts at s."""
    distance = np.arange(n)[:, None] - np.arange(n)[None, :]
    out = np.full((n, n), FAR)
    for d, log in JUMPS.items():
        out[distance == d] = log
    return out


def _jumps(by_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start the best score of the states before it, with the jump, and at which source sentence it ends."""
    n = len(by_end)
    if n <= _MATRIX:
        table_ = _jump_matrix(n) + by_end
        came = table_.argmax(axis=1)
        return table_[np.arange(n), came], came
    top = int(by_end.argmax())
    value, came = np.full(n, by_end[top] + FAR), np.full(n, top)
    for d, log in JUMPS.items():
        low, high = max(0, d), n + min(0, d)
        candidate = by_end[low - d : high - d] + log
        better = candidate > value[low:high]
        value[low:high][better], came[low:high][better] = candidate[better], np.arange(low - d, high - d)[better]
    return value, came


def _step(scores: np.ndarray, single: np.ndarray, double: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores (kind of state, its last source sentence) after one more target sentence; for each start and for each
    last sentence the state before it, kind * n + last sentence. Kinds: a sentence, a span of two, null."""
    n = scores.shape[1]
    kind = scores.argmax(axis=0)
    by_end = scores[kind, np.arange(n)]
    at_end = kind * n + np.arange(n)
    value, came = _jumps(by_end)
    span = np.full(n, -np.inf)
    span[1:] = value[:-1] + SPAN_STATE + double
    return np.stack([value + single, span, by_end + TO_NULL]), at_end[came], at_end


def decode(source: list[list[str]], target: list[list[str]], lexicon: Lexicon, strict: bool = True) -> list[tuple[int, int, float, float]]:
    """(source sentence, target sentence, evidence, share) of the links of the most probable state sequence over both whole
    texts; share is how much of both sentences' words is explained. Not strict: links with enough evidence, whatever their
    share, which is not looked at.

    Back pointers are kept for one stretch of target sentences at a time, from the last to the first; the scores at the
    beginnings of stretches, from a first pass without back pointers, are where each starts."""
    n, m = len(source), len(target)
    if not n or not m:
        return []
    emissions = Emissions(lexicon, source, target)
    size = max(1, _STATES // n)
    opening = np.stack([np.where(np.arange(n) == 0, -0.5, FAR / 2), np.concatenate([[-np.inf, -0.5][:n], np.full(max(0, n - 2), FAR / 2)]) + SPAN_STATE, np.where(np.arange(n) == 0, -0.5, FAR) + TO_NULL])
    begins: list[np.ndarray | None] = [None]

    def forward(low: int, scores: np.ndarray | None, keep: bool):
        high = min(low + size, m)
        single, double = emissions.stretch(low, high)
        back = []
        for j in range(high - low):
            if scores is None:
                scores = opening + np.stack([single[0], np.concatenate([[0.0], double[0]]), np.zeros(n)])
                back.append((None, None))
                continue
            scores, by_start, by_end = _step(scores, single[j], double[j])
            if keep:
                back.append((by_start, by_end))
        return scores, back, single, double

    for low in range(0, m - size, size):
        begins.append(forward(low, begins[-1], False)[0])
    state, links = -1, []
    for number in range(len(begins) - 1, -1, -1):
        low = number * size
        scores, back, single, double = forward(low, begins[number], True)
        if state < 0:
            state = int(scores.argmax())
        for j in range(len(back) - 1, -1, -1):
            kind, own = divmod(state, n)
            found = []
            if kind == 0:
                found = [(own, float(single[j, own]))]
            elif kind == 1:
                both = float(double[j, own - 1])
                found = [(own - k, both) for k in (0, 1) if both - float(single[j, own - 1 + k]) >= SPAN_GAIN] or [(own - int(single[j, own - 1] > single[j, own]), both)]
            for i, value in found:
                if value < LEAST_EVIDENCE:
                    continue
                shares = lexicon.coverage(source[i], target[low + j]) if strict else (1.0, 1.0)
                if max(shares) >= COVERED and min(shares) >= OTHER_COVERED:
                    links.append((i, low + j, value, min(shares)))
            by_start, by_end = back[j]
            if by_start is not None:
                state = int(by_end[own] if kind == 2 else by_start[own - kind])
    return links[::-1]


def anchors(source: list[list[str]], target: list[list[str]]) -> list[tuple[int, int]]:
    """Links of sentences that share numbers and names, the best for each target sentence."""
    names = [{w[:5] for w in own if w[-1] != "#" and len(w) >= 5} | {w for w in own if w[-1] == "#"} for own in source]
    out = []
    for j, own in enumerate(target):
        mine = {w[:5] for w in own if w[-1] != "#" and len(w) >= 5} | {w for w in own if w[-1] == "#"}
        scored = [(len(mine & other) - 1.5 * abs(i / len(source) - j / len(target)), i) for i, other in enumerate(names)]
        if scored and max(scored)[0] >= 0.7:
            out.append((max(scored)[1], j))
    return out


def belong_together(links: list[tuple[int, int, float, float]]) -> bool:
    """Do two texts say the same, by their links? However few the links are, what counts are log-odds for and against: how
    much of both sentences a link explains, and whether it stands where the one before leads."""
    odds = sum(WHOLE if share >= WHOLE_SHARE else MOSTLY if share >= MOSTLY_SHARE else PARTLY for *_, share in links)
    for (i, j, *_), (k, m, *_) in zip(links, links[1:]):
        odds += NEXT if abs((k - i) - (m - j)) <= 2 else ONWARD if k > i else BACKWARD
    return odds >= TOGETHER


def lexicon_of(rows: Iterator[tuple[str | None, str | None, float]]) -> Lexicon:
    """A Lexicon of rows (word, other, p): translations; target words' frequencies without a word; source words' without
    another; the frequency of words not seen without both."""
    translations, frequency, sources, rare = defaultdict(list), {}, {}, 0.001
    for word, other, p in rows:
        if word is not None and other is not None:
            translations[word].append((other, p))
        elif word is not None:
            sources[word] = p
        elif other is not None:
            frequency[other] = p
        else:
            rare = p
    return Lexicon(dict(translations), frequency, rare, sources)


def with_lexicon(joined: DataFrame, lexicon: DataFrame | None, work, schema: str) -> DataFrame:
    """``work(pair_id, source, target, lexicon)`` gives rows for each of ``joined`` (pair_id, ka, en: each sentence's
    words as one string); ``lexicon`` (word, other, p) as in ``lexicon_of``, or none yet.

    A lexicon of at most LEXICON_MOST rows is sent to all tasks. Of a larger one, each pair is joined with the rows of its
    own words: translations between words of its two texts, and their frequencies."""
    spark = joined.sparkSession
    columns = ["pair_id", "ka", "en"]
    if lexicon is None or lexicon.count() <= LEXICON_MOST:
        known = spark.sparkContext.broadcast(None if lexicon is None else lexicon_of(map(tuple, lexicon.toLocalIterator())))
        pairs = joined.select(*columns)
    else:
        known = None
        source, target = (joined.select("pair_id", F.explode(F.array_distinct(F.flatten(F.transform(side, lambda s: F.split(s, " "))))).alias(name)) for side, name in (("ka", "word"), ("en", "other")))
        words = source.join(lexicon.where("word is not null and other is null").select("word", "p"), "word").select("pair_id", F.struct("word", F.lit(None).cast("string").alias("other"), "p").alias("row"))
        others = target.join(lexicon.where("word is null and other is not null").select("other", "p"), "other").select("pair_id", F.struct(F.lit(None).cast("string").alias("word"), "other", "p").alias("row"))
        both = source.join(lexicon.where("word is not null and other is not null"), "word").join(target, ["pair_id", "other"], "left_semi").select("pair_id", F.struct("word", "other", "p").alias("row"))
        rare = lexicon.where("word is null and other is null").select(F.struct("word", "other", "p").alias("row"))
        own = words.unionByName(others).unionByName(both).groupBy("pair_id").agg(F.collect_list("row").alias("rows"))
        pairs = joined.select(*columns).join(own, "pair_id", "left").join(F.broadcast(rare)).select(*columns, F.concat(F.coalesce("rows", F.array()), F.array("row")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda side: [s.split(" ") if s else [] for s in side]
        for rows in batches:
            lists = [column.to_pylist() for column in rows.columns]
            yield work(
                (pair, split(ka), split(en), known.value if known is not None else lexicon_of((r["word"], r["other"], r["p"]) for r in own[0]))
                for pair, ka, en, *own in zip(*lists, strict=True)
            )

    return map_batches(pairs, run, schema)


def link_counts(joined: DataFrame, lexicon: DataFrame | None, strict: bool) -> DataFrame:
    """(word, other, n): in how many links of all pairs two words stand on the two sides; of a word, without another, in
    how many links; of another, without a word; and how many links there are. Without a lexicon, links are anchors."""
    schema = [("word", pa.string()), ("other", pa.string()), ("n", pa.int64())]

    def work(pairs) -> pa.RecordBatch:
        counts: Counter = Counter()
        for _, source, target, known in pairs:
            for i, j in anchors(source, target) if known is None else [link[:2] for link in decode(source, target, known, strict)]:
                counts[None, None] += 1
                counts.update((w, None) for w in source[i])
                counts.update((None, w) for w in target[j])
                there = [w for w in target[j] if w[-1] != "#"]
                for word in source[i]:
                    if word[-1] != "#":
                        counts.update((word, other) for other in there)
        return batch(schema, ([k[0] for k in counts], [k[1] for k in counts], list(counts.values())))

    return with_lexicon(joined, lexicon, work, "word string, other string, n long").groupBy("word", "other").agg(F.sum("n").alias("n"))


def translations(counts: DataFrame) -> DataFrame:
    """(word, other, p): of the ``counts`` of links, the other words that a word's links have far more often than all do."""
    counts = materialize(counts, "link-counts")
    sources = counts.where("word is not null and other is null").select("word", F.col("n").alias("n_word"))
    targets = counts.where("word is null and other is not null").select("other", F.col("n").alias("n_other"))
    total = counts.where("word is null and other is null").select(F.col("n").alias("total"))
    both = counts.where("word is not null and other is not null and n >= 2").join(sources, "word").join(targets, "other").join(F.broadcast(total))
    scored = both.withColumn("p", F.col("n") / (F.col("n_word") + 1.0)).withColumn("lift", F.col("n") * F.col("total") / (F.col("n_word") * F.col("n_other"))).where(f"p >= {LEAST} and lift > 1.5")
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.least(F.lit(1.0), F.col("lift") / 10) * F.col("p")), F.asc("other")))
    return scored.withColumn("place", place).where(F.col("place") <= TRANSLATIONS).select("word", "other", "p")


def frequencies(joined: DataFrame) -> DataFrame:
    """(word, other, p): how frequent the words of both sides are by target sentences, and words that are not seen."""
    schema = [("word", pa.string()), ("other", pa.string()), ("n", pa.int64())]

    def work(pairs) -> pa.RecordBatch:
        counts: Counter = Counter()
        for _, source, target, _ in pairs:
            counts[None, None] += len(target)
            counts.update((w, None) for own in source for w in own)
            counts.update((None, w) for own in target for w in own)
        return batch(schema, ([k[0] for k in counts], [k[1] for k in counts], list(counts.values())))

    counts = materialize(with_lexicon(joined, None, work, "word string, other string, n long").groupBy("word", "other").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.where("word is null and other is null").select(F.greatest(F.col("n"), F.lit(1)).alias("total"))
    one = F.col("word").isNull() & F.col("other").isNull()
    return counts.join(F.broadcast(total)).select("word", "other", F.when(one, 0.5 / F.col("total")).otherwise(F.least(F.lit(0.9), F.col("n") / F.col("total") * 0.5)).alias("p"))


def train(joined: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The lexicon (word, other, p) of all pairs in ``joined`` (pair_id, ka, en)."""
    general = materialize(frequencies(joined), "frequencies")
    lexicon = None
    for number in range(rounds):
        lexicon = materialize(translations(link_counts(joined, lexicon, number > 1)).unionByName(general), f"lexicon-{number}")
    return lexicon


def joined_texts(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(pair_id, ka, en) of ``pairs`` (id, ka_document_id, en_document_id) whose pages (id, content_text) are both there
    with a text, each pair once: of each sentence the words, as one string.

    Texts become words in the scan, and only pages of pairs go on: up to PAGES_MOST page ids are sent to all tasks, more
    are joined by shuffle."""
    sides = pairs.select(
        F.col("id").alias("pair_id"),
        F.explode(F.array(F.struct(F.lit("ka").alias("side"), F.col("ka_document_id").cast("long").alias("page")), F.struct(F.lit("en").alias("side"), F.col("en_document_id").cast("long").alias("page")))).alias("x"),
    ).select("pair_id", "x.side", "x.page").where("page is not null and pair_id is not null").distinct()
    sides = materialize(sides, "pair-sides")
    wanted = sides.select("page").distinct()
    texts = pages.select(F.col("id").alias("page"), "content_text").where("content_text is not null")
    texts = texts.join(F.broadcast(wanted) if sides.count() <= PAGES_MOST else wanted, "page", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words = [[" ".join(tokens(s)) for s in sentences(text)] for text in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words, pa.list_(pa.string()))], names=["page", "words"])

    worded = map_batches(texts, run, "page long, words array<string>").join(F.broadcast(sides) if sides.count() <= PAGES_MOST else sides, "page")
    sides_of = {side: F.first(F.when(F.col("side") == side, F.col("words")), True).alias(side) for side in ("ka", "en")}
    return worded.groupBy("pair_id").agg(*sides_of.values()).where("ka is not null and en is not null")


def aligned(joined: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(pair_id, ka_sentence_no, en_sentence_no, evidence) of ``joined`` (pair_id, ka, en): a row for each two sentences of
    which one translates the other or a part of it. Blank texts and texts that do not belong together give no row."""
    schema = [("pair_id", pa.int64()), ("ka_sentence_no", pa.int32()), ("en_sentence_no", pa.int32()), ("evidence", pa.float64())]

    def work(pairs) -> pa.RecordBatch:
        found = []
        for pair, source, target, known in pairs:
            links = decode(source, target, known)
            if belong_together(links):
                found += [(pair, *link[:3]) for link in links]
        return batch(schema, ([f[k] for f in found] for k in range(4)))

    return with_lexicon(joined, lexicon, work, "pair_id long, ka_sentence_no int, en_sentence_no int, evidence double")


def _aligned(spark: SparkSession, root: str) -> DataFrame:
    pairs = table(spark, root, "document_locale_pair", "id", "ka_document_id", "en_document_id")
    joined = materialize(joined_texts(pairs, spread(table(spark, root, "ingestion_document", "id", "content_text"))), "pair-texts")
    return aligned(joined, train(joined))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(pair_id, ka_sentence_no, en_sentence_no): which sentences say the same."""
    return _aligned(spark, root).select("pair_id", "ka_sentence_no", "en_sentence_no")


def p4_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(pair_id, n_links, evidence): how much each pair's texts have in common; pairs without a link have none."""
    pairs = table(spark, root, "document_locale_pair", F.col("id").alias("pair_id")).distinct()
    links = _aligned(spark, root).groupBy("pair_id").agg(F.count("*").alias("n_links"), F.round(F.sum("evidence"), 3).alias("evidence"))
    return pairs.join(links, "pair_id", "left").fillna({"n_links": 0, "evidence": 0.0})


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
SQL: dict[str, str] = {}
