"""Text cut off by field limits (problem 6).

A backward character n-gram model counts, for the characters before a place, how often a unit of text (a sentence or a
line) ends there and how often it goes on. A value's log-odds hold the end of text against continuation for its final
context, whatever it ends in; the threshold is found per language and column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, map_batches
from corpusmill.llm.language import LANGUAGES, WordModel, train
from corpusmill.session import materialize
from corpusmill.sources.tables import table
from corpusmill.sources.views import single_rows

#: Contexts of so many texts are counted in one pass over the values.
COUNT_BLOCK = 300_000
ORDERS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25)
#: A place counts so many units, one that may or may not end a sentence one.
UNITS = 4
#: Weight of the next shorter context, in observations.
BACKOFF = 1.0
THRESHOLDS = (-3.0, 0.0)
#: A language's own threshold needs so many values below them.
MODE = 10
#: Log-odds of a visible mark of a cut: who closes a text puts none there.
MARKED = -20.0
#: Characters at a value's end by which its language is told, and at the head of the next chunk.
END, HEAD = 120, 120
#: A length is a column's limit if this many times as many values have it as have the lengths around it; at a limit the
#: log-odds have to be so much higher.
SPIKE, AT_LIMIT = 6.0, 1.5
#: Values are hashed in stretches of about so many characters; places are summed up when so many have been found.
_STRETCH, _PENDING = 1 << 18, 1 << 23
#: Stands between two values; no character, so no context of a value has it.
_BETWEEN = 0x110000
#: Stands for it while texts are joined; a noncharacter, which is dropped from texts.
_STAND_IN = "\U0010ffff"
_BASE = np.uint64(0x100000001B3)
_CUT_MARK = re.compile(r"(?:\s*(?:\ufffd|\[\s*(?:…|\.{3})\s*\]|…|\.{3,}))+$")
_SPACES = re.compile(r"[ \u00a0\u2000-\u200a\u202f\u3000]+")
_DIGIT = re.compile(r"\d")
_GEORGIAN = re.compile("[ა-ჿ]")
_CLOSERS = "\"'»”’)]*"


def plain(text: str) -> str:
    """One space for several, digits alike."""
    return _DIGIT.sub("0", _SPACES.sub(" ", text.replace("\r", "")))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _plain_points(text: str) -> np.ndarray:
    """The characters of ``plain(text)``, for long texts."""
    points = _points(_SPACES.sub(" ", text.replace("\r", "")))
    digit = (_CLASSES[np.minimum(points, _LETTERS_FROM).astype(np.int64)] & _DECIMAL) > 0
    far = np.flatnonzero(points >= _LETTERS_FROM)
    if len(far):
        kinds, of = np.unique(points[far], return_inverse=True)
        digit[far] = np.array([chr(int(c)).isdecimal() for c in kinds])[of]
    points[digit] = ord("0")
    return points


def context_hashes(points: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[int, np.ndarray]]:
    """For each order k: the hash of the k characters before each place k, k + 1, ..., len(points)."""
    value, power = np.zeros(len(points) + 1, np.uint64), np.uint64(1)
    for k in range(1, max(orders) + 1):
        if len(points) < k:
            return
        value = value[1:] + (points[: len(points) - k + 1] + np.uint64(1)) * power
        power = np.uint64(int(power) * int(_BASE) % (1 << 64))
        if k in orders:
            yield k, value ^ (value >> np.uint64(31)) ^ (np.uint64(k) << np.uint64(58))


_MARK, _CLOSER, _DIGIT_, _LOWER, _ALPHA, _DECIMAL = (1 << k for k in range(6))
_LETTERS_FROM = 0x3000


def _character_classes() -> np.ndarray:
    """Classes of the characters below _LETTERS_FROM; what lies beyond counts as a letter without case."""
    table_ = np.zeros(_LETTERS_FROM + 1, np.uint8)
    for code in range(_LETTERS_FROM):
        c = chr(code)
        table_[code] = _MARK * (c in ".!?…") + _CLOSER * (c in _CLOSERS) + _DIGIT_ * c.isdigit() + _LOWER * (c.islower() and not _GEORGIAN.match(c)) + _ALPHA * c.isalpha() + _DECIMAL * c.isdecimal()
    table_[_LETTERS_FROM] = _ALPHA
    return table_


_CLASSES = _character_classes()


def joined_ends(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place 0 ... len(points) of texts that are each followed by _BETWEEN: does a sentence or a line end here? A
    place just before a full stop ends one too, as values may lack it. A full stop within a line after up to three letters
    may be that of an abbreviation: such places are no ends, but the second result, since they say less."""
    n = len(points)
    kind = _CLASSES[np.minimum(points, _LETTERS_FROM).astype(np.int64)]
    ends = np.zeros(n + 1, bool)
    at = np.flatnonzero(kind & _MARK)
    after = at + 1
    while True:
        closer = (kind[after] & _CLOSER) > 0
        if not closer.any():
            break
        after[closer] += 1
    follows = np.minimum(after + 1, n - 1)
    letters = [(kind[np.maximum(at - d, 0)] & _ALPHA > 0) & (at >= d) for d in (1, 2, 3, 4)]
    word = letters[0] & letters[1] & letters[2] & letters[3]
    digit, lower = kind[follows] & _DIGIT_ > 0, kind[follows] & _LOWER > 0
    goes_on = (points[after] == 32) & (points[follows] != _BETWEEN) & np.where(digit, letters[0] & letters[1] & letters[2], ~lower)
    short = goes_on & letters[0] & ~word
    unsure = np.zeros(n + 1, bool)
    unsure[at[short]] = unsure[at[short] + 1] = unsure[after[short]] = True
    good = goes_on & ~short | (points[after] == _BETWEEN) | (points[after] == 10)
    at, after = at[good], after[good]
    ends[at] = ends[at + 1] = ends[after] = True
    ends[:n] |= (points == 10) | (points == _BETWEEN)
    return ends, unsure & ~ends


def unit_ends(points: np.ndarray) -> np.ndarray:
    """``joined_ends`` of a single text."""
    return joined_ends(np.concatenate([points, np.array([_BETWEEN], np.uint64)]))[0][: len(points) + 1]


def backed_off(counts: list[tuple[int, int]], base: float, own: int) -> float:
    """The log-odds of an end by the (ends, all) ``counts`` of a text's final contexts, the shortest first."""
    p = base
    for ends, n in counts:
        if n - own <= 0:
            break
        p = (max(0, ends - own) + BACKOFF * UNITS * p) / (n - own + BACKOFF * UNITS)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


class EndModel:
    """Sorted context hashes with how often a unit ends after each, and how often the context comes."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, all_: np.ndarray, base: float):
        self.keys, self.ends, self.all, self.base = keys, ends, all_, base

    def log_odds(self, text: str, own: int = UNITS) -> float:
        """The log-odds that a unit ends where ``text`` ends. ``own``: how often the value itself may have been counted
        as an end; it is left out."""
        counts = []
        for _, hashes in context_hashes(_points(text[-max(ORDERS) :])):
            i = int(np.searchsorted(self.keys, hashes[-1]))
            if i >= len(self.keys) or self.keys[i] != hashes[-1]:
                break
            counts.append((int(self.ends[i]), int(self.all[i])))
        return backed_off(counts, self.base, own)


def fit(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The arrays of an EndModel of ``texts``."""
    points = _points("\n".join(plain(t).strip() for t in texts))
    ends = unit_ends(points)
    all_keys, all_ends, all_n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, hashes in context_hashes(points):
        keys, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
        all_keys.append(keys)
        all_ends.append(UNITS * np.bincount(inverse, weights=ends[k:], minlength=len(keys)).astype(np.int64))
        all_n.append(UNITS * n)
    keys = np.concatenate(all_keys)
    order = np.argsort(keys)
    return keys[order], np.concatenate(all_ends)[order], np.concatenate(all_n)[order], float(ends.mean())


def context_key(kind: int, hashes: np.ndarray) -> np.ndarray:
    """Contexts of ends (kind 0) and of starts (kind 1) in one table."""
    return hashes ^ (np.uint64(kind) << np.uint64(63))


def text_keys(kind: int, text: str) -> list[int]:
    """The keys of the final contexts of ``text``, the shortest first, as bigints."""
    return [int(context_key(kind, hashes[-1:]).view(np.int64)[0]) for _, hashes in context_hashes(_points(text[-max(ORDERS) :]))]


class Tally:
    """How often units end, or start, at the places with each of the contexts ``keys``, and how often these come.

    With a context, ``keys`` have all shorter ones of its end, so a place is given up at the first that is not among them.
    """

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, len(keys).bit_length() + 2)
        slots = self._slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys = np.concatenate([keys[order], np.zeros(1, np.uint64)])
        self.first = np.searchsorted(slots[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.ends, self.all = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        #: Places with an end or start, and all places, of both kinds.
        self.places = [[0, 0], [0, 0]]
        self.pending: list[np.ndarray] = []
        self.pending_ends: list[np.ndarray] = []
        self.pending_less: list[np.ndarray] = []
        self.waiting = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        at, end = self.first[slots], self.first[slots + 1]
        out = np.where((at < end) & (self.keys[at] == keys), at, -1)
        open_ = np.flatnonzero((out < 0) & (end - at > 1))
        while len(open_):
            at[open_] += 1
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (end[open_] - at[open_] > 1)]
        return out

    def add(self, texts: list[str]) -> None:
        pile, size = [], 0
        for text in texts:
            pile.append(text)
            size += len(text)
            if size >= _STRETCH:
                self._stretch(pile)
                pile, size = [], 0
        if pile:
            self._stretch(pile)

    def _stretch(self, texts: list[str]) -> None:
        """All places of ``texts``, each of which is put between a line break and _BETWEEN."""
        points = _plain_points("".join("\n" + t.replace(_STAND_IN, "").strip() + _STAND_IN for t in texts))
        points[points == ord(_STAND_IN)] = _BETWEEN
        ends, unsure = joined_ends(points)
        last = np.flatnonzero(points == _BETWEEN)
        first = np.concatenate([[0], last[:-1] + 1])
        ends[first] = False
        starts = np.zeros(len(points) + 1, bool)
        after = np.flatnonzero((points == 10) | (points == 32)) + 1
        starts[after] = ends[after - 1] | (points[after - 1] == 10)
        n = len(points) - len(texts)
        for kind, flags in ((0, ends), (1, starts)):
            self.places[kind][0] += int(flags.sum())
            self.places[kind][1] += n
        for kind, data, flags, less in ((0, points, ends, unsure), (1, points[::-1].copy(), starts[::-1].copy(), None)):
            alive = np.arange(1, len(flags))
            value, power = np.zeros(len(alive), np.uint64), 1
            for k in range(1, max(ORDERS) + 1):
                if alive[0] < k:
                    keep = alive >= k
                    alive, value = alive[keep], value[keep]
                value += (data[alive - k] + np.uint64(1)) * np.uint64(power)
                power = power * int(_BASE) % (1 << 64)
                if k in ORDERS:
                    found = self._find(context_key(kind, value ^ (value >> np.uint64(31)) ^ (np.uint64(k) << np.uint64(58))))
                    keep = np.flatnonzero(found >= 0)
                    if not len(keep):
                        break
                    alive, value, found = alive[keep], value[keep], found[keep]
                    self.pending.append(found)
                    self.pending_ends.append(found[flags[alive]])
                    if less is not None:
                        self.pending_less.append(found[less[alive]])
                    self.waiting += len(found)
                elif not len(alive):
                    break
        if self.waiting > _PENDING:
            self.sum_up()

    def sum_up(self) -> None:
        if self.pending:
            self.all += UNITS * np.bincount(np.concatenate(self.pending), minlength=len(self.all))
            self.ends += UNITS * np.bincount(np.concatenate(self.pending_ends), minlength=len(self.ends))
            if self.pending_less:
                self.all -= (UNITS - 1) * np.bincount(np.concatenate(self.pending_less), minlength=len(self.all))
        self.pending, self.pending_ends, self.pending_less, self.waiting = [], [], [], 0


def context_counts(values: DataFrame, texts: DataFrame, block: int = COUNT_BLOCK) -> DataFrame:
    """(key, ends, n): over all ``values`` (text), how often each final context of ``texts`` (kind, text) comes, and how
    often a unit ends there (kind 0) or starts (kind 1; the text is backward). The keys 0 and 1 have the counts of all
    places. Texts are sent out in blocks of at most ``block``; a block costs one pass over the values."""
    spark = values.sparkSession

    def count(own: list) -> DataFrame:
        keys = np.unique(np.array([k for r in own for k in text_keys(r.kind, r.text)], np.int64)).view(np.uint64)
        shared = spark.sparkContext.broadcast(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally = Tally(shared.value)
            for rows in batches:
                for column in rows.columns:
                    tally.add([t for t in column.to_pylist() if t])
            tally.sum_up()
            some = np.flatnonzero(tally.all)
            keys_ = np.concatenate([tally.keys[some].view(np.int64), [0, 1]])
            ends, n = (np.concatenate([part[some], [tally.places[kind][i] for kind in (0, 1)]]) for i, part in enumerate((tally.ends, tally.all)))
            yield pa.RecordBatch.from_arrays([pa.array(keys_), pa.array(ends), pa.array(n)], names=["key", "ends", "n"])

        return map_batches(values, run, "key long, ends long, n long").groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))

    out, part = None, []
    for row in texts.orderBy("kind", "text").toLocalIterator():
        part.append(row)
        if len(part) == block:
            out, part = count(part) if out is None else out.unionByName(count(part)), []
    if part or out is None:
        out = count(part) if out is None else out.unionByName(count(part))
    return out.groupBy("key").agg(F.max("ends").alias("ends"), F.max("n").alias("n"))


def text_odds(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, text, log_odds) of ``texts`` (kind, text) by their contexts' ``counts``. Each text was counted once itself,
    as an end or a start; that is left out."""
    totals = {r.key: r.ends / max(r.n, 1) for r in counts.where("key in (0, 1)").collect()}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [(kind, text, k, key) for kind, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for k, key in enumerate(text_keys(kind, text))]
            yield batch([("kind", pa.int32()), ("text", pa.string()), ("k", pa.int32()), ("key", pa.int64())], ([f[i] for f in found] for i in range(4)))

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            kinds, counted = rows.column(0).to_pylist(), rows.column(2).to_pylist()
            values = [backed_off([(c["ends"], c["n"]) for c in own], totals.get(kind, 0.02), UNITS) for kind, own in zip(kinds, counted, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(values, pa.float64())], names=["kind", "text", "log_odds"])

    exploded = map_batches(texts.select("kind", "text"), contexts, "kind int, text string, k int, key long")
    listed = exploded.join(counts, "key").groupBy("kind", "text").agg(F.array_sort(F.collect_list(F.struct("k", "ends", "n"))).alias("counts"))
    return map_batches(listed, odds, "kind int, text string, log_odds double")


def tails(values: DataFrame, words: WordModel) -> DataFrame:
    """(item_table, field, item_id, corpus_id, document_id, sequence_no, size, lang, mark, tail) of ``values`` (with text):
    one row a value; null and blank values are left out. lang: the language of the value's end by ``words``. mark: it ends
    in a replacement character or an added ellipsis. tail: its last characters, without the mark."""
    carried = ["item_table", "field", "item_id", "corpus_id", "document_id", "sequence_no"]
    shared = values.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            text = rows.column(len(carried)).to_pylist()
            keep = [i for i, t in enumerate(text) if t and not t.isspace()]
            languages, marks, ends, sizes = [], [], [], []
            for i in keep:
                value = text[i].rstrip()
                sizes.append(len(text[i]))
                letters = known.letters(value[-END:].replace("\n", " "))
                languages.append(LANGUAGES[max(range(4), key=letters.__getitem__)] if any(letters) else "none")
                whole = _CUT_MARK.sub("", value).rstrip()
                marks.append(len(whole) < len(value))
                tail = plain(whole[-END:]).rstrip()
                ends.append(("\n" + tail if len(whole) <= END else tail)[-max(ORDERS) :])
            picked = [rows.column(i).take(pa.array(keep, pa.int64())) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(sizes, pa.int32()), pa.array(languages, pa.string()), pa.array(marks, pa.bool_()), pa.array(ends, pa.string())], names=[*carried, "size", "lang", "mark", "tail"])

    kinds = "item_table string, field string, item_id long, corpus_id long, document_id long, sequence_no int, size int, lang string, mark boolean, tail string"
    return map_batches(values.select(*carried, "text"), run, kinds)


def thresholds(scored: DataFrame) -> dict[tuple[str, str], float]:
    """(field, language) -> threshold: the widest valley of the log-odds' histogram between THRESHOLDS. A language with
    fewer than MODE values below, which has no mode of cut values, takes that of all the field's values."""
    low, high = THRESHOLDS
    every = F.greatest(F.lit(int(low * 4) - 1), F.least(F.lit(int(high * 4)), F.floor(F.col("log_odds") * 4)))
    rows = scored.where("not mark").groupBy("field", "lang", every.alias("bin")).count().collect()
    found: dict[tuple[str, str | None], dict[int, int]] = {}
    for r in rows:
        for group in ((r.field, r.lang), (r.field, None)):
            own = found.setdefault(group, {})
            own[r.bin] = own.get(r.bin, 0) + r["count"]

    def valley(counts: dict[int, int]) -> float:
        bins = range(int(low * 4), int(high * 4))
        smooth = {b: sum(counts.get(b + d, 0) for d in (-2, -1, 0, 1, 2) if b + d in bins) for b in bins}
        places = [b for b in bins if smooth[b] == min(smooth.values())]
        return (places[len(places) // 2] + 0.5) / 4

    return {(field, lang): valley(counts if counts.get(int(low * 4) - 1, 0) >= MODE else found[field, None]) for (field, lang), counts in found.items() if lang is not None}


def limits(scored: DataFrame) -> dict[str, list[int]]:
    """field -> the lengths at which its values are cut: far more values than at the lengths around."""
    counts = scored.groupBy("field", "size").agg(F.count("*").alias("n"))
    around = [d for d in range(-4, 5) if d]
    near = counts.select("field", F.explode(F.array(*(F.col("size") + d for d in around))).alias("size"), F.col("n").alias("m")).groupBy("field", "size").agg(F.sum("m").alias("m"))
    spikes = counts.where("n >= 5").join(near, ["field", "size"], "left").where(F.col("n") >= SPIKE * F.greatest(F.lit(1.0), F.coalesce("m", F.lit(0)) / len(around)))
    out: dict[str, list[int]] = {}
    for r in spikes.select("field", "size").orderBy("field", "size").collect():
        out.setdefault(r.field, []).append(r["size"])
    return out


def _values(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    pages = single_rows(spark, root, "ingestion_document", "id", "corpus_id", "summary_ka", "summary_en").where("id is not null")
    nothing = F.lit(None)
    values = None
    for field in ("summary_ka", "summary_en"):
        own = pages.select(F.lit("ingestion_document").alias("item_table"), F.lit(field).alias("field"), F.col("id").alias("item_id"), "corpus_id", nothing.cast("long").alias("document_id"), nothing.cast("int").alias("sequence_no"), F.col(field).alias("text"))
        values = own if values is None else values.unionByName(own)
    return values, single_rows(spark, root, "ingestion_chunk", "id", "corpus_id", "document_id", "sequence_no", "text").where("id is not null")


def cut_values(spark: SparkSession, root: str) -> DataFrame:
    """(item_table, field, item_id, corpus_id, cut): every non-blank value once, and whether it was cut.

    A chunk that stops inside a sentence is whole if the document's next chunk starts inside one: the start model holds
    the head of the next chunk against the starts of sentences. Contexts are counted over all values and pages, but only
    those that a value or a head ends in.
    """
    values, chunks = _values(spark, root)
    words = train(table(spark, root, "ingestion_document", "id", F.col("language").alias("label"), F.col("content_text").alias("text")).where("id is not null"))
    own = chunks.select(F.lit("ingestion_chunk").alias("item_table"), F.lit("text").alias("field"), F.col("id").alias("item_id"), "corpus_id", "document_id", "sequence_no", "text")
    ended = materialize(tails(values.unionByName(own), words), "tails")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            pairs = [(i, plain(head).strip()[: max(ORDERS)][::-1]) for i, head in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
            pairs = [p for p in pairs if p[1]]
            yield batch([("item_id", pa.int64()), ("head", pa.string())], ([p[0] for p in pairs], [p[1] for p in pairs]))

    next_ = chunks.select("document_id", (F.col("sequence_no") - 1).alias("sequence_no"), F.substring(F.ltrim("text"), 1, HEAD).alias("head")).where("head is not null")
    followed = ended.where("field = 'text' and document_id is not null and sequence_no is not null").select("item_id", "document_id", "sequence_no")
    heads = materialize(map_batches(followed.join(next_, ["document_id", "sequence_no"]).select("item_id", "head"), begin, "item_id long, head string").distinct(), "heads")

    texts = materialize(ended.select(F.lit(0).alias("kind"), F.col("tail").alias("text")).unionByName(heads.select(F.lit(1).alias("kind"), F.col("head").alias("text"))).distinct(), "texts")
    counted = single_rows(spark, root, "ingestion_document", "content_text", "summary_ka", "summary_en")
    nothing = F.lit(None).cast("string")
    counted = counted.unionByName(single_rows(spark, root, "ingestion_chunk", "text").select(F.col("text").alias("content_text"), nothing.alias("summary_ka"), nothing.alias("summary_en")))
    odds = materialize(text_odds(materialize(context_counts(counted, texts), "contexts"), texts), "odds")

    by_tail = odds.where("kind = 0").select(F.col("text").alias("tail"), "log_odds")
    scored = materialize(ended.join(by_tail, "tail").withColumn("log_odds", F.col("log_odds") + F.when(F.col("mark"), MARKED).otherwise(0.0)), "ends-scored")
    known = thresholds(scored)
    limit = F.lit(-2.0)
    for (field, lang), value in known.items():
        limit = F.when((F.col("field") == field) & (F.col("lang") == lang), F.lit(value)).otherwise(limit)
    for field, sizes in limits(scored).items():
        limit = limit + F.when((F.col("field") == field) & F.col("size").isin(sizes), AT_LIMIT).otherwise(0.0)
    judged = scored.withColumn("cut", F.col("log_odds") < limit)

    going = odds.where("kind = 1 and log_odds < -1.0").select(F.col("text").alias("head"))
    whole = heads.join(going, "head").select("item_id", F.lit("text").alias("field"), F.lit(True).alias("goes_on")).distinct()
    joined = judged.join(whole, ["item_id", "field"], "left")
    return joined.select("item_table", "field", "item_id", "corpus_id", (F.col("cut") & F.col("goes_on").isNull()).alias("cut"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """(item_table, field, item_id): the cut values."""
    return cut_values(spark, root).where("cut").select("item_table", "field", "item_id").distinct()


def p6_per_site(spark: SparkSession, root: str) -> DataFrame:
    """(corpus_id, field, n_values, n_cut, cut_share): how often each site's values are cut."""
    values = cut_values(spark, root).groupBy("corpus_id", "field").agg(F.count("*").alias("n_values"), F.count_if("cut").alias("n_cut"))
    return values.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6))


QUERIES = {"p6_found": p6_found, "p6_per_site": p6_per_site}
SQL: dict[str, str] = {}
