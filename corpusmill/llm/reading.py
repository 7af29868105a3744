"""Reading level of each document (problem 10).

Gradient-boosted regression trees over distributions of length, vocabulary, syntax and cohesion; the cut points between
levels are those that fit predictions cross-validated by source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.boosting import LOWEST, STEPS, Graded, Trees, best_cuts, quantile_edges, stepped
from corpusmill.llm.common import map_batches
from corpusmill.llm.language import WordModel, count_items, fit_all
from corpusmill.session import materialize, spread
from corpusmill.sources.tables import table

#: Folds of the cross-validation.
FOLDS = 3
#: Up to so many labels are broadcast; up to so many labelled rows are fitted in the driver, about 80 bytes each. There is
#: another way beyond each.
LABELS_MOST, FIT_ROWS = 1_000_000, 500_000
#: A label farther than this from its cross-validated prediction is taken for a slip and left out of the second round.
SLIP = 0.75
MIN_WORDS = 40
#: Sizes of the lists of frequent words.
FREQUENT = (100, 400, 1500)

_LETTER = re.compile(r"[^\W\d_]")
_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+")
_SENTENCE_BINS = np.array([4, 6, 8, 10, 12, 15, 18, 22, 27, 33, 40])
_WORD_BINS = np.array([3, 4, 5, 6, 7, 8, 9, 11, 13, 15, 18])
_MEAN_BINS = np.array([3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0])
_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_MEMO = 300_000


def text_words(text: str) -> list[str]:
    """Runs of non-blank characters that hold a letter."""
    return [w for w in text.split() if _LETTER.search(w)]


class WordTable:
    """What is known of each distinct run of characters; a text is then a list of rows of this table."""

    def __init__(self, words: WordModel, ranks: dict[str, dict[str, int]]):
        self.words, self.ranks = words, ranks
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.rows: list[tuple] = []

    def add(self, run: str) -> int:
        """The row of a new run; -1 for one without a letter."""
        if not _LETTER.search(run):
            self.place[run] = -1
            return -1
        bare = _STRIP.sub("", run).lower()
        scores = self.words.scores(bare) or (0.0, 0.0, 0.0, 0.0)
        row = (len(bare), "," in run, self.bare.setdefault(bare, len(self.bare)), self.ranks["en"].get(bare, 10**6), self.ranks["ka"].get(bare, 10**6), *scores)
        self.place[run] = len(self.rows)
        self.rows.append(row)
        return len(self.rows) - 1


def _shares(values: np.ndarray, edges: np.ndarray, group: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """For each group the share of its values in each bin."""
    wide = len(edges) + 1
    table_ = np.bincount(group * wide + np.searchsorted(edges, values), weights, n * wide).reshape(n, wide)
    return table_ / np.maximum(table_.sum(axis=1, keepdims=True), 1)


def _moments(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """For each group the mean and the standard deviation."""
    size = np.maximum(np.bincount(group, minlength=n), 1)
    mean = np.bincount(group, values, n) / size
    return np.stack([mean, np.sqrt(np.maximum(np.bincount(group, values * values, n) / size - mean * mean, 0))], axis=1)


def _quantiles(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """For each group its values nearest to the quantiles."""
    ordered = values[np.lexsort((values, group))]
    size = np.bincount(group, minlength=n)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = [np.minimum(start + np.round(q * np.maximum(size - 1, 0)).astype(np.int64), max(0, len(ordered) - 1)) for q in _QUANTILES]
    return np.stack([ordered[a] if len(ordered) else np.zeros(n) for a in at], axis=1)


def batch_features(texts: list[str | None], table_: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Which of the texts are mainly English or Georgian and of at least MIN_WORDS words, and the distributions of
    their lengths, vocabulary, syntax and cohesion; all texts of a batch are counted together."""
    if len(table_.rows) > _MEMO:
        table_.clear()
    place, add = table_.place, table_.add
    ids: list[int] = []
    in_sentence: list[int] = []
    of_text: list[int] = []
    signs = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        if not text or len(text) < 2 * MIN_WORDS - 1:
            continue
        signs[i] = text.count(";") + text.count("—") + text.count("("), sum(map(text.count, "0123456789")) / len(text)
        for sentence in _END.split(text):
            if sentence:
                own = [place[w] if w in place else add(w) for w in sentence.split()]
                ids += own
                in_sentence.append(len(own))
                of_text.append(i)
    word, sentence = np.array(ids, np.int64), np.repeat(np.arange(len(in_sentence)), in_sentence)
    keep = word >= 0
    word, sentence = word[keep], sentence[keep]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    known = np.array(table_.rows, float)
    text_of = np.array(of_text, np.int64)
    n_sentences = len(text_of)
    # the language of most letters, a sentence at a time
    letters = known[word, 0]
    by_language = np.stack([np.bincount(sentence, known[word, 5 + k], n_sentences) for k in range(4)], axis=1).argmax(axis=1)
    sizes = np.bincount(sentence, letters, n_sentences)
    spoken = np.stack([np.bincount(text_of, sizes * (by_language == k), len(texts)) for k in range(4)], axis=1)
    main = spoken.argmax(axis=1)
    n_words = np.bincount(text_of[sentence], minlength=len(texts))
    fits = np.flatnonzero((n_words >= MIN_WORDS) & (main <= 1))
    if not len(fits):
        return fits, np.zeros((0, 0))
    # only the words of these texts, with sentences and texts numbered anew
    number = np.full(len(texts), -1)
    number[fits] = np.arange(len(fits))
    stays = number[text_of[sentence]] >= 0
    word, sentence = word[stays], sentence[stays]
    used, sentence = np.unique(sentence, return_inverse=True)
    group_of = number[text_of[used]]
    n, group = len(fits), group_of[sentence]
    facts, georgian = known[word], main[fits] == 0
    length, comma, bare = facts[:, 0], facts[:, 1], facts[:, 2].astype(np.int64)
    size = np.bincount(sentence).astype(float)
    mean_length = np.bincount(sentence, length) / size
    commas = np.bincount(sentence, comma)
    rank = np.where(georgian[group], facts[:, 4], facts[:, 3])
    total, per_text = np.bincount(group, minlength=n), np.bincount(group_of, minlength=n)
    types, times = np.unique(group * (len(table_.bare) + 1) + bare, return_counts=True)
    type_group = types // (len(table_.bare) + 1)
    # words shared by a sentence and the next one of its text, over the shorter one's
    wide = len(table_.bare) + 1
    pairs = np.unique(sentence * wide + bare)
    of, distinct = pairs // wide, np.bincount(pairs // wide, minlength=len(used))
    again = np.isin(pairs + wide, pairs, assume_unique=True) & (group_of[of] == group_of[np.minimum(of + 1, len(used) - 1)]) & (of + 1 < len(used))
    next_to = np.flatnonzero(group_of[:-1] == group_of[1:])
    shared = np.bincount(of[again], minlength=len(used))[next_to] / np.maximum(np.minimum(distinct[next_to], distinct[next_to + 1]), 1)
    columns = [
        georgian[:, None], total[:, None], per_text[:, None], _moments(size, group_of, n), _quantiles(size, group_of, n),
        _shares(size, _SENTENCE_BINS, group_of, n), _shares(size, _SENTENCE_BINS, group_of, n, size), _moments(length, group, n), _shares(length, _WORD_BINS, group, n),
        _quantiles(mean_length, group_of, n), _shares(mean_length, _MEAN_BINS, group_of, n),
        (np.bincount(type_group, minlength=n) / total)[:, None], (np.bincount(type_group, times == 1, n) / total)[:, None],
        *((np.bincount(group, rank < f, n) / total)[:, None] for f in FREQUENT),
        *((np.bincount(group_of, x, n) / per_text)[:, None] for x in (commas, commas > 0, commas > 1)),
        (signs[fits, 0] / per_text)[:, None], signs[fits, 1:], _moments(shared, group_of[next_to], n), (np.bincount(group_of[next_to], shared > 0.3, n) / per_text)[:, None],
    ]
    return fits, np.concatenate(columns, axis=1).astype(float)


@dataclass
class ReadingModel:
    """Trees and the cut points between levels; out_of_fold is their cross-validated share of right levels."""

    trees: Trees | None
    cuts: np.ndarray
    out_of_fold: float

    def levels(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.zeros(0, np.int32)
        return (np.searchsorted(self.cuts, stepped(self.trees.predict(x))) + 1).astype(np.int32)


def fit_levels(rows: Graded) -> ReadingModel:
    """Trees and cut points in two rounds over all rows: the first finds labels that are slips, the second goes without
    them. Cut points come from predictions of folds that share no source."""
    if rows.n < 10:
        return ReadingModel(None, np.arange(1, 5) + 0.5, 0.0)
    folds = list(range(FOLDS))
    good = rows.judged(rows.forests(folds), SLIP)
    *others, trees = good.forests([*folds, -1])
    every, own = good.graded(others)
    step, grade = np.nonzero(every)
    predicted, n = LOWEST + step / STEPS, own[step, grade]
    cuts = best_cuts(predicted[n > 0], grade[n > 0] + 1, weights=n[n > 0])
    return ReadingModel(trees, cuts, float(np.average(np.searchsorted(cuts, predicted) == grade, weights=every[step, grade])))


def described(documents: DataFrame, words: WordModel, ranks: dict[str, dict[str, int]], carried: list[str], finish) -> DataFrame:
    """Rows of ``documents`` (carried columns, then text) whose text is mainly English or Georgian and has at least
    MIN_WORDS words; ``finish(carried arrays, features)`` makes the batch that comes out, its schema is finish.schema."""
    shared = documents.sparkSession.sparkContext.broadcast((words, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(*shared.value)
        for rows in batches:
            keep, made = batch_features(rows.column(len(carried)).to_pylist(), known)
            at = pa.array(keep, pa.int64())
            yield finish([rows.column(k).take(at) for k in range(len(carried))], made)

    return map_batches(documents.select(*carried, "text"), run, finish.schema)


def word_counts(lang: str, runs: Counter) -> Counter:
    """How often each word, without what stands around it and in lower case, is in counted runs of characters."""
    counts = Counter()
    for run, n in runs.items() if lang in ("en", "ka") else ():
        if _LETTER.search(run):
            counts[_STRIP.sub("", run).lower()] += n
    return counts


def vocabulary(documents: DataFrame) -> tuple[WordModel, dict[str, dict[str, int]]]:
    """The model of words' languages and the frequent words, both counted over all labelled ``documents`` (text, lang)."""
    rows = spread(documents.select(F.col("lang").alias("label"), "text"))
    counted = materialize(count_items(rows, extra=word_counts), "counts")
    ranks = {}
    for lang in ("en", "ka"):
        frequent = counted.where((F.col("kind") == 1) & (F.col("lang") == lang)).orderBy(F.desc("n"), "item").limit(FREQUENT[-1]).select("item").collect()
        ranks[lang] = {r.item: k for k, r in enumerate(frequent)}
    return fit_all(rows, counted), ranks


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    joined = np.frombuffer(b"".join(column.to_pylist()), np.float32)
    return joined.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def features(documents: DataFrame) -> DataFrame:
    """(doc_id, source, x) of ``documents`` (doc_id, text, lang, source) that have levels, written out; x has the features
    as 32-bit numbers of ten binary digits after the first, so that few of their values differ."""

    def finish(columns: list[pa.Array], made: np.ndarray) -> pa.RecordBatch:
        short = (made.astype(np.float32).view(np.uint32) & np.uint32(0xFFFFE000)).view(np.float32)
        return pa.RecordBatch.from_arrays([*columns, _packed(short)], names=["doc_id", "source", "x"])

    finish.schema = "doc_id long, source string, x binary"
    return materialize(described(spread(documents.select("doc_id", "source", "text")), *vocabulary(documents), ["doc_id", "source"], finish), "features")


def labelled(rows: DataFrame, labels: DataFrame, most: int = LABELS_MOST) -> DataFrame:
    """(x, level, fold) of all ``rows`` (doc_id, source, x) that have labels, written out. Labels are broadcast up to
    ``most``; beyond, features are shuffled by id."""
    own = labels.where("doc_id is not null and reading_level between 1 and 5").groupBy("doc_id").agg(F.round(F.avg("reading_level")).cast("int").alias("level"))
    own = materialize(own, "labels")
    joined = rows.join(F.broadcast(own) if own.count() <= most else own.hint("merge"), "doc_id").select("x", "level", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            fold = [xxhash.xxh3_64_intdigest(s or "") % FOLDS for s in own.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(fold, pa.int32())], names=["x", "level", "fold"])

    return materialize(map_batches(joined, run, "x binary, level int, fold int"), "labelled")


def coded_rows(rows: DataFrame, most: int = FIT_ROWS, **trees: int) -> tuple[list[np.ndarray], Graded]:
    """The edges of the features' bins, by the quantiles of all ``rows`` (x, level, fold), and these rows in bins."""
    n = rows.count()
    first = rows.select("x").first()
    wide = len(first.x) // 4 if first else 0

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for f, column in enumerate(_unpacked(own.column(0)).T):
                value, times = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), f, np.int32)), pa.array(value), pa.array(times)], names=["feature", "value", "n"])

    counted = map_batches(rows.select("x"), values, "feature int, value float, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    edges = quantile_edges(counted, wide, Trees().bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binned = Trees(edges=edges)
        for own in batches:
            if own.num_rows:
                codes = [c.tobytes() for c in binned.coded(_unpacked(own.column(0)))]
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), own.column(1), own.column(2), pa.array(np.ones(len(codes), bool))], names=["codes", "grade", "fold", "good"])

    coded = materialize(map_batches(rows, run, "codes binary, grade int, fold int, good boolean"), "coded")
    return edges, Graded(coded, n, wide, most, **trees)


def reading_model(rows: DataFrame, labels: DataFrame) -> ReadingModel:
    """The model of levels, fitted on all labelled ``rows`` of ``features``."""
    edges, coded = coded_rows(labelled(rows, labels))
    model = fit_levels(coded)
    if model.trees is not None:
        model.trees.edges = edges
    return model


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of ``documents`` (doc_id, text, lang, source) whose text is mainly English or Georgian
    and has at least MIN_WORDS words. Null and short texts give no row; with fewer than ten labels there is no model, and so no row. Labels that
    come twice count once; of different ones the mean is taken."""
    rows = features(documents)
    shared = documents.sparkSession.sparkContext.broadcast(reading_model(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            levels = shared.value.levels(_unpacked(own.column(1)))
            yield pa.RecordBatch.from_arrays([own.column(0).slice(0, len(levels)), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"])

    return map_batches(rows.select("doc_id", "x"), run, "doc_id long, reading_level int")


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, root, "documents", "doc_id", "text", "lang", "source"), table(spark, root, "reading_label", "doc_id", "reading_level")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, reading_level): the level each English or Georgian text was written for."""
    return reading_levels(*_tables(spark, root))


def p10_per_source(spark: SparkSession, root: str) -> DataFrame:
    """(source, reading_level, n_documents): the profile of each source."""
    documents, labels = _tables(spark, root)
    return reading_levels(documents, labels).join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_documents"))


QUERIES = {"p10_found": p10_found, "p10_per_source": p10_per_source}
SQL: dict[str, str] = {}
