"""Missing or wrong document language labels, and passages in other languages (problem 3).

A word's script leaves few languages possible; among these, character trigram models score it. Viterbi over the words
of a line, with a penalty for each switch of language, labels the spans of mixed text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import batch, map_batches, page_lines
from corpusmill.session import spread
from corpusmill.sources.tables import table
from corpusmill.sources.views import single_rows

LANGUAGES = ("ka", "en", "ru", "de")
#: Labelled rows of each language, at most about so many, that the word models are fitted on.
TRAIN_ROWS = 400
SWITCH = 9.0
MIN_LINE_LETTERS = 40
LONGEST_RUN = 100
#: Distinct runs of characters that a task counts, and characters that it reads, before it passes the counts on.
RUNS_MOST, CHARACTERS_MOST = 300_000, 32 << 20
_NEVER = -40.0

# Usual spellings of the language labels, in lower case, without region.
SPELLINGS = {
    "ka": ["ka", "kat", "geo", "georgian", "ქართული", "kartuli", "грузинский", "georgisch"],
    "en": ["en", "eng", "english", "ინგლისური", "английский", "englisch"],
    "ru": ["ru", "rus", "russian", "რუსული", "русский", "russisch"],
    "de": ["de", "deu", "ger", "german", "გერმანული", "немецкий", "deutsch"],
}
NO_LABEL = ["", "und", "unknown"]

# The national romanization of Georgian; ejectives may carry an apostrophe, which is put in a second form.
ROMAN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z", "თ": "t", "ი": "i", "კ": "k", "ლ": "l",
    "მ": "m", "ნ": "n", "ო": "o", "პ": "p", "ჟ": "zh", "რ": "r", "ს": "s", "ტ": "t", "უ": "u", "ფ": "p", "ქ": "k",
    "ღ": "gh", "ყ": "q", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}
EJECTIVES = "კპტყწჭ"

_ROMAN = str.maketrans(ROMAN)
_EJECTIVE = str.maketrans(ROMAN | {c: ROMAN[c] + "'" for c in EJECTIVES})
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’ʼ`][^\W\d_]+)*['’ʼ]?")
_LONG_RUN = re.compile(rf"\S{{{LONGEST_RUN + 1},}}")
_GEORGIAN, _CYRILLIC, _LATIN = re.compile("[Ⴀ-ჿᲐ-Ჿⴀ-⴯]"), re.compile("[Ѐ-ԯ]"), re.compile("[A-Za-zÀ-ɏ]")


def romanize(text: str, ejectives: bool = False) -> str:
    """Georgian in Latin letters."""
    return text.translate(_EJECTIVE if ejectives else _ROMAN)


def label_language(label: Column) -> Column:
    """The language a label names, null where it names none, ``other`` where it names one that is not known."""
    plain = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    code = F.regexp_extract(plain, r"^([^-_\s.@(]*)", 1)
    spelled = F.create_map(*chain.from_iterable((F.lit(s), F.lit(lang)) for lang, known in SPELLINGS.items() for s in known))
    return F.when(plain.isin(NO_LABEL), None).otherwise(F.coalesce(F.try_element_at(spelled, plain), F.try_element_at(spelled, code), F.lit("other")))


class WordModel:
    """Scores of words by language; what it returns is kept per word."""

    def __init__(self, trigrams: dict[str, tuple[float, float, float]], unseen: tuple[float, float, float]):
        self.trigrams, self.unseen, self._memo = trigrams, unseen, {}

    def __getstate__(self) -> tuple:
        return self.trigrams, self.unseen

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def scores(self, word: str) -> tuple[float, float, float, float] | None:
        """Log-likelihoods in the order of LANGUAGES; None for a script of no known language."""
        known = self._memo.get(word, 0)
        if known != 0:
            return known
        if len(self._memo) > 200_000:
            self._memo.clear()
        if _GEORGIAN.search(word):
            result = (0.0, _NEVER, _NEVER, _NEVER)
        elif _CYRILLIC.search(word):
            result = (_NEVER, _NEVER, 0.0, _NEVER)
        elif _LATIN.search(word):
            ka = en = de = 0.0
            padded = f"^{word.lower()}$".replace("’", "'").replace("ʼ", "'")
            for i in range(len(padded) - 2):
                a, b, c = self.trigrams.get(padded[i : i + 3], self.unseen)
                ka, en, de = ka + a, en + b, de + c
            result = (ka, en, _NEVER + min(ka, en, de), de)
        else:
            result = None
        self._memo[word] = result
        return result

    def letters(self, line: str) -> tuple[int, int, int, int]:
        """How many letters of the line are in each of LANGUAGES."""
        if len(line) > LONGEST_RUN:
            line = _LONG_RUN.sub(" ", line)
        scripts = [_GEORGIAN.search(line) is not None, _LATIN.search(line) is not None, _CYRILLIC.search(line) is not None]
        if not scripts[1] and scripts[0] + scripts[2] == 1:
            n = sum(map(len, _LETTERS.findall(line)))
            return (n, 0, 0, 0) if scripts[0] else (0, 0, n, 0)
        scored = [(s, sum(c.isalpha() for c in w)) for w in _TOKEN.findall(line) if (s := self.scores(w))]
        if not scored:
            return (0, 0, 0, 0)
        sums = [sum(s[k] for s, _ in scored) for k in range(4)]
        best = max(range(4), key=sums.__getitem__)
        if sum(max(s) - s[best] for s, _ in scored) <= SWITCH:
            total = [0, 0, 0, 0]
            total[best] = sum(n for _, n in scored)
            return tuple(total)
        now, back = list(scored[0][0]), []
        for s, _ in scored[1:]:
            top = max(range(4), key=now.__getitem__)
            switched = now[top] - SWITCH
            back.append([k if now[k] >= switched else top for k in range(4)])
            now = [max(now[k], switched) + s[k] for k in range(4)]
        state, total = max(range(4), key=now.__getitem__), [0, 0, 0, 0]
        total[state] += scored[-1][1]
        for (_, n), came in zip(reversed(scored[:-1]), reversed(back), strict=True):
            state = came[state]
            total[state] += n
        return tuple(total)

    def spans(self, line: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, posterior) of the stretches of a line in one language, by the most probable path; the
        posterior is the mean over its words of their language's probability given the whole line, by forward and backward
        scores. Words of no known script belong to the stretch around them; long runs without a blank have no language."""
        gone = [(m.start(), m.end()) for m in _LONG_RUN.finditer(line)]
        found = [(m.start(), m.end(), s) for m in _TOKEN.finditer(line) if (s := self.scores(m.group())) and not any(a <= m.start() < b for a, b in gone)]
        if not found:
            return []
        scores = np.array([s for *_, s in found])
        forward, backward, now = np.zeros_like(scores), np.zeros_like(scores), scores[0]
        best, back = scores[0], np.zeros(scores.shape, int)
        forward[0] = now
        for i in range(1, len(scores)):
            forward[i] = np.logaddexp(forward[i - 1], np.logaddexp.reduce(forward[i - 1]) - SWITCH) + scores[i]
            top = int(best.argmax())
            back[i] = np.where(best >= best[top] - SWITCH, np.arange(4), top)
            best = np.maximum(best, best[top] - SWITCH) + scores[i]
        for i in range(len(scores) - 2, -1, -1):
            after = backward[i + 1] + scores[i + 1]
            backward[i] = np.logaddexp(after, np.logaddexp.reduce(after) - SWITCH)
        posterior = np.exp(forward + backward - np.logaddexp.reduce(forward + backward, axis=1, keepdims=True))
        states = [int(best.argmax())]
        for i in range(len(scores) - 1, 0, -1):
            states.append(int(back[i, states[-1]]))
        states.reverse()
        out, first = [], 0
        for i in range(1, len(states) + 1):
            if i == len(states) or states[i] != states[first]:
                out.append((found[first][0], found[i - 1][1], LANGUAGES[states[first]], float(posterior[first:i, states[first]].mean())))
                first = i
        return out

    def main(self, text: str) -> tuple[str | None, float]:
        """The language of most letters and its share of them."""
        total = [sum(n) for n in zip(*map(self.letters, text.split("\n")), strict=True)]
        if not sum(total):
            return None, 0.0
        best = max(range(4), key=total.__getitem__)
        return LANGUAGES[best], total[best] / sum(total)


def word_grams(words: Counter) -> Counter:
    """How often each trigram stands in the words."""
    grams = Counter()
    for word, n in words.items():
        padded = f"^{word.lower()}$"
        for i in range(len(padded) - 2):
            grams[padded[i : i + 3]] += n
    return grams


def word_model(grams: dict[str, Counter]) -> WordModel:
    """The model of counted trigrams of ka, en and de."""
    every = set().union(*grams.values())
    size = {lang: sum(g.values()) + 0.5 * (len(every) + 1) for lang, g in grams.items()}
    logs = {lang: {g: math.log((n + 0.5) / size[lang]) for g, n in own.items()} for lang, own in grams.items()}
    floor = {lang: math.log(0.5 / s) for lang, s in size.items()}
    level = min(floor.values())
    for lang, own in grams.items():
        if not own:  # never seen, so never likely
            logs[lang], floor[lang] = {}, level - 2.0
    table_ = {g: tuple(logs[lang].get(g, floor[lang]) for lang in ("ka", "en", "de")) for g in every}
    return WordModel(table_, tuple(level if grams[lang] else level - 2.0 for lang in ("ka", "en", "de")))


def fit(texts: dict[str, list[str]]) -> WordModel:
    """Trigram models of Latin words: English, German, and Georgian as romanized from Georgian letters.

    A second round drops the lines that the first one finds in another language than their row's label.
    """
    counts = {"ka": Counter(), "en": Counter(), "de": Counter()}
    for text in texts.get("ka", []):
        for word in _LETTERS.findall(text):
            if _GEORGIAN.match(word):
                counts["ka"][romanize(word)] += 1
                counts["ka"][romanize(word, True)] += 1
    lines = {lang: [line for text in texts.get(lang, []) for line in text.split("\n") if _LATIN.search(line) and not _GEORGIAN.search(line)] for lang in ("en", "de")}
    model = None
    for _ in range(2):
        for lang, own in lines.items():
            counts[lang] = Counter()
            for line in own:
                if model is None or model.main(line)[0] in (lang, None):
                    counts[lang].update(w.lower() for w in _TOKEN.findall(_LONG_RUN.sub(" ", line)))
        model = word_model({lang: word_grams(own) for lang, own in counts.items()})
    return model


class _Runs:
    """Distinct runs of non-blank characters with their scores, and how often each stands in lines that a model finds in
    their row's language."""

    def __init__(self, model: WordModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.counts = {"en": np.zeros(0, np.int64), "de": np.zeros(0, np.int64)}

    def add(self, run: str) -> int:
        scored = [s for w in (_TOKEN.findall(run) if len(run) <= LONGEST_RUN else ()) if (s := self.model.scores(w))]
        self.place[run] = len(self.rows)
        self.rows.append((*(sum(s[k] for s in scored) for k in range(4)), sum(map(max, scored)), len(scored)))
        return len(self.rows) - 1

    def count(self, lang: str, texts: list[str]) -> None:
        """Count the runs of lines in Latin letters; most lines' language is plain from the sums of their runs."""
        place, add, lines, ids, sizes = self.place, self.add, [], [], []
        for text in texts:
            foreign = _GEORGIAN.search(text) is not None
            for line in text.split("\n"):
                if _LATIN.search(line) and not (foreign and _GEORGIAN.search(line)):
                    own = [place[w] if w in place else add(w) for w in line.split()]
                    lines.append(line)
                    ids += own
                    sizes.append(len(own))
        if not lines:
            return
        run, line = np.array(ids, np.int64), np.repeat(np.arange(len(lines)), sizes)
        known = np.array(self.rows, float)
        sums = np.stack([np.bincount(line, known[run, k], len(lines)) for k in range(6)], axis=1)
        best = sums[:, :4].argmax(axis=1)
        keep = (sums[:, 5] == 0) | (best == LANGUAGES.index(lang))
        for i in np.flatnonzero((sums[:, 5] > 0) & (sums[:, 4] - sums[:, :4].max(axis=1) > SWITCH)):
            keep[i] = self.model.main(lines[i])[0] in (lang, None)
        more = np.bincount(run[keep[line]], minlength=len(self.rows))
        more[: len(self.counts[lang])] += self.counts[lang]
        self.counts[lang] = more

    def counted(self) -> Iterator[tuple[str, Counter]]:
        runs = list(self.place)
        for lang, n in self.counts.items():
            yield lang, Counter({runs[i]: int(n[i]) for i in np.flatnonzero(n)})


def _words_of_runs(lang: str, runs: Counter) -> Counter:
    """The words that ``fit`` counts in these runs."""
    words = Counter()
    for run, n in runs.items():
        if lang == "ka":
            for word in _LETTERS.findall(run):
                if _GEORGIAN.match(word):
                    words[romanize(word)] += n
                    words[romanize(word, True)] += n
        elif len(run) <= LONGEST_RUN:
            for word in _TOKEN.findall(run):
                words[word.lower()] += n
    return words


def count_items(rows: DataFrame, model: WordModel | None = None, extra: Callable[[str, Counter], Counter] | None = None) -> DataFrame:
    """(lang, kind, item, n) of all labelled ``rows`` (label, text): trigrams (kind 0) of words as ``fit`` counts them in a
    round, the first or, with ``model``, the second, which German and English rows alone have; and what ``extra`` makes of
    the counts of all runs of non-blank characters of a language (kind 1). Texts stay where they are."""
    labelled = rows.select(label_language(F.col("label")).alias("lang"), "text").where("text is not null").where("lang in ('ka', 'en', 'de')" if model is None else "lang in ('en', 'de')")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table_ = _Runs(model) if model else None
        used, left, size = {}, {}, 0
        columns: list[list] = [[], [], [], []]

        def put(lang: str, kind: int, items: Counter) -> None:
            for column, values in zip(columns, ([lang] * len(items), [kind] * len(items), items.keys(), items.values()), strict=True):
                column.extend(values)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, runs in used.items() if table_ is None else table_.counted():
                put(lang, 0, word_grams(_words_of_runs(lang, runs)))
            for lang in used if extra else ():
                put(lang, 1, extra(lang, used[lang] + left[lang]))
            for a in range(0, len(columns[0]), 20_000):
                yield batch([("lang", pa.string()), ("kind", pa.int32()), ("item", pa.string()), ("n", pa.int64())], [c[a : a + 20_000] for c in columns])
            used.clear()
            left.clear()
            for column in columns:
                column.clear()
            if table_ is not None:
                table_.clear()

        for rows in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                by_lang.setdefault(lang, []).append(text)
                size += len(text)
            for lang, texts in by_lang.items():
                if table_ is not None:
                    table_.count(lang, texts)
                    continue
                own, rest = used.setdefault(lang, Counter()), left.setdefault(lang, Counter())
                for text in texts:
                    if lang == "ka" or text.isascii():  # an ASCII line without Latin letters has no words
                        own.update(text.split())
                    else:
                        for line in text.split("\n"):
                            (own if _LATIN.search(line) and not _GEORGIAN.search(line) else rest).update(line.split())
            if size > CHARACTERS_MOST or sum(map(len, (*used.values(), *left.values()))) + (len(table_.rows) if table_ else 0) > RUNS_MOST:
                yield from flush()
                size = 0
        yield from flush()

    return map_batches(labelled, run, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def grams_of(counted: DataFrame) -> dict[str, Counter]:
    """The trigrams of ``count_items`` by language: as many as the letters of the corpus make."""
    grams = {"ka": Counter(), "en": Counter(), "de": Counter()}
    for rows in counted.where("kind = 0").select("lang", "item", "n").toArrow().to_batches():
        for lang, item, n in zip(*(column.to_pylist() for column in rows.columns), strict=True):
            grams[lang][item] = n
    return grams


def fit_all(rows: DataFrame, first: DataFrame | None = None) -> WordModel:
    """What ``fit`` makes of all labelled ``rows`` (label, text); ``first``: the counts of the first round, if they are there."""
    grams = grams_of(count_items(rows) if first is None else first)
    model = word_model(grams)
    return word_model({"ka": grams["ka"]} | {lang: own for lang, own in grams_of(count_items(rows, model)).items() if lang != "ka"})


def training_texts(rows: DataFrame, rows_each: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Texts of ``rows`` (id, label, text) by language: of each about ``rows_each`` labelled rows, the same at every run."""
    labelled = rows.select("id", label_language(F.col("label")).alias("lang"), "text").where("lang in ('ka', 'en', 'de') and text is not null")
    counts = dict(labelled.groupBy("lang").count().collect())
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < (rows_each << 40) // max(n, 1) + 1))
    texts: dict[str, list[str]] = {}
    for row in labelled.where(chosen).orderBy("id").toLocalIterator():
        texts.setdefault(row.lang, []).append(row.text)
    return texts


def train(rows: DataFrame, rows_each: int = TRAIN_ROWS) -> WordModel:
    """A model fitted on ``training_texts``."""
    return fit(training_texts(rows, rows_each))


def page_languages(pages: DataFrame, model: WordModel) -> DataFrame:
    """(document_id, label, language, confidence, lines) of ``pages`` (id, label, content_text, title).

    language is that of most letters of content_text, or of the title where content_text is null or blank; confidence
    its share of the letters; both are null where there are no letters. ``lines`` has (line_no, lang, confidence) of each
    line of at least MIN_LINE_LETTERS letters whose main language is another. Rows are handled one by one; nothing is
    shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    line = pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    schema = [("document_id", pa.int64()), ("label", pa.string()), ("language", pa.string()), ("confidence", pa.float64()), ("lines", pa.list_(line))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        memo: dict[str, tuple] = {}
        for rows in batches:
            columns: list[list] = [[] for _ in schema]
            for page, label, text, title in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                whole = bool(text) and not text.isspace()
                counted = []
                for own in page_lines(text) if whole else [title or ""]:
                    letters = memo.get(own)
                    if letters is None:
                        letters = known.letters(own)
                        if len(own) < 200:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[own] = letters
                    counted.append(letters)
                total = [sum(n) for n in zip(*counted, strict=True)]
                best, every = max(range(4), key=total.__getitem__), sum(total)
                other = []
                if whole:
                    for number, letters in enumerate(counted):
                        n = sum(letters)
                        if n >= MIN_LINE_LETTERS and letters[best] * 2 <= n:
                            main = max(range(4), key=letters.__getitem__)
                            if main != best:
                                other.append({"line_no": number, "lang": LANGUAGES[main], "confidence": letters[main] / n})
                for column, value in zip(columns, (page, label, LANGUAGES[best] if every else None, total[best] / every if every else None, other), strict=True):
                    column.append(value)
            yield batch(schema, columns)

    return map_batches(pages.select("id", "label", "content_text", "title"), run, "document_id long, label string, language string, confidence double, lines array<struct<line_no: int, lang: string, confidence: double>>")


def language_spans(pages: DataFrame, model: WordModel) -> DataFrame:
    """(document_id, line_no, start, end, lang, posterior) of ``pages`` (id, content_text, title): the stretches of each line
    of content_text that is not wholly in its page's language. Places are code points of the line. Null and blank texts
    have none. Rows are handled one by one; nothing is shuffled."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = [("document_id", pa.int64()), ("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("posterior", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            columns: list[list] = [[] for _ in schema]
            for page, text in zip(*(column.to_pylist() for column in rows.columns), strict=True):
                if not text or text.isspace():
                    continue
                lines = page_lines(text)
                counted = [known.letters(line) for line in lines]
                total = [sum(n) for n in zip(*counted, strict=True)]
                main = max(range(4), key=total.__getitem__)
                for number, (line, letters) in enumerate(zip(lines, counted, strict=True)):
                    if sum(letters) > letters[main]:
                        for span in known.spans(line):
                            for column, value in zip(columns, (page, number, *span), strict=True):
                                column.append(value)
            yield batch(schema, columns)

    return map_batches(pages.select("id", "content_text"), run, "document_id long, line_no int, start int, end int, lang string, posterior double")


def _languages(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "ingestion_document", "id", F.col("language").alias("label"), "content_text", "title").where("id is not null")
    return page_languages(spread(pages), train(pages.select("id", "label", F.col("content_text").alias("text"))))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, line_no, lang): pages whose label is missing or wrong (line_no -1) and lines in another language."""
    pages = _languages(spark, root)
    wrong = F.when(~label_language(F.col("label")).eqNullSafe(F.col("language")), F.array(F.struct(F.lit(-1).alias("line_no"), F.col("language").alias("lang"))))
    lines = F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), x["lang"].alias("lang")))
    cases = F.concat(F.coalesce(wrong, F.array().cast("array<struct<line_no: int, lang: string>>")), lines)
    return pages.where("language is not null").select("document_id", F.explode(cases).alias("case")).select("document_id", "case.line_no", "case.lang").distinct()


def p3_pages(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, language, confidence): the language of each page."""
    return _languages(spark, root).select("document_id", "language", F.round("confidence", 6).alias("confidence")).distinct()


def p3_lines(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, line_no, lang, confidence): each line whose main language is not its page's."""
    lines = _languages(spark, root).select("document_id", F.explode("lines").alias("line"))
    return lines.select("document_id", "line.line_no", "line.lang", F.round("line.confidence", 6).alias("confidence")).distinct()


def p3_spans(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, line_no, start, end, lang, posterior): the segments of lines that are not in their page's language
    alone, each with its language and how sure that is."""
    model = train(table(spark, root, "ingestion_document", "id", F.col("language").alias("label"), F.col("content_text").alias("text")).where("id is not null"))
    pages = single_rows(spark, root, "ingestion_document", "id", "content_text").where("id is not null")
    return language_spans(pages, model).withColumn("posterior", F.round("posterior", 6))


QUERIES = {"p3_found": p3_found, "p3_pages": p3_pages, "p3_lines": p3_lines, "p3_spans": p3_spans}
SQL: dict[str, str] = {}
