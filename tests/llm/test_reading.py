import random

from collections import Counter

import numpy as np

from corpusmill.llm.boosting import Trees, best_cuts
from corpusmill.llm.language import fit
from corpusmill.llm.reading import FREQUENT, coded_rows, fit_levels, labelled, p10_found, p10_per_source, text_words, vocabulary
from tests.conftest import rows

EASY = ["We asked many people.", "The crop was bad.", "Milk cost more.", "Old people got help.", "It was cold.", "This is good news."]
HARD = [
    "The methodological harmonisation of institutional subsectors presupposes the comparability of regional microdata, insofar as confidentiality constraints preclude granular dissemination.",
    "An econometrically consistent reconciliation of intermediate consumption estimates substantially attenuates the heterogeneity observed across peripheral jurisdictions.",
]
KA = ["რძე გაძვირდა.", "მოსავალი ცუდი იყო.", "ბევრ ადამიანს ვკითხეთ.", "ახალი გზა გაკეთდა."]


def text(level, seed):
    random.seed(seed)
    return " ".join(random.choice(HARD if random.random() < (level - 1) / 4 else EASY) for _ in range(24))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    y = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0.5), 2.0, -1.0) + 0.3 * x[:, 2]
    model = Trees().fit(x[:600], y[:600])
    assert np.mean((model.predict(x[600:]) - y[600:]) ** 2) < 0.2 * y.var()
    assert np.allclose(Trees().fit(np.zeros((20, 2)), np.ones(20)).predict(np.zeros((3, 2))), 1.0)


def test_cuts():
    predicted = np.array([1.1, 1.2, 2.4, 2.5, 3.3, 4.1, 4.9])
    cuts = best_cuts(predicted, np.array([1, 1, 2, 2, 3, 4, 5]))
    assert (np.searchsorted(cuts, predicted) + 1).tolist() == [1, 1, 2, 2, 3, 4, 5]


def test_words():
    assert text_words("a 12 3b — c, 'd'") == ["a", "3b", "c,", "'d'"]


def test_held_out_levels_and_odd_rows(spark, tables):
    level = {i: 1 + i % 5 for i in range(300)}
    documents = [{"doc_id": i, "text": text(n, i), "lang": "en" if i % 9 else None, "source": f"s{i % 12}"} for i, n in level.items()]
    documents += [{"doc_id": 1000 + i, "text": " ".join(random.choices(KA, k=30)), "lang": "ka", "source": None} for i in range(5)]
    documents += [{"doc_id": 2000, "text": None}, {"doc_id": 2001, "text": ""}, {"doc_id": 2002, "text": "too short"}, {"doc_id": 2003, "text": "Опрос проводился в регионе три недели. " * 20}, {"doc_id": 2004, "text": "1 2 3 " * 100}, {"doc_id": 2005, "text": "milk " * 60000}]
    labels = [{"doc_id": i, "reading_level": level[i]} for i in range(0, 200)] + [{"doc_id": 0, "reading_level": 1}, {"doc_id": None, "reading_level": 2}, {"doc_id": 5, "reading_level": None}]
    root = tables(documents=documents, reading_label=labels)
    got = dict(rows(p10_found(spark, root)))
    assert set(got) == set(level) | set(range(1000, 1005)) | {2005}
    held = [i for i in level if i >= 200]
    assert np.mean([got[i] == level[i] for i in held]) > 0.55 and np.mean([abs(got[i] - level[i]) <= 1 for i in held]) > 0.95
    assert sum(r.n_documents for r in p10_per_source(spark, root).collect()) == len(got)


def test_empty(spark, tables):
    assert rows(p10_found(spark, tables())) == []


def test_words_are_counted_over_all_rows(spark):
    """More rows than any sample had; lines in the other language, long runs and Georgian between them are told apart."""
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abdeghilmnorstu") for _ in range(n))
    texts = {
        "en": [f"The crop of {made(5)} was bad, wasn't it?\nDie Ernte war schlecht und das Wetter auch nicht gut, {made(4)}.\n“It cost” {made(6)} წელი\n{'x' * 101} 12" for _ in range(1500)],
        "de": [f"Die Ernte in {made(5)} war schlecht und das Wetter auch.\nThe crop was bad and the weather was not good." for _ in range(700)],
        "ka": [f"{rng.choice(KA)} {made(3)} {rng.choice(KA)}" for _ in range(700)],
    }
    rows_ = [(text_, lang) for lang, own in texts.items() for text_ in own] + [(None, "en"), ("", "ka"), ("Слово", "ru"), ("what", None)]
    words, ranks = vocabulary(spark.createDataFrame(rows_, "text string, lang string").repartition(7))
    plain = fit(texts)
    assert words.unseen == plain.unseen and words.trigrams == plain.trigrams
    for lang in ("en", "ka"):
        counts = Counter(w.strip("12.,?“”").lower() for t in texts[lang] for w in text_words(t))
        assert list(ranks[lang]) == sorted(counts, key=lambda w: (-counts[w], w))[: FREQUENT[-1]]


def test_all_labelled_rows_are_fitted_and_both_ways_give_the_same_trees(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9000, 4)).astype(np.float32)
    x[:, 3] = rng.integers(0, 3, 9000)
    level = np.clip(np.rint(3 + x[:, 0] + (x[:, 1] > 0.3)), 1, 5).astype(int)
    level[::40] = 1 + rng.integers(0, 5, 225)
    given = spark.createDataFrame([(r.tobytes(), int(n), i % 3) for i, (r, n) in enumerate(zip(x, level, strict=True))], "x binary, level int, fold int").repartition(5)
    (edges, rows_), (same, jobs) = coded_rows(given, n_trees=3, depth=3), coded_rows(given, most=0, n_trees=3, depth=3)
    assert rows_.arrays is not None and jobs.arrays is None and all(np.array_equal(a, b) for a, b in zip(edges, same, strict=True))
    for f in (0, 1):
        assert np.array_equal(edges[f], np.sort(x[:, f])[np.ceil(np.arange(1, 20) / 20 * 9000).astype(int) - 1])
    models = [fit_levels(r) for r in (rows_, jobs)]
    assert np.array_equal(models[0].cuts, models[1].cuts) and models[0].out_of_fold == models[1].out_of_fold
    for a, b in zip(models[0].trees.nodes, models[1].trees.nodes, strict=True):
        assert all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))
    assert rows_.graded(rows_.forests([0, 1, 2]))[0].sum() == 9000


def test_labels_meet_their_rows_both_ways(spark):
    described = spark.createDataFrame([(i, f"s{i % 4}", bytes([i] * 4)) for i in range(50)] + [(7, None, b"dddd")], "doc_id long, source string, x binary")
    labels = spark.createDataFrame([(i, 1 + i % 5) for i in range(0, 40)] + [(3, 2), (4, 9), (None, 1)], "doc_id long, reading_level int")
    got = [rows(labelled(described, labels, most)) for most in (100, 0)]
    assert got[0] == got[1] and len(got[0]) == 41 and {r[1] for r in got[0] if r[0] == bytes([3] * 4)} == {3}
