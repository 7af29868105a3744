import random

import numpy as np

from corpusmill.llm.truncation import UNITS, EndModel, context_counts, fit, limits, p6_found, p6_per_site, plain, text_keys, unit_ends
from tests.conftest import rows

SUBJECTS = ["The price of milk", "The number of births", "The average wage", "The export of goods"]
VERBS = ["rose by 4.2 percent in the region", "was corrected after late reports", "has been published since 2015", "fell again because the harvest was small"]


def sentence(random):
    return f"{random.choice(SUBJECTS)} {random.choice(VERBS)}."


def text(random, n=4):
    return " ".join(sentence(random) for _ in range(n))


def test_ends_of_units():
    points = np.array(list(map(ord, "It rose. By 4.2 now\nNo stop")), np.uint64)
    assert np.flatnonzero(unit_ends(points)).tolist() == [7, 8, 19, 27]


def test_held_out_accuracy():
    random.seed(2)
    model = EndModel(*fit([text(random) for _ in range(400)]))
    right = 0
    for _ in range(300):
        whole = text(random)
        cut = whole[: random.randrange(20, len(whole) - 1)]
        if cut.rstrip().endswith(".") or whole[len(cut)] == ".":
            cut = cut.rstrip(".") [:-3]
        right += model.log_odds(plain(whole).rstrip("."), 0) > -1
        right += model.log_odds(plain(cut).rstrip(), 0) < -1
    assert right > 0.95 * 600


def test_a_full_stop_alone_closes_nothing(spark, tables):
    random.seed(5)
    names = ["Smith", "Brown", "Jones", "Green", "Baker", "Clark"]
    pages = [{"id": i, "corpus_id": 1, "language": "en", "content_text": text(random, 4) + f" The report was given by Dr. {random.choice(names)} in the region.\n" + text(random, 2), "summary_en": text(random)} for i in range(400)]
    pages += [{"id": 1000 + i, "corpus_id": 1, "summary_en": text(random) + " The report was given by Dr."} for i in range(3)]
    pages += [{"id": 2000 + i, "corpus_id": 1, "summary_en": text(random)[:-9]} for i in range(20)]
    got = {r.item_id for r in p6_found(spark, tables(ingestion_document=pages)).collect()}
    assert {1000, 1001, 1002} <= got and len([i for i in got if i < 1000]) < 4


def test_queries(spark, tables):
    random.seed(3)
    pages, chunks, cut = [], [], set()
    for i in range(300):
        summary = text(random)
        if i % 5 == 0:
            short = summary[:60].rstrip(" .")
            summary = short[:-4] if summary[len(short)] == "." else short
            cut.add(("ingestion_document", "summary_en", i))
        if i % 7 == 1:
            summary = "Export of goods"[: 6 + i % 3] + "�"
            cut.add(("ingestion_document", "summary_en", i))
        pages.append({"id": i, "corpus_id": i % 3, "content_text": text(random, 6) + "\nA heading", "summary_en": summary, "summary_ka": [None, "", "  "][i % 3]})
        one, two = sentence(random), sentence(random)
        halves = one.split(" ", 4)
        chunks += [{"id": 2 * i, "document_id": i, "corpus_id": i % 3, "sequence_no": 0, "text": two + " " + " ".join(halves[:4])}, {"id": 2 * i + 1, "document_id": i, "corpus_id": i % 3, "sequence_no": 1, "text": halves[4] + " " + two}]
    chunks += [{"id": 9000 + i, "document_id": 5000 + i, "corpus_id": 1, "sequence_no": 0, "text": text(random) + " The average wage has been"} for i in range(20)]
    chunks += [{"id": 9500, "document_id": None, "sequence_no": None, "text": None}]
    root = tables(ingestion_document=pages + pages[:20], ingestion_chunk=chunks + chunks[:20])
    got = rows(p6_found(spark, root))
    assert len(got) == len(set(got))
    summaries = {g for g in got if g[1] == "summary_en"}
    assert len(summaries & cut) > 0.95 * max(len(summaries), len(cut))
    own = {g[2] for g in got if g[1] == "text"}
    assert set(range(9000, 9020)) <= own and len(own) < 30
    assert sum(r.n_cut for r in p6_per_site(spark, root).collect()) == len(got)


def test_empty(spark, tables):
    assert rows(p6_found(spark, tables())) == []


def test_contexts_are_counted_over_all_values(spark):
    random.seed(4)
    values = [text(random, 1) for _ in range(6000)] + ["A rare ending xq", "xq xq.", None, "two\nlines xq"]
    texts = ["rare ending xq", "lk fell again", "\nThe", "zzz", "q"]
    asked = spark.createDataFrame([(kind, t[::-1] if kind else t) for t in texts for kind in (0, 1)], "kind int, text string")
    got = {r.key: (r.ends, r.n) for r in context_counts(spark.createDataFrame([(v,) for v in values], "text string").repartition(3), asked, block=4).collect()}
    for t in texts:
        keys = text_keys(0, t)
        for k, key in zip((1, 2, 3, 4, 5, 6, 8, 10, 13), keys, strict=False):
            n = ends = 0
            for value in filter(None, values):
                points = np.array(list(map(ord, value)), np.uint64)
                own, at = unit_ends(points), [i for i in range(len(value) + 1) if ("\n" + value)[: i + 1].endswith(t[-k:])]
                n, ends = n + len(at), ends + int(sum(own[i] for i in at))
            assert got.get(key, (0, 0)) == (UNITS * ends, UNITS * n)
    assert got[text_keys(0, "rare ending xq")[-1]] == (UNITS, UNITS)


def test_limits_of_any_length(spark):
    sizes = [16_384] * 30 + [65_535] * 30 + list(range(100, 400))
    assert limits(spark.createDataFrame([("text", s) for s in sizes], "field string, size int")) == {"text": [16_384, 65_535]}
