import random

import pytest

from corpusmill.llm import alignment
from corpusmill.llm.alignment import belong_together, decode, lexicon_of, p4_found, p4_pairs, sentences, tokens, train
from tests.conftest import rows

WORDS = {"milk": "რძე", "price": "ფასი", "rose": "გაიზარდა", "fell": "შემცირდა", "region": "რეგიონი", "births": "დაბადება", "wheat": "ხორბალი", "survey": "კვლევა", "wage": "ხელფასი", "exports": "ექსპორტი", "report": "ანგარიში", "women": "ქალები", "tourism": "ტურიზმი", "school": "სკოლა", "water": "წყალი", "office": "ოფისი"}


def pair(seed):
    """Two texts of the same sentences: one left out on each side, two joined, two changed places."""
    random.seed(seed)
    made = []
    for _ in range(8):
        own = random.sample(sorted(WORDS), 4)
        made.append((" ".join(WORDS[w] for w in own) + f" {random.randint(100, 99999)}", " ".join(own)))
    made = [(ka, en + " " + ka.rsplit(" ", 1)[1]) for ka, en in made]
    ka = [made[i][0] for i in (0, 1, 2, 3, 4, 5, 6)]
    en = [made[0][1], made[1][1] + ", and " + made[2][1], made[4][1], made[3][1], made[5][1], made[7][1]]
    links = {(0, 0), (1, 1), (2, 1), (4, 2), (3, 3), (5, 4)}
    return ". ".join(ka) + ".", ". ".join(en) + ".", links


def test_sentences():
    assert sentences("A title\n\nOne. Two!  Three? 3.5 four\r\n ") == ["A title", "One.", "Two!", "Three?", "3.5 four"]
    assert sentences("") == sentences(" \n") == []


def test_tokens_of_numbers_and_names():
    assert tokens("12 365 და 43,2 ლელვანი") == ["12365#", "da", "43.2#", "lelvani"]
    assert tokens("12,365 and 43.2 Lelvani")[0] == "12365#"


def split(text):
    return [tokens(s) for s in sentences(text)]


@pytest.fixture(scope="module")
def lexicon(spark):
    made = [(n, *([" ".join(own) for own in split(text)] for text in pair(n)[:2])) for n in range(120)]
    return lexicon_of(map(tuple, train(spark.createDataFrame(made, "pair_id long, ka array<string>, en array<string>")).collect()))


def test_held_out_pairs(lexicon):
    right = found = wanted = 0
    for ka, en, links in map(pair, range(500, 560)):
        got = {(i, j) for i, j, *_ in decode(split(ka), split(en), lexicon)}
        right, found, wanted = right + len(got & links), found + len(got), wanted + len(links)
    assert right / found > 0.93 and right / wanted > 0.93
    assert decode([], [["a"]], lexicon) == decode([["a"]], [], lexicon) == []
    assert len(decode([["milk"]], [["milk"]], lexicon)) <= 1


def test_long_texts_with_a_sentence_moved_far(lexicon, monkeypatch):
    made = [pair(s) for s in range(330)]
    source = [s for ka, _, _ in made for s in split(ka)]
    target = [s for _, en, _ in made for s in split(en)]
    wanted = {(n * 7 + i, n * 6 + j) for n, (_, _, links) in enumerate(made) for i, j in links}
    moved = next(j for i, j in sorted(wanted) if j > 1000 and len([1 for x, y in wanted if y == j]) == 1 and i > 900)
    from_ = next(i for i, j in wanted if j == moved)
    target.insert(moved - 900, target.pop(moved))
    place = lambda j: moved - 900 if j == moved else j + 1 if moved - 900 <= j < moved else j
    wanted = {(i, place(j)) for i, j in wanted}
    links = decode(source, target, lexicon)
    got = {(i, j) for i, j, *_ in links}
    assert len(got & wanted) > 0.9 * max(len(got), len(wanted))
    assert (from_, moved - 900) in got
    monkeypatch.setattr(alignment, "_STATES", 1)  # a stretch for each target sentence
    assert decode(source[:300], target[:200], lexicon) == (monkeypatch.undo() or decode(source[:300], target[:200], lexicon))


def test_few_translated_sentences_still_belong_together(lexicon):
    for share in (0.2, 0.3):
        kept = right = wanted = 0
        for seed in range(12):
            random.seed(1000 + seed)
            own = random.sample(sorted(WORDS), 16)
            made = [(" ".join(WORDS[w] for w in ws) + f" {n}", " ".join(ws) + f" {n}") for ws, n in ((random.sample(own, 4), random.randint(100, 99999)) for _ in range(30))]
            other = [" ".join(random.sample(own, 4)) + f" {random.randint(100000, 999999)}" for _ in made]
            same = {k for k in range(30) if random.random() < share}
            links = decode([tokens(ka) for ka, _ in made], [tokens(en if k in same else other[k]) for k, (_, en) in enumerate(made)], lexicon)
            kept += belong_together(links)
            right += len({(i, j) for i, j, *_ in links if i == j and i in same})
            wanted += len(same)
        assert kept == 12 and right > 0.85 * wanted
    assert not belong_together([]) and not belong_together([(5, 1, 15.0, 0.6)]) and not belong_together([(10, 4, 21.1, 0.92), (2, 9, 20.1, 0.5), (1, 12, 13.6, 0.85)])


def test_queries(spark, tables, monkeypatch):
    made = [pair(s) for s in range(60)]
    documents = [{"id": 2 * n + side, "content_text": text} for n, (ka, en, _) in enumerate(made) for side, text in enumerate((ka, en))]
    pairs = [{"id": n, "ka_document_id": 2 * n, "en_document_id": 2 * n + 1} for n in range(50)]
    pairs += [{"id": 90, "ka_document_id": 0, "en_document_id": 999}, {"id": 91, "ka_document_id": 0, "en_document_id": None}, {"id": 92, "ka_document_id": 0, "en_document_id": 41}, {"id": 93, "ka_document_id": 800, "en_document_id": 1}]
    root = tables(ingestion_document=documents + documents[:4] + [{"id": 800, "content_text": None}], document_locale_pair=pairs + pairs[:3])
    got = set(rows(p4_found(spark, root)))
    expected = {(n, i, j) for n, (_, _, links) in enumerate(made[:50]) for i, j in links}
    assert len(got & expected) > 0.9 * max(len(got), len(expected))
    assert {p for p, _, _ in got} <= set(range(50))
    counts = {r.pair_id: r.n_links for r in p4_pairs(spark, root).collect()}
    assert counts[92] == counts[90] == 0 and len(counts) == len(pairs)
    monkeypatch.setattr(alignment, "LEXICON_MOST", 0)
    monkeypatch.setattr(alignment, "PAGES_MOST", 0)
    assert set(rows(p4_found(spark, root))) == got
    assert rows(p4_found(spark, tables())) == []
