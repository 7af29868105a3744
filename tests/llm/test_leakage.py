import random

from corpusmill.llm.common import words
from corpusmill.llm.leakage import EVERY, KEPT, SPAN, longest_span, p9_found, p9_items
from tests.conftest import rows


def spans(item, doc):
    """The longest span over all alignments, by dynamic programming over all pairs of places."""
    from functools import cache

    free = EVERY - 1

    @cache
    def on(i, p, since):
        best = 0
        if i < len(item) and p < len(doc) and item[i] == doc[p]:
            best = 1 + on(i + 1, p + 1, min(free, since + 1))
        if since == free:
            for di, dp in ((1, 1), (1, 0), (0, 1)):
                j, q = i + di, p + dp
                if j < len(item) and q < len(doc) and item[j] == doc[q]:
                    best = max(best, di + 1 + on(j + 1, q + 1, 1))
        return best

    return max((on(i, p, free) for i in range(len(item)) for p in range(len(doc)) if item[i] == doc[p]), default=0)


def edited(passage, random, apart):
    out, since = [], apart
    for w in passage:
        if since >= apart and random.random() < 0.3:
            since = 0
            out += random.choice([["zzz"], [], [w, "yyy"]])
        else:
            since += 1
            out.append(w)
    return out


def test_bound_of_the_prefix_filter():
    assert KEPT == 4


def test_longest_span_against_brute_force():
    random.seed(4)
    alphabet = [f"w{i}" for i in range(40)]
    for n in range(150):
        item = [random.choice(alphabet) for _ in range(30)]
        doc = edited(item, random, 7 if n % 2 else 4)
        seen = max(longest_span(item, doc, i, p) for i in range(30) for p in range(len(doc)) if item[i] == doc[p])
        assert seen == spans(item, doc)


def test_found_against_brute_force(spark, tables):
    random.seed(8)
    alphabet = [f"word{i}" for i in range(60)]
    items = [{"item_id": k, "passage": " ".join(random.choices(alphabet, k=45)) + "."} for k in range(12)]
    items += [{"item_id": 90, "passage": None}, {"item_id": 91, "passage": "too short"}, {"item_id": 92, "passage": items[0]["passage"]}]
    documents = []
    for n in range(160):
        own = items[n % 12]["passage"].split()
        size = random.choice([10, 16, 18, 19, 25, 40])
        at = random.randrange(0, 45 - size + 1)
        quote = edited(own[at : at + size], random, random.choice([7, 7, 3]))
        text = " ".join(random.choices(alphabet, k=30) + quote + random.choices(alphabet, k=30))
        documents.append({"doc_id": n, "text": text.upper().replace(" ", random.choice([" ", "\n", ", ", " ​"]))})
    documents += [{"doc_id": 500, "text": None}, {"doc_id": 501, "text": ""}, {"doc_id": 502, "text": items[0]["passage"]}]
    root = tables(documents=documents, eval_item=items)
    expected = {(d["doc_id"], i["item_id"]) for d in documents for i in items if d["text"] and i["passage"] and spans(words(i["passage"]), words(d["text"])) >= SPAN}
    got = rows(p9_found(spark, root))
    assert set(got) == expected and len(got) == len(expected) > 40
    assert {r.item_id for r in p9_items(spark, root).collect()} == {i for _, i in expected}


def test_empty(spark, tables):
    assert rows(p9_found(spark, tables())) == []
    assert rows(p9_found(spark, tables(documents=[{"doc_id": 1, "text": "a b c"}]))) == []


def test_a_document_with_all_items_and_a_very_long_passage(spark, tables):
    random.seed(9)
    alphabet = [f"word{i}" for i in range(3000)]
    items = [{"item_id": k, "passage": " ".join(random.choices(alphabet, k=30))} for k in range(5000)]
    long = random.choices(alphabet, k=20_000)
    often = [w if n % 8 else "zzz" for n, w in enumerate(long)]  # an edit in any 8 words
    closer = [w if n % 6 else "zzz" for n, w in enumerate(long)]
    items.append({"item_id": 9000, "passage": " ".join(long)})
    documents = [{"doc_id": 1, "text": "\n".join(i["passage"] for i in items[:5000])}, {"doc_id": 2, "text": " ".join(often)}, {"doc_id": 3, "text": " ".join(closer)}]
    got = rows(p9_found(spark, tables(documents=documents, eval_item=items)))
    assert got == [(1, k) for k in range(5000)] + [(2, 9000)]
