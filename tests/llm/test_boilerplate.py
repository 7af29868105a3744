import random

from corpusmill.llm import boilerplate
from corpusmill.llm.boilerplate import CLAUSES, DATED, FRAMED, HEADLINE, MARKED, ROW, SENTENCE, describe, furniture, p1_article, p1_found, p1_template, skeleton
from tests.conftest import rows

MENU = ["Census", "Trade", "Contacts", "Maps"]
FOOTER = ["Terms of use | Privacy", "© 2020 Office of Lelvani. All rights reserved"]


def page(i):
    """A page with a frame, but for every third one; articles have bulleted phrases and lines that the site sets in."""
    random.seed(i)
    framed = i % 3 > 0
    sentences = [f"{a} {b} {random.randint(100, 9999)} in {c}." for a, b, c in zip(random.sample(["Milk", "Wheat", "Wine", "Tea"], 3), random.sample(["rose to", "fell to", "reached about"], 3), random.sample(["Lelvani", "Gomarti", "Ivreti", "Khorbi"], 3))]
    title = f"{random.choice(['Milk', 'Wheat', 'Trade volume'])} in {random.choice(['Lelvani', 'Gomarti'])}, {2010 + i % 12}"
    lines, own = [], []

    def put(line, furniture):
        if furniture:
            own.append(len(lines))
        lines.append(line)

    if framed:
        for line in MENU:
            put(line, True)
        put(f"Home » Wine in Ivreti, {2010 + i % 9}", True)
        put("", False)
    put(title, False)
    put("Prepared by the Trade Division", False)
    put(sentences[0], False)
    put("Wheat in Khorbi | 12.5 | 13.1", False)
    put("- " + sentences[1], False)
    put("* Clothing and shoes", False)
    if framed and i % 2:
        put("See also", True)
        put(f"• Tea in Khorbi, {2010 + i % 7}", True)
        put(f"» Wine in Gomarti, {2010 + i % 5}", True)
        put(f"Milk in Gomarti, {2009 + i % 8}", True)
        put(f"{1 + i % 28}.05 — Tea in Ivreti, {2011 + i % 5}", True)
    put(sentences[2], False)
    put("Share this page with colleagues", False)
    for line in FOOTER if framed else ():
        put(line.upper() if i % 5 == 0 else line, True)
    return title, "\n".join(lines), own


def test_lines():
    assert skeleton("  SHARE   this — 2024! ") == "share this — #"
    assert describe("")[0] & boilerplate.BLANK
    assert describe("Milk in Lelvani | 12.5 | 3")[0] & ROW
    assert describe("• Tea in Khorbi, 2014")[0] & (MARKED | HEADLINE | DATED) == MARKED | HEADLINE
    assert describe("17.08 — Tea in Khorbi, 2014")[0] & DATED
    assert not describe("- Milk rose to 12 in Lelvani again.")[0] & HEADLINE
    assert describe("Milk rose to 12 in Lelvani again. 🌾")[0] & SENTENCE
    assert describe("Website designed by Studio Lelvani")[0] & FRAMED
    assert describe("We use cookies. " * 40)[0] & CLAUSES and len(describe("We use cookies. " * 40)[1]) > 40


def test_without_a_template_all_stays():
    lines = [dict(zip(("flags", "tokens"), describe(line))) for line in ("• Milk and bread products", "- Tobacco", "* Clothing and shoes", "Inflation by region", "Table of results")]
    assert furniture(lines, [[0] * len(line["tokens"]) for line in lines]) == []


def test_queries_and_the_way_without_a_broadcast(spark, tables, monkeypatch):
    made = {i: page(i) for i in range(180)}
    documents = [{"id": i, "canonical_url": f"https://h{i % 2}.example/p/{i}", "title": t, "content_text": c, "lead_text": "Census\nMilk rose." if i == 3 else None} for i, (t, c, _) in made.items()]
    documents += documents[:6] + [{"id": 1000, "canonical_url": None, "content_text": None}, {"id": 1001, "canonical_url": "https://h0.example/x", "content_text": " \n", "lead_text": ""}, {"id": 1002, "canonical_url": "https://h0.example/y", "content_text": "word " * 50000}, {"id": None, "content_text": "Census"}]
    root = tables(ingestion_document=documents)
    expected = sorted([(i, "content_text", n) for i, (_, _, own) in made.items() for n in own] + [(3, "lead_text", 0)])
    assert rows(p1_found(spark, root)) == expected
    assert {r.nested for r in p1_template(spark, root).collect()} <= {"frame", "article"}
    article = {r.document_id: r.content_text for r in p1_article(spark, root).collect()}
    assert article[1000] is None and article[1001] == " \n"
    assert all("Census" not in article[i] and "Prepared by" in article[i] and "* Clothing" in article[i] for i in made)
    monkeypatch.setattr(boilerplate, "BROADCAST_MOST", -1)
    assert rows(p1_found(spark, root)) == expected


def test_empty(spark, tables):
    assert rows(p1_found(spark, tables())) == []
