import random

import numpy as np

from corpusmill.llm.common import letters_key, page_lines
from corpusmill.llm.repeated_lines import p7_clean, p7_found, p7_lines, pack, unite, unpack
from tests.conftest import rows


def test_containers():
    rng = np.random.default_rng(1)
    for size in (0, 1, 4096, 4097, 60000):
        low = np.sort(rng.choice(65536, size, replace=False)).astype(np.uint16)
        assert np.array_equal(unpack(pack(low)), low)
    a, b = np.arange(0, 9000, 2).astype(np.uint16), np.arange(0, 9000, 3).astype(np.uint16)
    assert unite([pack(a), pack(b), pack(a)])[1] == len(set(a.tolist()) | set(b.tolist()))
    assert unite([pack(a)])[1] == len(a)


def brute(pages):
    pages = {p["id"]: p for p in pages if p.get("id") is not None and p.get("corpus_id") is not None and (p.get("content_text") or "").strip()}
    found = set()
    for site in {p["corpus_id"] for p in pages.values()}:
        own = [p for p in pages.values() if p["corpus_id"] == site]
        holders = {}
        for p in own:
            for key in {letters_key(line) for line in page_lines(p["content_text"])} - {""}:
                holders.setdefault(key, set()).add(p["id"])
        often = {k for k, ids in holders.items() if len(ids) >= 4 and len(ids) * 10 >= len(own)}
        found |= {(p["id"], n) for p in own for n, line in enumerate(page_lines(p["content_text"])) if letters_key(line) in often}
    return found


def test_against_brute_force_with_a_hot_site(spark, tables):
    random.seed(5)
    lines = ["All rights reserved", "ALL  rights: reserved!", "Share this", "ﬁne print 2", "fine print 9", "123", "", "მთავარი", "by A"] + [f"unique {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    pages = []
    for i in range(400):
        site = 1 if i % 3 else 2 + i % 7
        pages.append({"id": i * 977, "corpus_id": site, "content_text": random.choice(["\n", "\r\n"]).join(random.sample(lines, 8))})
    pages += pages[:40] + [{"id": 5, "corpus_id": None, "content_text": "Share this"}, {"id": None, "corpus_id": 1, "content_text": "Share this"}, {"id": 6, "corpus_id": 1, "content_text": None}, {"id": 7, "corpus_id": 1, "content_text": " \n"}]
    root = tables(ingestion_document=pages)
    expected = brute(pages)
    assert set(rows(p7_found(spark, root))) == expected and len(rows(p7_found(spark, root))) == len(expected) > 100
    for r in p7_lines(spark, root).collect():
        assert r.n_pages >= 4 and r.n_pages * 10 >= r.n_site_pages
    clean = {r.document_id: r.content_text for r in p7_clean(spark, root).collect()}
    assert all(len(clean[p["id"]].split("\n")) + sum(d == p["id"] for d, _ in expected) == len(p["content_text"].split("\n")) for p in pages[:50] if clean[p["id"]])


def test_empty(spark, tables):
    assert rows(p7_found(spark, tables())) == []
