import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.references import decimal_id, key_runs, missing_keys, p5_found, p5_per_month
from tests.conftest import TIME, rows

LATER = TIME + dt.timedelta(days=40)


def test_runs_are_the_longest_within_a_bucket(spark):
    keys = spark.createDataFrame([(k,) for k in (5, 6, 7, 7, 9, 16383, 16384, None, -1)], "key long")
    assert sorted((r.run_start, r.run_end) for r in key_runs(keys).collect()) == [(-1, -1), (5, 7), (9, 9), (16383, 16383), (16384, 16384)]


def test_missing_keys_against_brute_force(spark):
    there = {k for k in range(0, 60000, 7)} | set(range(100, 200))
    parents = spark.createDataFrame([(k,) for k in there], "key long")
    wanted = list(range(0, 40000, 13)) + [-5, 10**15]
    found = missing_keys(spark.createDataFrame([(k,) for k in wanted], "key long"), key_runs(parents))
    assert {r.key for r in found.where("missing").collect()} == set(wanted) - there
    assert found.count() == len(wanted)


@pytest.mark.parametrize(("text", "value"), [(" 0012 ", 12), ("12\n", 12), ("n/a", None), ("doc-12", None), ("1.5", None), ("99999999999999999999", None), ("-3", -3)])
def test_decimal_id(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(decimal_id(F.col("t"))).first()[0] == value


def test_every_kind_of_orphan(spark, tables):
    root = tables(
        ingestion_document=[{"id": 1, "created_at": TIME}, {"id": 1, "created_at": TIME}, {"id": 2, "created_at": LATER}, {"id": 3, "created_at": TIME}, {"id": None, "created_at": TIME}],
        document_deletion=[{"document_id": 3, "deleted_at": TIME + dt.timedelta(days=1)}, {"document_id": None, "deleted_at": TIME}],
        document_link=[
            {"id": 10, "target_doc_id": 1, "discovered_at": TIME}, {"id": 11, "target_doc_id": 2, "discovered_at": TIME}, {"id": 11, "target_doc_id": 2, "discovered_at": TIME},
            {"id": 12, "target_doc_id": 3, "discovered_at": TIME}, {"id": 13, "target_doc_id": 3, "discovered_at": LATER}, {"id": 14, "target_doc_id": 9, "discovered_at": LATER},
            {"id": 15, "target_doc_id": None, "discovered_at": LATER}, {"id": 16, "target_doc_id": 9, "discovered_at": None}, {"id": 17, "target_doc_id": 2, "discovered_at": None},
        ],
        chat_turn=[{"id": 1, "created_at": TIME}, {"id": 1, "created_at": TIME}],
        retrieval_hit=[
            {"hit_id": 1, "turn_id": 1, "document_id": " 001\n"}, {"hit_id": 2, "turn_id": 1, "document_id": "n/a"}, {"hit_id": 2, "turn_id": 1, "document_id": "n/a"},
            {"hit_id": 3, "turn_id": 1, "document_id": "  "}, {"hit_id": 4, "turn_id": 7, "document_id": "99"}, {"hit_id": 5, "turn_id": 1, "document_id": None},
        ],
        document_locale_pair=[{"id": 5, "en_document_id": 2, "created_at": LATER}, {"id": 6, "en_document_id": 8, "created_at": TIME}, {"id": 7, "en_document_id": None, "created_at": TIME}],
    )
    found = sorted(((r.ref_table, r.ref_month or "", r.ref_id) for r in p5_found(spark, root).collect()))
    assert found == [
        ("document_link", "", 16), ("document_link", "2024-01", 11), ("document_link", "2024-02", 13), ("document_link", "2024-02", 14),
        ("document_locale_pair", "2024-01", 6), ("retrieval_hit", "", 4), ("retrieval_hit", "2024-01", 2),
    ]
    assert ("document_link", "2024-02", 2) in {tuple(r) for r in p5_per_month(spark, root).collect()}


def test_a_hot_missing_key_and_empty_tables(spark, tables):
    hot = [{"id": i, "target_doc_id": 77, "discovered_at": TIME} for i in range(3000)]
    root = tables(document_link=hot + [{"id": 5000 + i, "target_doc_id": i, "discovered_at": TIME} for i in range(50)])
    assert p5_found(spark, root).count() == 3050
    assert rows(p5_found(spark, tables())) == []
