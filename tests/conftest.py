import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.session import local_session

TIME = dt.datetime(2024, 1, 1)
COLUMNS = {
    "ingestion_document": [
        ("id", pa.int64()), ("corpus_id", pa.int64()), ("canonical_url", pa.string()), ("title", pa.string()), ("language", pa.string()), ("content_text", pa.string()), ("content_hash", pa.string()),
        ("lead_text", pa.string()), ("summary_ka", pa.string()), ("summary_en", pa.string()), ("page_kind", pa.string()), ("fetch_status", pa.string()), ("created_at", pa.timestamp("us")),
    ],
    "ingestion_chunk": [("id", pa.int64()), ("document_id", pa.int64()), ("corpus_id", pa.int64()), ("sequence_no", pa.int32()), ("text", pa.string()), ("created_at", pa.timestamp("us"))],
    "document_locale_pair": [("id", pa.int64()), ("ka_document_id", pa.int64()), ("en_document_id", pa.int64()), ("created_at", pa.timestamp("us"))],
    "document_link": [("id", pa.int64()), ("source_doc_id", pa.int64()), ("target_url", pa.string()), ("target_doc_id", pa.int64()), ("discovered_at", pa.timestamp("us"))],
    "document_deletion": [("document_id", pa.int64()), ("deleted_at", pa.timestamp("us"))],
    "chat_turn": [("id", pa.int64()), ("session_id", pa.string()), ("user_message", pa.string()), ("created_at", pa.timestamp("us"))],
    "retrieval_hit": [("hit_id", pa.int64()), ("turn_id", pa.int64()), ("document_id", pa.string()), ("source_url", pa.string()), ("score", pa.float64())],
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())],
    "eval_item": [("item_id", pa.int64()), ("locale", pa.string()), ("passage", pa.string())],
    "reading_label": [("doc_id", pa.int64()), ("reading_level", pa.int32())],
}


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture
def tables(tmp_path):
    """A function that writes tables, given as lists of dicts, and returns their folder; every table also gets extra
    columns, one of them named like a column that operators make."""

    def write(**given):
        for name, columns in COLUMNS.items():
            rows = given.get(name, [])
            data = {c: pa.array([r.get(c) for r in rows], kind) for c, kind in columns}
            data |= {"key": pa.array([None] * len(rows), pa.string()), "n": pa.array(range(len(rows)), pa.int64())}
            pq.write_table(pa.table(data), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


def rows(df):
    return sorted(tuple(r) for r in df.collect())
