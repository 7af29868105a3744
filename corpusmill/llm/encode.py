"""Encoding of a corpus with a public byte-level tokenizer (problem 8).

Texts are cut into pre-tokens; a block of documents keeps its pre-tokens' positions as codes into the block's own list
of distinct words. Only these lists are shuffled: each word of the whole corpus is encoded once, its ids go back to the
blocks that have it, and each block puts its documents together by position. Decoding looks ids up in the
token-to-bytes table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches
from corpusmill.session import materialize
from corpusmill.sources.tables import table

#: Where the vocabulary files are.
FOLDER = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary. White space is spelled out, as engines differ on it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _pattern():
    import regex

    white = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
    return regex.compile(PATTERN.replace(r"[^\s", f"[^{white}").replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]"))


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _encoder(path: str):
    """Merges the bytes of a word that is cut out already: all of it is one piece."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


def pre_tokens(text: str) -> list[str]:
    """The pieces within which bytes are merged."""
    return _pattern().findall(text)


def coded_blocks(documents: DataFrame) -> DataFrame:
    """(block, doc_ids, sizes, codes, words) of ``documents`` (doc_id, text): a row for each batch of documents.

    codes are the positions' words, as places in words; sizes say how many of them each document has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part = _pattern().findall, TaskContext.get().partitionId()
        for number, rows in enumerate(batches):
            place: dict[str, int] = {}
            put, codes, sizes = place.setdefault, [], []
            for text in rows.column(1).to_pylist():
                found = find(text) if text else []
                sizes.append(len(found))
                codes.append(np.fromiter((put(word, len(place)) for word in found), np.int32, len(found)))
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part * 2**31 + number], pa.int64()), one(rows.column(0), pa.int64()), one(sizes, pa.int32()), one(np.concatenate(codes) if codes else np.zeros(0, np.int32), pa.int32()), one(list(place), pa.string())],
                names=["block", "doc_ids", "sizes", "codes", "words"],
            )

    return map_batches(documents.select("doc_id", "text"), run, "block long, doc_ids array<long>, sizes array<int>, codes array<int>, words array<string>")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, word_ids) of the distinct words in ``words`` (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, ranks = _encoder(path).encode_ordinary, _ranks(path)
        for rows in batches:
            ids = [[ranks[raw]] if (raw := word.encode()) in ranks else single(word) for word in rows.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "word_ids"])

    return map_batches(words.select("word").distinct(), run, "word string, word_ids array<int>")


def encode(documents: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``documents`` (doc_id, text), without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text; a repeated row is
    encoded each time it comes. A word's ids go to each block that has it, not to each position, so the commonest word
    moves once a block.
    """
    blocks = materialize(coded_blocks(documents), "coded")
    listed = blocks.select("block", F.posexplode("words").alias("code", "word"))
    ids = listed.join(encoded_words(listed, path), "word").groupBy("block").agg(F.collect_list(F.struct("code", "word_ids")).alias("known"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                docs, sizes, codes, known = (rows.column(k)[i].values for k in range(4))
                if known is None:
                    known = pa.array([], pa.struct([("code", pa.int32()), ("word_ids", pa.list_(pa.int32()))]))
                order = np.argsort(known.field("code").to_numpy())
                lists = known.field("word_ids").take(pa.array(order)).take(codes)
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
                places = ends[np.concatenate([[0], np.cumsum(sizes.to_numpy(), dtype=np.int64)])]
                flat = lists.flatten()
                yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat)], names=["doc_id", "ids"])

    joined = blocks.select("block", "doc_ids", "sizes", "codes").join(ids, "block", "left").drop("block")
    return map_batches(joined, assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids): the bytes of the ids, joined; an empty list gives an empty text.

    The token-to-bytes table has as many rows as the vocabulary, so each worker holds it whole. Null ids give null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        for rows in batches:
            texts = [None if ids is None else b"".join([by_id[i] for i in ids]).decode("utf-8", "replace") for ids in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, ids): every document's token ids."""
    return encode(table(spark, root, "documents", "doc_id", "text"))


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text): every document encoded and decoded again."""
    return decode(p8_ids(spark, root))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
SQL = {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
