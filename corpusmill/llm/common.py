"""What several operators of this package share."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from corpusmill.session import tune

#: Format characters (category Cf) that are invisible in running text.
INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
WORD = re.compile(r"[^\W_]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    tune(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch(schema: list[tuple[str, pa.DataType]], columns: Iterable[list]) -> pa.RecordBatch:
    """A record batch of Python lists."""
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(columns, schema, strict=True)], names=[name for name, _ in schema])


def signed(value: int) -> int:
    """An unsigned 64-bit number as a bigint."""
    return value - (1 << 64) if value >= 1 << 63 else value


def hash64(text: str) -> int:
    """A 64-bit fingerprint that is the same in every process."""
    return signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def letters_key(line: str) -> str:
    """NFKC, lower case, letters alone."""
    text = NOT_LETTERS.sub("", unicodedata.normalize("NFKC", line).lower())
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


def page_lines(text: str) -> list[str]:
    """The lines between newlines; a carriage return at the end belongs to the line break."""
    return [line[:-1] if line.endswith("\r") else line for line in text.split("\n")]


def words(text: str) -> list[str]:
    """Words whatever their case, punctuation, spacing, line breaks and invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())
