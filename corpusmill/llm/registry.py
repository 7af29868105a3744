"""The query modules of this package."""

from __future__ import annotations

import importlib

NAMES = ["boilerplate", "split", "language", "alignment", "repeated_lines", "encode", "leakage", "truncation", "reading"]


def modules() -> list:
    return [importlib.import_module(f"corpusmill.llm.{name}") for name in NAMES]
