"""Choosing and renaming columns by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    """Columns whose name starts with ``prefix``, ignoring case."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def columns_containing(df: DataFrame, part: str) -> list[str]:
    """Columns whose name contains ``part``, respecting case."""
    return [c for c in df.columns if part in c]


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """The contiguous run of columns from ``first`` to ``last``, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def rename_by_pattern(df: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Rename every column with a regular-expression substitution."""
    renamed = {c: re.sub(pattern, replacement, c) for c in df.columns}
    return df.withColumnsRenamed({old: new for old, new in renamed.items() if old != new})


def item_number(text: str) -> int | None:
    """The question number in a part of a column name; None for order or free-text columns."""
    return int(text) if re.fullmatch("[0-9]+", text) else None
