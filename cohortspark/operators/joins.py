"""Equi-joins in which a missing key matches a missing key.

No side is hinted: Catalyst broadcasts a lookup only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``, and AQE splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = str | tuple[str, str]


def _conditions(keys: Sequence[Key], na_matches: bool) -> tuple[dict[str, str], Column]:
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    renamed = {right: f"_right_{right}" for _, right in pairs}
    tests = [
        F.col(left).eqNullSafe(F.col(renamed[right]))
        if na_matches
        else F.col(left) == F.col(renamed[right])
        for left, right in pairs
    ]
    return renamed, reduce(Column.__and__, tests)


def left_join(
    left: DataFrame, right: DataFrame, on: Sequence[Key], na_matches: bool = True
) -> DataFrame:
    """Left join; a pair in ``on`` names the key differently on each side."""
    renamed, condition = _conditions(on, na_matches)
    joined = left.join(right.withColumnsRenamed(renamed), condition, "left")
    return joined.drop(*renamed.values())


def left_join_chain(
    base: DataFrame, parts: Sequence[DataFrame], on: Sequence[Key], na_matches: bool = True
) -> DataFrame:
    """Attach several score tables on the same key, one exchange per table."""
    return reduce(lambda acc, part: left_join(acc, part, on, na_matches), parts, base)


def full_join_reduce(
    parts: Sequence[DataFrame], on: Sequence[str], na_matches: bool = True
) -> DataFrame:
    """Full outer join of all parts; keys are merged into one column."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed, condition = _conditions(on, na_matches)
        joined = left.join(right.withColumnsRenamed(renamed), condition, "full")
        keys = {k: F.coalesce(F.col(k), F.col(r)) for k, r in renamed.items()}
        return joined.withColumns(keys).drop(*renamed.values())

    return reduce(merge, parts)


def semi_keep(
    df: DataFrame, kept: DataFrame, on: Sequence[Key], na_matches: bool = True
) -> DataFrame:
    """Rows whose key occurs in ``kept``."""
    renamed, condition = _conditions(on, na_matches)
    keys = kept.withColumnsRenamed(renamed).select(*renamed.values())
    return df.join(keys, condition, "left_semi")


def apply_aliases(
    df: DataFrame, aliases: DataFrame, column: str, alias: str = "alias", target: str = "target"
) -> DataFrame:
    """Replace mistyped ids by the ones listed in an alias table."""
    table = aliases.select(F.col(alias).alias("_alias"), F.col(target).alias("_target"))
    joined = df.join(table, F.col(column) == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_target", column)).drop("_alias", "_target")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack by column name and fill absent columns with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_tagged(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    """Stack by column name and record the source in ``tag``."""
    return stack([part.withColumn(tag, F.lit(name)) for name, part in parts.items()])
