"""Totals, missing counts, standardisation and exact quantiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import columns_starting, ratio

from .reshape import col


def _plus(part: str, names: Sequence[str], empty: str) -> Column:
    """Sum of one SQL term per column."""
    return F.expr(" + ".join(part.format(f"`{n}`") for n in names) or empty)


def matching(df: DataFrame, pattern: str, exclude: str | None = None) -> list[str]:
    """Columns whose name matches ``pattern`` anywhere and ``exclude`` nowhere."""
    return [
        c
        for c in df.columns
        if re.search(pattern, c) and not (exclude and re.search(exclude, c))
    ]


def row_total(df: DataFrame, pattern: str, exclude: str | None = None) -> Column:
    """Sum across matching columns, missing values as zero."""
    return _plus("coalesce(double({}), 0D)", matching(df, pattern, exclude), "0D")


def row_mean(df: DataFrame, pattern: str, exclude: str | None = None) -> Column:
    """Mean across matching columns, missing values skipped."""
    answered = _plus("int({} is not null)", matching(df, pattern, exclude), "0")
    return ratio(row_total(df, pattern, exclude), answered)


def missing_counts(
    df: DataFrame,
    groups: Mapping[str, str],
    match: str = "prefix",
    within: Sequence[str] | None = None,
) -> dict[str, Column]:
    """Expressions counting missing answers: output name -> column-name prefix or part."""
    allowed = set(df.columns if within is None else within)
    counts = {}
    for name, text in groups.items():
        if match == "prefix":
            names = columns_starting(df, text)
        else:
            names = [c for c in df.columns if text in c]
        counts[name] = _plus("int({} is null)", [c for c in names if c in allowed], "0")
    return counts


def with_missing_counts(
    df: DataFrame,
    groups: Mapping[str, str],
    total: str = "nas_total",
    match: str = "prefix",
    within: Sequence[str] | None = None,
) -> DataFrame:
    """Add the counts of :func:`missing_counts` and their sum."""
    counted = df.withColumns(missing_counts(df, groups, match, within))
    return counted.withColumn(total, _plus("{}", list(groups), "0"))


def zscore(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add standardised copies (source -> new name) by global mean and sample SD.

    The moments come from one aggregate read back as a scalar subquery, so no row
    moves. An undefined or zero SD gives NULL.
    """
    moments = [
        F.struct(F.avg(col(c)).alias("mean"), F.stddev_samp(col(c)).alias("sd")).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]
    # one column holds the subquery, so it is planned and run once
    held = df.withColumn("_moments", df.agg(F.struct(*moments)).scalar())
    return held.withColumns(
        {
            new: ratio(
                col(old) - F.col(f"_moments.m{i}.mean"), F.col(f"_moments.m{i}.sd")
            )
            for i, (old, new) in enumerate(columns.items())
        }
    ).drop("_moments")


#: Sketches know every rank to within 1 / SKETCH of a key's rows.
SKETCH = 10_000
#: Share of a key's rows between a bracket's end and the wanted rank, twice the sketch's error.
MARGIN = 2 / SKETCH


def group_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, into: str, margin: float = MARGIN
) -> DataFrame:
    """Exact quantile per key with linear interpolation between order statistics.

    A mergeable sketch per key, combined before the exchange, gives a bracket around the wanted
    ranks. One pass then counts what lies below it and above it, and keeps only the values
    inside, equal ones as one row with their count. The ranks are looked up among those, so
    the result is exact; a rank that is not inside its bracket, which the error of the sketch
    rules out for this ``margin``, would raise instead of giving a neighbour. A key whose margin is
    less than four rows keeps all its values. Values of a key of any size stay spread
    out until they are counted, and a window sees a few in ten thousand of them.
    """
    number = col(value).cast("double")
    # one column holds the keys: in it a missing key equals a missing key
    key = F.struct(*(col(k).alias(f"k{n}") for n, k in enumerate(keys))).alias("_key")
    rows = df.filter(number.isNotNull()).select(key, (number + F.lit(0.0)).alias("_v"))
    low_end, high_end = max(p - margin, 0.0), min(p + margin, 1.0)
    sketch = rows.groupBy("_key").agg(
        F.percentile_approx("_v", [low_end, high_end], SKETCH).alias("_ends"), F.count(F.lit(1)).alias("_rows")
    )
    # joined on a hash beside the key, so that brackets come by an exchange of their own: only then
    # can Spark split a hot key, whose values would otherwise follow its sketch into one task
    hashed = F.xxhash64("_key").alias("_hash")
    met = rows.select("*", hashed).join(sketch.select("*", hashed), ["_hash", "_key"])
    # a margin of less than a few ranks is no margin: such a key is all inside
    wide = F.col("_rows") * margin >= 4
    below = wide & F.lit(low_end > 0) & (F.col("_v") < F.col("_ends")[0])
    above = wide & F.lit(high_end < 1) & (F.col("_v") > F.col("_ends")[1])
    side = F.when(below, -1).when(above, 1).otherwise(0).alias("_side")
    counts = met.select("_key", "_rows", side, "_v").groupBy(
        "_key", "_rows", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_c"))

    ordered = Window.partitionBy("_key").orderBy("_side", "_v")
    upto = F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto)
    position = (F.col("_rows") - 1) * F.lit(p)
    low = F.floor(position)
    high = F.least(low + 1, F.col("_rows") - 1)
    wanted = ranked.filter((F.col("_upto") > low) & (F.col("_upto") - F.col("_c") <= high))
    ends = wanted.groupBy("_key").agg(
        F.max(F.abs("_side")).alias("_out"),
        F.min("_v").alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias("_b"),
        F.max(position - low).alias("_part"),
    )
    exact = F.when(F.col("_out") > 0, F.raise_error(F.lit("a rank is outside its bracket: raise the margin")))
    exact = exact.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))
    )
    return ends.select(*(F.col(f"_key.k{n}").alias(k) for n, k in enumerate(keys)), exact.alias(into))
