"""Rows of a key as list columns of bounded length, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import left_join
from .reshape import col

#: Copies of a row that one generated array may count out.
RUN = 65_536


def nest_rows(
    df: DataFrame, keys: Sequence[str], into: str = "data", size: int = 1_000, chunk: str = "chunk"
) -> DataFrame:
    """One row per key and chunk: ``keys``, ``chunk`` and the list ``into`` of at most ``size`` structs.

    A struct holds the columns beside ``keys`` and how often they occur as ``copies``, so a key has
    as many rows as it needs and no list grows with the data. Equal rows are counted before
    anything is gathered. The others of a key are dealt to chunks by their hash, half of ``size``
    to a chunk; what a chunk has beyond ``size`` goes to a further one. A missing key is a key,
    numbers of chunks tell them apart within a key but may have gaps, and a key without rows has no
    row. Columns that cannot be grouped (maps) raise. :func:`unnest_rows` gives the rows back.
    """
    rest = [c for c in df.columns if c not in keys]
    taken = {chunk, into, "copies"} & set(df.columns)
    if taken:
        raise ValueError(f"columns named {sorted(taken)} would clash: choose other names")
    if size < 1:
        raise ValueError("a chunk holds one row at least")
    row = F.struct(*[col(c) for c in rest], F.col("_copies").alias("copies"))
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    # hashed beside the key, so that totals come by an exchange of their own and Spark can split
    # the rows of a hot key
    rows = counted.select(*[col(k) for k in keys], row.alias("_row"), F.xxhash64(*[col(k) for k in keys]).alias("_key"))
    totals = rows.groupBy(*[col(k) for k in keys]).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * 2 / F.lit(size))).cast("long").alias("_slices")
    )
    totals = totals.withColumn("_key", F.xxhash64(*[col(k) for k in keys]))
    sliced = left_join(rows, totals, ["_key", *keys])
    sliced = sliced.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.col("_slices")))
    within = Window.partitionBy(*[col(k) for k in keys], "_slice").orderBy(F.xxhash64("_row"))
    part = F.floor((F.row_number().over(within) - 1) / F.lit(size)).cast("long")
    dealt = sliced.withColumn("_part", part)
    chunks = dealt.groupBy(*[col(k) for k in keys], "_slice", "_part", "_slices").agg(
        F.collect_list("_row").alias(into)
    )
    number = (F.col("_slice") + F.col("_part") * F.col("_slices")).alias(chunk)
    return chunks.select(*[col(k) for k in keys], number, into)


def unnest_rows(nested: DataFrame, into: str = "data", chunk: str = "chunk") -> DataFrame:
    """The rows of :func:`nest_rows`, every copy, with whatever columns were added to its chunks.

    Columns of the chunks come first. Rows come without an order, and a chunk whose list is missing or empty gives none. A
    generator gives the rows, so nothing moves.
    """
    rest = [c for c in nested.columns if c not in (chunk, into)]
    rows = nested.select(*[col(c) for c in rest], F.inline(into))
    # counted out in two steps: no array grows with the number of copies
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))))
    here = F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("_run") * RUN)
    every = runs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here)))
    return every.drop("copies", "_run", "_copy")
