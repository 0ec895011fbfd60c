"""Keeping one row per key by an explicit order.

The ranking filter lets Catalyst place a group limit before the exchange, so each
task ships at most one row per key however many copies a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]
) -> DataFrame:
    """The first full row of every key; NULL keys form one group."""
    ranked = Window.partitionBy(*keys).orderBy(*order_by)
    return (
        df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")
    )


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged; the running job fails when a key occurs twice."""
    repeated = df.groupBy(*keys).count().agg(F.max("count").alias("most")).scalar()
    message = F.lit(f"more than one row per {', '.join(keys)}")
    ok = F.when(repeated > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return df.filter(ok)
