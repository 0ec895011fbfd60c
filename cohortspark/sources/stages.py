"""Stage tables: every pipeline step is written and read back, which also cuts lineage."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(
    df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write a stage as Parquet and return the stored table."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return read_stage(df.sparkSession, folder, name)


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stage written earlier."""
    return spark.read.parquet(f"{folder}/{name}")


def write_parts(
    df: DataFrame, folder: str, name: str, by: str, parts: Sequence[str] | Sequence[int]
) -> None:
    """Replace the listed parts of a stage that is partitioned by ``by``; the others stay as they lie.

    ``df`` holds rows of those parts only. Each gets a mark row, so that a part which has lost all
    its rows is overwritten too. Writing the same parts again gives the same stage, and Spark
    splits a part that holds most of the rows into several files.
    """
    kind = df.schema[by].dataType.simpleString()
    listed = df.sparkSession.createDataFrame(pd.DataFrame({by: list(parts)}), f"`{by}` {kind}")
    marks = listed.withColumn("_mark", F.lit(True))
    rows = df.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    writer = rows.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by)
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def read_parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stage written by :func:`write_parts`, without its mark rows."""
    return read_stage(spark, folder, name).filter(~F.col("_mark")).drop("_mark")


def write_csv(df: DataFrame, folder: str, name: str) -> None:
    """Write a result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
