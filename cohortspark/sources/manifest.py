"""Which input files changed since the last run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling digest, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Lines folded at once inside a task.
FOLD = 65_536


def _powers(size: int) -> np.ndarray:
    """``BASE ** (size - 1), ..., BASE, 1``."""
    steps = np.full(size, BASE, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)[::-1]


def _fold_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and line count of each stretch of lines of one split, in the order read."""
    state: dict[tuple[str, int], tuple[int, int]] = {}
    for pdf in batches:
        for place, part in pdf.groupby(["path", "start"], sort=False):
            lines = part["line"].to_numpy(np.int64).view(np.uint64)
            digest, count = state.get(place, (0, 0))
            for at in range(0, len(lines), FOLD):
                some = lines[at : at + FOLD]
                here = int((some * _powers(len(some))).sum(dtype=np.uint64))
                digest = (digest * pow(BASE, len(some), 1 << 64) + here) % (1 << 64)
            state[place] = (digest, count + len(lines))
    rows = [(path, start, f"{d:016x}", n) for (path, start), (d, n) in state.items()]
    yield pd.DataFrame(rows, columns=["path", "start", "digest", "lines"])


def _join_splits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Digest of a file from those of its splits, in file order."""
    digest, lines = 0, 0
    for part, count in pdf.sort_values("start")[["digest", "lines"]].itertuples(index=False):
        digest = (digest * pow(BASE, int(count), 1 << 64) + int(part, 16)) % (1 << 64)
        lines += int(count)
    return pd.DataFrame({"_path": [pdf["path"].iloc[0]], "digest": [f"{lines}-{digest:016x}"]})


def input_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, length, modified, digest`` per file.

    The digest is a polynomial of the line hashes in file order. Each split folds its own
    lines and a file joins the few digests of its splits, so files of any size take one path,
    and neither a changed line nor a changed order goes unseen, however the file is split.
    """
    listed = spark.read.format("binaryFile").load(paths).select(
        F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified")
    )
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.xxhash64("value").alias("line"),
    )
    splits = lines.mapInPandas(_fold_splits, "path string, start long, digest string, lines long")
    files = splits.groupBy("path").applyInPandas(_join_splits, "_path string, digest string")
    joined = listed.join(files, F.col("path") == F.col("_path"), "left").drop("_path")
    return joined.withColumn("digest", F.coalesce("digest", F.lit("0-empty")))


def changed_inputs(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Files that are new, differ, or are gone: the manifest row and ``change``.

    Without a previous manifest every file is new; a deleted file shows its old row.
    """
    if previous is None:
        return current.withColumn("change", F.lit("new"))
    columns = current.columns
    old = previous.select(*[F.col(c).alias(f"_{c}") for c in columns])
    both = current.join(old, F.col("path") == F.col("_path"), "full")
    same = (F.col("length") == F.col("_length")) & (F.col("digest") == F.col("_digest"))
    change = (
        F.when(F.col("_path").isNull(), "new")
        .when(F.col("path").isNull(), "deleted")
        .when(~same, "changed")
    )
    merged = both.withColumn("change", change).filter("change is not null")
    return merged.select(*[F.coalesce(c, f"_{c}").alias(c) for c in columns], "change")
