"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, slices, stage
from .tokens import mix

SHARDS = 24
SEED = 42
#: Rows that one task orders in the second permutation, about.
RUN_ROWS = 4096
_LOW = (1 << 33) - 1
#: Most input partitions whose counts are broadcast (a few MB); beyond, they are joined.
BROADCAST_PARTS = 20_000


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample without replacement, by inversion from the mode.

    Exact up to double precision and for populations of any size; the steps it takes follow
    the standard deviation.
    """
    least, most = max(0, sample - bad), min(good, sample)
    if least == most:
        return least
    lg = math.lgamma

    def log_choose(n: int, k: int) -> float:
        return lg(n + 1) - lg(k + 1) - lg(n - k + 1)

    mode = min(most, max(least, (sample + 1) * (good + 1) // (good + bad + 2)))
    at = math.exp(log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample))
    u = rng.random() - at
    up = down = mode
    p_up = p_down = at
    while u > 0 and (up < most or down > least):
        if up < most:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > least:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break  # only rounding is left
    return mode


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (n < rows % shards) for n in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard under a uniform permutation.

    Row by row, a partition draws from the places that are left; its margins are exact.
    """
    rng = np.random.default_rng([seed, 1])
    left, matrix = list(sizes), []
    for count in counts:
        row, rest, places = [], count, sum(left)
        for size in left:
            places -= size
            take = draw_hypergeometric(rng, size, places, rest)
            row.append(take)
            rest -= take
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def row_labels(row: list[int], part: int, seed: int) -> np.ndarray:
    """Shard of each row of a partition: its counts in a random order."""
    labels = np.repeat(np.arange(len(row), dtype=np.int32), row)
    return np.random.default_rng([seed, 2, part]).permutation(labels)


def row_keys(parts: np.ndarray, order: np.ndarray, seed: int) -> np.ndarray:
    """Random 64-bit key of each row, the same on every run."""
    salt = mix(np.array([seed], np.uint64))
    return mix(mix(parts.astype(np.uint64) + salt) ^ mix(order.astype(np.uint64) + np.uint64(1)))


def _assign(rows: DataFrame, matrix: DataFrame, seed: int, bits: int) -> DataFrame:
    """Rows with ``part, ord`` -> the same with ``shard int, run int, key long``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        for piece in slices(batches):
            part = piece.column("part").to_numpy(zero_copy_only=False)
            order = piece.column("ord").to_numpy(zero_copy_only=False)
            shard = np.empty(len(part), np.int32)
            for p in np.unique(part).tolist():
                mine = part == p
                if p not in known:
                    counts = piece.column("counts")[int(np.flatnonzero(mine)[0])].as_py()
                    known[p] = row_labels(counts, p, seed)
                    if len(known) > 4:
                        known.popitem(last=False)
                shard[mine] = known[p][order[mine]]
            key = row_keys(part, order, seed)
            columns = dict(zip(piece.schema.names, piece.columns, strict=True))
            del columns["counts"]
            yield record_batch({
                **columns, "shard": pa.array(shard),
                "run": pa.array((key >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)),
                "key": pa.array(key.view("i8")),
            })

    joined = rows.join(matrix, "part")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = joined.select(*rows.columns, "counts")
    return ordered.mapInArrow(run, f"{kept}, shard int, run int, key long")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``row struct<all columns>, shard int, slot long``: a uniform permutation of the rows.

    Shard sizes are at most one apart and slots gapless from 0. The input is stored first, with
    the partition and place of each row, so that counts and labels hold on every reread.
    Partition-to-shard counts are drawn exactly, each partition permutes its labels, rows are
    exchanged once, and each shard orders its rows by random keys in runs of bounded size.

    Nulls in any column, repeated rows and any column names are carried as they are; an
    empty table gives an empty table; the same stored input and seed give the same result.
    """
    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))
    place = F.monotonically_increasing_id()
    stored = stage(
        plain.withColumns({"part": F.spark_partition_id(), "ord": place.bitwiseAND(F.lit(_LOW))}), "shards"
    )
    # one number per input partition, as the scheduler itself keeps
    counted = sorted(stored.groupBy("part").count().collect())
    total = sum(r["count"] for r in counted)
    matrix = communication_matrix([r["count"] for r in counted], shard_sizes(total, shards), seed)
    bits = max(0, (total // (shards * RUN_ROWS)).bit_length())
    sent = docs.sparkSession.createDataFrame(
        [(r.part, row) for r, row in zip(counted, matrix, strict=True)], "part int, counts array<long>"
    )
    if len(counted) <= BROADCAST_PARTS:
        sent = F.broadcast(sent)
    runs = _assign(stored.select("part", "ord"), sent, seed, bits).groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "run").orderBy("key", "part", "ord")
    rows = _assign(stored, sent, seed, bits).withColumn("rank", F.row_number().over(within))
    whole = F.struct(*(F.col(f"c{n}").alias(name) for n, name in enumerate(docs.columns)))
    return rows.join(offsets, ["shard", "run"]).select(
        whole.alias("row"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    )
