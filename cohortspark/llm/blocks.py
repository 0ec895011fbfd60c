"""Documents in blocks that ask key shards and get packed answers back.

A block is a stored row of some MB of documents. It sends each shard one packed array of the
distinct keys that it has there; the shard answers with a few bits per key, in the same
order. Neither keys nor documents travel row by row, and a key that all documents share
reaches its shard once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices, stage, stage_buckets

#: Size of the documents of a block, before compression.
BLOCK_BYTES = 4 << 20
#: Documents for which one key shard is made; their keys in a task take about as much.
SHARD_BYTES = 32 << 20
#: Sorts documents without an id after all others.
NO_ID = np.iinfo(np.int64).max
ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def weight_of(stored: DataFrame) -> int:
    """Size of the documents of all blocks in bytes."""
    return stored.agg(F.sum("weight")).first()[0] or 0


def shards(stored: DataFrame, weight: int) -> int:
    """Number of key shards: one for each ``SHARD_BYTES`` of documents, so shards keep their size.

    At least the shuffle partitions that the session is sized for.
    """
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // SHARD_BYTES))


def pack(parts: list[pa.RecordBatch], level: int | None = None) -> bytes:
    options = ZSTD
    if level is not None:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=options) as writer:
        for part in parts:
            writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def to_blocks(df: DataFrame, name: str) -> DataFrame:
    """Stored blocks ``block long, payload binary, weight long`` of the rows of ``df``.

    Columns are packed as ``c0, c1, ...``; ``weight`` is their size in bytes.
    """
    return stage(blocks_of(df, BLOCK_BYTES), name)


def to_bucketed_blocks(df: DataFrame, name: str, size: int, level: int, buckets: int) -> DataFrame:
    """As ``to_blocks``, stored in buckets by block: joins on it move the other side only.

    Blocks are of ``size`` bytes and packed at a compression level.
    """
    return stage_buckets(blocks_of(df, size, level), name, "block", buckets)


def blocks_of(df: DataFrame, block_bytes: int, level: int | None = None) -> DataFrame:
    """Blocks of about ``block_bytes`` of the rows of ``df``, as they lie in their partitions."""
    plain = df.toDF(*(f"c{n}" for n in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        parts, size = [], 0

        def block() -> pa.RecordBatch:
            return record_batch({
                "block": pa.array([first + number], pa.int64()),
                "payload": pa.array([pack(parts, level)], pa.binary()),
                "weight": pa.array([size], pa.int64()),
            })

        for piece in slices(batches, 32):
            parts.append(piece)
            size += piece.nbytes
            if size >= block_bytes:
                yield block()
                parts, size, number = [], 0, number + 1
        if parts:
            yield block()

    return plain.mapInArrow(run, "block long, payload binary, weight long")


def ids_of(table: pa.Table, place: int) -> np.ndarray:
    """Ids of the documents of a block, ``NO_ID`` for none."""
    return table.column(place).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


def texts_of(table: pa.Table, place: int) -> list[bytes]:
    """Texts of a block as UTF-8; null is empty."""
    return table.column(place).cast(pa.binary()).fill_null(b"").to_pylist()


def split_by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of each shard, given rows sorted by shard."""
    edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    bounds = [0, *edges.tolist(), len(shard)] if len(shard) else []
    for start, end in zip(bounds, bounds[1:], strict=False):
        yield int(shard[start]), *(c[start:end] for c in columns)


def ask(blocks: DataFrame, make: Callable[..., Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``shard, block, keys``: what ``make(payload, answers)`` yields for each block."""
    known = "answers" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            row = piece.to_pylist()[0]
            asked = list(make(row["payload"], row["answers"] or [] if known else []))
            if asked:
                yield record_batch({
                    "shard": pa.array([s for s, _ in asked], pa.int32()),
                    "block": pa.array([row["block"]] * len(asked), pa.int64()),
                    "keys": pa.array([k for _, k in asked], pa.binary()),
                })

    return blocks.drop("weight").mapInArrow(run, "shard int, block long, keys binary")


def answer(
    asked: DataFrame, reply: Callable[[list[bytes], list[int]], list[np.ndarray]], name: str | None
) -> DataFrame:
    """``block, shard, bits, hits``: a byte array per block from ``reply(keys, blocks)``, stored if named.

    A shard holds the distinct keys of its blocks; the number of shards follows the size of
    the blocks, and a key that all documents share comes once per block.
    """

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        bits = reply(table.column("keys").to_pylist(), blocks)
        return pa.table({
            "block": pa.array(blocks, pa.int64()),
            "shard": table.column("shard"),
            "bits": pa.array([b.astype(np.uint8).tobytes() for b in bits], pa.binary()),
            "hits": pa.array([int(b.any()) for b in bits], pa.int32()),
        })

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    replies = asked.groupBy("shard").applyInArrow(run, "block long, shard int, bits binary, hits int")
    return stage(replies, name) if name else replies


def with_answers(
    blocks: DataFrame, levels: list[DataFrame], join: str = "merge", buckets: int | None = None
) -> DataFrame:
    """Blocks beside their answers of all levels, ordered by level and shard.

    A block collects as many entries as it sent, so the list is bounded by the block.
    ``join`` is the hint for the one plan that serves every size; answers to blocks that lie in
    ``buckets`` are dealt out once, as the buckets are.
    """
    every = None
    for n, level in enumerate(levels):
        tagged = level.select(F.lit(n).alias("level"), "block", "shard", "bits")
        every = tagged if every is None else every.unionByName(tagged)
    if buckets:
        every = every.repartition(buckets, "block")
    entry = F.sort_array(F.collect_list(F.struct("level", "shard", "bits")))
    # answers grow with the blocks: one plan at every size
    listed = every.groupBy("block").agg(entry.alias("answers")).hint(join)
    return blocks.join(listed, "block", "left")


def bits_of(answers: list[dict], level: int) -> np.ndarray:
    """The answers of one level in the order in which the keys were sent."""
    parts = [a["bits"] for a in answers if a["level"] == level]
    return np.frombuffer(b"".join(parts), np.uint8)
