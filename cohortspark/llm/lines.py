"""Line deduplication against a sharded minimal perfect hash of all line keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks as bk
from .common import column, record_batch, slices
from .tokens import mix

SPACE = b" \t\n\r\x0b\x0c"
MIN_KEY = 10
#: Slots per key of a level of the perfect hash.
LOAD = 1.6


def line_key(line: bytes, least: int = MIN_KEY) -> bytes | None:
    """Stripped, A-Z lower-cased line; None if it has fewer than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys.

    Each level is a bit array; keys that are alone in their slot take it, the others go to
    the next level. A key's index is the number of taken slots before its own.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.taken: list[np.ndarray] = []
        self.rank: list[np.ndarray] = []
        below = 0
        while len(high):
            size = int(len(high) * LOAD) + 1
            slot = self._slot(high, low, len(self.taken), size)
            alone = np.bincount(slot, minlength=size) == 1
            self.taken.append(alone)
            self.rank.append(below + np.cumsum(alone) - 1)
            below += int(alone.sum())
            rest = ~alone[slot]
            high, low = high[rest], low[rest]

    @staticmethod
    def _slot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = mix(np.array([level + 1], np.uint64))
        return (mix(mix(high + salt) ^ low) % np.uint64(size)).astype(np.int64)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some of the keys that are not in the set."""
        out = np.full(len(high), -1, np.int64)
        todo = np.arange(len(high))
        for level, (taken, rank) in enumerate(zip(self.taken, self.rank, strict=True)):
            slot = self._slot(high[todo], low[todo], level, len(taken))
            hit = taken[slot]
            out[todo[hit]] = rank[slot[hit]]
            todo = todo[~hit]
        return out


class LineIndex:
    """Arrays over the perfect hash of a shard: fingerprint, document count, first document.

    The count stops at 2, which is all that "in several documents" needs.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, least: np.ndarray, most: np.ndarray):
        order = np.lexsort((low, high))
        high, low, least, most = high[order], low[order], least[order], most[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        self.hash = PerfectHash(high[at], low[at])
        slot = self.hash.index(high[at], low[at])
        least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
        self.fingerprint = np.empty(len(at), np.uint32)
        self.fingerprint[slot] = low[at].astype(np.uint32)
        self.count = np.empty(len(at), np.uint8)
        self.count[slot] = 1 + (least != most)
        self.first = np.empty(len(at), np.int64)
        self.first[slot] = least

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0 if the key is unknown) and first document of each key."""
        slot = self.hash.index(high, low)
        known = (slot >= 0) & (self.fingerprint[slot] == low.astype(np.uint32))
        return np.where(known, self.count[slot], 0), self.first[slot]


class BlockLines:
    """Lines of the documents of a block and their distinct keys in shard order."""

    def __init__(self, table: pa.Table, id_place: int, text_place: int, shards: int, least: int):
        self.ids = bk.ids_of(table, id_place)
        self.lines = [text.split(b"\n") for text in bk.texts_of(table, text_place)]
        keys = [line_key(line, least) for line in chain.from_iterable(self.lines)]
        self.keyed = np.array([k is not None for k in keys], bool)
        digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys if k is not None)
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        high, low = halves[:, 0], halves[:, 1]
        owner = np.repeat(np.arange(len(self.lines)), [len(x) for x in self.lines])
        self.doc = self.ids[owner[self.keyed]]
        shard = (high % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((low, high, shard))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.key = np.empty(len(order), np.int64)
        self.key[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.shard, self.high, self.low = shard[order][at], high[order][at], low[order][at]
        if len(at):
            self.least = np.minimum.reduceat(self.doc[order], at)
            self.most = np.maximum.reduceat(self.doc[order], at)
        else:
            self.least = self.most = np.empty(0, np.int64)

    def asked(self) -> Iterator[tuple[int, bytes]]:
        rows = np.stack([self.high, self.low, self.least.view("u8"), self.most.view("u8")], axis=1)
        for shard, part in bk.split_by_shard(self.shard, rows):
            yield shard, part.astype("<u8").tobytes()

    def dropped(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each document which lines go. Bit 1: shared; bit 2: first seen in this block."""
        shared, own = bits & 1, bits & 2
        gone = np.zeros(len(self.keyed), bool)
        keeps = (own[self.key] > 0) & (self.doc == self.least[self.key])
        gone[self.keyed] = (shared[self.key] > 0) & ~keeps
        return np.split(gone, np.cumsum([len(x) for x in self.lines])[:-1])


def reply(keys: list[bytes], _: list[int]) -> list[np.ndarray]:
    """Build the index of a shard from what all blocks sent, and probe it for each of them."""
    parts = [np.frombuffer(k, "<u8").reshape(-1, 4) for k in keys]
    every = np.concatenate(parts)
    index = LineIndex(every[:, 0], every[:, 1], every[:, 2].astype("i8"), every[:, 3].astype("i8"))
    count, first = index.probe(every[:, 0], every[:, 1])
    bits = (count > 1).astype(np.uint8) | ((first == every[:, 2].astype("i8")).astype(np.uint8) << 1)
    return np.split(bits, np.cumsum([len(p) for p in parts])[:-1])


def _answered(docs: DataFrame, id_place: int, text_place: int, least: int) -> tuple[DataFrame, int]:
    stored = bk.to_blocks(docs, "lines")
    shards = bk.shards(stored, bk.weight_of(stored))

    def make(payload: bytes, _: list) -> Iterator[tuple[int, bytes]]:
        return BlockLines(bk.unpack(payload), id_place, text_place, shards, least).asked()

    replies = bk.answer(bk.ask(stored, make), reply, "line-answers")
    return bk.with_answers(stored, [replies]).select("payload", "answers"), shards


def _kept(docs: DataFrame, id_col: str, text_col: str, least: int, schema: str, build) -> DataFrame:
    id_place, text_place = docs.columns.index(id_col), docs.columns.index(text_col)
    answered, shards = _answered(docs, id_place, text_place, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            row = piece.to_pylist()[0]
            table = bk.unpack(row["payload"])
            block = BlockLines(table, id_place, text_place, shards, least)
            gone = block.dropped(bk.bits_of(row["answers"] or [], 0))
            kept = [
                b"\n".join(x for x, g in zip(lines, drop, strict=True) if not g)
                for lines, drop in zip(block.lines, gone, strict=True)
            ]
            yield from build(table, block, gone, pa.array(kept, pa.binary()).cast(pa.string()))

    return answered.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: lines of keys found in several documents go.

    They stay in the document of the least id only. A null or empty text is one empty line;
    documents without an id count as one document after all others; rows that share an id
    are one document and keep or lose lines together; other columns are not read; an
    empty table gives an empty table. Very long texts and lines are split and hashed whole.
    Lines equal in 128 hash bits count as equal.
    """

    def build(table, block, gone, kept) -> Iterator[pa.RecordBatch]:
        yield record_batch({
            "doc_id": table.column(0).combine_chunks(),
            "text": kept,
            "n_lines": pa.array([len(x) for x in block.lines], pa.int64()),
            "n_dropped": pa.array([int(g.sum()) for g in gone], pa.int64()),
        })

    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    schema = "doc_id long, text string, n_lines long, n_dropped long"
    return _kept(rows, "doc_id", "text", min_key, schema, build)


def keep_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY
) -> DataFrame:
    """All rows and columns of ``docs`` with the kept lines as text; rules as above."""
    text_place = docs.columns.index(text_col)
    schema = ", ".join(f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(docs.schema))

    def build(table, _, __, kept) -> Iterator[pa.RecordBatch]:
        columns = [kept if n == text_place else c.combine_chunks() for n, c in enumerate(table.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=table.schema.names)

    return _kept(docs, id_col, text_col, min_key, schema, build).toDF(*docs.columns)
