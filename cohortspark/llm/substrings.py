"""Substring deduplication by level-wise doubling of repeated word windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bk
from .common import column, record_batch, slices
from .tokens import mix

WINDOW = 20
#: Length of the windows of the first level.
START = 10
#: Share of wrong candidates that short keys may let through below the last level: 2 ** -6.
SPARE_BITS = 6
MEMO = 300_000
_CHAINS = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)),
    (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)),
)


class WordHash(dict):
    """Memo from word to its 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: One memo per Python process, shared by its blocks.
WORDS = WordHash()


def levels(start: int, window: int) -> list[int]:
    """Window lengths from ``start`` to ``window``, each twice the one before."""
    out = [start]
    while out[-1] < window:
        out.append(2 * out[-1])
    if out[-1] != window:
        raise ValueError("window must be start times a power of two")
    return out


def window_hashes(words: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on, composed from halves.

    Both operands of every composition are exact window hashes, so equal windows have equal
    hashes; ``which`` chooses one of two independent chains.
    """
    first, second = _CHAINS[which]

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a[: len(b)] * first + mix(b + second))

    power, size, total, done = mix(words ^ first), 1, None, 0
    while True:
        if length & size:
            total = power if total is None else join(total, power[done:])
            done += size
        if done == length:
            return total[: max(0, len(words) - length + 1)]
        power, size = join(power, power[size:]), 2 * size


def pack_sorted(values: np.ndarray) -> bytes:
    """Increasing integers as 16-bit steps, with the larger steps listed apart."""
    steps = np.diff(values, prepend=np.uint64(0))
    large = np.flatnonzero(steps >> np.uint64(16))
    return b"".join([
        np.array([len(values), len(large)], "<u4").tobytes(),
        (steps & np.uint64(0xFFFF)).astype("<u2").tobytes(),
        large.astype("<u4").tobytes(),
        (steps[large] >> np.uint64(16)).astype("<u8").tobytes(),
    ])


def unpack_sorted(data: bytes) -> tuple[np.ndarray, int]:
    """What ``pack_sorted`` packed, and the number of bytes it took."""
    size, large = np.frombuffer(data, "<u4", 2).tolist()
    steps = np.frombuffer(data, "<u2", size, 8).astype(np.uint64)
    at = 8 + 2 * size
    where = np.frombuffer(data, "<u4", large, at)
    steps[where] += np.frombuffer(data, "<u8", large, at + 4 * large) << np.uint64(16)
    return np.cumsum(steps, dtype=np.uint64), at + 12 * large


class BlockWindows:
    """Words of the documents of a block in the order of their ids, and window candidates."""

    def __init__(self, table: pa.Table, shards: int, bits: int, lengths: list[int]):
        ids = bk.ids_of(table, 0)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = bk.texts_of(table, 1)
        self.words = [texts[n].split() for n in self.order.tolist()]
        sizes = np.array([len(w) for w in self.words], np.int64)
        total = int(sizes.sum())
        self.hash = np.fromiter(
            map(WORDS.__getitem__, chain.from_iterable(self.words)), np.uint64, total
        )
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.left = np.repeat(self.starts[1:], sizes) - np.arange(total)  # words from here to the end
        self.shards, self.bits, self.lengths = shards, bits, lengths

    def level_keys(self, level: int, alive: np.ndarray) -> tuple:
        """Shard and key of the windows at ``alive``; short keys but on the last level."""
        length = self.lengths[level]
        shard = window_hashes(self.hash, length, 0)[alive] % np.uint64(self.shards)
        key = window_hashes(self.hash, length, 1)[alive]
        if level < len(self.lengths) - 1:
            key = key >> np.uint64(64 - self.bits)
        order = np.lexsort((key, shard))  # stable: the first of equals comes first
        new = np.ones(len(order), bool)
        new[1:] = (shard[order][1:] != shard[order][:-1]) | (key[order][1:] != key[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return shard[first].astype(np.int32), key[first], number, first

    def alive(self, answers: list[dict], level: int) -> np.ndarray:
        """Positions whose window of this level may be repeated, from the levels before."""
        positions = np.flatnonzero(self.left >= self.lengths[0])
        for n in range(level):
            _, _, number, _ = self.level_keys(n, positions)
            repeated = positions[bk.bits_of(answers, n)[number] > 0] if len(positions) else positions
            mask = np.zeros(len(self.hash), bool)
            mask[repeated] = True
            length = self.lengths[n]
            positions = repeated[self.left[repeated] >= 2 * length]
            positions = positions[mask[positions + length]]
        return positions

    def asked(self, answers: list[dict], level: int) -> Iterator[tuple[int, bytes]]:
        shard, key, number, first = self.level_keys(level, positions := self.alive(answers, level))
        if level < len(self.lengths) - 1:
            several = np.bincount(number, minlength=len(key)) > 1
            for s, keys, many in bk.split_by_shard(shard, key, several):
                yield s, pack_sorted(keys) + np.packbits(many).tobytes()
            return
        doc = np.searchsorted(self.starts, positions[first], side="right") - 1
        for s, keys, docs in bk.split_by_shard(shard, key, doc):
            # by document, so that an id is sent once for all its keys
            order = np.argsort(docs, kind="stable")
            which, count = np.unique(docs, return_counts=True)
            head = np.array([len(keys), len(which)], "<u4").tobytes()
            yield s, b"".join([
                head, keys[order].astype("<u8").tobytes(),
                self.ids[which].astype("<i8").tobytes(), count.astype("<u4").tobytes(),
            ])

    def removed(self, answers: list[dict]) -> np.ndarray:
        """Which words a window covers that also starts earlier."""
        last = len(self.lengths) - 1
        positions = self.alive(answers, last)
        change = np.zeros(len(self.hash) + 1, np.int64)
        if len(positions):
            shard, _, number, first = self.level_keys(last, positions)
            doc = np.searchsorted(self.starts, positions[first], side="right") - 1
            sent = np.lexsort((np.arange(len(doc)), doc, shard))
            is_first = np.empty(len(first), bool)
            is_first[sent] = bk.bits_of(answers, last) > 0
            again = np.ones(len(positions), bool)
            again[first] = ~is_first
            change[: len(self.hash)] += np.bincount(positions[again], minlength=len(self.hash))
            ends = np.bincount(positions[again] + self.lengths[last], minlength=len(change))
            change -= ends
        return np.cumsum(change)[:-1] > 0


def reply_repeated(keys: list[bytes], _: list[int]) -> list[np.ndarray]:
    """Which keys of each block occur twice or more in all."""
    parts, many = [], []
    for data in keys:
        values, at = unpack_sorted(data)
        parts.append(values)
        many.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=len(values)))
    every = np.concatenate(parts)
    distinct, number = np.unique(every, return_inverse=True)
    count = np.bincount(number, minlength=len(distinct)) + np.bincount(
        number, np.concatenate(many), minlength=len(distinct)
    )
    return np.split((count[number] > 1).astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])


def reply_first(keys: list[bytes], blocks: list[int]) -> list[np.ndarray]:
    """Which keys of each block it has in the least document, then the least block."""
    parts, ids = [], []
    for data in keys:
        size, docs = np.frombuffer(data, "<u4", 2).tolist()
        parts.append(np.frombuffer(data, "<u8", size, 8))
        which = np.frombuffer(data, "<i8", docs, 8 + 8 * size)
        ids.append(np.repeat(which, np.frombuffer(data, "<u4", docs, 8 + 8 * size + 8 * docs)))
    every = np.concatenate(parts)
    order = np.lexsort((np.repeat(blocks, [len(p) for p in parts]), np.concatenate(ids), every))
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    first = np.zeros(len(every), np.uint8)
    first[order[new]] = 1
    return np.split(first, np.cumsum([len(p) for p in parts])[:-1])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, start: int = START,
) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: words of windows that also start earlier go.

    Windows of ``start`` words are looked up first; those that occur once are out. Where two
    adjacent repeated windows touch, the window of twice the length is looked up, and so on to
    ``window`` words or until no candidate is left. On the last level the earliest start
    (least id, then position) stays. Lookups are judged on the input texts.

    A null text has no words; documents without an id come after all others; rows that
    share an id are separate documents in the order read; other columns are not read; an empty
    table gives an empty table. Long texts are one block each.
    """
    lengths = levels(start, window)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    stored = bk.to_blocks(rows, "windows")
    weight = bk.weight_of(stored)
    shards = bk.shards(stored, weight)
    bits = min(48, max(16, int(weight // 4 // shards).bit_length() + SPARE_BITS))

    answers: list[DataFrame] = []
    known = stored
    for level in range(len(lengths)):

        def make(payload: bytes, replies: list, level: int = level) -> Iterator[tuple[int, bytes]]:
            block = BlockWindows(bk.unpack(payload), shards, bits, lengths)
            return block.asked(replies, level)

        last = level == len(lengths) - 1
        found = bk.answer(bk.ask(known, make), reply_first if last else reply_repeated, f"windows-{lengths[level]}")
        answers.append(found)
        known = bk.with_answers(stored, answers)
        if not last and found.filter("hits > 0").isEmpty():
            break
    finished = len(answers) == len(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            row = piece.to_pylist()[0]
            table = bk.unpack(row["payload"])
            block = BlockWindows(table, shards, bits, lengths)
            gone = block.removed(row["answers"] or []) if finished else np.zeros(len(block.hash), bool)
            parts = np.split(gone, block.starts[1:-1])
            kept = [
                b" ".join(words) if not drop.any()
                else b" ".join(w for w, g in zip(words, drop.tolist(), strict=True) if not g)
                for words, drop in zip(block.words, parts, strict=True)
            ]
            yield record_batch({
                "doc_id": table.column(0).combine_chunks().take(pa.array(block.order)),
                "text": pa.array(kept, pa.binary()).cast(pa.string()),
                "n_words": pa.array(np.diff(block.starts)),
                "n_removed": pa.array([int(p.sum()) for p in parts], pa.int64()),
            })
        WORDS.clear()  # the worker process lives on

    schema = "doc_id long, text string, n_words long, n_removed long"
    return known.select("payload", "answers").mapInArrow(run, schema)
