"""Quality rules: hashed n-gram likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bk
from .common import id_and_text, pack_array, record_batch, slices, stage, tree_merge, unpack_array
from .tokens import PIECE_BYTES, groups, mix, token_hashes

#: Least bucket bits of one n-gram order; there are more as the distinct bigrams grow.
BUCKET_BITS = 14
BUCKETS = 2 << BUCKET_BITS
#: Distinct bigrams a bucket. Fewer n-grams a bucket tell less about words that no trusted
#: document has, more make junk look like prose.
BUCKET_LOAD = 4
#: Bits of the registers that estimate the number of distinct bigrams.
REGISTER_BITS = 14
#: Size of a block before compression, and the level of its compression. A large block asks
#: for fewer buckets in all, since its texts share them.
BLOCK_BYTES, BLOCK_LEVEL = 40 << 20, 6
#: Buckets of the table of blocks for each block, so that few tasks get several.
BUCKETS_A_BLOCK = 4
#: Texts hashed at once: their arrays take some 80 times as much.
GROUP_BYTES = 1 << 18
#: Ranges of buckets that a block counts one after the other.
RANGES = 16
#: Counts from here on do not fit a byte.
ESCAPE = 255
#: Pseudo-count of every bucket.
SMOOTHING = 1.0
#: Documents below this log-likelihood ratio per n-gram are rejected.
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"


def ngram_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of unigrams and of bigrams, lower-cased, and the pieces they belong to."""
    one, piece = token_hashes(parts)
    inside = piece[:-1] == piece[1:]
    two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])[inside]
    return one, two, piece, piece[:-1][inside]


def ngram_buckets(parts: list[bytes], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram and the piece each belongs to."""
    one, two, *pieces = ngram_hashes(parts)
    shift = np.uint64(64 - bits)
    buckets = np.concatenate([one >> shift, (two >> shift) + np.uint64(1 << bits)])
    return buckets.astype(np.int64), np.concatenate(pieces)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that some label row marks 1 and none marks 0."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("least"))
        .filter("least = 1")
        .select("doc_id")
    )


def block_facts(stored: DataFrame, id_place: int, place: int) -> DataFrame:
    """Stored ``block, ids, grams, registers``: ids and n-gram counts of the rows of a block.

    The registers estimate the number of distinct bigrams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            payload = piece.column("payload")[0].as_buffer()
            ids = [i for batch in rows_of(payload) for i in batch.column(id_place).cast(pa.int64()).to_pylist()]
            registers = np.zeros(1 << REGISTER_BITS, np.int8)
            grams = np.zeros(len(ids), np.int64)
            for numbers, parts in groups(texts_in(payload, place), GROUP_BYTES):
                _, two, *pieces = ngram_hashes(parts)
                grams += np.bincount(np.asarray(numbers)[np.concatenate(pieces)], minlength=len(grams))
                # place of the first set bit above those that choose the register
                rest = (two >> np.uint64(REGISTER_BITS)).astype(np.float64)
                rank = (65 - REGISTER_BITS - np.frexp(rest)[1]).astype(np.int8)
                np.maximum.at(registers, (two & np.uint64(len(registers) - 1)).astype(np.int64), rank)
            yield record_batch({
                "block": piece.column("block"),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "grams": pa.array([grams.tolist()], pa.list_(pa.int64())),
                "registers": pa.array([pack_array(registers)], pa.binary()),
            })

    schema = "block long, ids array<long>, grams array<long>, registers binary"
    return stage(stored.select("block", "payload").mapInArrow(run, schema), "quality-facts")


def distinct_bigrams(facts: DataFrame) -> int:
    """Distinct bigrams of all blocks, estimated by registers of a fixed size."""
    parts = facts.select(F.lit(0).alias("key"), F.col("registers").alias("payload"))
    rows = tree_merge(parts, np.maximum, "int8").collect()
    if not rows:
        return 0
    registers = unpack_array(rows[0].payload, "int8").astype(float)
    size, free = len(registers), int((registers == 0).sum())
    distinct = 0.7213 / (1 + 1.079 / size) * size * size / np.exp2(-registers).sum()
    return int(size * np.log(size / free) if free and distinct <= 2.5 * size else distinct)


def trusted_rows(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored ``block, answers, grams``: places of the trusted rows of a block, and their n-grams."""
    rows = facts.select("block", F.posexplode(F.arrays_zip("ids", "grams")).alias("place", "row"))
    known = rows.select("block", "place", F.col("row.ids").alias("doc_id"), F.col("row.grams").alias("grams"))
    # labels grow with the documents: one plan at every size
    met = known.filter("doc_id is not null").join(trusted_ids(labels).hint("merge"), "doc_id")
    listed = met.groupBy("block").agg(F.collect_list("place").alias("answers"), F.sum("grams").alias("grams"))
    return stage(listed, "quality-trusted")


def pack_numbers(values: np.ndarray) -> bytes:
    """Integers, mostly small: a byte each, those that do not fit it after them by the places of their bytes."""
    large = values >= ESCAPE
    small = np.where(large, ESCAPE, values).astype(np.uint8)
    planes = values[large].astype(np.int64).view(np.uint8).reshape(-1, 8).T
    # bytes are coded one by one, but for runs, as these numbers have no longer patterns; a small
    # memory level starts new codes often, as numbers in the order of others change on the way
    packer = zlib.compressobj(1, memLevel=6, strategy=zlib.Z_RLE)
    return len(values).to_bytes(4, "little") + packer.compress(small.tobytes() + planes.tobytes()) + packer.flush()


def unpack_numbers(payload: bytes) -> np.ndarray:
    size, found = int.from_bytes(payload[:4], "little"), unpack_array(payload[4:], "uint8")
    values = found[:size].astype(np.int64)
    values[found[:size] == ESCAPE] = found[size:].reshape(8, -1).T.copy().view(np.int64)[:, 0]
    return values


def rising(values: np.ndarray) -> np.ndarray:
    """Places in the order of their values, those above 16 bits last."""
    return np.argsort(np.minimum(values, 0xFFFF).astype(np.uint16), kind="stable")


def pack_question(keys: np.ndarray, raw: np.ndarray, target: np.ndarray) -> bytes:
    """Sorted buckets and their two counts, of which the second is no larger than the first."""
    gaps = pack_numbers(np.diff(keys, prepend=0))
    return len(gaps).to_bytes(4, "little") + gaps + pack_numbers(raw * (raw + 1) // 2 + target)


def unpack_question(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(payload[:4], "little")
    pairs = unpack_numbers(payload[cut:])
    raw = ((np.sqrt(8.0 * pairs + 1) - 1) / 2).astype(np.int64)
    # the root of a large number may be rounded over the next integer
    raw -= raw * (raw + 1) // 2 > pairs
    raw += (raw + 1) * (raw + 2) // 2 <= pairs
    return np.cumsum(unpack_numbers(payload[4:cut])), raw, pairs - raw * (raw + 1) // 2


def pack_answer(raw: np.ndarray, target: np.ndarray, own: np.ndarray) -> bytes:
    """Two counts of each bucket, neighbours being alike: the first in the order of the counts that
    the block has itself, the second in the order of the first."""
    first = pack_numbers(raw[rising(own)])
    return len(first).to_bytes(4, "little") + first + pack_numbers(target[rising(raw)])


def answer_size(payload: bytes) -> int:
    """Number of buckets in an answer."""
    return int.from_bytes(payload[4:8], "little")


def unpack_answer(payload: bytes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(payload[:4], "little")
    raw, target = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    raw[rising(own)] = unpack_numbers(payload[4:cut])
    target[rising(raw)] = unpack_numbers(payload[cut:])
    return raw, target


def bucket_bits(distinct: int) -> int:
    """Bucket bits of one n-gram order for a number of distinct bigrams."""
    return max(BUCKET_BITS, ceil(log2(max(1, distinct) / BUCKET_LOAD)))


def rows_of(payload: bytes | pa.Buffer) -> Iterator[pa.RecordBatch]:
    """Rows of a block in the small batches in which they were packed; the block is never whole."""
    return iter(pa.ipc.open_stream(payload))


def texts_in(payload: bytes | pa.Buffer, place: int) -> Iterator[bytes]:
    """Texts of a block one after the other."""
    for batch in rows_of(payload):
        yield from bk.texts_of(batch, place)


def number_type(bits: int) -> type:
    """Type that holds a bucket and one bit beside it."""
    return np.uint32 if bits <= 30 else np.uint64


class BucketCounter:
    """Counts numbers in ranges that begin at ``edges``, so that only one range is sorted beside the numbers."""

    def __init__(self, edges: list[int], kind: type) -> None:
        self.edges = np.array(edges, kind)
        self.found: list[list[np.ndarray]] = [[] for _ in range(len(edges) + 1)]

    def add(self, numbers: np.ndarray) -> None:
        numbers.sort()
        for held, part in zip(self.found, np.split(numbers, np.searchsorted(numbers, self.edges)), strict=True):
            # a copy of its own is free as soon as its range is counted
            held.append(part.copy())

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct numbers in order, and how often each was added, range by range."""
        for held in self.found:
            every = np.concatenate(held) if held else np.zeros(0, self.edges.dtype)
            held.clear()
            every.sort()
            starts = firsts(every)
            yield every[starts], np.diff(starts, append=len(every)).astype(every.dtype)


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Places of the numbers that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def shard_edges(bits: int, shards: int) -> list[int]:
    """The first bucket of every shard."""
    return [-(-(2 << bits) * n // shards) for n in range(shards)]


def block_counts(
    payload: bytes, place: int, bits: int, trusted: list[int], edges: list[int]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct buckets of a block in order, and their counts in all and in trusted texts.

    They come in ranges, which begin at ``edges``.
    """
    kind = number_type(bits)
    marked = np.zeros(sum(batch.num_rows for batch in rows_of(payload)), kind)
    marked[np.array(trusted, np.int64)] = 1
    counter = BucketCounter([2 * edge for edge in edges], kind)
    for numbers, parts in groups(texts_in(payload, place), GROUP_BYTES):
        buckets, piece = ngram_buckets(parts, bits)
        counter.add(buckets.astype(kind) * kind(2) + marked[np.asarray(numbers)[piece]])
    for every, often in counter.counts():
        # a bucket comes at most twice, for other and for trusted texts
        buckets = every >> kind(1)
        starts = firsts(buckets)
        if len(starts):
            counts = (np.add.reduceat(part, starts) for part in (often, often * (every & kind(1))))
            yield tuple(part.astype(np.int64) for part in (buckets[starts], *counts))


def with_counts(
    stored: DataFrame, id_place: int, place: int, labels: DataFrame, buckets: int
) -> tuple[DataFrame, int, float]:
    """Blocks ``payload, answers``, the bucket bits and the part of a log ratio that all share.

    Answers are the counts of the block's buckets in all and in trusted texts. Counts lie in
    shards, to which blocks send theirs, so no task and no driver holds all of them.
    """
    facts = block_facts(stored, id_place, place)
    trusted = trusted_rows(facts, labels)
    bits = bucket_bits(distinct_bigrams(facts))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, b: a + b)
    all_raw = facts.agg(F.sum(total)).first()[0]
    all_target = trusted.agg(F.sum("grams")).first()[0]
    if not all_target:
        return stored.select("payload").withColumn("answers", F.lit(None).cast("array<struct<bits:binary>>")), bits, 0.0
    shards = bk.shards(stored, bk.weight_of(stored))
    smooth = SMOOTHING * (2 << bits)

    def make(payload: bytes, marked: list[int]) -> Iterator[tuple[int, bytes]]:
        edges = np.array(shard_edges(bits, shards))
        for counts in block_counts(payload, place, bits, marked, edges[:: -(-shards // RANGES)].tolist()[1:]):
            shard = np.searchsorted(edges, counts[0], side="right") - 1
            for n, *parts in bk.split_by_shard(shard, *counts):
                yield n, pack_question(*parts)

    def reply(asked: list[bytes], _: list[int]) -> list[np.ndarray]:
        parts = [unpack_question(a) for a in asked]
        # the buckets of a shard are neighbours: an array over all of them is no larger than what came
        least = min(keys[0] for keys, *_ in parts)
        sums = np.zeros((2, max(keys[-1] for keys, *_ in parts) - least + 1), np.int64)
        for keys, *counts in parts:
            sums[:, keys - least] += counts
        answers = [pack_answer(*sums[:, keys - least], own) for keys, own, _ in parts]
        return [np.frombuffer(a, np.uint8) for a in answers]

    stored = stored.drop("weight")
    # blocks lie in buckets, so both joins bring what is small to them
    flagged = stored.join(trusted.select("block", "answers").hint("shuffle_hash"), "block", "left")
    replies = bk.answer(bk.ask(flagged, make), reply, None)
    offset = np.log(all_raw + smooth) - np.log(all_target + smooth)
    return bk.with_answers(stored, [replies], "shuffle_hash", buckets).select("payload", "answers"), bits, float(offset)


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that the text has twice or more."""
    windows = list(zip(*(words[n:] for n in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    count, covered = 0, 0
    for start, window in enumerate(windows):
        if seen[window] > 1:
            count += start + size - max(covered, start)
            covered = start + size
    return count


def base_measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def mean_ratios(
    payload: bytes | pa.Buffer, place: int, bits: int, answers: list[bytes], offset: float
) -> np.ndarray:
    """Log ratio per n-gram of each text of a block, 0 for a text without any."""
    kind = number_type(bits)
    size = sum(batch.num_rows for batch in rows_of(payload))
    counter = BucketCounter(shard_edges(bits, RANGES)[1:], kind)
    for _, parts in groups(texts_in(payload, place), GROUP_BYTES):
        counter.add(ngram_buckets(parts, bits)[0].astype(kind))
    keys, own = (np.concatenate(part) for part in zip(*counter.counts(), strict=True))
    ratios, start = np.empty(len(keys)), 0
    for answer in answers:
        end = start + answer_size(answer)
        raw, target = unpack_answer(answer, own[start:end])
        ratios[start:end] = np.log(target + SMOOTHING) - np.log(raw + SMOOTHING) + offset
        start = end
    del own
    total, count = np.zeros(size), np.zeros(size)
    # the n-grams are made again rather than held; in the order of their buckets they are
    # looked up in one sweep
    place_bits = np.uint64(PIECE_BYTES.bit_length())
    for numbers, parts in groups(texts_in(payload, place), GROUP_BYTES):
        buckets, piece = ngram_buckets(parts, bits)
        order = (buckets.astype(np.uint64) << place_bits) | piece.astype(np.uint64)
        order.sort()
        piece = (order & np.uint64((1 << int(place_bits)) - 1)).astype(np.int64)
        found = ratios[np.searchsorted(keys, (order >> place_bits).astype(kind))]
        texts = np.asarray(numbers)
        total += np.bincount(texts, np.bincount(piece, found, len(texts)), len(total))
        count += np.bincount(texts, np.bincount(piece, minlength=len(texts)), len(count))
    return total / np.maximum(count, 1)


def judge(texts: list[bytes], ratios: np.ndarray) -> list[tuple]:
    """Base measures, base verdict, log ratio and verdict of each text."""
    rows = []
    for text, ratio in zip(texts, ratios.tolist(), strict=True):
        base = base_measures(text)
        failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED_PERCENT * base[0]
        rows.append((*base, failed, ratio, not failed and ratio >= THRESHOLD))
    return rows


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, schema: str,
    build: Callable[[pa.Table, list[tuple]], pa.Table],
) -> DataFrame:
    """What ``build`` makes of each block of ``docs`` and the verdicts on its rows."""
    id_place, place = docs.columns.index(id_col), docs.columns.index(text_col)
    own_id, width = F.col(f"c{id_place}").cast("long"), len(docs.columns)
    plain = docs.toDF(*(f"c{n}" for n in range(width))).withColumn("id", own_id)
    weight = plain.agg(F.sum(F.octet_length(F.col(f"c{place}").cast("string")).cast("long"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-weight * BUCKETS_A_BLOCK // BLOCK_BYTES))
    stored = bk.to_bucketed_blocks(plain, "quality", BLOCK_BYTES, BLOCK_LEVEL, buckets)
    answered, bits, offset = with_counts(stored, width, place, labels, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            payload = piece.column("payload")[0].as_buffer()
            answers, means, start = piece.column("answers")[0].as_py(), None, 0
            if answers:
                means = mean_ratios(payload, place, bits, [a["bits"] for a in answers], offset)
            for batch in rows_of(payload):
                end = start + batch.num_rows
                rows = judge(bk.texts_of(batch, place), np.zeros(end - start) if means is None else means[start:end])
                plain = pa.Table.from_batches([batch])
                yield from build(plain.select(plain.column_names[:-1]), rows).to_batches()
                start = end

    return answered.mapInArrow(run, schema)


MEASURES = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("ratio", "double"), ("kept", "boolean"),
)
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Measures and verdict of every document: ``doc_id`` and ``MEASURES``.

    ``ratio`` is the log-likelihood ratio between the multinomial of trusted documents and
    that of all documents, per n-gram; a document is kept from a fixed threshold on. One
    row per input row. A null text counts as empty (and fails the base rule); a null id
    stays null and is never trusted; repeated rows count as often as they occur; other
    columns are not read; without trusted rows every ratio is 0 and the base rule alone
    decides; an empty table gives an empty table. Very long texts count whole.
    """
    def build(table: pa.Table, rows: list[tuple]) -> pa.Table:
        columns = {"doc_id": table.column(0)}
        for n, (name, kind) in enumerate(MEASURES):
            columns[name] = pa.array([r[n] for r in rows], ARROW[kind])
        return pa.table(columns)

    schema = "doc_id long, " + ", ".join(f"{n} {k}" for n, k in MEASURES)
    return judged(id_and_text(docs, id_col, text_col), labels, "doc_id", "text", schema, build)


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep; nulls as above."""
    schema = ", ".join(f"c{n} {f.dataType.simpleString()}" for n, f in enumerate(docs.schema))

    def build(table: pa.Table, rows: list[tuple]) -> pa.Table:
        return table.filter(pa.array([row[-1] for row in rows], pa.bool_()))

    return judged(docs, labels, id_col, text_col, schema, build).toDF(*docs.columns)
