"""Benchmark decontamination by canonical templates and slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_and_bytes, pack_array, record_batch, slices, tree_merge, unpack_array
from .substrings import window_hashes
from .tokens import mix

#: Words of a template window; shorter items are one window of their own.
WINDOW = 8
#: Items of fewer words are too short to be told from ordinary text.
SHORTEST = 5
#: Bits of the fixed-size filter of benchmark windows: 2 MB at any size of the benchmark.
FILTER_BITS = 24
MEMO = 200_000

PUNCTUATION = b".,;:!?\"'()[]{}<>"
# an end mark and the quotes and brackets that close after it
SENTENCE_END = re.compile(rb"[.!?:](?:[\"')\]}>]|\xe2\x80[\x99\x9d]|\xc2\xbb)*$")
# characters of scripts that put no spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han
SPACELESS = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
    "\uf900-\ufaff\U00020000-\U0003ffff]"
)
SPACELESS_LEAD = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
NUMBER = re.compile(rb"[+-]?(?:[$]|\xe2\x82\xac|\xc2\xa3)?[0-9][0-9.,:/]*%?")
NAME = re.compile(rb"(?:[A-Z]|\xc3[\x80-\x9e])(?:[a-z'-]|[\x80-\xff])+")
# Number words and units that a template replaces.
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    b"sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    b"hundred thousand million billion".split()
)
UNITS = frozenset(
    b"mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer "
    b"kilometers g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter "
    b"liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    b"month months year years dollar dollars cent cents euro euros percent mph degrees".split()
)
LITERAL, IS_NUMBER, IS_UNIT, IS_NAME = range(4)
#: Forms of a window by its first word: as it is, as a name, as a name that opens a sentence.
AS_IS, AS_NAME, AS_OPENING_NAME = range(3)
# Hashes that stand for the placeholders of the three types.
_SLOT = mix(np.array([1, 2, 3], np.uint64))
_EXACT = np.uint64(0xD6E8FEB86659FD93)
_AFTER = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> tuple[list[bytes], int]:
    """Words of a text, and how many of them are single characters of unspaced scripts."""
    if not SPACELESS_LEAD.search(text):
        return text.split(), 0
    spaced, count = SPACELESS.subn(r" \g<0> ", text.decode("utf-8", "surrogateescape"))
    return (spaced.encode("utf-8", "surrogateescape") if count else text).split(), count


class WordShapes(dict):
    """Memo from word to (hash of the bare word, type, ends a sentence) in one integer."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(PUNCTUATION)
        low = bare.lower()
        if NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
            kind = IS_NUMBER
        elif low in UNITS:
            kind = IS_UNIT
        else:
            kind = IS_NAME if NAME.fullmatch(bare) else LITERAL
        shape = xxhash.xxh3_64_intdigest(low or word) & ~7 | kind | 4 * bool(SENTENCE_END.search(word))
        if len(self) >= MEMO:
            self.clear()
        self[word] = shape
        return shape


#: One memo per Python process.
SHAPES = WordShapes()


class Templates:
    """Canonical words of some texts, one after the other.

    Numbers, units and names become typed placeholders. A capitalised word is a name unless
    it starts the text or a sentence. What precedes a window differs between an item and its
    copy, so a window whose first word may be a name has two forms, with and without one.
    Windows of few literal words keep the words themselves. A character of an unspaced
    script is a word.
    """

    def __init__(self, texts: list[bytes]):
        split = [split_words(t) for t in texts]
        self.words = [words for words, _ in split]
        self.spaceless = [count for _, count in split]
        sizes = np.array([len(w) for w in self.words], np.int64)
        total = int(sizes.sum())
        shape = np.fromiter(map(SHAPES.__getitem__, chain.from_iterable(self.words)), np.uint64, total)
        kind = (shape & np.uint64(3)).astype(np.int8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        opens = np.zeros(total + 1, bool)
        opens[self.starts] = True
        opens[1:] |= (shape & np.uint64(4)) > 0
        self.named = kind == IS_NAME
        self.opening = self.named & opens[:-1]
        kind[self.opening] = LITERAL
        self.kind = kind
        self.value = shape >> np.uint64(3)
        hashes = mix(self.value)
        for slot in (IS_NUMBER, IS_UNIT, IS_NAME):
            hashes[kind == slot] = _SLOT[slot - 1]
        self.hash = hashes
        self.left = np.repeat(self.starts[1:], sizes) - np.arange(total)
        self.literals = np.concatenate([[0], np.cumsum(kind == LITERAL)])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and forms of the windows inside one text.

        Windows that are not mostly literal words would match too much as templates and are
        hashed by their words.
        """
        count = max(0, len(self.hash) - length + 1)
        at = np.flatnonzero(self.left[:count] >= length)
        after = window_hashes(self.hash, length - 1, 0)[at + 1] if length > 1 else np.zeros(len(at), np.uint64)
        literal = self.literals[at + length] - self.literals[at + 1]
        named = self.named[at]
        as_is = np.where(named, mix(self.value[at]), self.hash[at])
        found = []
        for form, first, plain in (
            (AS_IS, as_is, named | (self.kind[at] == LITERAL)),
            (AS_NAME, np.full(len(at), _SLOT[IS_NAME - 1]), np.zeros(len(at), bool)),
        ):
            hashes = mix(mix(first) + after * _AFTER + np.uint64(length))
            use = 2 * (literal + plain) >= length
            if form == AS_IS:
                if not use.all():
                    exact = window_hashes(mix(self.value), length, 1)[at] + np.uint64(length)
                    hashes = np.where(use, hashes, mix(exact ^ _EXACT))
                use[:] = True
            else:
                use &= named
            forms = form + ((form == AS_NAME) & self.opening[at[use]])
            found.append((at[use], hashes[use], forms))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    def is_slot(self, at: int, length: int, form: int) -> np.ndarray:
        """Which words of a window are placeholders."""
        chosen = self.kind[at : at + length] != LITERAL
        chosen[0] = form != AS_IS or (chosen[0] and not self.named[at])
        return chosen

    def slots(self, at: int, length: int, form: int) -> list[int]:
        """Values of the placeholders of a window, in order."""
        return self.value[at : at + length][self.is_slot(at, length, form)].astype(np.int64).tolist()

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def item_length(words: int, spaceless: int, window: int) -> int:
    """Length of the windows of an item, 0 if it is too short.

    In unspaced scripts two characters count for a word.
    """
    scale = 2 if 2 * spaceless > words else 1
    return min(words, scale * window) if words >= scale * SHORTEST else 0


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """All windows of all items.

    Columns ``hash, length, item, words, item_at, item_form, item_slots, literal_at``: ``words``
    is the length of the item, ``literal_at`` the places of literal words in it.

    A window without placeholders needs no other window to be judged, so the least item
    stands for it. Items of one text count once, as the least of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            ids = piece.column("doc_id").to_pylist()
            rows = []
            for item, text in zip(ids, piece.column("text").to_pylist(), strict=True):
                one = Templates([text])
                length = item_length(len(one.hash), one.spaceless[0], window)
                if length:
                    at, hashes, forms = one.windows(length)
                    rows += [
                        (h, length, item, len(one.hash), a, f, one.slots(a, length, f),
                         (a + np.flatnonzero(~one.is_slot(a, length, f))).tolist())
                        for a, h, f in zip(at.tolist(), hashes.astype(np.int64).tolist(), forms.tolist(), strict=True)
                    ]
            places, values = pa.list_(pa.int32()), pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), values, places)
            names = ("hash", "length", "item", "words", "item_at", "item_form", "item_slots", "literal_at")
            yield record_batch({
                n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)
            })

    distinct = items.filter("doc_id is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    schema = (
        "hash long, length int, item long, words int, item_at int, item_form int, "
        "item_slots array<long>, literal_at array<int>"
    )
    every = distinct.mapInArrow(run, schema)
    slotted = F.size("item_slots") > 0
    rest = ("item", "item_at", "length", "words", "item_form", "item_slots", "literal_at")
    least = F.min(F.struct(*rest)).alias("least")
    keys = [F.when(slotted, F.col(n)).alias(f"own_{n}") for n in ("item", "item_at")]
    return every.groupBy("hash", *keys).agg(least).select("hash", "least.*")


def window_filter(windows: DataFrame) -> np.ndarray:
    """Bit array of the hashes of all windows, of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[filter_place(batch.column("hash").to_numpy(zero_copy_only=False))] = True
        if bits.any():
            packed = pack_array(np.packbits(bits))
            yield record_batch({"key": pa.array([0], pa.int32()), "payload": pa.array([packed], pa.binary())})

    parts = windows.select("hash").mapInArrow(run, "key int, payload binary")
    rows = tree_merge(parts, np.bitwise_or, "uint8").collect()
    return unpack_array(rows[0].payload, "uint8") if rows else np.zeros(1 << FILTER_BITS >> 3, np.uint8)


def in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    place = filter_place(hashes)
    return (packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def filter_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view("u8") >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def document_windows(docs: DataFrame, packed: np.ndarray, lengths: list[int]) -> DataFrame:
    """``doc_id, row_key, hash, doc_at, doc_form, doc_slots`` of windows that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = Templates(piece.column("text").to_pylist())
            rows, owners = [], []
            for length in lengths:
                at, hashes, forms = texts.windows(length)
                hit = in_filter(packed, hashes)
                at, hashes, forms = at[hit], hashes[hit].astype(np.int64), forms[hit]
                owner = texts.owner(at)
                owners += owner.tolist()
                places = (at - texts.starts[owner]).tolist()
                rows += [
                    (h, place, f, texts.slots(a, length, f))
                    for a, h, place, f in zip(at.tolist(), hashes.tolist(), places, forms.tolist(), strict=True)
                ]
            if rows:
                owners = pa.array(owners, pa.int64())
                yield record_batch({
                    "doc_id": piece.column("doc_id").take(owners),
                    "row_key": piece.column("row_key").take(owners),
                    "hash": pa.array([r[0] for r in rows], pa.int64()),
                    "doc_at": pa.array([r[1] for r in rows], pa.int32()),
                    "doc_form": pa.array([r[2] for r in rows], pa.int32()),
                    "doc_slots": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                })
        SHAPES.clear()  # the worker process lives on

    schema = "doc_id long, row_key long, hash long, doc_at int, doc_form int, doc_slots array<long>"
    return docs.mapInArrow(run, schema)


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str,
    item_col: str, item_text_col: str, window: int,
) -> DataFrame:
    """``doc_id, row_key, n_windows, items`` of documents that hold part of an item.

    Windows that meet form alignments of a document and an item. An alignment counts if
    its placeholders are consistent: each value of the item stands for one value of the
    document throughout, and a window of it has the item's own values, or as many literal
    words agree as a window has words, or the whole item does; its opening word is judged
    apart, as it may or may not be a name. A window without placeholders counts by itself.
    Each window of a document names the least item of those whose alignments count.
    """
    items = id_and_bytes(benchmark, item_col, item_text_col)
    asked = benchmark_windows(items, window)
    # at most twice ``window`` different lengths
    lengths = sorted(r.length for r in asked.select("length").distinct().collect())
    texts = id_and_bytes(docs, id_col, text_col).withColumn("row_key", F.xxhash64(F.col("text").cast("string")))
    met = document_windows(texts, window_filter(asked), lengths).join(asked, "hash")
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("doc_slots").alias("doc"))
    aligned = (
        # an equal opening word has matched as it is
        met.withColumn("opening", F.greatest("item_form", "doc_form") == AS_OPENING_NAME)
        .filter(~F.col("opening") | (F.get("item_slots", F.lit(0)) != F.get("doc_slots", F.lit(0))))
        .withColumn("shift", F.col("doc_at") - F.col("item_at"))
        .withColumn("plain", F.size("item_slots") == 0)
        .withColumn("pairs", pairs)
    )
    covered = F.sequence("item_at", F.col("item_at") + F.col("length") - 1)
    # one window per position of an item on an alignment, so the lists are bounded by the item
    checked = (
        aligned.groupBy("doc_id", "row_key", "item", "shift", "plain", "opening")
        .agg(
            F.collect_set(F.struct("doc_at", "length")).alias("windows"),
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
            F.max(F.col("item_slots") == F.col("doc_slots")).alias("own_values"),
            F.size(F.array_distinct(F.flatten(F.collect_set("literal_at")))).alias("literals"),
            # but for the opening word of the item
            F.size(F.array_remove(F.array_distinct(F.flatten(F.collect_set(covered))), 0)).alias("covered"),
            F.max("words").alias("words"),
        )
        .filter(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))))
        .filter(F.col("own_values") | (F.col("literals") >= window) | (F.col("covered") >= F.col("words") - 1))
    )
    held = checked.select("doc_id", "row_key", "item", F.explode("windows").alias("window"))
    named = held.groupBy("doc_id", "row_key", "window").agg(F.min("item").alias("item"))
    return named.groupBy("doc_id", "row_key").agg(
        F.count("*").alias("n_windows"), F.sort_array(F.collect_set("item")).alias("items")
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """``doc_id, contaminated boolean, n_windows long, items array<long>`` of every row.

    Template windows of the benchmark are hash-joined with those of the documents; a filter of
    fixed size keeps other windows from travelling. Windows with few literal words are joined
    by the words themselves, and characters of unspaced scripts are words, two of which
    count as one in all lengths. Windows that match with other numbers, units or names
    only count if ``window`` literal words of an alignment agree, or the item as a whole.
    Items of fewer than ``SHORTEST`` words
    or without an id are not looked for. Every item that has a window is tested; a window
    that several items pass counts for the least of them. A null text counts as empty and is clean; a null id stays null;
    repeated rows get the same verdict; other columns are not read; an empty table on
    either side gives no leaks. Very long texts are searched whole. A template matches by 64
    hash bits.
    """
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), _row_key(column(text_col)).alias("row_key"))
    found = found.withColumnsRenamed({"doc_id": "leak_id", "row_key": "leak_key"})
    same = rows["doc_id"].eqNullSafe(found["leak_id"]) & (rows["row_key"] == found["leak_key"])
    return rows.join(found, same, "left").select(
        "doc_id",
        F.col("leak_key").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no part of an item; rules as above."""
    found = contaminated(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    found = found.select(F.col("doc_id").alias("leak_id"), F.col("row_key").alias("leak_key"))
    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))
    own_id = plain[f"c{docs.columns.index(id_col)}"].cast("long")
    own_key = _row_key(plain[f"c{docs.columns.index(text_col)}"])
    same = own_id.eqNullSafe(found["leak_id"]) & (own_key == found["leak_key"])
    return plain.join(found, same, "left_anti").toDF(*docs.columns)
