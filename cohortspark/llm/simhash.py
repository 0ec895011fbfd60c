"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices, stage
from .components import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Variants that are compared at once inside a task.
LEAF_VARIANTS = 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash over word shingles, A-Z lower-cased; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    counts = np.zeros(BITS, np.int64)
    xxh64 = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], ends[at + size - 1 : at + size - 1 + CHUNK], strict=False)
        hashes = np.array([xxh64(line[a : b - 1], SEED) for a, b in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(chosen.view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, id_col: str, text_col: str, shingle_words: int, whole_rows: bool
) -> DataFrame:
    """``doc_id, fp`` of every row, and all columns as ``c0, c1, ...`` if ``whole_rows``."""
    place = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))
    doc_id = F.col(f"c{docs.columns.index(id_col)}").cast("long").alias("doc_id")
    text = F.coalesce(F.col(f"c{place}").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = plain.select(doc_id, text, *(plain.columns if whole_rows else []))
    kept = rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            fps = [fingerprint(t.as_py(), shingle_words) for t in piece.column("text")]
            columns = dict(zip(piece.schema.names, piece.columns, strict=True))
            del columns["text"]
            yield record_batch({**columns, "fp": pa.array(np.array(fps, "u8").view("i8"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(run, f"{schema}, fp long")


@lru_cache(maxsize=256)
def flip_masks(bits: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` of the lowest ``bits`` bits."""
    masks = [0]
    for n in range(1, flips + 1):
        masks += [sum(1 << b for b in chosen) for chosen in combinations(range(bits), n)]
    return np.array(masks, np.uint64)


def local_roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of the component of each of ``size`` nodes."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def colliding(
    variant: np.ndarray, owner: np.ndarray, left: np.ndarray, free: int, odd: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of owners with a common variant below one prefix.

    ``variant`` is fixed above its lowest ``free`` bits, where ``left`` more bits may flip.
    Too many variants are split by their next bit, so memory stays bounded for any number
    of fingerprints. Neighbours in the order of the variants are paired, which links each
    group of a common variant without all its pairs. For an ``odd`` radius the balls are
    unequal: an owner with a flip to spare is near all others, and is paired with them.
    """
    if len(np.unique(owner)) < 2:
        return
    masks = {n: flip_masks(free, n) for n in np.unique(left).tolist()}
    count = sum(len(masks[n]) * int((left == n).sum()) for n in masks)
    if count > LEAF_VARIANTS and free > 16:
        bit = np.uint64(1 << (free - 1))
        more = left > 0
        every = np.concatenate([variant, variant[more] ^ bit])
        owners = np.concatenate([owner, owner[more]])
        lefts = np.concatenate([left, left[more] - 1])
        high = (every & bit) != 0
        for side in (high, ~high):
            yield from colliding(every[side], owners[side], lefts[side], free - 1, odd)
        return
    every, owners, outer = [], [], []
    for n, mask in masks.items():
        of = left == n
        every.append((variant[of][:, None] ^ mask[None, :]).ravel())
        owners.append(np.repeat(owner[of], len(mask)))
        outer.append(np.tile(np.bitwise_count(mask) == n, int(of.sum())))
    values, who = np.concatenate(every), np.concatenate(owners)
    if odd:
        far = np.concatenate(outer)
        order = np.lexsort((far, values))
        values, who, far = values[order], who[order], far[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        first = np.repeat(starts, np.diff(np.append(starts, len(values))))
        same = np.flatnonzero(~far[first] & (first != np.arange(len(values))))
        if len(same):
            yield who[first[same]], who[same]
        return
    order = np.argsort(values)
    values, who = values[order], who[order]
    same = np.flatnonzero(values[1:] == values[:-1])
    if len(same):
        yield who[same], who[same + 1]


def bucket_links(variants: np.ndarray, fps: np.ndarray, left: np.ndarray, free: int, max_bits: int):
    """Spanning links of the fingerprints of one bucket: each to the least of its component."""
    distinct, owner = np.unique(fps, return_inverse=True)
    found: list[np.ndarray] = []
    size = len(distinct)
    for a, b in colliding(variants, owner, left, free, max_bits & 1):
        near = np.bitwise_count(distinct[a] ^ distinct[b]) <= max_bits
        code = np.minimum(a, b)[near] * size + np.maximum(a, b)[near]
        found.append(np.unique(code[(a != b)[near]]))
        if sum(map(len, found)) > LEAF_VARIANTS:
            found = [spanning(size, np.unique(np.concatenate(found)))]
    if not found:
        return distinct[:0], distinct[:0]
    code = spanning(size, np.unique(np.concatenate(found)))
    return distinct[code % size], distinct[code // size]


def spanning(size: int, code: np.ndarray) -> np.ndarray:
    """Coded links replaced by links to the least node of each component."""
    root = local_roots(size, code // size, code % size)
    node = np.flatnonzero(root != np.arange(size))
    return root[node] * size + node


def ball_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints at ``max_bits`` or fewer bits.

    Every fingerprint emits all variants within half the radius; two are near exactly when
    they meet in a variant, within the lesser half of one and the greater of the other if
    the radius is odd. A variant travels as the fingerprint and its own highest bits,
    which choose the bucket; the flips of the lower bits are made there. The number of
    highest bits follows the number of fingerprints, so buckets keep their size.
    """
    flips = (max_bits + 1) // 2
    ball = len(flip_masks(BITS, flips))
    bits = max(4, min(28, int(fps.count() * ball // LEAF_VARIANTS).bit_length()))
    shift = np.uint64(BITS - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flip_masks(bits, flips)
        for piece in slices(batches, 4096):
            own = piece.column("fp").to_numpy(zero_copy_only=False).view("u8")
            bucket = ((own >> shift)[:, None] ^ masks[None, :]).ravel().astype(np.int32)
            fp = np.repeat(own, len(masks)).view("i8")
            yield record_batch({"bucket": pa.array(bucket), "fp": pa.array(fp)})

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.column("fp").to_numpy().view("u8")
        top = np.uint64(key[0].as_py()) << shift
        flipped = (own ^ top) >> shift
        left = flips - np.bitwise_count(flipped).astype(np.int64)
        a, b = bucket_links(own ^ (flipped << shift), own, left, BITS - bits, max_bits)
        return pa.table({"a": pa.array(a.view("i8")), "b": pa.array(b.view("i8"))})

    meet.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    variants = fps.select("fp").mapInArrow(emit, "bucket int, fp long")
    return variants.groupBy("bucket").applyInArrow(meet, "a long, b long")


def classes(
    docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int, whole_rows: bool
) -> tuple[DataFrame, DataFrame]:
    """Stored rows with ``rid, doc_id, fp``, and ``fp -> first``, the first row of its class.

    ``first`` is the least (no id, doc_id, rid): rows without an id come last.
    """
    rows = stage(
        with_fingerprint(docs, id_col, text_col, shingle_words, whole_rows)
        .withColumn("rid", F.monotonically_increasing_id()),
        "fingerprints",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first")
    distinct = stage(rows.groupBy("fp").agg(first), "distinct")
    roots = components(ball_links(distinct, max_bits))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first"
    )
    member = stage(member, "members")
    least = member.groupBy("root").agg(F.min("first").alias("first"))
    return rows, member.drop("first").join(least, "root").select("fp", "first")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; fingerprints link at ``max_bits`` or fewer bits.

    ``component_id`` is the least doc_id reachable over links; rows without an id take the
    least id of their class, null where the class has none. A null text counts as empty;
    texts without words have fingerprint 0; repeated rows share a class; other columns
    are not read; an empty table gives an empty table. Very long texts are shingled whole.
    """
    rows, members = classes(docs, id_col, text_col, shingle_words, max_bits, whole_rows=False)
    return rows.join(members, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of every class, all columns: that of the least doc_id (none last)."""
    rows, members = classes(docs, id_col, text_col, shingle_words, max_bits, whole_rows=True)
    keep = members.select(F.col("first.rid").alias("rid")).distinct()
    kept = rows.join(keep, "rid", "left_semi")
    return kept.select(*(f"c{n}" for n in range(len(docs.columns)))).toDF(*docs.columns)
