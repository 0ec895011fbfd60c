"""Spelling variants: words one letter apart, found in a trie of letter counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, record_batch, slices, stage

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A word's variant of largest count is its form if it is so many times as frequent.
RATIO = 10
#: One in so many (document, word) pairs loses a letter.
SLIP = 31

# Letters of a word, after A-Z are lower-cased, in Latin-1.
LETTERS = "a-zÀ-ÿ"
#: Letters from common to rare; one level of the trie each.
LEVELS = "etaoinsrhldcumfpgwybvkxjqz"

#: Words that one bucket holds; more make the buckets finer.
BUCKET_WORDS = 100_000
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
#: Trie nodes, and pairs of words, that are looked at together.
FRONT = 1 << 17
#: Leaves of more words are asked for each spelling instead of being read.
LEAF_WORDS = 256
#: Words up to this length are compared together.
SHORT = 40


def level_table() -> np.ndarray:
    """Level of each Latin-1 letter; letters beyond a-z share the levels."""
    table = np.arange(256) % len(LEVELS)
    table[[ord(c) for c in LEVELS]] = np.arange(len(LEVELS))
    return table


LEVEL_OF = level_table()


def slip(doc: int, word: str, every: int) -> str:
    """The word, without one letter if ``every`` divides the hash of ``<document>:<word>``."""
    value = crc32(word.encode("utf-8"), doc)
    if value % every:
        return word
    at = value % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = SLIP,
) -> DataFrame:
    """Stored ``word, n``: words of all texts and how often they occur.

    A word is a maximal run of letters, A-Z lower-cased, without one letter if ``every`` divides
    the CRC-32 of ``<id>:<run>``; shorter and rarer words are left out. A null text has no
    words; a null id counts as an empty one; repeated rows count as often as they occur.
    Very long texts are read whole. Tasks count before the exchange, so that a word which all
    documents have is one row of each task.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = {"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}
            total.clear()
            return record_batch(rows)

        for piece in slices(batches):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text"), strict=True):
                own = Counter(runs.findall(text.as_py().lower().decode("utf-8")))
                doc = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    word = slip(doc, word, every)
                    if len(word) >= least_letters:
                        total[word] += n
            if len(total) >= COUNTED:
                yield flush()
        if total:
            yield flush()

    counted = id_and_bytes(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    return stage(words, "words")


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Letters of each level in each Latin-1 word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    levels = LEVEL_OF[np.frombuffer(b"".join(words), np.uint8)]
    cells = np.repeat(np.arange(len(words)), sizes) * len(LEVELS) + levels
    return np.bincount(cells, minlength=len(words) * len(LEVELS)).reshape(-1, len(LEVELS))


def coarse_counts(counts: np.ndarray, groups: int) -> np.ndarray:
    """Letter counts of ``groups`` groups of levels."""
    return np.stack([counts[:, g::groups].sum(axis=1) for g in range(groups)], axis=1)


def moves(groups: int) -> np.ndarray:
    """Differences of the group counts of two words one letter apart, one of each sign, and none."""
    unit = np.eye(groups, dtype=np.int64)
    found = [np.zeros(groups, np.int64), *unit]
    found += [unit[i] - unit[j] for i in range(groups) for j in range(i + 1, groups)]
    return np.array(found)


class Trie:
    """Trie over the letter counts of words, a level a letter group; words of one leaf agree in all.

    Level by level its nodes are the sorted codes (parent, count), so a child is a binary
    search, also for many words at once.
    """

    def __init__(self, counts: np.ndarray, order: np.ndarray):
        self.levels = order
        self.rows = np.lexsort(counts[:, order[::-1]].T)
        ranked = counts[self.rows][:, order]
        self.most = int(ranked.max()) if ranked.size else 0
        self.codes = []
        node = np.zeros(len(ranked), np.int64)
        for level in range(len(order)):
            code = node * (self.most + 1) + ranked[:, level]
            first = np.concatenate([[True], code[1:] != code[:-1]])
            self.codes.append(code[first])
            node = np.cumsum(first) - 1
        self.starts = np.append(np.flatnonzero(first), len(ranked))

    def leaves(self, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """Leaves that each asked count vector reaches: ``(asked, leaf, over, under)``.

        Depth first. On its way a vector may meet one count that is one more than its own and one
        that is one less, at levels where ``surplus`` and ``deficit`` allow it; ``over`` and
        ``under`` are those levels, -1 for a budget not spent.
        """
        size = len(asked)
        none = np.full(size, -1)
        stack = [(0, np.arange(size), np.zeros(size, np.int64), none, none)]
        while stack:
            level, who, node, over, under = stack.pop()
            if level == len(self.levels):
                yield who, node, over, under
                continue
            if len(who) > FRONT:
                half = len(who) // 2
                for part in (slice(half, None), slice(half)):
                    stack.append((level, who[part], node[part], over[part], under[part]))
                continue
            letter, codes, found = self.levels[level], self.codes[level], []
            for step in (0, 1, -1):
                free = np.ones(len(who), bool) if step == 0 else (
                    (over < 0) & surplus[who, letter] if step > 0 else (under < 0) & deficit[who, letter]
                )
                want = asked[who, letter] + step
                at = np.flatnonzero(free & (want >= 0) & (want <= self.most))
                code = node[at] * (self.most + 1) + want[at]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[place] == code
                at, place = at[hit], place[hit]
                spent = np.full(len(at), letter)
                found.append((
                    who[at], place, spent if step > 0 else over[at], spent if step < 0 else under[at],
                ))
            parts = [np.concatenate(part) for part in zip(*found, strict=True)]
            if len(parts[0]):
                stack.append((level + 1, *parts))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def padded(words: list[bytes]) -> np.ndarray:
    """Short words as rows of bytes; long ones are empty."""
    cut = [w if len(w) <= SHORT else b"" for w in words]
    return np.array(cut, f"S{SHORT + 1}").view(np.uint8).reshape(len(words), -1)


def near_pairs(words: list[bytes], chars: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs are one letter apart."""
    near = np.zeros(len(a), bool)
    swap = sizes[a] > sizes[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    short = sizes[b] <= SHORT
    at = np.flatnonzero(short & (sizes[a] == sizes[b]))
    near[at] = (chars[a[at]] != chars[b[at]]).sum(axis=1) == 1
    at = np.flatnonzero(short & (sizes[a] + 1 == sizes[b]))
    less, more = chars[a[at]], chars[b[at]]
    seam = (less != more).argmax(axis=1)
    rest = np.where(np.arange(less.shape[1] - 1) < seam[:, None], more[:, :-1], more[:, 1:])
    near[at] = (rest == less[:, :-1]).all(axis=1)
    for n in np.flatnonzero(~short):
        near[n] = one_edit(words[a[n]], words[b[n]])
    return near


def spellings(word: bytes, over: int, under: int) -> Iterator[bytes]:
    """Words one letter from ``word`` with one letter more of the level ``over``, one less of ``under``.

    -1 for neither: with both -1 a letter is replaced by another of its level.
    """
    codes = [*range(97, 123), *range(192, 256)]
    of_level = lambda level: [bytes([c]) for c in codes if LEVEL_OF[c] == level]
    if under < 0 <= over:
        for n in range(len(word) + 1):
            for letter in of_level(over):
                yield word[:n] + letter + word[n:]
        return
    for n, code in enumerate(word):
        level = int(LEVEL_OF[code])
        if under >= 0 and level != under:
            continue
        if over < 0 <= under:
            yield word[:n] + word[n + 1 :]
        else:
            for letter in of_level(over if over >= 0 else level):
                yield word[:n] + letter + word[n + 1 :]


def pairs_of(words: list[bytes], owner: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of words one letter apart, at least one of them an owner, each pair once.

    Owners share their group counts and make the trie. A word with other group counts spends
    its budgets in the groups that differ; owners spend both in one group.
    """
    counts = letter_counts(words)
    sizes, chars = np.fromiter(map(len, words), np.int64, len(words)), padded(words)
    home = np.flatnonzero(owner)
    order = np.argsort(np.arange(len(LEVELS)) % groups, kind="stable")
    trie = Trie(counts[home], order)
    leaf_rows, place = home[trie.rows], {words[n]: n for n in home.tolist()}
    target = coarse_counts(counts[home[:1]], groups)[0]
    for start in range(0, len(words), FRONT):
        asked = counts[start : start + FRONT]
        gap = target - coarse_counts(asked, groups)
        alike = ~gap.any(axis=1)[:, None]
        of_group = np.arange(len(LEVELS)) % groups
        surplus, deficit = (alike | (gap == sign) for sign in (1, -1))
        for who, leaf, over, under in trie.leaves(asked, surplus[:, of_group], deficit[:, of_group]):
            who = who + start
            size = trie.starts[leaf + 1] - trie.starts[leaf]
            big = size > LEAF_WORDS
            for n in np.flatnonzero(big).tolist():
                found = {place.get(s, -1) for s in spellings(words[who[n]], int(over[n]), int(under[n]))}
                other = np.array(sorted(found - {-1, int(who[n])}), np.int64)
                if owner[who[n]]:
                    other = other[other > who[n]]
                yield np.full(len(other), who[n]), other
            who, leaf, size = who[~big], leaf[~big], size[~big]
            ends = np.cumsum(size)
            cut = 0
            while cut < len(who):
                stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + FRONT)))
                many = size[cut:stop]
                a = np.repeat(who[cut:stop], many)
                inside = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
                b = leaf_rows[np.repeat(trie.starts[leaf[cut:stop]], many) + inside]
                once = ~owner[a] | (a < b)
                a, b = a[once], b[once]
                near = near_pairs(words, chars, sizes, a, b)
                yield a[near], b[near]
                cut = stop


def best_variants(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that have near words, how many, and the one of largest count (ties: smaller number)."""
    both, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((other, -n[other], both))
    both, other = both[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else both
    return both[first], np.diff(np.append(first, len(both))), other[first]


def latin(cells: pa.Array) -> list[bytes]:
    """Words in Latin-1, a byte a letter, which sort as their code points do."""
    return [word.encode("latin-1") for word in cells.to_pylist()]


def packed(counts: np.ndarray) -> pa.Array:
    """Rows of counts as binary keys."""
    width = 4 * counts.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(counts, "<u4"))
    return pa.Array.from_buffers(pa.binary(width), len(counts), [None, data]).cast(pa.binary())


def bucket_groups(words: DataFrame, most: int) -> int:
    """Least even number of letter groups whose fullest bucket holds ``most`` words.

    As many as there are levels where no fewer do; a bucket then holds words with equal counts.
    """
    for groups in range(4, len(LEVELS), 2):

        def keys(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, 4096):
                yield record_batch({"key": packed(coarse_counts(letter_counts(latin(piece.column("word"))), groups))})

        filled = words.select("word").mapInArrow(keys, "key binary").groupBy("key").count()
        if (filled.agg(F.max("count")).first()[0] or 0) <= most:
            return groups
    return len(LEVELS)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_word, form_n`` of the words that have near words.

    ``n_near`` counts the words one inserted, deleted or replaced letter away, ``form_word`` is the
    one of largest count. A word goes to the bucket of its letter-group counts and, as a
    visitor, to those one letter apart on one side, so each pair meets once.
    """
    groups = bucket_groups(words, BUCKET_WORDS)
    steps = moves(groups)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 4096):
            own = coarse_counts(letter_counts(latin(piece.column("word"))), groups)
            for step in steps:
                moved = own + step
                rows = np.flatnonzero((moved >= 0).all(axis=1))
                chosen = piece.take(pa.array(rows))
                yield record_batch({
                    "bucket": packed(moved[rows]), "word": chosen.column("word"), "n": chosen.column("n"),
                    "owner": pa.array(np.full(len(rows), not step.any())),
                })

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        owner = table.column("owner").to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, ...]] = []
        if owner.any() and len(owner) > 1:
            text = latin(table.column("word"))
            order = np.array(sorted(range(len(text)), key=text.__getitem__))
            text, n = [text[k] for k in order], table.column("n").to_numpy()[order]
            pairs = list(pairs_of(text, owner[order], groups))
            if pairs:
                who, many, form = best_variants(*(np.concatenate(p) for p in zip(*pairs, strict=True)), n)
                found.append((order[who], many, order[form], n[form]))
        who, many, form, n = (np.concatenate(p) for p in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        name = table.column("word")
        return pa.table({
            "word": name.take(pa.array(who)), "n_near": pa.array(many, pa.int64()),
            "form_word": name.take(pa.array(form)), "form_n": pa.array(n, pa.int64()),
        })

    meet.__annotations__ = {"table": pa.Table, "return": pa.Table}
    asked = words.mapInArrow(emit, "bucket binary, word string, n long, owner boolean")
    met = asked.groupBy("bucket").applyInArrow(meet, "word string, n_near long, form_word string, form_n long")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form_word")).alias("first")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", F.col("first.form_word").alias("form_word"), (-F.col("first.less")).alias("form_n")
    )


def roots(forms: DataFrame, depth: int) -> DataFrame:
    """``word, root``: the last word that following ``word, form`` from ``word`` leads to.

    Chains of up to ``depth`` steps, halved by each round.
    """
    current = forms.select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(1, depth)))):
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        moved = current.join(further, "root", "left")
        current = stage(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
    return current


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of stored ``word, n``.

    Near words differ by one inserted, deleted or replaced letter. ``form`` is the near word of
    largest ``n`` (ties: the first in code-point order) if it is at least ``ratio`` times as
    frequent, else null; ``root`` is where forms lead to in the end, the word itself without one.
    Words are distinct, of Latin-1 letters, and have positive counts; no words give an empty table.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    near = near_words(words).hint("merge")
    is_form = F.col("form_n") >= ratio * F.col("n")
    joined = stage(
        words.join(near, "word", "left").select(
            "word", F.when(is_form, F.col("form_word")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "near-words",
    )
    least, most = words.agg(F.min("n"), F.max("n")).first()
    # every step to a form multiplies the count
    depth = int(log(most / least, ratio) + 1e-9) if most else 0
    last = roots(joined.filter("form IS NOT NULL"), depth).hint("merge")
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
