"""Token counts of every prefix of a text, for a BPE vocabulary with word ends."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Sequence
from functools import lru_cache
from operator import sub
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import column, id_and_text, map_slices, record_batch

#: Tokens above which a text is over the limit.
TOKEN_LIMIT = 2048
#: Distinct words, starts of words and seams that a Python worker remembers. Results do not depend on it.
MEMO = 250_000
#: Starts of words up to this length are remembered: words that begin alike share their counts.
HEAD_BYTES = 16

# The mark of a word's end and the pre-splitting pattern of the public vocabulary.
WORD_END = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

NO_TOKEN = (-1, -1)
SPLIT = regex.compile(WORDS + r"|\s+")
SOLID = regex.compile(r"\S")


def _narrow_split() -> tuple[re.Pattern, re.Pattern]:
    """The same pattern as plain character ranges for texts below U+0250, which is faster."""
    chars = [chr(c) for c in range(0x250)]
    letter, number, space = (
        "".join(f"\\u{ord(c):04x}" for c in chars if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")
    )
    words = rf"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^{space}{letter}{number}]+|[{space}]+"
    return re.compile(words), re.compile("[^\u0000-\u024f]")


NARROW, WIDE_CHARACTER = _narrow_split()


def cover(text: str) -> list[str]:
    """Pre-split words and the white space between them; joined they are the text."""
    return (SPLIT if WIDE_CHARACTER.search(text) else NARROW).findall(text)


def lowered(text: str) -> str:
    """Every character lower-cased by itself, so a final sigma is like any other."""
    return text.replace("Σ", "σ").lower()


class PrefixCounter:
    """Exact token counts of all prefixes of a word by dynamic programming over its bytes.

    ``last[i]`` is the last token of the first ``i`` bytes and ``count[i]`` their number of
    tokens. Just one token that ends at ``i`` can follow what stands before it without a
    merge across the seam, so ``count[i] = count[i - len] + 1`` needs the two tokens at the
    seam only. A prefix that is a whole word ends in a token with the word-end mark; it is one
    more step from a position inside the word.
    """

    def __init__(self, vocab: dict[str, int], merges: Sequence, special: Sequence[str]):
        letters = byte_letters()
        size = max(vocab.values()) + 1
        self.digest = crc32(repr((list(vocab.items()), list(merges), list(special))).encode())
        self.special = sorted(special, key=len, reverse=True)
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.rank: dict[tuple[int, int], int] = {}
        self.seams: dict[int, bool] = {}
        # last token, token count and whole-word count of the starts of words
        self.heads: dict[bytes | None, tuple[int, int, int]] = {}
        # tokens of a label inside and at the end of a word, -1 for none, also for what ends labels
        self.known: dict[bytes, tuple[int, int]] = {}
        names = [letter + mark for letter in letters for mark in ("", WORD_END)]
        for rank, merge in enumerate(merges, 1):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[u + v]
            self.left[whole], self.right[whole], self.born[whole] = vocab[u], vocab[v], rank
            self.rank[vocab[u], vocab[v]] = rank
            names.append(u + v)
        for name in names:
            ends = name.endswith(WORD_END)
            label = bytes(letters[c] for c in (name[: -len(WORD_END)] if ends else name))
            inner, final = self.known.get(label, NO_TOKEN)
            self.known[label] = (inner, vocab[name]) if ends else (vocab[name], final)
        for label in list(self.known):
            for n in range(1, len(label)):
                self.known.setdefault(label[n:], NO_TOKEN)

    def __getstate__(self):
        return {**self.__dict__, "seams": {}, "heads": {}}

    def stays_split(self, u: int, v: int) -> bool:
        """Whether ``u`` and ``v`` side by side are left apart by every merge.

        Looks back in the order of the merges: the younger of the two is replaced by its part
        at the seam, and no pair met that way may have been merged before the younger was made.
        """
        before = len(self.born) + 1
        while self.rank.get((u, v), before) >= before:
            if self.born[u] > self.born[v]:
                before, u = self.born[u], self.right[u]
            elif self.born[v]:
                before, v = self.born[v] + 1, self.left[v]  # equal merges go from left to right
            else:
                return True
        return False

    def seam(self, u: int, v: int) -> bool:
        """``stays_split``, remembered."""
        key = u << 20 | v
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) >= MEMO:
                self.seams.clear()
            found = self.seams[key] = self.stays_split(u, v)
        return found

    def follow(self, found: list[tuple[int, tuple[int, int]]], kind: int, last: list[int]) -> tuple[int, int]:
        """Start and id of the one token of a kind, longest first, that can follow what is before it."""
        for start, tokens in reversed(found):
            token = tokens[kind]
            if token >= 0 and (not start or self.seam(last[start], token)):
                return start, token
        raise ValueError("the vocabulary has no token for a byte")

    def whole_words(self, word: str) -> list[int]:
        """Tokens of each prefix of a pre-split word, taken as a word: one entry a code point."""
        data = word.encode("utf-8")
        size, known, heads = len(data), self.known, self.heads
        last, count, whole = [-1], [0], []
        for end in range(1, size + 1):
            head = data[:end] if end <= HEAD_BYTES else None
            state = heads.get(head)
            if state is None:
                found, start = [], end
                while start and (tokens := known.get(data[start - 1 : end])):
                    start -= 1
                    found.append((start, tokens))
                token = inside = ended = 0
                if end == size or data[end] & 0xC0 != 0x80:
                    ended = count[self.follow(found, 1, last)[0]] + 1
                if end < size:
                    start, token = self.follow(found, 0, last)
                    inside = count[start] + 1
                state = token, inside, ended
                if head is not None and end < size:
                    if len(heads) >= MEMO:
                        heads.clear()
                    heads[head] = state
            last.append(state[0])
            count.append(state[1])
            if state[2]:
                whole.append(state[2])
        return whole

    def steps(self, word: str) -> bytes:
        """Change of the token count with each code point of a word; white space has none."""
        if not SOLID.search(word):
            return bytes(len(word))
        counts = self.whole_words(word)
        if len(counts) == 3 and word[0] == "'" and word[1].isalpha():
            # two characters of a contraction are a quote and a letter
            counts[1] = counts[0] + self.whole_words(word[1])[0]
        return array("b", map(sub, counts, [0, *counts])).tobytes()


class TextCounter(dict):
    """Memo from a word to its steps; a full memo becomes the older generation."""

    def __init__(self, words: PrefixCounter):
        super().__init__()
        self.words = words
        self.older: dict[str, bytes] = {}
        names = "|".join(map(regex.escape, words.special))
        self.special = regex.compile(f"({names})") if names else None

    def __missing__(self, word: str) -> bytes:
        steps = self.older.get(word)
        if steps is None:
            steps = self.words.steps(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = steps
        return steps

    def plain(self, text: str) -> np.ndarray:
        """Steps of a text without special tokens, one for each code point of its NFC form."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = lowered(text)
        steps = np.frombuffer(b"".join(map(self.__getitem__, cover(low))), np.int8)
        if len(low) == len(text):
            return steps
        sizes = np.fromiter((len(lowered(c)) for c in text), np.int64, len(text))
        return np.add.reduceat(steps, np.cumsum(sizes) - sizes, dtype=np.int8)

    def steps_of(self, text: str) -> np.ndarray:
        """Steps of a whole text; a special token's string is one token once it is complete."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return self.plain(text)
        done = []
        for n in range(0, len(parts) - 1, 2):
            # until its last character the string is plain text, then one token after the part
            steps = self.plain(parts[n] + parts[n + 1]).copy()
            steps[-1] = self.plain(parts[n]).sum() + 1 - steps[:-1].sum()
            done.append(steps)
        done.append(self.plain(parts[-1]))
        return np.concatenate(done)


_worker: dict[int, TextCounter] = {}


def worker_counter(words: PrefixCounter) -> TextCounter:
    """The counter of this Python worker: the tasks it runs one after the other share its memos."""
    if words.digest not in _worker:
        _worker.clear()
        _worker[words.digest] = TextCounter(words)
    return _worker[words.digest]


@lru_cache(maxsize=2)
def load_counter(path: str) -> PrefixCounter:
    """Counter of a vocabulary file (its size is that of the vocabulary)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return PrefixCounter(spec["model"]["vocab"], spec["model"]["merges"], special)


def counts_at(steps: bytes) -> np.ndarray:
    """Tokens of the prefixes of 0, 1, 2, ... code points."""
    counts = np.zeros(len(steps) + 1, np.int64)
    np.cumsum(np.frombuffer(steps, np.int8), out=counts[1:])
    return counts


def longest_fit(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens.

    Counts may fall as a word grows, so the last place within the limit is looked for.
    """
    fits = np.flatnonzero(counts[::-1] <= limit)
    return len(counts) - 1 - int(fits[0]) if len(fits) else 0


def prefix_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token counts of all prefixes: ``doc_id, n_bytes, n_chars, n_tokens, steps``.

    ``steps`` holds, a signed byte for each code point of the text's NFC form, how the token
    count changes with it; ``counts_at`` adds them up. Store the table and put questions to
    it (:func:`truncations`, :func:`prefix_tokens`); texts are not encoded again. ``n_bytes``
    is the size of the text as it is. One row per input row and no shuffle. A null text
    counts as empty; a null id stays null; repeated rows give repeated results; other
    columns are not read, so their names cannot clash; an empty table gives an empty table.
    Very long texts are counted whole: work is linear in the text, also in one unbroken word.
    """
    words = load_counter(tokenizer_path)

    def setup():
        counter = worker_counter(words)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = piece.column("text").to_pylist()
            steps = [counter.steps_of(t) for t in texts]
            return record_batch({
                "doc_id": piece.column("doc_id"),
                "n_bytes": pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                "n_chars": pa.array([len(s) for s in steps], pa.int64()),
                "n_tokens": pa.array([int(s.sum(dtype=np.int64)) for s in steps], pa.int64()),
                "steps": pa.array([s.tobytes() for s in steps], pa.binary()),
            })

        return work

    schema = "doc_id long, n_bytes long, n_chars long, n_tokens long, steps binary"
    return map_slices(id_and_text(docs, id_col, text_col), setup, schema)


def truncations(counted: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``doc_id, max_tokens, fit_chars, fit_tokens``: the longest prefix within each limit.

    ``counted`` is what :func:`prefix_counts` returns. ``fit_chars`` counts code points of the
    NFC text. One row per row and limit; no limits give no rows.
    """
    wanted = [int(n) for n in limits]

    def setup():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            found = []
            for n, steps in enumerate(piece.column("steps")):
                counts = counts_at(steps.as_py() or b"")
                for limit in wanted:
                    fit = longest_fit(counts, limit)
                    found.append((n, limit, fit, int(counts[fit])))
            if not found:
                return None
            row, *rest = zip(*found, strict=True)
            return record_batch({
                "doc_id": piece.column("doc_id").take(pa.array(row)),
                **{
                    name: pa.array(part, pa.int64())
                    for name, part in zip(("max_tokens", "fit_chars", "fit_tokens"), rest, strict=True)
                },
            })

        return work

    schema = "doc_id long, max_tokens long, fit_chars long, fit_tokens long"
    return map_slices(counted.select("doc_id", "steps"), setup, schema)


def prefix_tokens(counted: DataFrame, at: str, into: str = "prefix_tokens") -> DataFrame:
    """Add the tokens of the first ``at`` code points, ``at`` a column beside ``steps``.

    A place beyond the text counts the whole text, a negative one none; a null place, or
    null ``steps``, gives null.
    """
    places = F.least(F.greatest(column(at).cast("long"), F.lit(0)), F.octet_length("steps").cast("long"))

    @F.pandas_udf("long")
    def count(steps, end):
        sums = [
            None if s is None or e != e else int(np.frombuffer(s, np.int8, int(e)).sum(dtype=np.int64))
            for s, e in zip(steps, end, strict=True)
        ]
        import pandas as pd

        return pd.Series(sums, dtype="Int64")

    place = F.when(column(at).isNotNull() & F.col("steps").isNotNull(), places)
    return counted.withColumn(into, count("steps", place))


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` of every text.

    ``fit_chars`` is the longest prefix of at most ``limit`` tokens, in code points of the
    text's NFC form, read off the counts of all prefixes. Rows, nulls and long texts as in
    :func:`prefix_counts`.
    """
    counted = prefix_counts(docs, tokenizer_path, id_col, text_col)

    def setup():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            total = piece.column("n_tokens").to_pylist()
            fits = [
                len(steps.as_py()) if n <= limit else longest_fit(counts_at(steps.as_py()), limit)
                for n, steps in zip(total, piece.column("steps"), strict=True)
            ]
            return record_batch({
                **{name: piece.column(name) for name in ("doc_id", "n_bytes", "n_tokens")},
                "over_limit": pa.array([n > limit for n in total], pa.bool_()),
                "fit_chars": pa.array(fits, pa.int64()),
            })

        return work

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_slices(counted, setup, schema)
