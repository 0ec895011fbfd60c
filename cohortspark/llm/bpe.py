"""Byte-level BPE by a tokenization automaton."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, record_batch

# The pre-splitting pattern of the public byte-level vocabularies.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _narrow_split() -> tuple[re.Pattern, re.Pattern]:
    """The same pattern as plain character ranges for texts below U+0250, which is faster."""
    chars = [chr(c) for c in range(0x250)]
    letter, number, space = (
        "".join(f"\\u{ord(c):04x}" for c in chars if regex.match(kind, c))
        for kind in (r"\p{L}", r"\p{N}", r"\s")
    )
    words = (
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+"
    )
    return re.compile(words), re.compile("[^\u0000-\u024f]")


NARROW, WIDE_CHARACTER = _narrow_split()


def split_words(text: str) -> list[str]:
    """Pre-split words; joined they are the text."""
    return (SPLIT if WIDE_CHARACTER.search(text) else NARROW).findall(text)


#: Distinct words, and arcs, that a task remembers. Results do not depend on it.
MEMO = 250_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + n): b for n, b in enumerate(spare)}


class Automaton:
    """Deterministic automaton over tokens that accepts exactly the BPE tokenizations.

    It starts as one state with a loop for each byte. For every merge ``u v -> w``, in
    rank order, the merge gadget copies the state that arcs labelled ``u`` lead to, takes
    the arc ``v`` out of the copy, leads the ``u`` arcs to the copy, and adds an arc ``w``
    beside every ``u`` arc, to the state that ``v`` led to. All arcs of one label lead to one
    state, so a state is written as (label, rank): where that label led before the gadget
    of that rank. ``arc`` follows a state back through the gadgets that copied it.
    """

    def __init__(self, labels: list[bytes], pairs: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        size = len(labels)
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.never = len(pairs) + 1
        reached = {t for t, label in enumerate(labels) if len(label) == 1 and t not in special.values()}
        for rank, (u, v, w) in enumerate(pairs, 1):
            if u in reached and v in reached and self.arc(u, v, rank):
                self.cut[u, v] = rank
                self.left[w], self.right[w], self.born[w] = u, v, rank
                reached.add(w)
        self.memo.clear()
        self.token = {labels[t]: t for t in reached}
        self.prefix = {label[:n] for label in self.token for n in range(1, len(label) + 1)}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def arc(self, u: int, x: int, before: int) -> bool:
        """Whether the state that ``u`` led to before the gadget ``before`` has an arc ``x``."""
        born, cut, left, right = self.born, self.cut, self.left, self.right
        while True:
            if cut.get((u, x), self.never) < before:
                return False  # a gadget took the arc out
            if born[u] > born[x]:
                before, u = born[u], right[u]  # the state was that of the right part
            elif born[x]:
                before, x = born[x] + 1, left[x]  # the arc came beside that of its left part
            else:
                return True  # a byte, and the first state

    def step(self, u: int, x: int) -> bool:
        """Table entry of the finished automaton, filled when first used."""
        key = u << 20 | x
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[key] = self.arc(u, x, self.never)
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word: the path of the automaton whose labels spell it.

        Each prefix of the word has one accepted path, so an end that turned out dead is
        dead for good and is never tried twice.
        """
        whole = self.token.get(word)
        if whole is not None:
            return (whole,)
        size, token, prefix, step = len(word), self.token, self.prefix, self.step
        ids: list[int] = []
        starts: list[int] = []
        start, limit, dead = 0, size, set()
        while start < size:
            end = start + 1
            while end < limit and word[start : end + 1] in prefix:
                end += 1
            while end > start:
                arc = token.get(word[start:end])
                if arc is not None and end not in dead and (not ids or step(ids[-1], arc)):
                    break
                end -= 1
            if end > start:
                ids.append(arc)
                starts.append(start)
                start, limit = end, size
            else:
                dead.add(start)
                start, limit = starts.pop(), start - 1
                ids.pop()
        return tuple(ids)

    def decode(self, ids) -> str:
        """The labels of the arcs, one after the other; broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Encoder(dict):
    """Memo from a pre-split word to its ids; a full memo becomes the older generation."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton
        self.older: dict[str, tuple[int, ...]] = {}
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.automaton.encode_word(word.encode("utf-8"))
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids of a whole text; names of special tokens in it become those tokens."""
        if self.special is None:
            return array("i", chain.from_iterable(map(self.__getitem__, split_words(text))))
        out = array("i")
        for n, piece in enumerate(self.special.split(text)):
            if n % 2:
                out.append(self.automaton.special[piece])
            else:
                out.extend(chain.from_iterable(map(self.__getitem__, split_words(piece))))
        return out


@lru_cache(maxsize=2)
def compile_automaton(path: str) -> Automaton:
    """Automaton of a byte-level vocabulary file (its size is that of the vocabulary)."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letters = spec["model"], byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
    labels = [
        b"" if i not in names
        else names[i].encode("utf-8") if names[i] in special
        else bytes(letters[c] for c in names[i])
        for i in range(max(names) + 1)
    ]
    pairs = []
    for merge in model["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((model["vocab"][u], model["vocab"][v], model["vocab"][u + v]))
    return Automaton(labels, pairs, special)


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text and decode the ids again: ``doc_id, ids array<int>, decoded``.

    One row per input row and no shuffle. A null text counts as empty and has no ids; a
    null id stays null; repeated rows give repeated results; other columns are not read, so
    their names cannot clash; an empty table gives an empty table. Very long texts are
    encoded whole: work is linear in the text, also in one unbroken word.
    """
    automaton = compile_automaton(tokenizer_path)

    def setup():
        encoder = Encoder(automaton)

        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(t) for t in piece.column("text").to_pylist()]
            offsets = array("i", [0])
            for one in ids:
                offsets.append(offsets[-1] + len(one))
            flat = array("i", chain.from_iterable(ids))
            return record_batch({
                "doc_id": piece.column("doc_id"),
                "ids": pa.ListArray.from_arrays(
                    pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32())
                ),
                "decoded": pa.array([automaton.decode(one) for one in ids], pa.string()),
            })

        return work

    return map_slices(id_and_text(docs, id_col, text_col), setup, "doc_id long, ids array<int>, decoded string")
