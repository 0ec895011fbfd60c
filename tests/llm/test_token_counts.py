import random
import unicodedata

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from cohortspark.llm import token_counts as tc
from cohortspark.llm.queries import LLM, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")
PARTS = [
    "a", "b", "the", "ing", "'s", "'re", "'", "'ll", "é", "é", "́", "İ", "Σ", "ς", " ", "\n", "1", "23",
    "日本", "😂", "🇺🇸", "--", "...", "<|endoftext|>", "<|startof", "ṩ", "ǆ", " ", "\x1c", "\x85", "ß",
    "ا", "न", "ि", "haha", "zzz", "x", "q",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return tc.TextCounter(tc.load_counter(PATH))


def test_every_prefix_has_the_count_of_the_library(library, counter):
    draw = random.Random(7)
    for _ in range(1500):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        pieces = regex.split(r"(<\|endoftext\|>|<\|startoftext\|>)", text)
        normal = "".join(unicodedata.normalize("NFC", p) for p in pieces)
        prefixes = [normal[:n] for n in range(len(normal) + 1)]
        want = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert tc.counts_at(counter.steps_of(text).tobytes()).tolist() == want, text


def test_all_code_points_split_as_in_the_library(library, counter):
    plain = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cn"]
    # the library knows fewer new letters, so unassigned code points are left out
    texts = ["a" + c + "a" for c in plain]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    mine = [int(counter.steps_of(t).sum()) for t in texts]
    assert [(hex(ord(c)), a, b) for c, a, b in zip(plain, mine, want) if a != b] == []


def test_whole_table_against_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    rows = LLM.queries["op13_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 2048)
        if not row.over_limit:
            assert row.fit_chars == len(unicodedata.normalize("NFC", text))
        else:
            near = unicodedata.normalize("NFC", text)[: row.fit_chars + 40]
            ends = range(row.fit_chars, len(near) + 1)
            counts = [len(library.encode(near[:e], add_special_tokens=False).ids) for e in ends]
            assert counts[0] <= 2048 and all(c > 2048 for c in counts[1:])


def test_questions_to_a_stored_table(spark, docs, library, tmp_path):
    rows = [(1, "The quick brown foxes, they'll jump"), (2, None), (3, ""), (None, "x y"), (3, "")]
    tc.prefix_counts(docs(*rows), PATH).write.parquet(str(tmp_path / "counts"))
    stored = spark.read.parquet(str(tmp_path / "counts"))
    size = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    fits = {(r.doc_id, r.max_tokens): r for r in tc.truncations(stored, (0, 3, 100)).collect()}
    assert len(fits) == 12  # four ids, of which 3 twice, and three limits
    text = rows[0][1]
    for limit in (0, 3, 100):
        best = max(n for n in range(len(text) + 1) if size(text[:n]) <= limit)
        assert fits[1, limit].fit_chars == best and fits[1, limit].fit_tokens == size(text[:best])
    assert fits[2, 3].fit_chars == 0
    asked = stored.selectExpr("*", "explode(array(-1, 0, 5, 10, 99, null)) AS `at.x`")
    found = {(r.doc_id, r["at.x"]): r.prefix_tokens for r in tc.prefix_tokens(asked, "at.x").collect()}
    assert [found[1, n] for n in (-1, 0, 5, 10, 99, None)] == [0, 0, size(text[:5]), size(text[:10]), size(text), None]
    assert tc.truncations(stored, ()).count() == 0 and tc.truncations(stored.limit(0), (3,)).count() == 0


def test_edges(docs):
    rows = [(1, None), (2, ""), (None, "word"), (3, "a b"), (3, "a b"), (4, "x" * 400_000 + " end")]
    out = tc.token_counts(docs(*rows), PATH, limit=1).collect()
    assert len(out) == len(rows)
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit, r.fit_chars) for r in out}
    assert found[1] == found[2] == (0, 0, False, 0) and found[None] == (4, 1, False, 4)
    assert found[3] == (3, 2, True, 2) and found[4][:2] == (400_004, 100_001)
    assert tc.token_counts(docs(*rows).limit(0), PATH).count() == 0


def test_full_memos_change_nothing(counter, monkeypatch):
    text = "many different words which all pass a very small memo, again many different words"
    want = counter.steps_of(text).tolist()
    monkeypatch.setattr(tc, "MEMO", 3)
    small = tc.TextCounter(tc.load_counter(PATH))
    assert small.steps_of(text).tolist() == want and small.steps_of(text).tolist() == want
    assert np.cumsum(want)[-1] == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
