import hashlib

import pytest
from tokenizers import Tokenizer

from cohortspark.llm import bpe
from cohortspark.llm.queries import LLM, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
TRICKY = [
    "", " ", "\n\n \n x\t\t", "don't we'LL 's", "=" * 500 + "a" * 3000, "<|endoftext|> a<|endoftext|>",
    "naïve Übung ²½ 数字 ١٢٣  x\x1c\x85", "\U0001f600 ok\U0001f600", "a\x00b",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_tricky_texts_and_round_trip(library):
    automaton = bpe.compile_automaton(tokenizer_path())
    encoder = bpe.Encoder(automaton)
    for text in TRICKY:
        ids = list(encoder.encode(text))
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert automaton.decode(ids) == text


def test_every_low_character_splits_as_the_library(library):
    encoder = bpe.Encoder(bpe.compile_automaton(tokenizer_path()))
    for code in [*range(0x300), 0x1680, 0x2028, 0x3000, 0x0660, 0x2167, 0xFEFF]:
        text = f"a{chr(code)}{chr(code)}b 1{chr(code)} "
        assert list(encoder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_gadgets_by_brute_force():
    """Small merges, with repeated letters, against merging in rank order."""
    labels = [b"a", b"b", b"aa", b"ab", b"aab", b"ba", b"aaaa", b"baa"]
    pairs = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5), (2, 2, 6), (1, 2, 7)]
    automaton = bpe.Automaton(labels, pairs, {})

    def merged(word):
        ids = [b"ab".index(c) for c in word]
        for u, v, w in pairs:
            out, n = [], 0
            while n < len(ids):
                hit = ids[n : n + 2] == [u, v]
                out.append(w if hit else ids[n])
                n += 1 + hit
            ids = out
        return tuple(ids)

    for size in range(1, 11):
        for code in range(2**size):
            word = bytes(b"ab"[code >> n & 1] for n in range(size))
            assert automaton.encode_word(word) == merged(word), word


def test_whole_table_and_edges(spark, docs, library):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "twice"), (3, "twice"), (4, "long " * 40_000)]
    out = bpe.encode_decode(docs(*rows), tokenizer_path()).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    assert list(by_id[1].ids) == [] and by_id[1].decoded == ""
    assert by_id[None].decoded == "null id" and by_id[4].decoded == "long " * 40_000
    assert bpe.encode_decode(docs(*rows).limit(0), tokenizer_path()).count() == 0

    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    result = LLM.queries["op3_bpe"](spark, FOLDER).collect()
    assert len(result) == len(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in result:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == digest(",".join(map(str, ids)))
        assert row.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))
