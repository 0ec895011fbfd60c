import os
import re

import numpy as np
import pytest
from compare import compare, connect

from cohortspark.llm import blocks, substrings
from cohortspark.llm.queries import LLM

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, window):
    """Kept words of ``(id, text)`` rows whose ids differ."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, gone = {}, {i: set() for i in words}
    for i in sorted(words, key=lambda i: (i is None, i)):
        for n in range(len(words[i]) - window + 1):
            if first.setdefault(tuple(words[i][n : n + window]), (i, n)) != (i, n):
                gone[i].update(range(n, n + window))
    return [
        (i, " ".join(w for n, w in enumerate(words[i]) if n not in gone[i]), len(words[i]), len(gone[i]))
        for i in words
    ]


def test_packed_integers_round_trip():
    rng = np.random.default_rng(2)
    for high in (1, 70_000, 2**40, 2**64 - 1):
        values = np.unique(rng.integers(0, high, 500, np.uint64))
        data = substrings.pack_sorted(values)
        back, size = substrings.unpack_sorted(data + b"tail")
        assert (back == values).all() and size == len(data)


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2, 3000).astype(np.uint64)
    for length in (1, 3, 10, 20):
        for which in (0, 1):
            hashes = substrings.window_hashes(words, length, which)
            seen = {}
            for n, h in enumerate(hashes.tolist()):
                seen.setdefault(h, set()).add(tuple(words[n : n + length].tolist()))
            assert len(hashes) == 3000 - length + 1 and all(len(v) == 1 for v in seen.values())
    assert len(substrings.window_hashes(words[:5], 10, 0)) == 0


@pytest.mark.parametrize("size", [300, 4 << 20])
@pytest.mark.parametrize("lengths", [(4, 2), (8, 2), (5, 5), (20, 10)])
def test_random_documents(docs, monkeypatch, size, lengths):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    window, start = lengths
    rng = np.random.default_rng(window)
    passages = [" ".join(rng.choice(list("abcdefgh"), 25)) for _ in range(4)]
    rows = []
    for i in rng.permutation(60).tolist():
        parts = [" ".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz", "é", "\x85"], rng.integers(0, 12))) for _ in range(3)]
        parts.insert(1, str(rng.choice(passages)))
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (None, passages[0]), (102, "z " * 60), (103, rows[0][1]), (104, rows[0][1])]
    out = [tuple(r) for r in substrings.dedup_substrings(docs(*rows, partitions=6), window=window, start=start).collect()]
    assert sorted(out, key=str) == sorted(plain(rows, window), key=str)


def test_no_survivors_repeated_rows_and_empty_tables(docs):
    lonely = [(1, "a b c d e f g h"), (2, "i j k l m n o p")]
    out = substrings.dedup_substrings(docs(*lonely), window=4, start=2).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(1, 0), (2, 0)]
    twice = substrings.dedup_substrings(docs((1, "a b c d e"), (1, "a b c d e")), window=4, start=2).collect()
    assert sorted(r.n_removed for r in twice) == [0, 5]
    assert substrings.dedup_substrings(docs(*lonely).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.levels(3, 20)


def test_query_agrees_with_sql_and_plain_python(spark):
    name = "op7_substring_dedup"
    assert compare(spark, connect(FOLDER), LLM.queries[name], LLM.sql[name], FOLDER) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, d) for i, _, n, d in plain(rows, 20))
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in LLM.queries[name](spark, FOLDER).collect()) == want
