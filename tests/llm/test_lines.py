import hashlib
import os

import numpy as np
import pytest
from compare import compare, connect

from cohortspark.llm import blocks, lines
from cohortspark.llm.queries import LLM

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, least=10):
    """Kept text per row by a table of all lines."""
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [
            x for x in every
            if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=order) == i
        ]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 2**64, (2, 5000), np.uint64)
    high[:2000] = high[0]  # equal halves
    index = lines.PerfectHash(high, low).index(high, low)
    assert sorted(index) == list(range(5000))
    assert lines.PerfectHash(high[:0], low[:0]).taken == []


def test_index_knows_counts_and_strangers():
    high, low = np.array([[1, 1, 2, 3], [5, 5, 6, 7]], np.uint64)
    index = lines.LineIndex(high, low, np.array([4, 2, 9, 1]), np.array([4, 3, 9, 1]))
    count, first = index.probe(np.array([1, 2, 3, 8], np.uint64), np.array([5, 6, 7, 123], np.uint64))
    assert count.tolist() == [2, 1, 1, 0] and first[:3].tolist() == [2, 9, 1]


@pytest.mark.parametrize("size", [200, 4 << 20])
def test_random_documents(spark, docs, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rng = np.random.default_rng(3)
    pool = ["a shared line here", " A SHARED line here\t", "short", "", "ünïcode ten", "ÜNÏCODE TEN", "x" * 30,
            *(f"line number {n}" for n in range(40))]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(0, 9)))) for i in rng.permutation(120)]
    rows += [(None, "line number 1\nonly null here"), (None, "only null here"), (3, "line number 2\nnew one here"),
             (500, None), (501, ""), (502, "own line of 502\nown line of 502")]
    frame = docs(*rows, partitions=7)
    mine = [tuple(r) for r in lines.dedup_lines(frame).collect()]
    assert sorted(mine, key=str) == sorted(plain(rows), key=str)
    whole = lines.keep_lines(frame)
    assert whole.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=str) == sorted((m[:2] for m in mine), key=str)


def test_empty_table_and_long_text(docs):
    assert lines.dedup_lines(docs((1, "a")).limit(0)).count() == 0
    out = lines.dedup_lines(docs((1, "line of a long text\n" * 50_000), (2, "line of a long text"))).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out) == [(1, 50_001, 0), (2, 1, 1)]


def test_query_agrees_with_sql_and_plain_python(spark):
    name = "op4_line_dedup"
    assert compare(spark, connect(FOLDER), LLM.queries[name], LLM.sql[name], FOLDER) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain(rows)}
    assert {tuple(r) for r in LLM.queries[name](spark, FOLDER).collect()} == want


def test_shards_follow_the_size_of_the_blocks(spark, docs, monkeypatch):
    from cohortspark.llm import blocks, substrings

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(i, f"a line that all of them have in common\nand line {i % 7} of some\nand own line {i}") for i in range(60)]
    made = lambda: [sorted(map(str, f(docs(*rows)).collect())) for f in (lines.keep_lines, substrings.dedup_substrings)]
    want = made()
    monkeypatch.setattr(blocks, "SHARD_BYTES", 50)
    stored = blocks.to_blocks(docs(*rows), "sizes")
    assert blocks.shards(stored, blocks.weight_of(stored)) > 2 * least and blocks.shards(stored, 0) == least
    assert made() == want
