import os
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortspark.llm import sharding
from cohortspark.llm.queries import LLM

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def test_draws_follow_the_distribution():
    rng = np.random.default_rng(11)
    for good, bad, sample in [(5, 7, 4), (30, 10, 25), (1, 50, 3), (400, 600, 100)]:
        mine = np.array([sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(4000)])
        theirs = rng.hypergeometric(good, bad, sample, 4000)
        assert mine.min() >= max(0, sample - bad) and mine.max() <= min(good, sample)
        assert abs(mine.mean() - sample * good / (good + bad)) < 5 * theirs.std() / 4000**0.5 + 1e-9
        assert abs(mine.std() - theirs.std()) < 0.1 * theirs.std() + 0.02
    big = sharding.draw_hypergeometric(rng, 2 * 10**9, 46 * 10**9, 10**6)
    assert abs(big - 10**6 / 24) < 2000
    assert sharding.draw_hypergeometric(rng, 0, 9, 4) == 0 and sharding.draw_hypergeometric(rng, 9, 0, 4) == 4


def test_matrix_has_exact_margins():
    counts = [0, 17, 3, 500, 1]
    sizes = sharding.shard_sizes(sum(counts), 24)
    matrix = sharding.communication_matrix(counts, sizes, 5)
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix)] == sizes
    assert max(sizes) - min(sizes) <= 1
    labels = sharding.row_labels(matrix[3], 3, 5)
    assert Counter(labels.tolist()) == {n: c for n, c in enumerate(matrix[3]) if c}


@pytest.mark.parametrize(("run_rows", "broadcast"), [(4096, 99), (3, 99), (3, 0)])
def test_rows_are_kept_and_slots_gapless(docs, monkeypatch, run_rows, broadcast):
    monkeypatch.setattr(sharding, "RUN_ROWS", run_rows)
    monkeypatch.setattr(sharding, "BROADCAST_PARTS", broadcast)
    rows = [(1, None), (None, "x"), (2, ""), *[(3, "same")] * 40, *[(n, f"t{n}") for n in range(10, 100)]]
    frame = docs(*rows, partitions=5)
    out = sharding.shuffle_shards(frame, shards=7, seed=3).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in out) == Counter(rows)
    assert out[0].row.__fields__ == frame.columns
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    few = sharding.shuffle_shards(frame.limit(2), shards=7).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0)]
    assert sharding.shuffle_shards(frame.limit(0)).count() == 0


def test_places_are_uniform(spark):
    """Over many seeds each row of each partition meets each shard and slot alike."""
    counts, sizes = [6, 10, 4], sharding.shard_sizes(20, 4)
    seen = np.zeros((20, 4))
    for seed in range(3000):
        matrix = sharding.communication_matrix(counts, sizes, seed)
        labels = np.concatenate([sharding.row_labels(m, p, seed) for p, m in enumerate(matrix)])
        seen[np.arange(20), labels] += 1
    assert np.abs(seen / 3000 - 0.25).max() < 0.04
    keys = sharding.row_keys(np.zeros(20_000, np.int64), np.arange(20_000), 1)
    assert abs((keys >> np.uint64(63)).mean() - 0.5) < 0.02 and len(np.unique(keys)) == 20_000


def test_whole_table(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    out = LLM.queries["op10_sharding"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in out} == {(s, n) for s, c in sizes.items() for n in range(c)}
    for r in out:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
