import os
import zlib

import numpy as np
import pytest

from cohortspark.llm import classifier as cl
from cohortspark.llm.queries import LLM
from cohortspark.llm.tokens import token_hashes

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.01")


def plain_matrix(texts):
    """Context matrix by a loop over words and neighbours."""
    total = np.zeros((1 << cl.BUCKET_BITS, cl.DIMENSIONS + 1), np.int64)
    for text in texts:
        hashes, _ = token_hashes([text])
        places, signs = cl.index_entries(hashes)
        bucket = (hashes >> np.uint64(64 - cl.BUCKET_BITS)).astype(int)
        for n in range(len(hashes)):
            total[bucket[n], -1] += 1
            for m in range(max(0, n - cl.CONTEXT), min(len(hashes), n + cl.CONTEXT + 1)):
                if m != n:
                    for p, s in zip(places[m], signs[m], strict=True):
                        total[bucket[n], p] += s
    return total


def test_contexts_and_pooling_as_plain_loops(spark):
    texts = [b"a b c, d a b", b"", b"one", "é b a!! x y z".encode() * 3]
    want = plain_matrix(texts)
    rows = [(bytearray(t),) for t in texts]
    frame = spark.createDataFrame(rows, "text binary").repartition(3)
    assert (cl.context_matrix(frame) == want).all()
    words = cl.WordVectors.of(want)
    pooled = words.pool(texts)
    for text, vector in zip(texts, pooled, strict=True):
        bucket = (token_hashes([text])[0] >> np.uint64(64 - cl.BUCKET_BITS)).astype(int)
        own = words.vectors[bucket]
        steps = np.abs(own[1:] - own[:-1]).sum(axis=0) / max(1, len(own))
        none = np.zeros(3 * cl.DIMENSIONS)
        plain = np.concatenate([own.mean(axis=0), own.std(axis=0), steps]) if len(bucket) else none
        assert np.allclose(vector, plain, atol=1e-6)


def test_long_texts_pool_in_pieces(monkeypatch):
    words = cl.WordVectors.of(plain_matrix([b"a b c d e f g"]))
    text = b"a b c d e f g " * 500
    whole = words.pool([b"x", text])[1]
    monkeypatch.setattr(cl, "GATHER", 64)
    assert np.allclose(words.pool([b"x", text])[1], whole)


def test_network_learns_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(6000) < 0.1)).astype(float)
    net = cl.Network.fit(x[:5000], y[:5000])
    p = net.probability(x[5000:])
    assert ((p >= 0.5) == (y[5000:] > 0)).mean() > 0.8
    logits = 8 * rng.normal(size=4000)
    truth = (rng.random(4000) < cl.sigmoid(logits / 3)).astype(float)
    assert 2.3 < cl.best_temperature(logits, truth) < 3.9


def test_held_out_rows_are_judged_well_and_never_learnt(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    out = LLM.queries["op2_quality_classifier"](spark, FOLDER).collect()
    assert len(out) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    apart = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in apart]) > 0.95
    good = [r.score for r in apart if labels[r.doc_id] == 1]
    bad = [r.score for r in apart if labels[r.doc_id] == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None, :]) > 0.95
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    table = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = table.withColumn("quality", cl.F.when(cl.held_out(table.doc_id), 1 - table.quality).otherwise(table.quality))
    again = {r.doc_id: r.score for r in cl.score_quality(documents, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)


@pytest.mark.parametrize("quality", [None, 1])
def test_edges(spark, docs, quality):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice here"), (3, "twice here"), (4, "long " * 300_000)]
    labels = spark.createDataFrame([(i, quality) for i in (1, 2, 3, 3, None)], "doc_id long, quality int")
    out = cl.score_quality(docs(*rows), labels).collect()
    assert len(out) == len(rows) and len({r.score for r in out}) == 1
    assert out[0].score == 0.5 if quality is None else out[0].score > 0.5
    assert cl.score_quality(docs(*rows).limit(0), labels).count() == 0
