import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import blocks as bk
from cohortspark.llm import quality, tokens
from cohortspark.llm.queries import LLM

FOLDER = "/root/testdata/sf0.001"


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[n : n + 5]) for n in range(len(words) - 4)]
    covered = {n + k for n, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:n] for n, line in enumerate(lines)), len(covered),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x1c\x85#é|", max_size=80))
def test_base_measures_as_plain_counts(text):
    assert quality.base_measures(text.encode()) == plain_measures(text)


def test_token_hashes_follow_the_tokens_only():
    texts = [b"Ab, c", b"ab , C ab", b"", "é ab".encode()]
    hashes, piece = tokens.token_hashes(texts)
    assert piece.tolist() == [0, 0, 0, 1, 1, 1, 1, 3, 3]
    one = [re.findall(rb"\w+|,", t.lower()) for t in (texts[0], texts[1])]
    names = [*one[0], *one[1], "é".encode(), b"ab"]
    same = {(a, b): hashes[i] == hashes[j] for i, a in enumerate(names) for j, b in enumerate(names)}
    assert all(equal == (a == b) for (a, b), equal in same.items())


def test_pieces_cover_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    text = b"word " * 100 + b"x" * 200
    assert b"".join(tokens.pieces(text)) == text and max(map(len, tokens.pieces(text))) <= 50


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{FOLDER}/{n}.parquet")
    return read("documents"), read("labels")


def test_whole_table_against_plain_model(spark, tables):
    documents, labels = tables
    texts = dict(documents.select("doc_id", "text").collect())
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    count = {True: np.zeros(quality.BUCKETS), False: np.zeros(quality.BUCKETS)}
    grams = {}
    for i, text in texts.items():
        grams[i] = quality.ngram_buckets([text.encode()])[0]
        for which in {False, i in good}:
            np.add.at(count[which], grams[i], 1)
    share = {k: (c + 1) / (c.sum() + quality.BUCKETS) for k, c in count.items()}
    result = LLM.queries["op8_quality_rules"](spark, FOLDER).collect()
    assert len(result) == len(texts)
    for row in result:
        measures = plain_measures(texts[row.doc_id])
        assert tuple(row[1:6]) == measures
        failed = measures[0] < 10 or 100 * measures[4] > 20 * measures[0]
        mine = [np.log(share[True][g] / share[False][g]) for g in grams[row.doc_id]]
        ratio = float(np.mean(mine)) if mine else 0.0
        assert row.base_failed == failed and abs(row.ratio - ratio) < 1e-9
        assert row.kept == (not failed and ratio >= quality.THRESHOLD)


def test_keeps_clean_documents_and_drops_junk(tables):
    documents, labels = tables
    verdict = {r.doc_id: r for r in quality.quality_rules(documents, labels).collect()}
    rows = labels.collect()
    clean = [verdict[r.doc_id] for r in rows if r.quality == 1 and verdict[r.doc_id].n_words >= 30]
    junk = [verdict[r.doc_id] for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) / len(clean) > 0.97
    assert sum(not r.kept for r in junk) / len(junk) > 0.9


def test_edges(spark, docs, tables):
    labels = tables[1]
    rows = [(1, None), (2, ""), (None, "some words " * 9), (3, "a b"), (3, "a b"), (4, "x" * 3_000_000)]
    out = quality.quality_rules(docs(*rows), labels.limit(0)).collect()
    assert len(out) == len(rows) and {r.ratio for r in out} == {0.0}
    kept = quality.keep_good(docs(*rows), labels.limit(0))
    assert kept.columns == docs(*rows).columns and kept.count() == 0
    clashing = [(1, "fine words that differ " + "one two three four five six seven"), (2, "no")]
    assert [r.doc_id for r in quality.keep_good(docs(*clashing), labels.limit(0)).collect()] == [1]
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted_ids(odd).collect()] == [2]
    assert quality.quality_rules(docs(*rows).limit(0), labels).count() == 0


def test_buckets_follow_the_distinct_bigrams(spark):
    """Junk is told from prose at a larger scale too."""
    assert quality.bucket_bits(0) == quality.bucket_bits(60_000) == 14 and quality.bucket_bits(2_000_000) == 19
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    documents, labels = read("documents"), read("labels")
    ratio = {r.doc_id: r.ratio for r in quality.quality_rules(documents, labels).collect() if r.n_words >= 30}
    quality_of = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in ratio}
    junk = [ratio[i] >= quality.THRESHOLD for i, q in quality_of.items() if q == 0]
    other = [ratio[i] >= quality.THRESHOLD for i in ratio if quality_of.get(i, 1) == 1]
    assert sum(junk) / len(junk) < 0.02 and sum(other) / len(other) > 0.9


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    for top in (3, 400, 1 << 31):
        raw = rng.integers(1, top, 3000)
        target = rng.integers(0, raw + 1)
        keys = np.cumsum(rng.integers(1, 1 << 20, len(raw)))
        asked = quality.unpack_question(quality.pack_question(keys, raw, target))
        assert all((a == b).all() for a, b in zip(asked, (keys, raw, target), strict=True))
        every = raw + rng.integers(0, 1 << 40, len(raw)), target
        answer = quality.pack_answer(*every, raw)
        assert quality.answer_size(answer) == len(raw)
        assert all((a == b).all() for a, b in zip(quality.unpack_answer(answer, raw), every, strict=True))


def entropy(*columns):
    often = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return -(often * np.log2(often / often.sum())).sum() / often.sum()


def test_counts_travel_in_little_more_than_their_information():
    """Counts with a long tail, as those of words; of two counts the second depends on the first."""
    rng = np.random.default_rng(2)
    own = np.minimum(rng.zipf(2.0, 60_000), 5000)
    target = rng.binomial(own, 0.4)
    gaps = rng.geometric(0.1, len(own))
    every = own + rng.binomial(10 * own, 0.5)
    in_trusted = rng.binomial(every, 0.4)
    question = quality.pack_question(np.cumsum(gaps), own, target)
    assert 8 * len(question) < 1.15 * len(own) * (entropy(gaps) + entropy(own, target))
    # the block knows its own counts, so it needs only what they do not tell
    answer = quality.pack_answer(every, in_trusted, own)
    assert 8 * len(answer) < 1.05 * len(own) * entropy(every, in_trusted)


def test_block_is_counted_in_little_memory():
    """Counts equal plain ones, and working memory stays near the size of the texts."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{n:x}" for n in range(20_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 2000)]) for _ in range(800)]
    table = pa.table({"c0": pa.array(range(len(texts))), "c1": texts})
    block = bk.pack(table.to_batches(max_chunksize=32))
    trusted = list(range(0, len(texts), 3))
    every = [quality.ngram_buckets([t.encode()], 18)[0] for t in texts]
    plain = [np.bincount(np.concatenate(part), minlength=4 << 18) for part in (every, every[::3])]
    edges = quality.shard_edges(18, 16)[1:]
    tracemalloc.start()
    found = list(quality.block_counts(block, 1, 18, trusted, edges))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((np.searchsorted(edges, part[0], side="right") == n).all() for n, part in enumerate(found))
    keys, raw, target = (np.concatenate(part) for part in zip(*found, strict=True))
    assert (keys == np.flatnonzero(plain[0])).all()
    assert (raw == plain[0][keys]).all() and (target == plain[1][keys]).all()
    assert peak < 6 * sum(map(len, texts)), peak / sum(map(len, texts))


def test_groups_of_a_given_size():
    texts = [b"a b", b"", b"c " * 40, b"d"]
    found = list(tokens.groups(texts, 10))
    assert [n for numbers, _ in found for n in numbers] == [0, 1, 2, 3]
    assert [len(b"\n".join(parts)) <= 10 for _, parts in found] == [True, False, True]
    long = b"word " * 100_000
    assert len(set(tokens.token_hashes([long])[0].tolist())) == 1
