import hashlib
import os

import corpus_pipeline
from pyspark.sql import functions as F
from test_lines import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import __spark_entry__
from cohortspark.llm.queries import LLM, tokenizer_path

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(LLM.queries) <= names
    assert {n.split("_")[0] for n in LLM.queries} == {f"op{n}" for n in range(1, 14)}
    assert set(LLM.sql) <= set(__spark_entry__.oracle_sql())


def test_run_as_plain_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    kept = {r.doc_id for r in LLM.queries["op8_quality_rules"](spark, FOLDER).collect() if r.kept}
    rows = [r for r in rows if r[0] in kept]
    rows = [(i, t) for i, t, _, _ in plain_lines(rows)]
    comps = plain_components([plain_fingerprint(t) for _, t in rows])
    rows = [r for n, r in enumerate(rows) if comps[n] == n]
    bare = lambda t: [w.strip(".,").lower() for w in t.split()]
    bench = [bare(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[n : n + 8]) for w in bench for n in range(len(w) - 7)}
    clean = lambda w: not any(tuple(w[n : n + 8]) in windows for n in range(len(w) - 7))
    rows = [(i, t) for i, t in rows if clean(bare(t))]
    library = Tokenizer.from_file(tokenizer_path())
    want = {(i, tuple(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(out) == len(want) > 50
    assert {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in out} == want


def test_stages_keep_the_columns(spark, docs):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = documents.limit(30).unionByName(documents.limit(5)).withColumn("text", documents.text)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, FOLDER)
        assert out.dtypes == documents.dtypes, name
        assert step(spark, documents.limit(0), FOLDER).count() == 0, name


def test_encode_takes_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "a b", None), (3, "word " * 20_000, "c")],
        "doc_id long, text string, ids string",
    ).withColumn("decoded", F.lit(1))
    step = dict(corpus_pipeline.STAGES)["encode"]
    rows = step(spark, odd, FOLDER).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r.doc_id for r in rows if r.n_tokens == 0) == [1, 2, 2]
    assert all(r.ids == [] and r.decoded_sha256 == empty for r in rows if r.n_tokens == 0)
    by_id = {r.doc_id: r for r in rows}
    library = Tokenizer.from_file(tokenizer_path())
    for doc_id, text in ((None, "a b"), (3, "word " * 20_000)):
        assert by_id[doc_id].ids == library.encode(text, add_special_tokens=False).ids
        assert by_id[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert step(spark, odd.limit(0), FOLDER).collect() == []
