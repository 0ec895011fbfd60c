"""Corpus preparation from the operators of ``cohortspark.llm``: named stages over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import bpe, decontamination, lines, quality, simhash
from cohortspark.llm.common import stage
from cohortspark.llm.queries import sha256_of, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text fails the rules and goes; a null id is never trusted but judged like
    any other; repeated rows share a verdict; texts are judged whole; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has too; ``n_chars`` follows the text.

    Every document stays, also one that loses all its lines. A null text counts as one empty line.
    Rows without an id are one document after all others, rows that share an id are one
    document; of equal lines those of the least id stay. An empty table stays empty.
    """
    return lines.keep_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each SimHash class.

    Rows without an id come last; of rows that share the least id one stays. Null texts and
    texts without words have fingerprint zero and are linked like any other. Texts count
    whole; an empty table stays empty.
    """
    return simhash.keep_first(docs, shingle_words=simhash.SHINGLE_WORDS, max_bits=simhash.MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text is clean, a null id makes no difference, repeated rows share a verdict;
    texts are searched whole. Without benchmark items every document stays; an empty table
    stays empty.
    """
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to.

    A null text has no tokens, as an empty one; a null id stays null; repeated rows give
    repeated results; texts are encoded whole; an empty table stays empty.
    """
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
# Fingerprints, hashed n-grams and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
