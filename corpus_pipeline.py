"""A training corpus from ``documents`` in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  The mixing stage writes its rows in the order of the mixture;
a reread does not keep that order, but a row's file and its place there tell it, so
the last stage returns the place in the mixture beside the tokens, and the result is
ordered by it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurescape.llm import bpe, jaccard, langid, mixing, pii
from featurescape.operators.ids import with_row_number
from featurescape.session import checkpoint_dir, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    return langid.keep_known(docs, langid.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies
    (five-word shingles, Jaccard similarity of 0.8 or more).  Of rows with one
    id the smallest text stays; rows without an id cannot be told apart from their
    copies and all stay."""
    found = materialize(jaccard.link_components(docs, size=5, percent=80))
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    first = materialize(first)
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi")
    again = first.where("n > 1").select("doc_id")
    if not again.isEmpty():
        single = kept.join(again, "doc_id", "left_anti")
        twice = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("row"))
        kept = single.select(docs.columns).unionByName(twice.select(
            *[F.col("doc_id") if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in docs.columns]))
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    clean = pii.redact(docs, pii.find(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of their sources' target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the digest of the text decoded from them, its
    source, and its place (from 1) in the mixture that ``docs`` was written in."""
    placed = with_row_number(docs, "place").select("doc_id", "text", "source", "place")
    return bpe.encoded(placed, VOCABULARY, keep=["source", "place"])


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing", mixed),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read
    again; rows in the order of the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
    return docs.orderBy("place")


# Training, components, the Pfair period and the automaton are no SQL; the
# stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None
