"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import exact_dedup, language_id, minhash_forest, mixing, sentencepiece_index
from rollcall.llm.common import table
from rollcall.llm.queries import TOKENIZER
from rollcall.plans.scratch import materialize, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, learnt from the labels among them."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, against an index that begins empty."""
    return exact_dedup.keep_new(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_forest.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same weight, in a global random order."""
    found = mixing.replicate(docs)
    return found.select(*mixing.unpacked(found, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return sentencepiece_index.encode(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("language id", languages),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mix sources", mixed),
    ("sentencepiece", tokens),
]

# SQL cannot express every stage; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, each stage written and read before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
