"""Registered queries of the operators: each over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import (
    conversation_trie,
    exact_dedup,
    language_id,
    license_automaton,
    minhash_forest,
    mixing,
    quality,
    secret_scan,
    sentencepiece_index,
    token_alignment,
    toxicity,
    warc,
    window_dedup,
)
from rollcall.llm.common import table
from rollcall.plans.scratch import scratch_path

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"))
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_index.encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.Tokenizers(BYTE_TOKENIZER, TOKENIZER)
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizers).documents().drop("groups")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_automaton.scan(table(spark, sf_dir, "documents"))


def registered() -> dict[str, Query]:
    found = {name: item for name, item in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))
