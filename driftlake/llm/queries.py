"""The operators as named queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlake.llm import ann_tree, bagminhash, collocations, decontaminate, language_id, lm_mixing, role_repair, source_mixing, suffix_dedup, token_counts, token_output, toxicity, whitening
from driftlake.llm.common import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_report(_table(spark, sf_dir, "documents"))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(_table(spark, sf_dir, "embeddings"))


def op5_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classify(_table(spark, sf_dir, "documents")).drop("bmh_node")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_all(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair(_table(spark, sf_dir, "conversations"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_token_output, op4_ann_tree, op5_lm_mixing, op6_decontaminate, op7_bagminhash, op8_token_counts, op9_source_mixing, op10_role_repair, op11_toxicity, op12_collocations, op13_whitening)}
ORACLE = {"op9_source_mixing": source_mixing.ORACLE, "op12_collocations": collocations.ORACLE}
