"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlens.llm import (alignment, bpe, divergence, line_dedup, mixing, near_dup, packing, pii,
                            quality_classifier, quality_rules, topk, toxicity, warc)
from branchlens.llm.common import table
from branchlens.session import ensure_checkpoint_dir

#: Folder of the vocabulary files; None: the installed public tokenizers.
VOCABULARIES: str | None = None


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    if VOCABULARIES:
        return f"{VOCABULARIES.rstrip('/')}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(table(spark, sf_dir, "documents"), vocabulary())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/branchlens-warc/{uuid.uuid4().hex}"
    return warc.warc_report(table(spark, sf_dir, "pages"), path)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_report(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                      vocabulary("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_exact_top_k, op2_line_dedup, op3_quality_rules, op4_bpe, op5_quality_classifier, op6_pii, op7_warc,
    op8_mixing, op9_toxicity, op10_minhash_near_dup, op11_packing, op12_token_alignment,
    op13_source_divergence)}

#: The other queries are tested against brute force or held-out labels: line
#: edits, token merges, classifiers, span offsets, block picks and set
#: similarities have no SQL of reasonable speed over whole tables.
ORACLES: dict[str, str] = {"op1_exact_top_k": topk.SQL, "op3_quality_rules": quality_rules.SQL, "op7_warc": warc.SQL,
                           "op13_source_divergence": divergence.SQL}
