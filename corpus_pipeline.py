"""Corpus pipeline: toxic documents go, repeated lines go, one document of each
near-duplicate group stays, sources are mixed to target weights, and the mix is
encoded. Every stage is a Parquet table in the shared folder that the next one
reads.

Null, empty and repeated rows follow the rules of the operators; an empty
``documents`` table passes through every stage as an empty table; extra columns
stay until the last stage adds its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlens.llm import bpe, line_dedup, mixing, near_dup, toxicity
from branchlens.llm.common import free_name, table
from branchlens.llm.queries import vocabulary
from branchlens.session import ensure_checkpoint_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score as toxic go. The field learns from the
    labelled rows of the stage's own documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines with an earlier duplicate go."""
    return line_dedup.drop_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group stays."""
    return near_dup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: whole passes and picked blocks of each source."""
    return mixing.apply_mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: number of tokens, token ids, and whether they decode to the
    text, under n_tokens, token_ids and round_trip or free variants of them."""
    got = bpe.encode(docs, vocabulary())
    ids, decoded = got.columns[-2:]
    exact = F.col(decoded) == F.coalesce(F.col("text"), F.lit(""))
    new = {"n_tokens": F.size(ids).cast("long"), "token_ids": F.col(ids), "round_trip": exact}
    return got.select(*docs.columns, *[c.alias(free_name(docs, n)) for n, c in new.items()])


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can neither fit the tagger nor merge byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/branchlens-pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
