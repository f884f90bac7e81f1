"""Sinks (B1-B7) and input guards.

Tables are written as Parquet (or CSV where a human reads them), range
partitioned and sorted within partitions for ordered outputs instead of a
global single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_facts(df: DataFrame, path: str, partition_by: str = "branch", mode: str = "overwrite") -> None:
    """Cleaned facts partitioned by branch, so a branch slice is a partition
    prune (B1)."""
    df.write.mode(mode).partitionBy(partition_by).parquet(path)


def write_sorted(df: DataFrame, path: str, sort_cols: Sequence, fmt: str = "parquet",
                 partitions: int | None = None, mode: str = "overwrite") -> None:
    """Ordered output: range-partitioned on the sort keys, sorted within
    partitions; part files read in name order give the total order (B2, B3, B6)."""
    out = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    out = out.sortWithinPartitions(*sort_cols)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_by_k(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-K factor tables / metrics as one table partitioned by K."""
    df.write.mode(mode).partitionBy("K").parquet(path)


def write_chosen_k(chosen: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chosen K as a one-row table."""
    chosen.select(F.col(chosen.columns[0]).cast("int").alias("chosen_K")).coalesce(1).write.mode(mode).parquet(path)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raise if columns are missing (A11); checked on the schema, no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}. Found: {df.columns}")


def require_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise listing every input that cannot be read."""
    missing = []
    for p in paths:
        try:
            spark.read.parquet(p).schema  # noqa: B018 - resolves the files only
        except Exception:  # noqa: BLE001
            missing.append(p)
    if missing:
        raise FileNotFoundError("Missing required inputs: " + ", ".join(missing))
