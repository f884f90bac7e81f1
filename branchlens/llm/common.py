"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the ASCII controls TAB to CR.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Words a memo keeps in each of its two generations, and the longest one kept.
MEMO = 400_000
MEMO_CHARS = 64
#: Text a batch is worked on at once.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trimmed(text: Column) -> Column:
    """The text without leading and trailing separators; null becomes empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty or blank texts."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def n_words(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_GAP))).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text divisible by 5,
    and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (inputs may carry any extra
    columns)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


class Memo(dict):
    """word -> packed ids, made on demand. When the young generation is full
    it replaces the old one; words found in the old one move on."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


def pack_ids(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def steps(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about STEP_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end
