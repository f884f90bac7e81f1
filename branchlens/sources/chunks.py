"""Work in file order without one task per file.

Lines carry ``file`` and ``line_no`` (any number that grows in file order: a line
number or a byte offset). A file is cut into chunks of ``line_no``; windows run
over a chunk only. What a chunk needs to know of the lines before it is a
summary that combines associatively: every chunk is summarised by one aggregate,
a prefix scan runs over the summaries (one row a chunk), and the result is
joined back to the chunk's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Span of ``line_no`` in one chunk.
CHUNK = 1 << 16
#: Lines of a file that one task sorts.
PART = 1 << 18
KEY = ["file", "_chunk"]


def in_chunks(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    return lines.withColumn("_chunk", F.floor(F.col("line_no") / size))


def within_chunk():
    """The chunk's lines in order, up to and with the current one."""
    return Window.partitionBy(*KEY).orderBy("line_no")


def running():
    return within_chunk().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier_chunks():
    return Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def carried_in(lines: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(file, _chunk, line and value of the last non-null of each of ``values``
    before the chunk, as structs ``at``, ``v``)."""
    last = [F.max(F.when(v.isNotNull(), F.struct(F.col("line_no").alias("at"), v.alias("v")))).alias(n)
            for n, v in values.items()]
    return (lines.groupBy(*KEY).agg(*last)
            .select(*KEY, *[F.max(n).over(earlier_chunks()).alias(n) for n in values]))


def last_seen(value: Column) -> Column:
    """The last non-null ``value`` of the chunk so far, with its line."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col("line_no").alias("at"), value.alias("v")))).over(running())


def carry_depth(lines: DataFrame, shift: str, cap: str) -> DataFrame:
    """(file, _chunk, _d0): the depth a chunk starts at, when a line maps depth d
    to least(d + shift, cap). Such maps compose to maps of the same kind, so a
    chunk is one (shift, cap relative to the running shift) pair."""
    s = lines.groupBy(*KEY).agg(F.sum(shift).alias("_s"), F.min(cap).alias("_c"))
    before = F.coalesce(F.sum("_s").over(earlier_chunks()), F.lit(0))
    s = s.withColumn("_before", before).withColumn("_low", F.col("_c") - F.col("_before"))
    low = F.coalesce(F.min("_low").over(earlier_chunks()), F.lit(0))
    return s.select(*KEY, (F.col("_before") + F.least(F.lit(0), low)).alias("_d0"))


def in_file_order(rows: DataFrame, order: list, columns: list | None = None) -> DataFrame:
    """``rows`` with ``line_no`` growing in ``order`` within each ``file``: rows
    are range partitioned by file and order, so a large file is many tasks. A
    table in the shared folder, as the numbers belong to one run of the sort.
    ``columns`` are derived behind the sort, as sampling for the ranges computes
    the rows once more. Files lie in the order of a hash, which compares faster
    than their names; names come next, so equal hashes do no harm."""
    keys = [F.xxhash64("file"), "file", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("line_no", F.monotonically_increasing_id())
    return cut_lineage(placed.select("file", "line_no", *columns) if columns else placed)


def cuts(groups: DataFrame, place: str, n: str, most: int = PART) -> DataFrame:
    """(file, ``_cuts``) of the files of more than ``most`` lines: the places where they
    are cut into parts of about ``most`` lines. ``groups`` holds the place and the lines
    ``n`` of every group of lines that stays together. A table of known size, so that a
    small one is broadcast and the lines stay where they are."""
    long = groups.groupBy("file").agg(F.sum(n).alias("_all")).filter(F.col("_all") > most)
    before = Window.partitionBy("file").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    at = groups.join(long, "file").withColumn("_before", F.sum(n).over(before))
    at = at.filter(F.floor(F.col("_before") / most) < F.floor((F.col("_before") + F.col(n)) / most))
    return cut_lineage(at.groupBy("file").agg(F.sort_array(F.collect_list(place)).alias("_cuts")))


def in_cut_files(rows: DataFrame, place: str, at: DataFrame, columns: list) -> DataFrame:
    """``rows`` with ``line_no`` growing with ``place`` within each ``file``, like
    ``in_file_order``: the parts of files between their ``cuts`` ``at`` are dealt by
    hash and sorted in their tasks, so no row is computed once more for samples.
    ``line_no`` is the part of the file, then the place in the task."""
    if at.isEmpty():        # no long file
        parts = rows.withColumn("_part", F.lit(0))
    else:
        part = F.size(F.filter("_cuts", lambda c: c <= F.col(place)))
        parts = rows.join(at, "file", "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")
    # a column, as a sort computes its expressions for every pair of rows that it compares
    placed = parts.repartition("file", "_part").withColumn("_hash", F.xxhash64("file")).sortWithinPartitions("_hash", "file", place)
    number = F.shiftleft(F.col("_part").cast("bigint"), 33) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut_lineage(placed.withColumn("line_no", number).select("file", "line_no", *columns))


def numbered(placed: DataFrame) -> DataFrame:
    """Lines of ``in_file_order`` or ``in_cut_files`` numbered from 1 in each file: the
    first number and the count of every (file, task), a prefix sum over those of a file."""
    part = F.shiftright("line_no", 33)
    starts = placed.groupBy("file", part.alias("_part")).agg(F.min("line_no").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a table of known size, so that a small one is broadcast and the lines stay where they are
    starts = cut_lineage(starts.select("file", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_add")))
    return (placed.withColumn("_part", part).join(starts, ["file", "_part"])
            .withColumn("line_no", F.col("line_no") + F.col("_add")).drop("_part", "_add"))


def heads(rest: DataFrame, marks: DataFrame, state: str) -> DataFrame:
    """(file, _chunk, ``_in``, ``_last``) of every chunk of ``rest`` and ``marks``: the
    last non-null ``state`` of the marks before it, with its line, and the last line of
    its file. The rest has no state, so only the marks are sorted for it. A table of
    known size, so that a small one is broadcast and the lines stay where they are."""
    at = F.max(F.when(F.col(state).isNotNull(), F.struct(F.col("line_no").alias("at"), F.col(state).alias("v"))))
    end = F.max("line_no").alias("_end")
    seen = marks.groupBy(*KEY).agg(at.alias("_in"), end)
    s = seen.unionByName(rest.groupBy(*KEY).agg(F.lit(None).cast(seen.schema["_in"].dataType).alias("_in"), end))
    s = s.groupBy(*KEY).agg(F.max("_in").alias("_in"), F.max("_end").alias("_end"))
    return cut_lineage(s.select(*KEY, F.max("_in").over(earlier_chunks()).alias("_in"),
                                F.max("_end").over(Window.partitionBy("file")).alias("_last")))


def spread(rows: DataFrame, state: str, at: DataFrame) -> DataFrame:
    """``rows`` with ``state`` (null on most) filled from the last one at or before
    the row in its file, and with the columns of the chunk's ``heads`` ``at``. The
    rows are dealt and sorted once."""
    filled = rows.withColumn(state, F.last(state, ignorenulls=True).over(running())).join(at, KEY)
    return filled.withColumn(state, F.coalesce(state, "_in.v"))
