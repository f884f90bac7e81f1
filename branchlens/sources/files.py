"""Reading report exports from files.

Lines come from Spark's text reader, which splits large files by byte range on
any store Spark reads. A line's place is its file, the start of its range and its
place within the range; ``line_no`` is a number that grows in file order, and
``numbered`` turns it into line numbers from 1 by a prefix sum over the ranges. A
report written by many tasks is a folder of part files in name order. Cells are
parsed by ``from_csv``; a byte-order mark is removed. Fixed-schema CSV tables use
``spark.read.schema(...)`` with the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage

BOM = "\ufeff"


def read_lines(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(file, line_no, value) of every line under ``path``, line numbers from 1 in
    file order. With ``folders`` a folder ``file=<name>`` of part files is one
    report, named by the folder."""
    text = spark.read.option("recursiveFileLookup", not folders).text(path)
    name = F.col("file").cast("string") if folders else F.col("_metadata.file_path")
    raw = cut_lineage(text.select(name.alias("file"), F.col("_metadata.file_path").alias("_part"),
                                  F.col("_metadata.file_block_start").alias("_start"),
                                  F.monotonically_increasing_id().alias("_at"), "value"))
    key = ["file", "_part", "_start"]
    ranges = raw.groupBy(*key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_part", "_start").rowsBetween(Window.unboundedPreceding, -1)
    # a table of known size, so that a small one is broadcast and the lines stay where they are
    ranges = cut_lineage(ranges.select(*key, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")).alias("_add")))
    return raw.join(ranges, key).select("file", (F.col("_at") + F.col("_add")).alias("line_no"),
                                        F.regexp_replace("value", f"^{BOM}", "").alias("value"))


def csv_cells(lines: DataFrame) -> DataFrame:
    """Each line's unquoted, trimmed cells (A3: all strings); lines differ in
    length, so missing cells of short lines are left out. A table in the shared
    folder: a line is parsed once, however often its cells are named later."""
    most = lines.select(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0] or 0
    names = [f"c{i}" for i in range(int(most) + 1)]
    row = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    cells = F.array(*[F.coalesce(F.col(f"_r.{n}"), F.lit("")) for n in names])
    last = F.array_max(F.array(*[F.when(F.col(f"_r.{n}").isNotNull(), F.lit(i + 1)).otherwise(0) for i, n in enumerate(names)]))
    return cut_lineage(lines.withColumn("_r", row).withColumn("cells", F.slice(cells, 1, F.greatest(last, F.lit(1)))).drop("_r"))


def header_names(raw: Sequence[str]) -> list[tuple[int, str]]:
    """(place, name) of a header's columns: stripped (A9), blank ones left out
    (A8), repeated ones numbered ``_2``, ``_3`` (A6)."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(c.strip() for c in raw):
        if n:
            seen[n] = seen.get(n, 0) + 1
            out.append((i, n if seen[n] == 1 else f"{n}_{seen[n]}"))
    return out


def with_header(lines: DataFrame, header_line: int, names: Sequence[str] | None = None) -> DataFrame:
    """``read_csv(header=n)``: rows after line ``header_line`` (1-based) of
    every file as named string columns. Files with different headers are an error;
    ``names`` stands for a header."""
    cells = csv_cells(lines)
    if names is None:
        found = cells.filter(F.col("line_no") == header_line).select("cells").distinct().limit(2).collect()
        if len(found) > 1:
            raise ValueError(f"files differ in their headers: {found[0][0]}, {found[1][0]}")
        names = found[0][0] if found else []
    body = cells.filter(F.col("line_no") > header_line)
    return body.select("file", "line_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in header_names(names)])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Fixed-schema CSV table with a header row (A1)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str, cols: Sequence[str], header: Sequence[str] | None = None) -> None:
    """Write report lines as CSV text, one folder per report: its part files in
    name order are its lines in order, so a large report is written by many tasks.
    ``header`` is printed, behind a byte-order mark, as the first line."""
    def q(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.contains(",") | v.contains('"'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    text = lines.select("file", "line_no", F.concat_ws(",", *[q(c) for c in cols]).alias("value"))
    if header:
        top = lines.groupBy("file").agg((F.min("line_no") - 1).alias("line_no"))
        text = text.unionByName(top.withColumn("value", F.lit(BOM + ",".join(header))))
    text = text.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    text.select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
