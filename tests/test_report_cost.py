"""What the report writer and parser spend on a line."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from branchlens.plans import reports as plans_reports
from branchlens.sources import chunks
from branchlens.sources import reports as rp


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_place_sorts_like_its_parts(spark):
    """One text in place of numbers and names: the same order, nulls first, also where
    names begin alike, are empty or hold NULs."""
    rng = random.Random(3)
    names = [None, "", "a", "ab", "a\x00", "a\x00b", "a\x01", "b", "\x00", "é", "1", "0"]
    rows = [(rng.choice(names), rng.choice("012"), rng.choice(names), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, n string, b string, i int").withColumn("m", F.col("n").cast("int"))
    place = F.when(F.col("m") == 0, rp._place((1, F.col("a"), 0, F.col("b")))).when(
        F.col("m") == 1, rp._place((1, F.col("a"), 1, F.col("b")))).otherwise(rp._place((1, F.col("a"), 2, F.col("b"))))
    want = [r["i"] for r in df.orderBy("a", "m", "b", "i").collect()]
    assert [r["i"] for r in df.withColumn("p", place).orderBy("p", "i").collect()] == want


def test_rest_is_not_sorted_for_states(spark, monkeypatch):
    """Chunk ends of the lines without a state come from a hash aggregate: only the
    marks are sorted for their states."""
    monkeypatch.setattr(chunks, "cut_lineage", lambda df: df)
    cols = "file string, _chunk bigint, line_no bigint"
    rest = spark.createDataFrame([("f", 0, i) for i in range(10)], cols)
    marks = spark.createDataFrame([("f", 0, i) for i in range(3)], cols).withColumn("s", F.struct(F.col("line_no").cast("string").alias("n")))
    heads = chunks.heads(rest, marks, "s")
    assert any("HashAggregate(keys=[file" in ln and "functions=[partial_max(line_no" in ln for ln in _plan(heads).splitlines())
    assert [(r["_in"], r["_last"]) for r in heads.collect()] == [(None, 9)]


def test_number_cells_are_cleaned_once(spark):
    """A filter on a number cell names the cleaned text four times, three of them
    behind the look for a bracket; results as before on odd cells."""
    cells = ["1,234.50", "(12.5)", "-", "", " 7 ", "nan", "1d", "1e3", None, '"(1,2)"', "((3))", "(4", "5)", "1\n", "\t7", "(-5)",
             ".5", "5.", "+.", "(1e2)", "x(1)", "(nan)", "inf", "0x1p3"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    condition = _plan(df.filter(rp.to_num(F.col("c")) > 0)).split("Filter")[1].split("\n")[0]
    assert condition.count("trim(c") <= 5
    got = [r[0] for r in df.select(rp.to_num(F.col("c"))).collect()]
    assert got == [1234.5, -12.5, None, None, 7.0, None, None, 1000.0, None, -12.0, None, None, None, 1.0, None, None,
                   0.5, 5.0, None, -100.0, None, None, None, None]


def test_lines_dealt_without_samples(spark, monkeypatch):
    """No written report is range partitioned, which computes every line once more."""
    plans = []
    for m in (chunks, rp):
        monkeypatch.setattr(m, "cut_lineage", lambda df, real=m.cut_lineage: plans.append(_plan(df)) or real(df))
    it = spark.createDataFrame([("b", 2000, m, "d", "c", "v", "g", f"p{i}", 1.0, 5.0, 2.0, 3.0) for m in (1, 2) for i in range(3)],
                               "branch string, year int, month int, department string, category string, division string, grp string, "
                               "product string, qty double, price double, cost double, profit double")
    item = rp.write_item_report(it, faults=True).orderBy("file", "line_no").collect()
    group = rp.write_group_report(it).orderBy("line_no").collect()
    assert not any("rangepartitioning" in p for p in plans)
    assert [r["line_no"] for r in item] == [*range(1, 15), *range(1, 14)]
    assert [r["desc"] for r in item[:9]] == [rp.PRINT_DATE, rp.PAGE_NOISE[0], "Store - b", "d", "c", "v", "p0", "p1", "p2"]
    assert [r["desc"] for r in group[:6]] == [rp.PRINT_DATE, rp.PAGE_NOISE[1], "Branch: b", "Division: v", "Group: g", "p0"]


def test_long_files_are_cut(spark):
    """Files longer than a part are sorted by several tasks, also where one group is
    longer than a part; a file whose name is null is a file too. Numbers are the same."""
    rng = random.Random(5)
    rows = [(f, f"{g:02d}", i) for f, groups in (("a", 30), ("b", 2), (None, 9), ("c", 1)) for g in range(groups)
            for i in range(rng.choice([1, 3, 40]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, g string, i int").withColumn("place", F.format_string("%s%05d", "g", "i"))
    groups = df.groupBy("file", "g").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    got = {}
    for most in (10, 1 << 18):
        at = chunks.cuts(groups, "place", "n", most)
        assert at.filter("file = 'a'").count() == (most == 10)
        placed = chunks.in_cut_files(df, "place", at, ["place"])
        named = chunks.numbered(placed.fillna({"file": "-"})).collect()
        got[most] = sorted((r["file"], r["line_no"], r["place"]) for r in named)
        if most == 10:
            assert placed.filter("file = 'a'").select(F.shiftright("line_no", 33)).distinct().count() > 5
    want = sorted((f or "-", f"{g}{i:05d}") for f, g, i in rows)
    assert got[10] == got[1 << 18]
    assert [(f, p) for f, _, p in got[10]] == want
    for f in {x[0] for x in want}:
        assert [n for g, n, _ in got[10] if g == f] == list(range(1, 1 + sum(x[0] == f for x in want)))


def test_chunk_ends_look_at_no_cell(spark, tmp_path, monkeypatch):
    """Ends of chunks and files need the places of the lines, not what they are."""
    cols = "file string, line_no int, desc string, qty string, price string, cost string, profit string"
    spark.createDataFrame([("f", 1, "Store - a", None, None, None, None), ("f", 2, "x", "1", "2", "3", "4"),
                           ("f", 3, "end", None, None, None, None)], cols).write.parquet(str(tmp_path / "lines"))
    plans = []
    monkeypatch.setattr(chunks, "cut_lineage", lambda df, real=chunks.cut_lineage: plans.append((df.columns, _plan(df))) or real(df))
    parsed = rp.parse_item_report(spark.read.parquet(str(tmp_path / "lines")))
    plan = next(p for c, p in plans if "_last" in c)
    reads = [ln for ln in plan.splitlines() if str(tmp_path) in ln and "FileScan" in ln]
    assert reads and not any("qty" in ln for ln in reads)
    assert [r["desc"] for r in parsed.orderBy("line_no").collect()] == ["Store - a", "x"]


def test_column_printed_like_fmt(spark):
    """The cheaper print of a column gives the texts of ``fmt``, also where it rounds, at
    thousands, beyond a million and on numbers that are none."""
    rng = random.Random(7)
    odd = [None, 0.0, float("nan"), float("inf"), 5e-5, 1.5e-4, 0.5, 1.5, 2.5, 999.5, 999.99994, 999.99996, 1000.0, 9999.99996,
           99999.5, 99999.99996, 999999.4, 999999.99994, 999999.99996, 1e6, 123456789.12345, 1e15, 1e300, 1e-320, 0.1 + 0.2, 1234.5]
    odd += [rng.random() * 10 ** rng.randint(-6, 9) for _ in range(2000)] + [rng.randint(0, 10 ** 9) / 20000 for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in odd] + [(-x,) for x in odd if x is not None], "c double")
    for decimals in (0, 4):
        got, want = rp.fmt_column(F.col("c"), decimals), rp.fmt(F.col("c"), decimals)
        assert df.filter(~got.eqNullSafe(want)).count() == 0
        assert df.filter("c is null").select(got).head()[0] is None
    assert [r[0] for r in df.filter("abs(c) = 1234.5").select(rp.fmt_column(F.col("c"), 4)).collect()] == ["1,234.5000", "(1,234.5000)"]


def test_lines_are_compared_by_columns(spark, monkeypatch):
    """The sort of the lines names columns: an expression is computed for both lines of
    every pair that is compared. The price is printed from a column as well."""
    plans = []
    monkeypatch.setattr(chunks, "cut_lineage", lambda df, real=chunks.cut_lineage: plans.append((df.columns, _plan(df))) or real(df))
    it = spark.createDataFrame([("b", 2000, 1, "d", "c", "v", "p", 1.0, 123456.5, 2.0, 3.0)],
                               "branch string, year int, month int, department string, category string, division string, "
                               "product string, qty double, price double, cost double, profit double")
    lines = rp.write_item_report(it, faults=True)
    plan = next(p for c, p in plans if "line_no" in c).splitlines()
    top, sort = plan[:next(i for i, ln in enumerate(plan) if "Exchange" in ln)], next(ln for ln in plan if " Sort [" in ln)
    assert "xxhash64" not in sort and not any("LOG10" in ln.upper() for ln in top)
    assert [r["price"] for r in lines.filter("desc = 'p'").collect()] == ["12,345.6500"]


def test_fact_cells_are_parsed_once(spark):
    """The filter on the price takes the parsed cells instead of parsing them once more."""
    cols = "file string, line_no int, desc string, qty string, price string, cost string, profit string, is_total boolean, is_open boolean"
    rows = [("f", 1, " a ", "1", "9", "1,000.5", "(0.5)", False, False), ("f", 2, "zero", "1", "9", "2", "(2)", False, False),
            ("f", 3, "no cost", "1", "9", None, "4", False, False), ("f", 4, "none", None, None, None, None, False, False),
            ("f", 5, "bad", "1", "9", "x", "3", False, False), ("f", 6, "t", "1", "9", "2", "2", True, False)]
    df = spark.createDataFrame(rows, cols).select("*", *[F.lit("x").alias(n) for n in rp.LEVELS])
    facts = rp.report_facts(df)
    assert _plan(facts.groupBy("file").agg(F.sum("profit"))).count("regexp_extract(CASE WHEN") <= 2
    assert facts.columns == ["file", "line_no", *rp.LEVELS, "product", "qty", "price", "cost", "profit"]
    got = [(r["product"], r["qty"], r["price"], r["cost"], r["profit"]) for r in facts.orderBy("line_no").collect()]
    assert got == [("a", 1.0, 1000.0, 1000.5, -0.5), ("no cost", 1.0, 4.0, None, 4.0), ("bad", 1.0, 3.0, None, 3.0)]


def test_totals_and_items_split_in_one_pass(spark, monkeypatch):
    """Scopes and leaked totals come from one pass over the parsed lines, also without lines."""
    cols = "desc string, is_total boolean, is_open boolean, total_scope string"
    rows = [("Total By Branch:", True, False, "Branch"), ("p", False, False, None), ("Grand Total By Month:", False, False, None),
            (None, False, False, None), ("open", False, True, None), ("Total by x", True, False, None)]
    for given, want in ((rows, {("Branch", 1), ("items", 3), (None, 1), ("leaked_totals", 1)}), ([], {("leaked_totals", 0)})):
        parsed = spark.createDataFrame(given, cols)
        monkeypatch.setattr(plans_reports, "parsed_item_report", lambda *_: parsed)
        got = plans_reports.q_totals_items_split(spark, "")
        assert "Scan ExistingRDD" not in _plan(got) and "LocalTableScan" not in _plan(got)
        assert {(r["scope"], r["n"]) for r in got.collect()} == want
