"""E1 / E2 window rules against the plain row-by-row state machines."""

import random

from branchlens.sources import reports as rp

LEVELS = ["Branch", "Department", "Category", "Division"]


def state_machine_14(rows):
    cur = {lv: None for lv in LEVELS}
    out = []
    for desc, qty in rows:
        txt = (desc or "").strip()
        import re
        m = re.match(r"\s*total\s+by\s+(Branch|Department|Category|Division)\s*:?\s*$", txt, re.I)
        if m:
            out.append(tuple(cur[lv] for lv in LEVELS))
            idx = [x.lower() for x in LEVELS].index(m.group(1).lower())
            for lv in LEVELS[idx:]:
                cur[lv] = None
            continue
        if qty is None and txt:
            lv = next((x for x in LEVELS if cur[x] is None), "Division")
            i = LEVELS.index(lv)
            cur[lv] = txt.split(" - ", 1)[1].strip() if (lv == "Branch" and " - " in txt) else txt
            for x in LEVELS[i + 1:]:
                cur[x] = None
        out.append(tuple(cur[lv] for lv in LEVELS))
    return out


def random_report(rng, n):
    rows = []
    for i in range(n):
        r = rng.random()
        if r < 0.3:
            rows.append((f"open{i}", None))
        elif r < 0.5:
            rows.append((f"Total By {rng.choice(LEVELS)}:", "1"))
        else:
            rows.append((f"item{i}", "2"))
    return rows


def test_implicit_matches_state_machine(spark):
    rng = random.Random(7)
    data, expect = [], {}
    for f in range(40):
        rows = random_report(rng, 30)
        # page header + footer, removed by the parser
        full = [("22-Jan-26", None), ("Product Desc", None)] + rows + [("footer", None)]
        for ln, (d, q) in enumerate(full, start=1):
            data.append((f"f{f}", ln, d, q, None, None, None))
        for ln, st in zip(range(3, 3 + len(rows)), state_machine_14(rows)):
            expect[(f"f{f}", ln)] = st
    df = spark.createDataFrame(data, "file string, line_no int, desc string, qty string, price string, "
                                     "cost string, profit string")
    for chunk in (3, 7, 1 << 16):      # lines of a chunk: the scan carries the state from chunk to chunk
        got = {(r["file"], r["line_no"]): tuple(r[lv] for lv in LEVELS)
               for r in rp.parse_item_report(df, chunk).collect()}
        assert got == expect, chunk


EXPLICIT = ["Branch", "Division", "Group"]


def state_machine_191(rows):
    cur, out = dict.fromkeys(EXPLICIT), []
    for text in rows:
        flat = " ".join(text.split())
        total = flat.lower().startswith("total by ")
        word, colon, name = (flat[9:] if total else flat).partition(":")
        level = next((x for x in EXPLICIT if x.lower() == word.strip().lower()), None)
        known = level and colon and name.strip()
        below = EXPLICIT[EXPLICIT.index(level):] if known else []
        if known and not total:
            cur.update(dict.fromkeys(below))
            cur[level] = name.strip()
        out.append(tuple(cur[x] for x in EXPLICIT))
        if known and total:
            cur.update(dict.fromkeys(below))
    return out


def test_explicit_matches_state_machine(spark):
    rng = random.Random(11)
    data, expect = [], {}
    for f in range(30):
        rows = []
        for i in range(30):
            level, r = rng.choice(EXPLICIT + ["Season"]), rng.random()
            rows.append(f" {level.upper()} : n{i}" if r < 0.15 else f"{level}: n{i}" if r < 0.4
                        else f"Total  by {level}: n{i}" if r < 0.6 else f"{level}:" if r < 0.65 else f"item{i}")
        full = ["19-Jan-26", "Description"] + rows + ["footer"]
        data += [(f"f{f}", ln, t, "1", "2") for ln, t in enumerate(full, start=1)]
        expect.update({(f"f{f}", ln): st for ln, st in zip(range(3, 3 + len(rows)), state_machine_191(rows))})
    df = spark.createDataFrame(data, "file string, line_no int, desc string, qty string, amount string")
    for chunk in (3, 1 << 16):
        got = {(r["file"], r["line_no"]): tuple(r[x] for x in EXPLICIT) for r in rp.parse_group_report(df, chunk).collect()}
        assert got == expect, chunk


def test_no_window_over_a_file(spark):
    """Windows over lines are partitioned by file and chunk; those by file alone
    run over one row per chunk."""
    import contextlib
    import io
    import re
    df = spark.createDataFrame([("f", 1, "a", "1", "2", "3", "4")], "file string, line_no int, desc string, qty string, "
                                                                "price string, cost string, profit string")
    for parsed in (rp.parse_item_report(df), rp.parse_group_report(df)):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            parsed.explain("simple")
        plan = out.getvalue()
        assert not re.search(r"Window \[.*line_no.*\], \[file#\d+\], \[line_no", plan)
        assert "_chunk" in plan


def test_number_lines(spark):
    """Numbers from 1 without gaps, whatever the partitions."""
    from pyspark.sql import functions as F

    from branchlens.sources import chunks
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("f"), F.col("id") % 7)).alias("file"),
                                    F.xxhash64("id").alias("k"))
    got = chunks.numbered(chunks.in_file_order(rows, ["k"])).toPandas().sort_values(["file", "k"])
    for _, g in got.groupby("file"):
        assert g.line_no.tolist() == list(range(1, len(g) + 1))
    assert len(got) == 5000


def test_monthly_report_chunks(spark):
    from pyspark.sql import functions as F
    rows = [(f"b{b}", y, m, float(b * 1000 + y + m)) for b in range(4) for y in (2000, 2001, 2003) for m in range(1, 13)]
    lines = rp.write_monthly_report(spark.createDataFrame(rows, "branch string, year int, month int, sales double"))
    for chunk in (2, 1 << 16):
        long = rp.parse_monthly_report(lines, chunk=chunk)
        assert sorted(map(tuple, long.filter("month > 0").collect())) == sorted(rows)
        assert long.filter("month = 0").agg(F.sum("sales")).first()[0] == sum(r[3] for r in rows)
    assert {r["line_no"]: r["all_months"] for r in rp.header_rows(lines).collect()} == {
        1: True, 7: False, 13: False, 19: False, 25: False}


def test_explicit_rules(spark):
    lines = ["Branch: a", "x0", "Division: d1", "Group: g1", "x1", "Total by Group: g1", "x2",
             "Branch: b", "x3", "Group: g2", "x4", "Total by Division: d9", "x5", "TOTAL BY BRANCH: b", "x6"]
    df = spark.createDataFrame([("f", i, t, "1", "2") for i, t in enumerate(lines)],
                               "file string, line_no int, desc string, qty string, amount string")
    got = {r["line_no"]: (r["Branch"], r["Division"], r["Group"])
           for r in rp.parse_group_report(df, noise=False).collect()}
    assert got[1] == ("a", None, None)
    assert got[4] == ("a", "d1", "g1")
    assert got[5] == ("a", "d1", "g1")       # closing row tagged before it closes
    assert got[6] == ("a", "d1", None)
    assert got[8] == ("b", None, None)       # new branch resets lower levels
    assert got[10] == ("b", None, "g2")
    assert got[12] == ("b", None, None)      # division closing clears group
    assert got[14] == (None, None, None)


def test_file_roundtrip(spark, tmp_path):
    """Written report files read back with line numbers give the same parse, also
    where ranges are a few bytes and the header has blanks and repeats."""
    from pyspark.sql import functions as F

    from branchlens.sources import files
    from branchlens.sources.tables import items
    cols = ["desc", "qty", "price", "cost", "profit"]
    it = items(spark, "/root/testdata/sf0.001").filter((F.col("year") == 2000) & (F.col("month") == 3))
    lines = rp.write_item_report(it)
    wide = lines.withColumn("gap", F.lit(None).cast("string"))
    files.write_lines(wide, str(tmp_path / "rep"), ["desc", "qty", "price", "gap", "cost", "profit", "profit"],
                      [" Product Desc ", "Qty", "Total Price", "", "Total Cost", "Total Profit", "Total Profit"])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        back = files.with_header(files.read_lines(spark, str(tmp_path / "rep"), folders=True), 1)
        assert back.columns == ["file", "line_no", "Product Desc", "Qty", "Total Price", "Total Cost", "Total Profit", "Total Profit_2"]
        got = {(r[0], r[1] - 1): tuple(v or None for v in r[2:]) for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = {(r["file"], r["line_no"]): tuple(r[c] for c in (*cols, "profit")) for r in lines.collect()}
    assert got == want


def test_headers_and_tables(spark, tmp_path):
    import pytest

    from branchlens.sources import files
    (tmp_path / "a.csv").write_text("\ufeffx, y ,,x\n1,\"2,5\",3\n,,\n", encoding="utf-8")
    (tmp_path / "t.csv").write_text("k,v\na,1\nb,\n", encoding="utf-8")
    got = files.with_header(files.read_lines(spark, str(tmp_path / "a.csv")), 1)
    assert got.columns == ["file", "line_no", "x", "y", "x_2"]
    assert [tuple(r)[1:] for r in got.orderBy("line_no").collect()] == [(2, "1", "2,5", None), (3, "", None, None)]
    with pytest.raises(ValueError):
        files.with_header(files.read_lines(spark, str(tmp_path)), 1)
    from pyspark.sql.types import StructType
    table = files.read_table(spark, str(tmp_path / "t.csv"), StructType.fromDDL("k string, v int"))
    assert sorted(map(tuple, table.collect()), key=str) == [("a", 1), ("b", None)]


def _plan(df) -> str:
    import contextlib
    import io
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue()


def test_cells_parsed_once(spark, tmp_path):
    """Columns of a read file come from stored cells: a line is not parsed again
    wherever one of them is named."""
    from pyspark.sql import functions as F

    from branchlens.sources import files
    (tmp_path / "a.csv").write_text("x,y\n1,2\n\"3,5\",4\n", encoding="utf-8")
    rows = files.with_header(files.read_lines(spark, str(tmp_path / "a.csv")), 1)
    twice = rows.select((F.length("x") + F.length(F.trim("x"))).alias("n"), "y").filter("n > 1")
    assert "from_csv" not in _plan(twice)
    assert sorted(tuple(r)[2:] for r in rows.collect()) == [("1", "2"), ("3,5", "4")]


ITEM_LINES = "file string, line_no int, desc string, qty string, price string, cost string, profit string"


def test_lines_dealt_once(spark):
    """Item lines are shuffled once, by chunk; totals need no scan over the lines."""
    import re
    df = spark.createDataFrame([("f", 1, "Store - a", None, None, None, None), ("f", 2, "x", "1", "2", "3", "4"),
                                ("f", 3, "Total By Branch:", "1", "2", "3", "4"), ("f", 4, "end", None, None, None, None)], ITEM_LINES)
    parsed = rp.parse_item_report(df)
    items, totals = (_plan(f).split("== Physical Plan ==")[1] for f in (rp.report_facts(parsed), rp.report_totals(parsed)))
    assert len(re.findall(r"Exchange hashpartitioning", items)) == 1
    assert "Window" not in totals and "Exchange hashpartitioning" not in totals
    assert [r["Branch"] for r in rp.report_facts(parsed).collect()] == ["a"]
    assert [r["Branch"] for r in rp.report_totals(parsed).collect()] == ["a"]


def test_texts_behind_the_sort(spark):
    """Ranges of the written lines are sampled without printing their numbers."""
    from pyspark.sql import functions as F

    from branchlens.sources import chunks
    seen = spark.sparkContext.accumulator(0)

    def printed(x):
        seen.add(1)
        return str(x)
    rows = spark.range(300).select(F.lit("f").alias("file"), "id")
    got = chunks.in_file_order(rows, ["id"], [F.udf(printed)("id").alias("text")])
    assert [r["text"] for r in got.orderBy("line_no").collect()] == [str(i) for i in range(300)]
    assert seen.value == 300
