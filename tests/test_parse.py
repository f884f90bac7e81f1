"""K1/K2 number parsing and E4 branch names on the FIXTURES money strings."""

from pyspark.sql import functions as F

from branchlens.sources.reports import branch_name, to_num, to_num_zero


def test_to_num(spark):
    vals = ["1,234.50", "(12.5)", "-", "", " 7 ", "nan", "1d", "1e3", None, '"3,355"']
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_num(F.col("s"))).collect()]
    assert got == [1234.5, -12.5, None, None, 7.0, None, None, 1000.0, None, 3355.0]
    got0 = [r[0] for r in df.select(to_num_zero(F.col("s"))).collect()]
    assert got0 == [1234.5, 0.0, 0.0, 0.0, 7.0, 0.0, 0.0, 1000.0, 0.0, 3355.0]


def test_branch_name(spark):
    df = spark.createDataFrame([("12 - Achrafieh",), ("Shop-Jbeil",), ("Plain",)], "s string")
    assert [r[0] for r in df.select(branch_name(F.col("s"))).collect()] == ["Achrafieh", "Jbeil", "Plain"]


def test_extract_count(spark):
    from branchlens.functions.exprs import extract_count
    df = spark.createDataFrame([("top 3 products",), ("show me products",), ("top 50",), ("best 0",)], "q string")
    assert [r[0] for r in df.select(extract_count("q")).collect()] == [3, 5, 10, 1]


def test_to_num_strict(spark):
    import pytest
    from pyspark.errors import PySparkException

    from branchlens.sources.reports import to_num_strict
    ok = spark.createDataFrame([("1,234.5",), (" 7",)], "s string")
    assert [r[0] for r in ok.select(to_num_strict(F.col("s"))).collect()] == [1234.5, 7.0]
    bad = spark.createDataFrame([("abc",)], "s string")
    with pytest.raises(Exception) as e:
        bad.select(to_num_strict(F.col("s"))).collect()
    assert isinstance(e.value, (PySparkException, Exception))
