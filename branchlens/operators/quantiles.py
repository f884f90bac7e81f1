"""Exact grouped quantiles without a group's values in one buffer (L1, G7, G9,
G23).

A quantile with linear interpolation needs two order statistics. Each wanted rank
of a (group, column) is a bracket: lowest and highest value it can have, the
number of values below, and the number inside. A round counts the values inside
each bracket into BINS bins, with each bin's own lowest and highest value, and the
bin that holds the rank is the next bracket. Counting is a partial aggregate, so a
group with a third of all rows is spread over all tasks. Bins are linear and, every
second round, logarithmic, so values many orders of magnitude apart are told
apart too; the lowest and the highest value of a bracket never share a linear bin,
so each round makes progress. A bracket of one value is the answer, and one of at
most LEAF values is read out as it is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 1024
LEAF = 4096


def _bin(v: Column, lo: Column, hi: Column, logarithmic: bool) -> Column:
    """Bin of v in [lo, hi], growing with v; halves keep the span finite."""
    linear = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    share = linear
    if logarithmic:
        size = F.try_divide(F.ln(F.abs(v)) - F.ln(F.abs(lo)), F.ln(F.abs(hi)) - F.ln(F.abs(lo)))
        # both ends of one sign; among negative values the log shrinks as v grows, as does the span
        share = F.when((lo > 0) | (hi < 0), F.coalesce(size, linear)).otherwise(linear)
    return F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1))


def group_quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(group, ``<column>_q`` for every column): the array of its quantiles ``qs``
    with linear interpolation over the non-null values; null where a group has
    none. Null group keys are a group. ``df`` is read a few times: pass a table."""
    g = list(group)
    ends = df.groupBy(*g).agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"_{a}{i}") for i, c in enumerate(columns)
                                for a, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    ends = cut_lineage(ends)
    rank = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(float(q)) for q in qs]), lambda q: F.array(
        F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)))))
    col = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_n{i}").alias("n"), F.col(f"_lo{i}").alias("lo"),
                                       F.col(f"_hi{i}").alias("hi")) for i in range(len(columns))]))
    open_ = (ends.select(*g, col.alias("s")).select(*g, "s.*").filter("n > 0")
             .select(*g, "c", F.explode(rank).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"),
                     F.col("n").alias("inside")))
    values = df.select(*g, F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v"))
                                               for i, c in enumerate(columns)])).alias("s")).select(*g, "s.c", "s.v")

    def inside(brackets: DataFrame) -> DataFrame:
        b = brackets.select(*[F.col(k).alias(f"_{k}") for k in g], F.col("c").alias("_c"), "rank", "lo", "hi", "below")
        same = [values[k].eqNullSafe(b[f"_{k}"]) for k in g] + [values["c"] == b["_c"], values["v"] >= b["lo"], values["v"] <= b["hi"]]
        cond = same[0]
        for s in same[1:]:
            cond = cond & s
        return values.join(b, cond).select(*g, "c", "rank", "lo", "hi", "below", "v")

    keys = [*g, "c", "rank"]
    done, turn = open_.filter("lo = hi OR inside <= " + str(LEAF)), 0
    wide = open_.filter(f"lo < hi AND inside > {LEAF}")
    while wide.head(1):
        binned = inside(wide).withColumn("bin", _bin(F.col("v"), F.col("lo"), F.col("hi"), turn % 2 == 1))
        bins = binned.groupBy(*keys, "below", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))          # bounded: BINS rows
        bins = bins.withColumn("upto", F.col("below") + upto).withColumn("from", F.col("upto") - F.col("n"))
        step = cut_lineage(bins.filter("`from` <= rank AND rank < upto")
                           .select(*keys, "lo", "hi", F.col("from").alias("below"), F.col("n").alias("inside")))
        done = done.unionByName(step.filter(f"lo = hi OR inside <= {LEAF}"))
        wide, turn = step.filter(f"lo < hi AND inside > {LEAF}"), turn + 1
    at = (F.col("rank") - F.col("below") + 1).cast("int")
    leaves = (inside(done.filter("lo < hi")).groupBy(*keys, "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
              .select(*keys, F.element_at("vs", at).alias("v")))
    found = done.filter("lo = hi").select(*keys, F.col("lo").alias("v")).unionByName(leaves)
    # few numbers a group: the order statistics of each column as a map
    stats = found.groupBy(*g).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("c") == i, F.struct("rank", "v")))).alias(f"_m{i}")
                                    for i in range(len(columns))])
    right = stats.select(*[F.col(k).alias(f"_{k}") for k in g], *[f"_m{i}" for i in range(len(columns))])
    cond = None
    for k in g:
        one = ends[k].eqNullSafe(right[f"_{k}"])
        cond = one if cond is None else cond & one

    wanted = F.array(*[F.lit(float(q)) for q in qs])

    def quantiles(i: int) -> Column:
        def one(q):
            pos = (F.col(f"_n{i}") - 1) * q
            lo, hi = F.floor(pos), F.ceil(pos)
            a, b = (F.try_element_at(f"_m{i}", x) for x in (lo, hi))
            return F.when(lo == hi, a).otherwise((hi - pos) * a + (pos - lo) * b)
        return F.transform(wanted, one)

    return ends.join(right, cond, "left").select(
        *[ends[k] for k in g],
        *[F.when(F.col(f"_n{i}") > 0, quantiles(i)).alias(f"{c}_q") for i, c in enumerate(columns)])
