"""Mixing sources to target weights.

Sainte-Lague apportionment in two steps. Every source has a target in words;
whole passes over the source are taken first, the rest is apportioned in
blocks of about BLOCK words: sources get blocks by the highest quotients
v / (2j + 1), then the shards of a source share its blocks the same way, which
gives an integer quota per shard. Within a shard whole documents fill that
quota in a seeded order of their hashes, so no random state is needed and
reruns agree. What is then missing is the document closest to it in size, if it
is met within a block; otherwise the next document is cut at the line end
closest to it. So all documents of a shard but one leave as exact copies, and
no line is cut.

The j-th highest quotients are found without a queue: for total votes V, M
seats and n parties the last winning divisor lies between V / (M + n) and
V / (M - n), so each party has only a few undecided quotients; those are ranked
and the rest is certain.

A shard has a bounded number of documents (SHARD_DOCS on average, dealt by
hash), whatever its source's size; the words before a document are a running
sum inside a shard. Only sizes travel, never texts, until ``apply_mix`` joins the
plan back; the report reads the texts of the documents to be cut only.

Defined results: null or blank texts have size 0 and take nothing; a null
source is a source of its own, last in order; rows that agree in id, source and
text take the same words; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlens.llm.common import n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
BLOCK = 16
SHARD_DOCS = 4096
SEED = 20_240_607


def fingerprint(text: str = "text", source: str = "source") -> Column:
    return F.xxhash64(F.col(text), F.col(source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """Per source (rows: source, size, copies) its size and target words: shares of ``share`` times all
    words by weight, no source above ``passes`` times its size, the excess
    shared again by weight among the others. The end of that resharing is the
    level x with sum(min(passes * size, x * weight)) = total, found over the
    sources sorted by passes * size / weight."""
    per = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"),
        F.sum("size").cast("long").alias("single"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    names = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", names[(F.row_number().over(order) - 1) % len(weights)])
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (per.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
           .withColumn("x", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
                       / F.sum("w").over(from_here))
           # the first source whose cap is not reached fixes the level
           .withColumn("level", F.max(F.when(F.col("cap") >= F.col("x") * F.col("w"), F.col("x"))).over(every)))
    target = F.when(F.col("cap") < F.col("level") * F.col("w"), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return per.select("source", "source_size", "single", "n", F.coalesce(F.least(target, F.col("cap")), F.lit(0.0)).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Seats per party of each group by the highest quotients votes / (2j + 1),
    j = 0, 1, ...; equal quotients go to the party that comes first. ``seats``
    is the group's number of seats, repeated on its rows."""
    g = Window.partitionBy(*group)
    p = (parties.withColumn("_v", F.sum(votes).over(g).cast("double"))
         .withColumn("_n", F.count("*").over(g)))
    # quotients above the highest possible last winner are certain
    share = F.col(votes) / F.when(F.col("_v") > 0, F.col("_v"))
    low = F.floor(share * F.greatest(F.col(seats) - F.col("_n"), F.lit(0)) - 0.5)
    high = F.ceil(share * (F.col(seats) + F.col("_n")) + 0.5)
    p = (p.withColumn("_sure", F.greatest(F.coalesce(low, F.lit(0)), F.lit(0)).cast("long"))
         .withColumn("_last", F.greatest(F.coalesce(high, F.lit(0)), F.lit(0)).cast("long")))
    open_ = (p.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
             .where(F.col(votes) > 0)
             .select(*group, *party, "_left", votes, F.explode(F.sequence("_sure", "_last")).alias("_j"))
             .withColumn("_q", F.col(votes) / (2 * F.col("_j") + 1)))
    by = Window.partitionBy(*group).orderBy(F.desc("_q"), *[F.col(c).asc_nulls_last() for c in party])
    won = (open_.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= F.col("_left"))
           .groupBy(*group, *party).agg(F.count("*").alias("_won")))
    keys = group + party
    won = won.select(*[F.col(c).alias("_" + c) for c in keys], "_won")
    on = [p[c].eqNullSafe(won["_" + c]) for c in keys]
    return (p.join(won, on, "left")
            .withColumn("quota", (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long"))
            .drop("_v", "_n", "_sure", "_last", "_won", *["_" + c for c in keys]))


def _cut(text: Column, wanted: Column) -> Column:
    """(lines, words) of the beginning of a text that ends at the line end
    closest to so many words; the earlier one of equally close ends."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("lines"),
                     F.lit(0).cast("long").alias("words"))

    def step(s, size):
        i, n = s["i"] + 1, s["n"] + size
        closer = F.abs(n - wanted) < F.abs(s["words"] - wanted)
        return F.struct(i.alias("i"), n.alias("n"), F.when(closer, i).otherwise(s["lines"]).alias("lines"),
                        F.when(closer, n).otherwise(s["words"]).alias("words"))

    sizes = F.transform(F.split(text, "\n", -1), n_words)
    return F.aggregate(sizes, start, step, lambda s: F.struct(s["lines"].alias("lines"), s["words"].alias("words")))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES,
             block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per distinct (doc_id, source, text): doc_id, source, print,
    size, copies, source_size, target, whole passes, and ``more``, the words
    wanted once more: none, all, or as many as the line end closest to them
    gives. ``copies`` is the number of rows that agree."""
    d = (docs.select("doc_id", "source", fingerprint().alias("print"), n_words(F.col("text")).alias("size"))
         .groupBy("doc_id", "source", "print", "size").agg(F.count("*").alias("copies")))
    per = targets(d, weights, share, passes)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("passes", F.floor(ratio).cast("long"))
    per = per.withColumn("votes", (ratio - F.col("passes")) * F.col("single"))
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("one", F.lit(1))
           .withColumn("m", F.round(F.sum("votes").over(all_) / block).cast("long")))
    per = (sainte_lague(per, ["one"], ["source"], "votes", "m").withColumnRenamed("quota", "blocks")
           .withColumn("n_shards", F.ceil(F.col("n") / SHARD_DOCS).cast("long"))
           .select("source", "source_size", "target", "passes", "blocks", "n_shards"))
    d = d.join(per.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "print"), F.col("n_shards")))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_size", "blocks").drop("blocks")
    n_blocks = F.greatest(F.round(F.col("shard_size") / block), F.lit(1)).cast("long")
    shards = shards.select(F.col("source").alias("s2"), F.col("shard").alias("h2"),
                           F.floor(F.least("quota", n_blocks) * F.col("shard_size") / n_blocks).cast("long").alias("fill"))
    d = d.join(shards, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("h2"))).drop("s2", "h2")
    shard = Window.partitionBy("source", "shard")
    run = (shard.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "print")
           .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("first", F.coalesce(F.sum("size").over(run), F.lit(0)).cast("long"))
    fits = F.col("first") + F.col("size") <= F.col("fill")
    d = d.withColumn("rest", F.col("fill") - F.coalesce(
        F.max(F.when(fits, F.col("first") + F.col("size"))).over(shard), F.lit(0).cast("long")))
    # documents without words share the start of the next one
    d = d.withColumn("near", F.min(F.when(~fits, F.struct(
        F.abs(F.col("size") - F.col("rest")).alias("gap"), F.col("first").alias("at")))).over(shard))
    gap, is_near = F.col("near.gap"), F.col("near.at") == F.col("first")
    more = (F.when(fits, F.col("size"))
            .when((gap <= block) & (gap < F.col("rest")), F.when(is_near & (F.col("size") > 0), F.col("size")))
            .when((F.col("rest") > block) & (F.col("first") < F.col("fill")), F.col("rest")))
    return d.select("doc_id", "source", "print", "size", "copies", "source_size", "target", "passes",
                    F.coalesce(more, F.lit(0)).cast("long").alias("more"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    plan = plan_mix(docs)
    # one row a shard at most, and none where a whole document is close enough
    open_ = plan.where("more > 0 AND more < size").select(
        F.col("doc_id").alias("d2"), F.col("print").alias("p2"), F.col("more").alias("wanted"))
    texts = docs.select("doc_id", "text", fingerprint().alias("print"))
    cuts = (texts.join(F.broadcast(open_), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("print") == F.col("p2")))
            .select("d2", "p2", _cut(F.col("text"), F.col("wanted"))["words"].alias("cut")).distinct())
    plan = plan.join(F.broadcast(cuts), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("print") == F.col("p2")), "left")
    taken = F.col("passes") * F.col("size") + F.coalesce("cut", "more")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return (plan.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), each.alias("_"))
            .drop("_"))


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows, with the columns of ``docs``: a document appears once
    for each whole pass and once more if it is picked, whole or, for one
    document of a shard, up to the end of a line. Documents with no taken words
    leave."""
    plan = plan_mix(docs, **how).where("size > 0 AND passes + more > 0").select(
        F.struct("size", "passes", "more").alias("_mix"), F.col("doc_id").alias("_mix_id"),
        F.col("print").alias("_mix_print"))
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_row_id"),
                    fingerprint().alias("_row_print"))
    d = d.join(plan, F.col("_row_id").eqNullSafe(F.col("_mix_id")) & (F.col("_row_print") == F.col("_mix_print")))
    text, size, passes, more = (F.col(c) for c in ("_row.text", "_mix.size", "_mix.passes", "_mix.more"))
    whole = F.array_repeat(text, passes.cast("int"))
    part = F.transform(F.array(_cut(text, more)), lambda c: F.array_join(
        F.slice(F.split(text, "\n", -1), F.lit(1), c["lines"]), "\n"))
    extra = (F.when(more == 0, F.array().cast("array<string>")).when(more >= size, F.array(text))
             .otherwise(F.filter(part, lambda t: n_words(t) > 0)))
    out = d.select("_row", F.explode(F.concat(whole, extra)).alias("_text"))
    cols = []
    for c in docs.columns:
        col = F.col("_row").getField(c)
        if c == "text":
            col = F.col("_text")
        elif c == "n_chars":
            col = F.length("_text").cast(docs.schema[c].dataType)
        cols.append(col.alias(c))
    return out.select(*cols)
