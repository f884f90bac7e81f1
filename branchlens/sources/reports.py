"""POS report text lines: writer and parser (A2, D1f-D3f, D5f, D6f, E1-E5,
K1-K3, C7).

A report is a sequence of text rows per file: page header, nested opening
rows (no quantity), item rows, ``Total By <level>:`` closing rows, a footer.
Lines are rows (file, line_no, cells...); ``line_no`` grows in file order. Real
exports come from the ``report_lines`` data source (``sources/files.py``); here
reports are *written* from the items view so that a parse can be checked
against the direct aggregate. The writers can print faulty reports on purpose
(see ``write_item_report``).

Hierarchy reconstruction is the reference's row-by-row state machine as chunk
summaries and a prefix scan over them (``sources/chunks.py``): no window runs
over a whole file, so one large file is parsed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import chunks

# Report noise rows and level names.
PAGE_NOISE = ("Product Desc", "Description")
PAGE_DATE = r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"
LEVELS = ("Branch", "Department", "Category", "Division")
TOTAL_PREFIX = "total by "
EXPLICIT_LEVELS = ("Branch", "Division", "Group")
PRINT_DATE = "22-Jan-26"
#: Word in front of a branch name in printed reports.
BRAND = "Store"
#: Digits before the point that fit a printed price.
PRICE_DIGITS = 5


# ----------------------------------------------------------------- numbers (K1)
NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_num(c: Column) -> Column:
    """``to_num``: strip, drop thousands separators and quotes, ``(x)`` -> -x,
    anything else that is not a plain decimal -> NULL (a regex guard, so
    strings like ``1d`` or ``nan`` that a cast would accept stay NULL)."""
    s = F.replace(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit('"'), F.lit(""))
    # a filter computes a column anew wherever it is named, so cells without a bracket name ``s`` once
    bracket = F.contains(c, F.lit("(")) & s.startswith("(") & s.rlike(r"^\(.*\)$")
    s = F.when(bracket, F.concat(F.lit("-"), F.regexp_extract(s, r"^\((.*)\)$", 1))).otherwise(s)
    return F.regexp_extract(s, NUMERIC_RE, 0).try_cast("double")


def to_num_zero(c: Column) -> Column:
    """Lenient parse (K2): quotes and thousands separators go, and whatever is no plain
    number then is 0: blanks, ``-``, ``nan``, ``None``, and ``(12.5)`` too, which
    only K1 reads as a negative."""
    s = F.regexp_replace(F.trim(c), '[",]', "")
    return F.coalesce(F.when(s.rlike(NUMERIC_RE), s.try_cast("double")), F.lit(0.0))


def to_num_strict(c: Column) -> Column:
    """Strict parse (K4): thousands separators removed, then an ANSI cast
    that fails the job on any non-numeric value."""
    return F.regexp_replace(F.trim(c), ",", "").cast("double")


def fmt(c: Column, decimals: int) -> Column:
    """Report money format: thousands separators, negatives in parentheses."""
    return F.when(c < 0, F.concat(F.lit("("), F.format_number(-c, decimals), F.lit(")"))).otherwise(
        F.format_number(c, decimals))


def fmt_column(c: Column, decimals: int) -> Column:
    """``fmt`` of a plain column, at less cost: a number below a million that lies so near
    to one of ``decimals`` decimals that no rounding is in doubt is cast to that decimal
    and gets its one separator; all others are formatted. ``c`` is named many times, so
    it must not be computed."""
    one = float(10 ** decimals)
    exact = F.abs(c) * one
    units = F.rint(exact)
    sure = (F.abs(exact - units) < 0.25) & (units > 0) & (units < 1e6 * one)
    digits = F.abs(c).cast(f"decimal(18,{decimals})").cast("string")
    at = F.when(units < 1e4 * one, 2).when(units < 1e5 * one, 3).otherwise(4)
    text = F.when(units < 1e3 * one, digits).otherwise(F.overlay(digits, F.lit(","), at, F.lit(0)))
    return F.when(sure, F.concat(F.when(c < 0, "(").otherwise(""), text, F.when(c < 0, ")").otherwise(""))).otherwise(fmt(c, decimals))


# --------------------------------------------------------- writer (report 14)
def _place(rank: tuple) -> Column:
    """Numbers of one digit and names as one text that sorts as they do one after the
    other, nulls first: one comparison a pair of lines. A name ends with two NULs, a
    NUL within it is followed by ``\\x01``, so no name reaches into the next."""
    def name(c):
        return F.coalesce(F.concat(F.lit("\x01"), F.replace(c, F.lit("\x00"), F.lit("\x00\x01")), F.lit("\x00\x00")), F.lit("\x00"))
    return F.concat(*[F.lit(str(r)) if isinstance(r, int) else name(r) for r in rank])


def _line(rank: tuple, desc: Column, numbers: dict | None = None) -> Column:
    """One printed line: where it sorts (``rank``: numbers and names from the
    file level down), its text and its ``numbers``."""
    return F.struct(_place(rank).alias("place"), desc.alias("desc"), *[c.alias(n) for n, c in (numbers or {}).items()])


def _printed(lines: list[DataFrame], cells: dict[str, Column], dense: bool, sections: DataFrame) -> DataFrame:
    """Rows (file, struct ``l``) as numbered report lines; ``cells`` are the texts
    of their numbers, written behind the sort. Long files are cut where their deepest
    ``sections`` (file, place, n) begin, n being the item rows of one."""
    rows = lines[0].select("file", "l.*")
    for more in lines[1:]:
        rows = rows.unionByName(more.select("file", "l.*"))
    texts = ["desc", *[c.alias(n) for n, c in cells.items()]]
    placed = chunks.in_cut_files(rows, "place", chunks.cuts(sections, "place", "n"), texts)
    return (chunks.numbered(placed) if dense else placed).select("file", "line_no", "desc", *cells)


def _sections(p: DataFrame, keys: list[str], top: int, sums: list[Column]) -> DataFrame:
    """Sums of every section of the files (the first ``top`` of ``keys``), deepest
    sections first summed from the rows, then rolled up; ``depth`` 0 is the file,
    ``n`` the rows of ``p``. A table, read for the cuts of the files and for the lines."""
    g = p.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"))
    sets = [[F.col(c) for c in keys[:k]] for k in range(len(keys), top - 1, -1)]
    g = cut_lineage(g.groupingSets(sets, *keys).agg(*sums, F.sum("n").alias("n"), F.grouping_id().alias("gid")))
    return g.withColumn("depth", len(keys) - top - F.bit_count("gid"))


def write_item_report(items: DataFrame, faults: bool = False, dense: bool = True) -> DataFrame:
    """Hierarchical item report, one file per (branch, year, month): page
    header, Branch > Department > Category > Division openings, item rows,
    ``Total By`` closings at every level, footer. Returns (file, line_no, desc,
    qty, price, cost, profit) with numeric cells as text; ``dense`` numbers the
    lines from 1.

    ``faults`` prints what real exports print: prices of more than
    ``PRICE_DIGITS`` digits lose their last ones (I19); profits of division totals
    have no decimals; February files end without their branch total; March files
    hold an empty department, ``Catering``, with a zero total; April files end with
    a stray zero line that only looks like a total (D4f, D7f)."""
    keys = ["branch", "year", "month", "department", "category", "division", "product"]
    sums = [F.sum(c).alias(c) for c in ("qty", "price", "cost", "profit")]
    # one pass over the facts; every section is summed from it
    p = cut_lineage(items.groupBy(*keys).agg(*sums))
    file = F.concat_ws("/", F.lit("rep14"), "branch", F.col("year").cast("string"),
                       F.lpad(F.col("month").cast("string"), 2, "0"))
    g = _sections(p, keys[:-1], 3, sums)
    depth = F.col("depth")

    def numbers(of=F.col, whole_profit: bool = False):
        return {**{c: of(c).cast("double") for c in ("qty", "price", "cost", "profit")}, "whole": F.lit(whole_profit)}

    nothing, zero = numbers(lambda c: F.lit(None)), numbers(lambda c: F.lit(0))
    d, c, v, i = (F.col(x) for x in keys[3:])
    none = F.lit(None).cast("string")

    def at(r0, dep=none, r2=0, cat=none, r4=0, div=none, r6=0, prod=none):
        return r0, dep, r2, cat, r4, div, r6, prod

    header = [_line(at(0, r2=0), F.lit(PRINT_DATE), nothing), _line(at(0, r2=1), F.lit(PAGE_NOISE[0]), nothing),
              _line(at(0, r2=2), F.concat(F.lit(f"{BRAND} - "), F.col("branch")), nothing)]
    total = _line(at(3), F.lit("Total By Branch:"), numbers())
    footer = _line(at(4), F.lit("End of report"), nothing)
    whole = F.array(*header, total, footer)
    if faults:
        empty = [_line(at(2, r2=0), F.lit("Catering"), nothing), _line(at(2, r2=1), F.lit("Total By Department:"), zero)]
        stray = _line(at(3, r2=1), F.lit("Grand Total By Month:"), zero)
        whole = (F.when(F.col("month") == 2, F.array(*header, footer))
                 .when(F.col("month") == 3, F.array(*header, *empty, total, footer))
                 .when(F.col("month") == 4, F.array(*header, total, stray, footer)).otherwise(whole))
    sections = (F.when(depth == 3, F.array(_line(at(1, d, 1, c, 1, v, 0), v, nothing),
                                           _line(at(1, d, 1, c, 1, v, 2), F.lit("Total By Division:"), numbers(whole_profit=faults))))
                .when(depth == 2, F.array(_line(at(1, d, 1, c, 0), c, nothing),
                                          _line(at(1, d, 1, c, 2), F.lit("Total By Category:"), numbers())))
                .when(depth == 1, F.array(_line(at(1, d, 0), d, nothing),
                                          _line(at(1, d, 2), F.lit("Total By Department:"), numbers())))
                .otherwise(whole))
    lines = [p.select(file.alias("file"), _line(at(1, d, 1, c, 1, v, 1, i), i, numbers()).alias("l")),
             g.select(file.alias("file"), F.explode(sections).alias("l"))]
    if faults:              # ahead of the sort, so that the price printed behind it is a plain column
        price = F.col("l.price")
        lost = F.greatest(F.floor(F.log10(F.abs(price))) + 1 - PRICE_DIGITS, F.lit(0))
        price = F.when(price == 0, price).otherwise(price / F.pow(F.lit(10.0), lost))
        lines = [x.withColumn("l", F.col("l").withField("price", price)) for x in lines]
    cells = {"qty": fmt_column(F.col("qty"), 0), "price": fmt_column(F.col("price"), 4), "cost": fmt_column(F.col("cost"), 4),
             "profit": F.when(F.col("whole"), fmt(F.col("profit"), 0)).otherwise(fmt_column(F.col("profit"), 4))}
    begin = g.filter(depth == 3).select(file.alias("file"), _place(at(1, d, 1, c, 1, v, 0)).alias("place"), "n")
    return _printed(lines, cells, dense, begin)


# ------------------------------------------------------ parser (E1, report 14)
def _blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin("", "nan", "none")


def branch_name(c: Column) -> Column:
    """Text after the first `` - ``, else after the first ``-``, else itself."""
    s = F.trim(c)
    return (F.when(F.instr(s, " - ") > 0, F.trim(F.split(s, " - ", 2)[1]))
            .when(F.instr(s, "-") > 0, F.trim(F.split(s, "-", 2)[1])).otherwise(s))


def without_noise(lines: DataFrame) -> DataFrame:
    """Lines without page dates and repeated page headers (D1f). The footer, the
    last line left of every file (D3f), goes in ``_spread_states``."""
    desc = F.trim(F.col("desc"))
    date = F.col("desc").contains("-") & desc.rlike(PAGE_DATE)      # few lines need the pattern
    return lines.filter(~F.coalesce(desc.isin(*PAGE_NOISE) | date, F.lit(False)))


def _spread_states(lines: DataFrame, rest: DataFrame, marks: DataFrame, names: list[str], more: dict[str, Column],
                   footer: bool = True) -> DataFrame:
    """The parsed ``lines``: ``marks``, the openings and totals with their hierarchy
    and the state ``_state`` behind them, and the ``rest`` under the state of the
    last mark before each; ``more`` are the constant columns of the rest, so a
    filter on is_total or is_open leaves one part out. The ``footer``, the last line
    of every file, goes (D3f)."""
    both = rest.withColumns({"_state": F.lit(None).cast(marks.schema["_state"].dataType), "_mark": F.lit(False)}).unionByName(
        marks.withColumn("_mark", F.lit(True)).select(*rest.columns, "_state", "_mark"))
    # ends of chunks are those of all lines, so no line is looked at for what it is
    heads = chunks.heads(lines, marks, "_state")
    under = chunks.spread(both, "_state", heads).filter(~F.col("_mark"))
    marks = marks.join(heads, chunks.KEY)
    if footer:
        under, marks = under.where("line_no < _last"), marks.where("line_no < _last")
    cols = [c for c in rest.columns if c != "_chunk"]
    under = under.select(*cols, *[v.alias(n) for n, v in more.items()], *[F.col(f"_state.{n}").alias(n) for n in names])
    return marks.select(*under.columns).unionByName(under)


def parse_item_report(lines: DataFrame, chunk: int = chunks.CHUNK) -> DataFrame:
    """Implicit hierarchy (E1): an opening is a non-blank text with an empty
    quantity and opens the first unset level (a fifth opening overwrites
    Division); ``Total By <Level>`` closes that level and all below and is
    tagged with the state before it closes; other rows inherit.

    Only openings and totals change the state, so the scan runs over them and
    the other lines take the state of the last one before them. A line maps the
    depth d to least(d + a, c), with a = 1, c = 4 on openings, a = 0, c = level
    index on closings. The maps of a chunk compose to one such map, so a first
    scan over chunks gives every chunk its depth, and a second one the last
    opening of every level before it."""
    x = chunks.in_chunks(without_noise(lines), chunk)
    # every row with the prefix is a total; only a known level closes something
    text = F.concat(F.trim(F.regexp_replace(F.lower(F.col("desc")), r"\s+", " ")), F.lit(" "))
    is_total = F.coalesce(F.contains(F.lower(F.col("desc")), F.lit("total")) & text.startswith(TOTAL_PREFIX), F.lit(False))
    lvl = F.when(is_total, F.trim(F.split(F.substring(text, len(TOTAL_PREFIX) + 1, 1 << 20), ":", 2)[0]))
    is_open = ~is_total & _blank(F.col("qty")) & ~_blank(F.col("desc"))
    close = F.array_position(F.array(*[F.lit(n.lower()) for n in LEVELS]), lvl)
    every, rest = x, x.filter(~is_total & ~is_open)
    x = cut_lineage(x.filter(is_total | is_open).select(
        "*", is_total.alias("is_total"), is_open.alias("is_open"),
        F.when(close > 0, (close - 1).cast("int")).alias("close_level"), F.initcap(lvl).alias("total_scope")))
    x = x.withColumn("_shift", F.col("is_open").cast("int"))
    cap = F.when(F.col("is_open"), 4).when(F.col("is_total"), F.col("close_level")).otherwise(1 << 30)
    run = chunks.running()
    x = x.withColumn("_A", F.sum("_shift").over(run)).withColumn("_cap", cap - F.col("_A"))
    x = x.withColumn("_low", F.min("_cap").over(run))
    x = x.join(chunks.carry_depth(x, "_shift", "_cap"), chunks.KEY)
    x = x.withColumn("depth", F.col("_A") + F.least(F.col("_d0"), F.col("_low")))
    before = F.coalesce(F.lag("depth").over(chunks.within_chunk()), F.col("_d0"))
    eff = F.when(F.col("is_total"), before).otherwise(F.col("depth"))
    opened = {name: F.when(F.col("is_open") & (F.col("depth") == i + 1),
                           branch_name(F.col("desc")) if i == 0 else F.trim(F.col("desc")))
              for i, name in enumerate(LEVELS)}
    y = x.join(chunks.carried_in(x, {f"_in{n}": v for n, v in opened.items()}), chunks.KEY)
    y = y.withColumn("_eff", eff)
    for i, (name, v) in enumerate(opened.items()):
        y = y.withColumn(name, F.when(F.col("_eff") >= i + 1,
                                      F.coalesce(F.last(v, ignorenulls=True).over(run), F.col(f"_in{name}.v"))))
    state = F.struct("depth", *[F.when(F.col("depth") >= i + 1, F.col(n)).alias(n) for i, n in enumerate(LEVELS)])
    marks = cut_lineage(y.withColumn("_state", state).select(
        *rest.columns, "is_total", "is_open", "close_level", "total_scope", "depth", *LEVELS, "_state"))
    no = F.lit(False)
    return _spread_states(every, rest, marks, ["depth", *LEVELS], {
        "is_total": no, "is_open": no, "close_level": F.lit(None).cast("int"), "total_scope": F.lit(None).cast("string")})


def report_facts(parsed: DataFrame) -> DataFrame:
    """Item rows of a parsed report with numbers (K1) and the repaired price
    Total Price = cost + profit (C7); zero-price rows dropped, NULL kept (D4f)."""
    it = parsed.filter(~F.col("is_total") & ~F.col("is_open"))
    it = it.filter(F.coalesce(*[F.col(c) for c in ("qty", "price", "cost", "profit")]).isNotNull())   # D2f
    # a row of its own, as the filter on the price would else parse both cells once more
    both = F.struct(to_num(F.col("cost")).alias("_cost"), to_num(F.col("profit")).alias("_profit"))
    it = it.select("file", "line_no", "desc", "qty", *LEVELS, F.inline(F.array(both)))
    price = F.coalesce("_cost", F.lit(0.0)) + F.coalesce("_profit", F.lit(0.0))
    return (it.select("file", "line_no", *LEVELS, F.trim("desc").alias("product"), to_num(F.col("qty")).alias("qty"),
                      price.alias("price"), F.col("_cost").alias("cost"), F.col("_profit").alias("profit"))
            .filter(~(F.col("price") == 0) | F.col("price").isNull()))


def report_totals(parsed: DataFrame) -> DataFrame:
    """Printed ``Total By <scope>`` rows with their hierarchy (D5f, D6f)."""
    t = parsed.filter("is_total")
    return t.select("file", "line_no", "total_scope", *LEVELS, to_num(F.col("qty")).alias("qty"),
                    to_num(F.col("cost")).alias("cost"), to_num(F.col("profit")).alias("profit"),
                    to_num(F.col("price")).alias("printed_price"))


def reconcile_totals(totals: DataFrame, facts: DataFrame) -> DataFrame:
    """Printed totals against the rollup of the item rows, every file and scope:
    (file, scope, levels, printed, computed, reason), reason ``both``, ``printed
    only`` or ``computed only`` (I18, F9)."""
    lv = list(LEVELS)
    sets = [["file", *lv[:k]] for k in range(1, len(lv) + 1)]
    # the deepest level is summed first, so that the row copies of the sets are few
    facts = facts.groupBy("file", *lv).agg(F.sum("profit").alias("profit"))
    roll = facts.groupingSets([[F.col(c) for c in s] for s in sets], "file", *lv).agg(
        F.sum("profit").alias("computed"), F.grouping_id().alias("gid"))
    scope = F.element_at(F.array(*[F.lit(n) for n in lv]), 4 - F.bit_count("gid"))
    keys = ["file", "scope", *lv]
    a = totals.select("file", F.col("total_scope").alias("scope"), *lv, F.col("profit").alias("printed"), F.lit(1).alias("_p"))
    b = roll.select("file", scope.alias("scope"), *lv, "computed", F.lit(1).alias("_c"))
    j = a.join(b, [a[k].eqNullSafe(b[k]) for k in keys], "full_outer")
    return j.select(*[F.coalesce(a[k], b[k]).alias(k) for k in keys], "printed", "computed",
                    F.when(F.col("_c").isNull(), "printed only").when(F.col("_p").isNull(), "computed only")
                    .otherwise("both").alias("reason"))


# --------------------------------------------------- explicit hierarchy
def write_group_report(items: DataFrame, dense: bool = True) -> DataFrame:
    """Report "191": ``Branch: x`` / ``Division: y`` / ``Group: z`` openings,
    item rows (Description, Qty, Total Amount), ``Total by <level>: name``
    closings, page header and footer; one file per (branch, year)."""
    keys = ["branch", "year", "division", "grp", "product"]
    sums = [F.sum("qty").alias("qty"), F.sum("amount").alias("amount")]
    p = cut_lineage(items.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.sum("price").alias("amount")))
    g = _sections(p, keys[:-1], 2, sums)
    depth = F.col("depth")
    numbers = {c: F.col(c).cast("double") for c in ("qty", "amount")}
    nothing = {c: F.lit(None).cast("double") for c in numbers}
    dv, gp, it, none = F.col("division"), F.col("grp"), F.col("product"), F.lit(None).cast("string")

    def at(r0, div=none, r2=0, grp=none, r4=0, prod=none):
        return r0, div, r2, grp, r4, prod

    def both(rank, level, name):
        return F.array(_line(rank(0), F.concat(F.lit(f"{level}: "), name), nothing),
                       _line(rank(2), F.concat(F.lit(f"Total by {level}: "), name), numbers))

    whole = F.concat(
        F.array(_line(at(0, r2=0), F.lit(PRINT_DATE), nothing), _line(at(0, r2=1), F.lit(PAGE_NOISE[1]), nothing)),
        both(lambda k: at(0, r2=2) if k == 0 else at(2), "Branch", F.col("branch")),
        F.array(_line(at(3), F.lit("End of report"), nothing)))
    sections = (F.when(depth == 2, both(lambda k: at(1, dv, 1, gp, k), "Group", gp))
                .when(depth == 1, both(lambda k: at(1, dv, k), "Division", dv)).otherwise(whole))
    file = F.concat_ws("/", F.lit("rep191"), "branch", F.col("year").cast("string"))
    lines = [p.select(file.alias("file"), _line(at(1, dv, 1, gp, 1, it), it, numbers).alias("l")),
             g.select(file.alias("file"), F.explode(sections).alias("l"))]
    begin = g.filter(depth == 2).select(file.alias("file"), _place(at(1, dv, 1, gp, 0)).alias("place"), "n")
    return _printed(lines, {"qty": fmt_column(F.col("qty"), 0), "amount": fmt_column(F.col("amount"), 4)}, dense, begin)


def _level_and_name(desc: Column) -> tuple[Column, Column, Column]:
    """A line cut at its first colon: whether it is a total, the level it names
    (lower case; null for other words) and the name behind the colon."""
    flat = F.trim(F.regexp_replace(F.lower(desc), r"\s+", " "))
    is_total = F.coalesce(flat.startswith(TOTAL_PREFIX), F.lit(False))
    word = F.trim(F.split(F.when(is_total, F.substring(flat, len(TOTAL_PREFIX) + 1, 1 << 20)).otherwise(flat), ":", 2)[0])
    name = F.regexp_replace(F.substring(desc, F.instr(desc, ":") + 1, 1 << 20), r"^\s+|\s+$", "")
    known = F.contains(desc, F.lit(":")) & word.isin(*[n.lower() for n in EXPLICIT_LEVELS]) & (name != "")
    return is_total, F.when(known, word), name


def parse_group_report(lines: DataFrame, chunk: int = chunks.CHUNK, noise: bool = True) -> DataFrame:
    """Explicit hierarchy (E2): ``Level: name`` opens the level and resets
    the lower ones; ``Total by Level: name`` closes it after tagging.

    Level l holds the name of its last opening o iff o lies after the last
    opening of every higher level and after the last closing (strictly
    before the current row) of level l or higher. Last openings and closings are
    maxima, so a chunk is summarised by them."""
    x = chunks.in_chunks(without_noise(lines) if noise else lines, chunk)
    total, level, name = _level_and_name(F.col("desc"))
    every, rest = x, x.filter(level.isNull())
    x = cut_lineage(x.filter(level.isNotNull()).select(
        "*", total.alias("is_total"), (~total).alias("is_open"), level.alias("_l"), name.alias("_n")))
    names = [n.lower() for n in EXPLICIT_LEVELS]
    opened = {f"_o{i}": F.when(F.col("is_open") & (F.col("_l") == n), F.col("_n")) for i, n in enumerate(names)}
    closed = {f"_c{i}": F.when(F.col("is_total") & (F.col("_l") == n), F.lit(True)) for i, n in enumerate(names)}
    y = x.join(chunks.carried_in(x, {**opened, **closed}), chunks.KEY)
    for c, v in opened.items():
        y = y.withColumn(c, F.greatest(F.col(c), chunks.last_seen(v)))
    strictly = chunks.within_chunk().rowsBetween(Window.unboundedPreceding, -1)
    for c, v in closed.items():
        y = y.withColumn(c, F.greatest(F.col(f"{c}.at"), F.max(F.when(v.isNotNull(), F.col("line_no"))).over(strictly)))
    for i, n in enumerate(EXPLICIT_LEVELS):
        o = F.col(f"_o{i}.at")
        ok = o.isNotNull()
        for h in range(i):
            ok = ok & (o > F.coalesce(F.col(f"_o{h}.at"), F.lit(-1)))
        for h in range(i + 1):                 # closings of this or a higher level
            ok = ok & (o > F.coalesce(F.col(f"_c{h}"), F.lit(-1)))
        y = y.withColumn(n, F.when(ok, F.col(f"_o{i}.v")))
    closes = F.when(F.col("is_total"), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_l")))
    state = F.struct(*[F.when(closes.isNull() | (closes > i + 1), F.col(n)).alias(n) for i, n in enumerate(EXPLICIT_LEVELS)])
    marks = cut_lineage(y.withColumn("_state", state).select(*rest.columns, "is_total", "is_open", *EXPLICIT_LEVELS, "_state"))
    no = F.lit(False)
    return _spread_states(every, rest, marks, list(EXPLICIT_LEVELS), {"is_total": no, "is_open": no}, footer=noise)


# ------------------------------------------- paged monthly report (A4-A10)
# Month header names of the monthly report and its total column.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
               "October", "November", "December")
YEAR_TOTAL = "Total By Year"
PAGE_SPLIT = 9          # months on the first page of a year block


def branch_token(brand: str = BRAND) -> str:
    """Pattern of cells that name a branch."""
    return rf"(?i)\b{brand}\b"


def write_monthly_report(monthly: DataFrame, dense: bool = True) -> DataFrame:
    """Comparative monthly sales report: per year two pages, January..September
    and October..December + ``Total By Year``; the month header is repeated per
    page and shifted by one column on the second page; the year is printed
    on the first row of each page only; each page ends with a ``Total`` row.
    Even years are printed on one wide page with all twelve months. Yearly totals
    have no decimals. ``monthly``: (branch, year, month, sales). Returns (file,
    line_no, cells)."""
    wide = cut_lineage(monthly.groupBy("branch", "year").agg(*[
        F.coalesce(F.sum(F.when(F.col("month") == m, F.col("sales"))), F.lit(0.0)).alias(f"m{m}")
        for m in range(1, 13)]))
    wide = wide.withColumn("tot", sum((F.col(f"m{m}") for m in range(1, 13)), F.lit(0.0)))
    tot = wide.groupBy("year").agg(*[F.sum(f"m{m}").alias(f"m{m}") for m in range(1, 13)],
                                   F.sum("tot").alias("tot"), F.min("branch").alias("first_branch"))
    first = tot.select("year", "first_branch")
    year = F.when(F.col("branch") == F.col("first_branch"), F.col("year").cast("string")).otherwise("")
    name, even = F.concat(F.lit(f"{BRAND} "), F.col("branch")), F.col("year") % 2 == 0

    def cells(*cs):
        return F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cs])

    def page(number, kind, k, row):
        return F.struct(F.lit(number).alias("page"), F.lit(kind).alias("kind"), k.alias("k"), row.alias("cells"))

    def pages(kind, k, start, texts, total, wide_start, gap):
        """Rows of one kind on their pages; ``gap`` cells shift the second."""
        return F.when(even, F.array(page(1, kind, k, cells(*wide_start, *texts, total)))).otherwise(F.array(
            page(1, kind, k, cells(*start, *texts[:PAGE_SPLIT])),
            page(2, kind, k, cells(*start, *gap, *texts[PAGE_SPLIT:], total))))

    money = [fmt(F.col(f"m{m}"), 4) for m in range(1, 13)]
    whole = fmt(F.col("tot"), 0)
    body = wide.join(first, "year").select(
        "year", pages(1, F.col("branch"), (year, name), money, whole, (year, name), ("",)).alias("rows"))
    rest = tot.select("year", F.concat(
        pages(0, F.lit(""), ("", ""), list(MONTH_NAMES), YEAR_TOTAL, ("", ""), ("",)),
        pages(2, F.lit(""), ("", "Total"), money, whole, ("", "Total"), ("",))).alias("rows"))
    flat = body.unionByName(rest).select(F.lit("rep134").alias("file"), "year", F.explode("rows").alias("r"))
    flat = flat.select("file", "year", "r.page", "r.kind", "r.k", "r.cells")
    placed = chunks.in_file_order(flat, ["year", "page", "kind", "k"])
    return (chunks.numbered(placed) if dense else placed).select("file", "line_no", "cells")


def _branch_column(rows: DataFrame, brand: str) -> DataFrame:
    """(file, bpos): the position with the most cells that name a branch."""
    hits = rows.select("file", F.posexplode("cells").alias("pos", "val"))
    return (hits.groupBy("file", "pos").agg(F.count_if(F.col("val").rlike(branch_token(brand))).alias("n"))
            .groupBy("file").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("bpos")))


def is_header() -> Column:
    return F.exists("cells", lambda c: F.trim(c).isin(*MONTH_NAMES))


def parse_monthly_report(lines: DataFrame, brand: str = BRAND, chunk: int = chunks.CHUNK) -> DataFrame:
    """Paged report -> long (branch, year, month, sales) (A10, A4-A9, D8f, J6).

    Header rows (any month name) and the year printed on a page's first row are
    carried forward over the file order, within chunks and from chunk to chunk;
    the branch column is the position with the most branch cells (A7); cells are
    exploded with their position and named by the carried header; blank and
    ``Total`` branches are dropped; ``Total By Year`` is returned as month 0 for
    reconciliation."""
    x = chunks.in_chunks(lines, chunk)
    y0 = F.trim(F.col("cells")[0])
    seen = {"_header": F.when(is_header(), F.col("cells")), "_year": F.when(y0.rlike(r"^\d{4}$"), y0.cast("int"))}
    y = x.join(chunks.carried_in(x, seen), chunks.KEY)
    for c, v in seen.items():
        y = y.withColumn(c, F.coalesce(F.last(v, ignorenulls=True).over(chunks.running()), F.col(f"{c}.v")))
    y = y.filter(~is_header() & F.col("_header").isNotNull()).join(_branch_column(lines.filter(~is_header()), brand), "file")
    y = y.withColumn("branch_cell", F.trim(F.get("cells", F.col("bpos"))))
    y = y.filter((F.col("branch_cell") != "") & (F.lower(F.col("branch_cell")) != "total"))   # D8f
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    named = (y.select("branch_cell", F.col("_year").alias("year"), "_header", F.posexplode("cells").alias("pos", "val"))
             .withColumn("hname", F.trim(F.get("_header", F.col("pos")))).filter(F.col("hname").isin(*MONTH_NAMES, YEAR_TOTAL)))
    return named.select(
        F.regexp_replace("branch_cell", rf"(?i)^{brand}\s+", "").alias("branch"), "year",
        F.when(F.col("hname") == YEAR_TOTAL, F.lit(0)).otherwise(F.array_position(months, F.col("hname")))
        .cast("int").alias("month"),
        to_num_zero(F.col("val")).alias("sales"))


# ------------------------------------------------ profiling and checks
def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """Null count and percent of every column in one aggregate pass, as rows
    (column, n_null, pct_null, sparse) with sparse = pct >= 90 % (G13, C3)."""
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_z{i}")
                                                  for i, c in enumerate(cols)])
    stacked = one.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_z{i}").alias("n_null")) for i, c in enumerate(cols)])).alias("s"))
    return stacked.select("s.column", "s.n_null",
                          F.try_divide(F.col("s.n_null"), F.col("_n")).alias("pct_null")).withColumn(
        "sparse", F.col("pct_null") >= 0.9)


def drop_sparse(df: DataFrame, at: float = 0.9) -> DataFrame:
    """``df`` without columns that are null in the share ``at`` of its rows or
    more (C3)."""
    sparse = {r["column"] for r in null_profile(df).collect() if (r["pct_null"] or 0.0) >= at}      # a row per column
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in sparse])


def price_overflow(parsed: DataFrame) -> DataFrame:
    """Printed Total Price against cost + profit (X6): the power-of-ten factor
    printed / true rounded to an integer exponent, per line kind (I19)."""
    x = parsed.filter(F.col("price").isNotNull())
    printed = to_num(F.col("price"))
    true = F.coalesce(to_num(F.col("cost")), F.lit(0.0)) + F.coalesce(to_num(F.col("profit")), F.lit(0.0))
    ratio = F.when((true != 0) & (printed != 0), F.abs(true / printed))
    exp = F.round(F.log10(ratio)).cast("int")
    return (x.select(F.when(F.col("is_total"), F.lit("total")).otherwise(F.lit("item")).alias("kind"),
                     exp.alias("lost_digits"))
            .groupBy("kind", "lost_digits").agg(F.count(F.lit(1)).alias("n")))


def header_rows(lines: DataFrame, brand: str = BRAND) -> DataFrame:
    """Header discovery (A4, A5, A7): every line naming a month, its first
    month name, whether it names all twelve, and the branch column of the file."""
    hdr = lines.filter(is_header()).select(
        "file", "line_no",
        F.element_at(F.filter("cells", lambda c: F.trim(c).isin(*MONTH_NAMES)), 1).alias("first_month"),
        F.forall(F.array(*[F.lit(m) for m in MONTH_NAMES]),
                 lambda m: F.array_contains("cells", m)).alias("all_months"))
    return hdr.join(_branch_column(lines.filter(~is_header()), brand).withColumnRenamed("bpos", "branch_col"), "file")
