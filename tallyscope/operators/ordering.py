"""Exact ranks and order statistics that never sort a whole group in one task.

A plain window function sends every row of its partition to one task, so a year, a kind or
the whole table as partition key does not survive a group that holds a third of all rows.
So group sizes are counted first (combined before the shuffle). When no group is above
``ROWS_PER_TASK`` rows, the plan is the plain window. Otherwise the large groups, and only
they, are cut into ordered buckets at their approximate quantiles: an aggregate counts the
rows per bucket, and the exact position of a row is the count of the buckets before its own
plus the position inside it. A value that repeats so often that it is itself a bound gets a
bucket of its own, cut further by the tie-break column, so one hot value cannot fill a task
either. The approximation only moves bucket edges; results are exact.

The bounds and bucket counts are materialised and counted before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.session import cut_lineage

ROWS_PER_TASK = 1 << 20
MAX_GROUPS = 2_000
MAX_CELLS = 1_000_000
BUCKETS = 1024
_STRIDE = 32


def _every(bounds: Column, stride: int) -> Column:
    """Every ``stride``-th element, starting with the first."""
    steps = F.sequence(F.lit(0), F.floor((F.size(bounds) - 1) / stride).cast("int"))
    return F.when(F.size(bounds) > 0, F.transform(steps, lambda i: F.get(bounds, i * stride))
                  ).otherwise(F.array().cast("array<double>"))


def _large_groups(keyed: DataFrame, names: list[str], buckets: int, rows_per_task: int,
                  with_tie: bool) -> DataFrame | None:
    """Size and distinct approximate quantiles of every group above the row bound, if any."""
    sizes = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_task)
    if not sizes.take(1):
        return None
    sizes = cut_lineage(sizes)
    rows = _join(keyed, sizes, names, "inner", MAX_GROUPS)
    fractions = [i / buckets for i in range(1, buckets)]
    cut = lambda c: F.array_distinct(F.percentile_approx(c, fractions, buckets * 8))
    aggs = [F.first("_n").alias("_n"), cut("_v").alias("_b")] + ([cut("_t").alias("_tb")] if with_tie else [])
    out = rows.groupBy(*names).agg(*aggs)
    for name in ["_b", "_tb"] if with_tie else ["_b"]:
        out = out.withColumn(name + "c", _every(F.col(name), _STRIDE))
    return cut_lineage(out)


def _locate(value: Column, bounds: str) -> Column:
    """2·(bounds below value), plus one when the value is itself a bound."""
    coarse = F.size(F.filter(F.col(bounds + "c"), lambda x: x < value))
    start = F.greatest(coarse - 1, F.lit(0)) * _STRIDE
    pos = start + F.size(F.filter(F.slice(F.col(bounds), start + 1, _STRIDE),
                                  lambda x: x < value))
    return 2 * pos + F.coalesce((F.get(F.col(bounds), pos) == value).cast("int"), F.lit(0))


def _prepare(df: DataFrame, value: Column, groups: Sequence[str],
             tie: Column | None) -> tuple[DataFrame, list[str]]:
    keyed = df.withColumn("_v", value.cast("double"))
    if tie is not None:
        keyed = keyed.withColumn("_t", tie.cast("double"))
    names = list(groups)
    if not names:
        keyed, names = keyed.withColumn("_all", F.lit(0)), ["_all"]
    return keyed, names


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str, max_rows: int) -> DataFrame:
    """Join a materialised per-key summary, NULL keys equal; broadcast only within the row bound."""
    renamed = right.select(*[F.col(k).alias("_r_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    side = F.broadcast(renamed) if right.count() <= max_rows else renamed.hint("merge")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed["_r_" + k])
    if how == "left_anti":
        return left.join(side, cond, how)
    return left.join(side, cond, how).drop(*["_r_" + k for k in keys])


def _approximate(df: DataFrame, value: Column) -> tuple[Column, Column]:
    """A double that never falls where the value rises, and whether equal doubles mean equal values."""
    kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
    if kind in ("string", "binary"):
        # The first six bytes as a number, in the order in which texts compare.
        head = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double"), F.lit(False)
    if kind in ("date", "timestamp", "timestamp_ntz", "boolean"):
        number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda v: v.cast("timestamp").cast("double") if kind == "timestamp_ntz" else v.cast("int"))(value)
        return number.cast("double"), F.lit(kind in ("date", "boolean"))
    exact = F.lit(kind in ("double", "float", "int", "smallint", "tinyint")) | (F.lit(kind == "bigint") & (F.abs(value) < 1 << 53) if kind == "bigint" else F.lit(False))
    return value.cast("double"), exact


def row_number(df: DataFrame, value: Column, tie: Column, groups: Sequence[str] = (),
               out: str = "rank", descending: bool = False, size: str | None = None,
               before: str | None = None, upto: str | None = None,
               buckets: int = BUCKETS, rows_per_task: int | None = None) -> DataFrame:
    """Unique position 1..n per group by (value, tie) in their own types; NULL values come last.

    ``tie`` must be unique within equal values. ``size``, ``before`` and ``upto`` name
    optional columns for the group size, the rows with a strictly earlier value, and the
    rows with an earlier or equal value. Doubles only tell the buckets of large groups.
    """
    rough, exact = _approximate(df, value)
    rough_tie = _approximate(df, tie)[0]
    order = F.coalesce(-rough if descending else rough, F.lit(float("inf")))
    keyed, names = _prepare(df.withColumns({"_nv": value, "_nt": tie, "_exact": F.coalesce(exact, F.lit(False))}), order, groups, F.coalesce(rough_tie, F.lit(0.0)))
    large = _large_groups(keyed, names, buckets, rows_per_task or ROWS_PER_TASK, True)
    if large is None:
        single, offset, value_offset, value_count, group_size = F.lit(False), F.lit(0), F.lit(0), F.lit(None), F.lit(None)
        placed = keyed.withColumns({"_k": F.lit(0), "_s": F.lit(0)})
    else:
        keyed = _join(keyed, large, names, "left", MAX_GROUPS)
        # NULLs have the last bucket to themselves; one value fills an odd bucket if doubles tell its like apart.
        nulls = 2 * buckets + 1
        keyed = keyed.withColumn("_k", F.when(F.col("_b").isNull(), 0).when(F.col("_nv").isNull(), nulls).otherwise(_locate(F.col("_v"), "_b")))
        single = (F.col("_k") == nulls) | ((F.col("_k") % 2 == 1) & F.col("_exact"))
        keyed = keyed.withColumn("_single", single)
        single = F.col("_single")
        keyed = keyed.withColumn("_s", F.when(single, _locate(F.col("_t"), "_tb")).otherwise(0))
        cells = keyed.where(F.col("_n").isNotNull()).groupBy(*names, "_k", "_s").agg(F.count(F.lit(1)).alias("_c"))
        line = Window.partitionBy(*names).orderBy("_k", "_s").rowsBetween(Window.unboundedPreceding, -1)
        one_value = Window.partitionBy(*names, "_k")
        cells = cells.withColumn("_off", F.coalesce(F.sum("_c").over(line), F.lit(0)))
        cells = cells.withColumns({"_koff": F.min("_off").over(one_value), "_kc": F.sum("_c").over(one_value)}).drop("_c")
        placed = _join(keyed.drop("_b", "_bc", "_tb", "_tbc"), cut_lineage(cells), [*names, "_k", "_s"], "left", MAX_CELLS)
        offset, value_offset = F.coalesce("_off", F.lit(0)), F.coalesce("_koff", F.lit(0))
        value_count, group_size = F.col("_kc"), F.col("_n")
    bucket = Window.partitionBy(*names, "_k", "_s")
    value_order = [F.col("_nv").isNull(), F.desc("_nv") if descending else F.asc("_nv")]
    inside, values = bucket.orderBy(*value_order, "_nt"), bucket.orderBy(*value_order)
    added = {out: (offset + F.row_number().over(inside)).cast("long")}
    if before:
        added[before] = (value_offset + F.when(single, 0).otherwise(F.rank().over(values) - 1)).cast("long")
    if upto:
        local = F.count(F.lit(1)).over(values.rangeBetween(Window.unboundedPreceding, 0))
        added[upto] = (value_offset + F.when(single, value_count).otherwise(local)).cast("long")
    if size:
        added[size] = F.coalesce(group_size, F.count(F.lit(1)).over(bucket)).cast("long")
    return placed.withColumns(added).drop("_v", "_t", "_k", "_s", "_off", "_koff", "_kc", "_n", "_all", "_nv", "_nt", "_exact", "_single")


def tie_counts(df: DataFrame, value: Column, groups: Sequence[str] = (),
               below: str = "n_below", upto: str = "n_upto", size: str = "n_all",
               weight: Column | None = None,
               buckets: int = BUCKETS, rows_per_task: int | None = None) -> DataFrame:
    """Per row: rows of its group strictly below its value, at or below it, and all.

    Average rank is ``(below + 1 + upto) / 2``; cumulative share is ``upto / size``.
    With ``weight`` the counts become sums of weights. The value must not be NULL.
    """
    keyed, names = _prepare(df, value, groups, None)
    keyed = keyed.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    large = _large_groups(keyed, names, buckets, rows_per_task or ROWS_PER_TASK, False)
    if large is None:
        placed = keyed.withColumns({"_k": F.lit(0), "_salt": F.lit(0)})
        single, offset, value_sum, total = F.lit(False), F.lit(0), F.lit(None), F.lit(None)
    else:
        keyed = _join(keyed, large.drop("_n"), names, "left", MAX_GROUPS)
        keyed = keyed.withColumn("_hot", F.col("_b").isNotNull())
        keyed = keyed.withColumn("_k", F.when(F.col("_hot"), _locate(F.col("_v"), "_b")).otherwise(0)).drop("_b", "_bc")
        cells = keyed.where("_hot").groupBy(*names, "_k").agg(F.sum("_w").alias("_c"))
        line = Window.partitionBy(*names).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumns({"_off": F.sum("_c").over(line) - F.col("_c"), "_tw": F.sum("_c").over(Window.partitionBy(*names))})
        placed = _join(keyed, cut_lineage(cells), [*names, "_k"], "left", MAX_CELLS)
        single = F.col("_k") % 2 == 1
        # Rows of a one-value bucket need no order, so they are spread over many tasks.
        spread = F.when(single, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1024)))
        placed = placed.withColumn("_salt", F.coalesce(spread, F.lit(0)))
        offset, value_sum, total = F.coalesce("_off", F.lit(0)), F.col("_c"), F.col("_tw")
    bucket = Window.partitionBy(*names, "_k", "_salt")
    inside = bucket.orderBy("_v")
    local_upto = F.sum("_w").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    local_same = F.sum("_w").over(inside.rangeBetween(0, 0))
    return placed.withColumns({
        below: offset + F.when(single, 0).otherwise(local_upto - local_same),
        upto: offset + F.when(single, value_sum).otherwise(local_upto),
        size: F.coalesce(total, F.sum("_w").over(bucket)),
    }).drop("_v", "_w", "_k", "_c", "_off", "_tw", "_hot", "_salt", "_all")


def order_statistics(df: DataFrame, value: Column, groups: Sequence[str],
                     picks: dict[str, Callable[[Column], Column]],
                     buckets: int = BUCKETS, rows_per_task: int | None = None) -> DataFrame:
    """The k-th smallest non-NULL values per group, one column per pick.

    A pick maps the group size to a 1-based position; a position outside 1..n is NULL.
    In a large group only the buckets that hold a wanted position are sorted.
    """
    keyed, names = _prepare(df.where(value.isNotNull()), value, groups, None)
    keyed = keyed.select(*names, "_v")
    large = _large_groups(keyed, names, buckets, rows_per_task or ROWS_PER_TASK, False)
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), f(F.col("_n")).cast("long").alias("r"))
                       for p, f in picks.items()])

    def picked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_p", F.explode(F.filter("_w", lambda w: w["r"] == F.col("_r")))).select(
            *names, "_n", "_p", F.col("_v").alias("_x"))

    small = keyed if large is None else _join(keyed, large.select(*names), names, "left_anti", MAX_GROUPS)
    group = Window.partitionBy(*names)
    small = small.withColumns({"_n": F.count(F.lit(1)).over(group), "_r": F.row_number().over(group.orderBy("_v"))})
    found = picked(small.withColumn("_w", wanted))
    if large is not None:
        big = _join(keyed, large, names, "inner", MAX_GROUPS).withColumn("_k", _locate(F.col("_v"), "_b")).drop("_b", "_bc")
        cells = big.groupBy(*names, "_k").agg(
            F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.min("_v").alias("_lo"))
        line = group.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_off", F.coalesce(F.sum("_c").over(line), F.lit(0)))
        cells = cells.withColumn("_w", F.filter(wanted, lambda w: (w["r"] > F.col("_off")) & (
            w["r"] <= F.col("_off") + F.col("_c"))))
        needed = cut_lineage(cells.where(F.size("_w") > 0))
        flat = needed.where(F.col("_k") % 2 == 1).select(
            *names, "_n", F.explode("_w").alias("_p"), F.col("_lo").alias("_x"))
        sorted_cells = needed.where(F.col("_k") % 2 == 0).select(*names, "_k", "_off", "_w")
        rows = _join(big.where(F.col("_k") % 2 == 0), sorted_cells, [*names, "_k"], "inner", MAX_CELLS)
        inside = Window.partitionBy(*names, "_k").orderBy("_v")
        rows = rows.withColumn("_r", F.col("_off") + F.row_number().over(inside))
        found = found.unionByName(picked(rows)).unionByName(flat)
    out = found.groupBy(*names).agg(
        F.first("_n").alias("n"),
        *[F.max(F.when(F.col("_p")["p"] == p, F.col("_x"))).alias(p) for p in picks])
    return out.drop("_all")


# --- position formulas ------------------------------------------------------

def middle_low(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def middle_high(n: Column) -> Column:
    return F.floor(n / 2) + 1


def medians(df: DataFrame, value: Column, groups: Sequence[str], out: str = "median",
            **kw) -> DataFrame:
    """Exact median per group."""
    got = order_statistics(df, value, groups, {"_lo": middle_low, "_hi": middle_high}, **kw)
    return got.withColumn(out, (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")


def hinge_picks() -> dict[str, Callable[[Column], Column]]:
    """Positions for the median and Tukey hinges whose halves leave the middle out."""
    half = lambda n: F.floor(n / 2)
    start = lambda n: F.floor((n + 1) / 2)
    return {
        "_m1": middle_low, "_m2": middle_high,
        "_a1": lambda n: F.floor((half(n) + 1) / 2),
        "_a2": lambda n: F.floor(half(n) / 2) + 1,
        "_b1": lambda n: start(n) + F.floor((half(n) + 1) / 2),
        "_b2": lambda n: start(n) + F.floor(half(n) / 2) + 1,
    }


def exclusive_quartiles(df: DataFrame, value: Column, groups: Sequence[str], **kw) -> DataFrame:
    """Quartiles at (n+1)·i/4 with linear interpolation between neighbours."""
    def base(i: int) -> Callable[[Column], Column]:
        return lambda n: F.least(F.greatest(F.floor((n + 1) * i / 4), F.lit(1)), n - 1)
    picks = {}
    for i in (1, 2, 3):
        picks[f"_l{i}"] = base(i)
        picks[f"_h{i}"] = lambda n, f=base(i): f(n) + 1
    got = order_statistics(df, value, groups, picks, **kw)
    for i in (1, 2, 3):
        share = ((F.col("n") + 1) * i - base(i)(F.col("n")) * 4) / F.lit(4)
        got = got.withColumn(f"q{i}", F.col(f"_l{i}") * (1 - share) + F.col(f"_h{i}") * share)
    return got.drop(*picks)
