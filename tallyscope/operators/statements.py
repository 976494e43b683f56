"""Filed statements as tables: ordered lines, page tables, fees, long facts and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed


def first_lines(lines: DataFrame, key: Sequence[str], label: Column, position: Column,
                wanted: dict[str, str], values: Sequence[str]) -> DataFrame:
    """First line whose squeezed label contains each wanted text, one struct per text.

    ``min_by`` combines before the shuffle, so a report of any length costs one row.
    """
    flat = C.squeeze(label)
    pick = F.struct(*[F.col(v) for v in values])
    return lines.groupBy(*key).agg(*[
        F.min_by(F.when(flat.contains(text), pick), F.when(flat.contains(text), position)).alias(name)
        for name, text in wanted.items()])


def forensic_signals(d: DataFrame, operating: Sequence[str], admin: str, total: str) -> DataFrame:
    """Twelve signals of a statement; ``operating``/``admin``/``total`` are first-line structs."""
    rate = lambda n: C.execution_rate(F.col(n)["actual"], F.col(n)["budget"])
    rates = F.filter(F.array(*[rate(n) for n in operating]), lambda r: r.isNotNull())
    mean = F.when(F.size(rates) > 0, F.aggregate(rates, F.lit(0.0), lambda a, x: a + x) / F.size(rates))
    c = F.col
    out = d.withColumns({
        "prepaid_coverage": C.ratio(c("cash"), c("prepaid")),
        "reserve_funding_gap": c("reserve_liability") - c("reserve_asset"),
        "equity_erosion": C.ratio(c("current_surplus"), F.abs(c("accumulated_surplus"))),
        "admin_execution": rate(admin),
        "related_party_priority": rate(admin) - mean,
        "enrolment_utilisation": C.ratio(c("actual_enrolment"), c("approved_capacity")),
        "staff_ratio": F.when(c("actual_enrolment") != 0, C.ratio(c("actual_enrolment"), c("educators"))),
        "cost_per_child": F.when(c(total)["actual"] != 0, C.ratio(c(total)["actual"], c("actual_enrolment"))),
    })
    return out.withColumns({f"{n}_execution": rate(n) for n in operating})


def unbudgeted(label: Column, budget: Column, actual: Column, excluded: Sequence[str]) -> Column:
    """Sum of actuals on lines without a budget; a zero sum says nothing."""
    skip = F.lit(False)
    for word in excluded:
        skip = skip | C.squeeze(label).contains(word)
    total = F.sum(F.when((budget.isNull() | (budget == 0)) & ~skip, actual))
    return F.when(total != 0, total)


def page_facts(tables: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, refused): a table whose value count differs from its labels is refused whole.

    ``labels`` and ``cells`` are arrays; blank cells leave no fact.
    """
    aligned = F.size("labels") == F.size("cells")
    cell = F.posexplode(F.arrays_zip("labels", "cells"))
    facts = (tables.where(aligned).select(*keys, cell.alias("period_index", "_c"))
             .select(*keys, "period_index", F.col("_c.labels").alias("item"), F.col("_c.cells").alias("value"))
             .where(F.col("value").isNotNull()))
    return facts, tables.where(~aligned)


def wide_facts(facts: DataFrame, key: Sequence[str], wanted: Sequence[str], position: Column,
               section: str = "section") -> DataFrame:
    """First value per wanted item, and the number of sections that gave any fact.

    Positions are structs, so the aggregate of values sorts its input. Only the wanted items go there, as narrow rows dealt
    by key in partitions of bounded size, a key of many rows in several of them: each sorts in memory and leaves about a
    row a key. Sections are counted by hash.
    """
    item = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("item")).cast("byte")
    slim = facts.where(F.col("item").isin(*wanted)).select(*key, item.alias("_i"), F.col("value").alias("_v"), position.alias("_p"))
    hit = lambda i: F.col("_i") == wanted.index(i) + 1
    values = slim.hint("rebalance", *key).groupBy(*key).agg(*[F.min_by(F.when(hit(i), F.col("_v")), F.when(hit(i), F.col("_p"))).alias(i) for i in wanted])
    sections = facts.groupBy(*key).agg(F.count_distinct(section).alias("n_sections"))
    both = sections.unionByName(values, allowMissingColumns=True)
    return both.groupBy(*key).agg(F.max("n_sections").alias("n_sections"), *[F.max(i).alias(i) for i in wanted])


def fee_checksum(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Core items against the declared total; a missing declaration leaves the difference NULL."""
    declared = F.max("declared")
    core = F.coalesce(F.sum("core"), F.lit(0.0))
    return lines.groupBy(*key).agg(core.alias("core"), F.coalesce(F.sum("addon"), F.lit(0.0)).alias("addons"),
                                   declared.alias("declared"), (declared - core).alias("diff"))


def fee_basis(fees: DataFrame, key: Sequence[str], items: Sequence[str], groups: dict[str, Sequence[str]],
              per_year: int = 2) -> DataFrame:
    """Year basis per item: mean filing times the semesters of a year; group sums keep NULL."""
    d = fees.groupBy(*key).agg(
        F.count_distinct("semester").alias("n_semesters"), F.count_distinct("age").alias("n_ages"),
        *[F.round(F.avg(F.when(F.col("item") == i, F.col("amount"))) * per_year, 4).alias(f"y_{i}") for i in items])
    for name, parts in groups.items():
        d = d.withColumn(f"y_{name}", C.any_sum(*[F.col(f"y_{p}") for p in parts]))
    return d


def yearly_jump(series: DataFrame, key: str, year: str, value: str, years: Sequence[int] | None = None) -> DataFrame:
    """Wide series and the largest rise in percent between adjacent years.

    The years are those of the series (or a given list), every one from the first to the last, so the rise needs no
    window: it is computed on the row.
    """
    if years is None:
        first, last = series.agg(F.min(year), F.max(year)).first()
        years = list(range(first, last + 1)) if first is not None else []
    wide = series.groupBy(key).agg(*[F.max(F.when(F.col(year) == y, F.col(value))).alias(f"fee_{y}") for y in years])
    rises = [F.when(F.col(f"fee_{a}") != 0, F.when(F.col(f"fee_{b}") != 0, (F.col(f"fee_{b}") - F.col(f"fee_{a}"))
                                                   / F.col(f"fee_{a}") * 100)) for a, b in zip(years, years[1:])]
    return wide.withColumn("max_jump_pct", F.array_max(F.array(*rises, F.lit(None).cast("double"))))


def two_sided_split(lines: DataFrame, key: Sequence[str], position: Column) -> DataFrame:
    """Parent and government part (last line) and first subtotal; both parts must be present."""
    part = lambda kind, f: f(F.when(F.col("part") == kind, F.col("value")), F.when(F.col("part") == kind, position))
    return lines.groupBy(*key).agg(
        part("parent", F.max_by).alias("parent"), part("gov", F.max_by).alias("gov"),
        part("subtotal", F.min_by).alias("subtotal")).where(F.col("parent").isNotNull() & F.col("gov").isNotNull())


def total_once(rows: DataFrame, cell: Sequence[str], key: Sequence[str], value: str, position: Column) -> DataFrame:
    """Totals per key, each cell counted once (its first row)."""
    return rows.groupBy(*key, *[c for c in cell if c not in key]).agg(
        F.min_by(value, position).alias("_v")).groupBy(*key).agg(F.sum("_v").alias("total"))


def spread_percent_columns(table: DataFrame) -> DataFrame:
    """Move percent columns under their amount column.

    A percent label belongs to the first plain label that starts with its stem, or whose
    stem it starts with. ``labels`` and ``cells`` are parallel arrays of one short row.
    """
    stem = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        s, "[%％]", ""), "[（(][^）)]*[）)]", ""), r"(金額|占比|比率)\s*$", ""))
    is_pct = lambda s: s.rlike("[%％]")
    d = table.withColumn("_all", F.arrays_zip("labels", "cells"))
    plain = F.filter("_all", lambda e: ~is_pct(e["labels"]))
    pct = F.filter("_all", lambda e: is_pct(e["labels"]))

    def owner(p: Column) -> Column:
        s = stem(p["labels"])
        hits = F.filter(F.col("_plain"), lambda e: (s != "") & (
            F.trim(e["labels"]).startswith(s) | ((stem(e["labels"]) != "") & s.startswith(stem(e["labels"])))))
        return F.get(hits, F.lit(0))["labels"]

    d = d.withColumn("_plain", plain).withColumn("_pct", pct)
    d = d.withColumn("_own", F.transform("_pct", lambda p: F.struct(owner(p).alias("o"), p["labels"].alias("l"), p["cells"].alias("c"))))
    kept = F.filter("_own", lambda p: p["o"].isNull())
    return d.select(
        *[c for c in table.columns if c not in ("labels", "cells")],
        F.concat(F.transform("_plain", lambda e: e["labels"]), F.transform(kept, lambda p: p["l"])).alias("labels"),
        F.concat(F.transform("_plain", lambda e: e["cells"]), F.transform(kept, lambda p: p["c"])).alias("cells"),
        F.transform("_plain", lambda e: F.get(F.filter("_own", lambda p: p["o"] == e["labels"]), F.lit(0))["c"]).alias("percents"))


def route(title: Column, heading: Column, routes: Sequence[tuple[str, Sequence[str]]], unknown: str = "unrouted") -> Column:
    """First needle in priority order, the title before the heading."""
    def by(text: Column) -> Column:
        flat = C.squeeze(text)
        out = F.when(F.lit(False), "")
        for name, needles in routes:
            cond = F.lit(False)
            for n in needles:
                cond = cond | flat.contains(n)
            out = out.when(cond, name)
        return out
    return F.coalesce(by(title), by(heading), F.lit(unknown))


def inherit_sections(pages: DataFrame, report: Sequence[str], page: str, section: str, inheritable: Column,
                     span: int = 4096) -> DataFrame:
    """Carry a section over consecutive pages (page step of exactly one).

    Pages are cut into spans of ``span`` numbers: a window runs inside a span only, and a
    summary row per span carries the last page and its section to the next one, so a
    report of any length is never handled by one task.
    """
    d = pages.withColumn("_b", F.floor(F.col(page) / span))
    w = Window.partitionBy(*report, "_b").orderBy(page)
    known = F.when(~inheritable, F.col(section))
    d = d.withColumn("_known", known).withColumn("_prev", F.lag(page).over(w))
    # A run starts where the step from the page before is not one.
    d = d.withColumn("_break", F.when(F.col("_prev").isNull(), F.lit(None)).otherwise(
        (F.col(page) - F.col("_prev") != 1).cast("int")))
    ends = d.groupBy(*report, "_b").agg(F.min(page).alias("_first"), F.max(page).alias("_last"))
    chain = Window.partitionBy(*report).orderBy("_b")
    ends = ends.withColumn("_gap", F.coalesce((F.col("_first") - F.lag("_last").over(chain) != 1).cast("int"), F.lit(1)))
    d = d.join(ends.select(*report, "_b", "_gap"), [*report, "_b"])
    d = d.withColumn("_cut", F.coalesce("_break", "_gap"))
    mark = F.when((F.col("_cut") == 1) | F.col("_known").isNotNull(), F.struct(F.col("_known").alias("s")))
    d = d.withColumn("_m", mark).withColumn("_local", F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tails = d.groupBy(*report, "_b").agg(F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col(page))).alias("_t"))
    tails = tails.withColumn("_carry", F.last("_t", True).over(chain.rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    d = d.join(tails, [*report, "_b"])
    got = F.coalesce("_local", "_carry")["s"]
    return d.withColumn("inherited", F.col("_known").isNull() & got.isNotNull()).withColumn(
        "resolved", F.coalesce("_known", got, F.col(section))).select(*pages.columns, "resolved", "inherited")


def section_ranges(toc: DataFrame, report: str, start: str, last_page: Column) -> DataFrame:
    """A section runs to the page before the next entry; the last one to the end.

    Entries of a report are a short table of contents (one row per entry after grouping).
    """
    w = Window.partitionBy(report).orderBy(start)
    return toc.withColumn("page_end", F.coalesce(F.lead(start).over(w) - 1, last_page))


def nonempty_identities(d: DataFrame, checks: dict[str, tuple[Column, Column]], keys: Sequence[str], tol: float) -> DataFrame:
    """Long identity results with status passed / failed / skipped."""
    from tallyscope.operators.checks import identity_status
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("identity"), identity_status(a, b, tol).alias("status"))
                                  for n, (a, b) in checks.items()]))
    return d.select(*keys, entries.alias("_e")).select(*keys, "_e.*")
