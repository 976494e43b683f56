"""Two versions of a table: reconciliation, change capture, cell scoring, occurrence keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(old: DataFrame, new: DataFrame, key: Sequence[str], value: str, tol: float) -> DataFrame:
    """match / differ / old_only / new_only per key; both blank says nothing."""
    o = old.select(*key, F.col(value).alias("old_value"), F.lit(1).alias("_o"))
    n = new.select(*key, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    d = o.join(n, list(key), "full_outer")
    a, b = F.col("old_value"), F.col("new_value")
    verdict = (F.when(a.isNotNull() & b.isNotNull(), F.when(F.abs(a - b) <= tol, "match").otherwise("differ"))
               .when(a.isNotNull(), "old_only").when(b.isNotNull(), "new_only"))
    return d.select(*key, "old_value", "new_value", verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def row_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def snapshot_changes(old: DataFrame | None, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """changed / added / removed rows with the changed fields; a first snapshot gives none."""
    if old is None:
        return new.where(F.lit(False)).select(
            key, F.lit("").alias("change_type"), F.array().cast("array<string>").alias("changed_fields"))
    def side(d: DataFrame, tag: str) -> DataFrame:
        return d.select(F.col(key), row_hash(columns).alias(f"{tag}_hash"), F.struct(*columns).alias(tag))
    d = side(old, "o").join(side(new, "n"), key, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("o_hash").isNull(), "added").when(F.col("n_hash").isNull(), "removed").when(
        F.col("o_hash") != F.col("n_hash"), "changed")
    return d.select(key, kind.alias("change_type"), F.when(kind == "changed", fields).otherwise(
        F.array().cast("array<string>")).alias("changed_fields"), "o_hash", "n_hash").where(F.col("change_type").isNotNull())


def score_cells(truth: DataFrame, got: DataFrame, key: Sequence[str], tol: float) -> DataFrame:
    """correct / wrong_value / false_zero / missing / spurious per cell of either side."""
    d = truth.select(*key, F.col("value").alias("_g")).join(got.select(*key, F.col("value").alias("_e")), list(key), "full_outer")
    g, e = F.col("_g"), F.col("_e")
    state = (F.when(g.isNull() & e.isNull(), F.lit(None).cast("string"))
             .when(g.isNull(), F.when(e == 0, "false_zero").otherwise("spurious"))
             .when(e.isNull(), "missing").when(F.abs(e - g) <= tol, "correct").otherwise("wrong_value"))
    return d.select(*key, state.alias("state")).where(F.col("state").isNotNull())


def occurrence_keys(df: DataFrame, identity: Sequence[str], record_id: str, out: str = "occurrence",
                    block: int = 1 << 20) -> DataFrame:
    """Number identical copies 1..n in record order.

    A copied row may be a third of the table, so copies are counted per (identity, block of
    record numbers) and numbered inside a block; the blocks before give the offset.
    """
    d = df.withColumn("_blk", F.floor(F.col(record_id) / block))
    cells = d.groupBy(*identity, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*identity).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*identity, "_blk").orderBy(record_id)
    return d.join(cells, [*identity, "_blk"]).withColumn(
        out, (F.col("_off") + F.row_number().over(inside)).cast("long")).drop("_blk", "_off")


def document_counts(rows: DataFrame, owner: str, doc_no: Column, content: Sequence[str], amount: str) -> tuple[DataFrame, DataFrame]:
    """(rows against documents per owner, repeated rows and their amount per owner).

    The document key is (owner, number). Copies beyond the first share number and content,
    so the surplus follows from counts; no copy is numbered.
    """
    d = rows.withColumn("_doc", doc_no)
    per_doc = d.groupBy(owner, "_doc").agg(F.count(F.lit(1)).alias("_r"))
    docs = per_doc.groupBy(owner).agg(F.sum("_r").alias("n_rows"), F.count(F.lit(1)).alias("n_documents")).withColumn(
        "surplus", F.col("n_rows") - F.col("n_documents"))
    same = d.groupBy(owner, "_doc", *content).agg(F.count(F.lit(1)).alias("_c"), F.max(amount).alias("_a"))
    dupes = same.where(F.col("_c") > 1).groupBy(owner).agg(
        F.sum(F.col("_c") - 1).alias("duplicate_rows"), F.sum((F.col("_c") - 1) * F.coalesce("_a", F.lit(0.0))).alias("overcounted"))
    return docs, dupes


def latest_revision(rows: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest revision per key by the given order columns."""
    return rows.groupBy(*key).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("revisions")).select(
        *key, "_r.*", "revisions")


def digits_confirmed(claims: DataFrame, page_text: DataFrame, key: str, pattern: str, least_digits: int = 4) -> DataFrame:
    """Claimed numbers of at least ``least_digits`` digits that do or do not occur in the page text.

    Digits are compared as text, so a number of any length counts. claims: key, digits; page_text: key, text
    """
    seen = digit_runs(page_text, key, pattern).distinct().withColumn("_s", F.lit(True))
    d = claims.where(F.length("digits") >= least_digits)
    return d.join(seen, [key, "digits"], "left").withColumn("confirmed", F.coalesce("_s", F.lit(False))).drop("_s")


def digit_runs(page_text: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, digits) of every run of digits, thousands separators left out."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return page_text.select(key, runs.alias("_d")).select(key, F.replace("_d", F.lit(","), F.lit("")).alias("digits"))


def union_by_priority(primary: DataFrame, fallback: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Merged rows, the primary source winning per key; one row per key."""
    tag = lambda d, p: d.select(key, F.struct(*columns).alias("_r"), F.lit(p).alias("_p"))
    both = tag(primary, 0).unionByName(tag(fallback, 1))
    return both.groupBy(key).agg(F.min_by("_r", "_p").alias("_r"), F.min("_p").alias("source_rank")).select(key, "_r.*", "source_rank")
