"""Connected components of links between long ids, as joins and minima; nothing meets on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyscope.session import stored, swept


def _hung_on_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of every node on its least neighbour (or itself).

    ``larger``: all neighbours above the node move; otherwise the node and its neighbours below it do. The two steps
    in turn end in stars around the least node of every component.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def component_labels(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, label) of every node of ``links`` (a, b): the least id of its component, for the ids that are not the least.

    With ``rounds`` the work ends after so many: rows of one label are connected, but a component may still have
    several labels. That is enough where labels only save comparisons.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    state, turn = None, 0
    while rounds is None or turn < rounds:
        # The sum tells whether a round changed anything; an unchanged set of edges is a set of stars.
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
        state, turn = now, turn + 1
        edges = stored(_hung_on_least(_hung_on_least(edges, True), False))
        swept(links.sparkSession)
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
