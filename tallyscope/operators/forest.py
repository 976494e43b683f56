"""Isolation forest: how few random cuts part a row from a sample of the others.

Each tree is grown on its own small sub-sample, as the method asks; all sub-samples together are a bounded number of
rows, picked by a hash of the row's key, whatever the table's size. Trees are flat arrays. Every row of the table walks
all trees inside tasks, all rows of a batch one level a step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trees, and rows of a tree's sub-sample: what the method's authors propose.
TREES, SAMPLE_ROWS = 100, 256


class Forest(NamedTuple):
    feature: np.ndarray  # (trees, nodes) column that a node cuts, -1 at a leaf
    cut: np.ndarray  # rows below it go to the first child
    child: np.ndarray  # first of two neighbouring children
    length: np.ndarray  # path length that a leaf stands for, its own rows included
    fill: np.ndarray  # per column, what stands in for a missing value
    scale: float  # mean path length of a sub-sample


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple[list, list, list, list]:
    """One tree as flat lists; the root is node 0."""
    feature, cut, child, length = [-1], [0.0], [0], [0.0]
    todo = [(0, rows, 0)]
    while todo:
        node, mine, level = todo.pop()
        low, high = (mine.min(0), mine.max(0)) if len(mine) else (np.zeros(0), np.zeros(0))
        open_columns = np.flatnonzero(low < high)
        if level >= depth or len(mine) <= 1 or not len(open_columns):
            length[node] = level + mean_path(len(mine))
            continue
        f = int(rng.choice(open_columns))
        at = float(rng.uniform(low[f], high[f]))
        at = at if at > low[f] else float(high[f])  # both children get rows
        left = mine[:, f] < at
        feature[node], cut[node], child[node] = f, at, len(feature)
        for part in (mine[left], mine[~left]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), child.append(0), length.append(0.0)
    return feature, cut, child, length


def fit_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Forest:
    """A forest on at most ``trees * sample_rows`` rows, by their hash; missing values take the sample's median."""
    total = df.count()
    wanted = trees * sample_rows
    share = min(1.0, 1.2 * wanted / max(total, 1))
    mark = F.xxhash64(F.col(key), F.lit(seed))
    near = df.where(mark <= int(share * (2**64 - 1)) - 2**63) if share < 1 else df
    # The hash bounds what is collected to about 1.2 times the sub-samples; the smallest hashes are taken.
    picked = near.select(mark.alias("_h"), *[F.col(c).cast("double").alias(c) for c in features]).orderBy("_h").limit(wanted).collect()
    rows = np.array([[np.nan if v is None else v for v in r[1:]] for r in picked], float).reshape(len(picked), len(features))
    fill = np.zeros(len(features))
    for k in range(len(features)):
        known = rows[~np.isnan(rows[:, k]), k]
        fill[k] = np.median(known) if len(known) else 0.0
    rows = np.where(np.isnan(rows), fill, rows)
    grown = []
    for t in range(trees):
        own = rows[t::trees] if len(rows) >= wanted else rows[np.random.default_rng([seed, t, 1]).permutation(len(rows))[:sample_rows]]
        grown.append(grow(own, np.random.default_rng([seed, t]), max(1, math.ceil(math.log2(max(len(own), 2))))))
    nodes = max(len(g[0]) for g in grown)
    flat = [np.array([list(g[i]) + [d] * (nodes - len(g[i])) for g in grown]) for i, d in ((0, -1), (1, 0.0), (2, 0), (3, 0.0))]
    return Forest(*flat, fill, mean_path(min(sample_rows, max(len(rows), 2))))


def path_lengths(forest: Forest, values: np.ndarray) -> np.ndarray:
    """Mean path length of every row over all trees."""
    values = np.where(np.isnan(values), forest.fill, values)
    total = np.zeros(len(values))
    for feature, cut, child, length in zip(forest.feature, forest.cut, forest.child, forest.length):
        node = np.zeros(len(values), np.int64)
        alive = np.arange(len(values))
        while len(alive):
            alive = alive[feature[node[alive]] >= 0]
            at = node[alive]
            node[alive] = child[at] + (values[alive, feature[at]] >= cut[at])
        total += length[node]
    return total / len(forest.feature)


def isolation_scores(df: DataFrame, forest: Forest, features: Sequence[str], out: str = "isolation") -> DataFrame:
    """``df`` with the anomaly score of every row: near 1 for rows that few cuts part, below 0.5 for common ones."""
    shipped = df.sparkSession.sparkContext.broadcast(forest)
    kept = df.drop(out)
    columns = [f"_f{k}" for k in range(len(features))]

    def run(batches):
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if len(columns) else np.zeros((batch.num_rows, 0))
            score = 2.0 ** (-path_lengths(shipped.value, values) / (shipped.value.scale or 1.0))
            names = [n for n in batch.schema.names if n not in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, out])

    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    return kept.select("*", *[F.col(f).cast("double").alias(c) for f, c in zip(features, columns)]).mapInArrow(run, schema)
