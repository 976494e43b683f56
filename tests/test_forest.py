import numpy as np
import pytest

from tallyscope.operators import forest as G


def walk(forest, tree, row):
    """One row down one tree, node by node."""
    node = 0
    while forest.feature[tree, node] >= 0:
        node = forest.child[tree, node] + int(row[forest.feature[tree, node]] >= forest.cut[tree, node])
    return forest.length[tree, node]


def test_path_lengths_against_single_walks():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 3))
    grown = [G.grow(rows[t::5], np.random.default_rng(t), 6) for t in range(5)]
    n = max(len(g[0]) for g in grown)
    forest = G.Forest(*(np.array([list(g[i]) + [d] * (n - len(g[i])) for g in grown]) for i, d in ((0, -1), (1, 0.0), (2, 0), (3, 0.0))), np.zeros(3), G.mean_path(40))
    got = G.path_lengths(forest, rows)
    assert got == pytest.approx([np.mean([walk(forest, t, r) for t in range(5)]) for r in rows])


def test_leaves_hold_all_rows_and_cuts_are_inside():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(60, 2)), np.ones((20, 2))])  # twenty rows that no cut parts
    feature, cut, child, length = G.grow(rows, rng, 30)
    leaf = []
    for r in rows:
        node = 0
        while feature[node] >= 0:
            node = child[node] + int(r[feature[node]] >= cut[node])
        leaf.append(node)
    assert len(set(leaf[60:])) == 1 and len(set(leaf)) == sum(f < 0 for f in feature)
    assert G.mean_path(1) == 0 and G.mean_path(2) == 1 and G.mean_path(256) == pytest.approx(10.24, abs=0.01)


def test_planted_outliers_come_first(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *(float(x) for x in rng.normal(size=3)), "x") for i in range(3000)] + [(9000 + k, 8.0 + k, -9.0, 7.0, "x") for k in range(5)] + [(9100, None, None, None, "x")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, isolation string")
    forest = G.fit_forest(df, "id", ["a", "b", "c"])
    got = G.isolation_scores(df, forest, ["a", "b", "c"])
    out = {r.id: r.isolation for r in got.collect()}
    assert got.columns == ["id", "a", "b", "c", "isolation"] and len(out) == len(rows)
    assert {i for i, _ in sorted(out.items(), key=lambda x: -x[1])[:5]} == {9000 + k for k in range(5)}
    assert out[9100] < 0.5 < out[9004]
    again = G.isolation_scores(df.repartition(7), G.fit_forest(df.repartition(3), "id", ["a", "b", "c"]), ["a", "b", "c"])
    assert {r.id: r.isolation for r in again.collect()} == out


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, a double")
    assert len(G.isolation_scores(df, G.fit_forest(df, "id", ["a"], trees=3), ["a"]).collect()) == 2
    none = df.limit(0)
    assert G.isolation_scores(none, G.fit_forest(none, "id", ["a"], trees=3), ["a"]).count() == 0
