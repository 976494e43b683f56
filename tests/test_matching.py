import random
import time

import numpy as np
import pandas as pd
import pytest

from tallyscope.operators import matching as G


def greedy(cases, controls):
    free = sorted(controls, key=lambda c: (c[1], c[0]))
    out = set()
    for cid, cap in sorted(cases, key=lambda c: (c[1], c[0])):
        if not free:
            break
        best = min(range(len(free)), key=lambda i: (abs(free[i][1] - cap), i))
        out.add((cid, free.pop(best)[0]))
    return out


@pytest.mark.parametrize("n_case,n_ctrl,spread", [(12, 60, 1000), (40, 60, 30), (30, 20, 100), (25, 200, 8)])
def test_equals_sequential_rule(spark, n_case, n_ctrl, spread):
    rng = random.Random(n_case * n_ctrl)
    cases = [(i, float(rng.randint(0, spread)), "x") for i in range(n_case)]
    controls = [(1000 + i, float(rng.randint(0, spread)), "x") for i in range(n_ctrl)] + [(5000, 1.0, "other")]
    cols = "id long, cap double, s string"
    got = G.match_without_replacement(spark.createDataFrame(cases, cols), spark.createDataFrame(controls, cols), "s", "id", "cap")
    assert {(r["case_id"], r["control_id"]) for r in got.collect()} == greedy([c[:2] for c in cases], [c[:2] for c in controls if c[2] == "x"])


@pytest.mark.parametrize("n_case,n_ctrl,spread", [(300, 200, 40), (200, 500, 10**6), (1, 1, 1), (50, 50, 1), (400, 300, 100)])
def test_deleting_lists_give_the_sequential_rule(n_case, n_ctrl, spread):
    rng = random.Random(spread + n_case)
    cases = sorted(((i, float(rng.randint(0, spread))) for i in range(n_case)), key=lambda c: (c[1], c[0]))
    controls = sorted(((1000 + i, float(rng.randint(0, spread))) for i in range(n_ctrl)), key=lambda c: (c[1], c[0]))
    got = G._greedy(pd.DataFrame(cases, columns=["cid", "cap"]), pd.DataFrame(controls, columns=["cid", "cap"]))
    assert set(got) == greedy(cases, controls)


def test_a_dense_stratum_is_matched_in_short_time():
    """60,000 cases on 40,000 controls of a few hundred capacities, all in one group."""
    rng = np.random.default_rng(2)
    cases, controls = (np.sort(rng.integers(0, 300, n)).astype(float) for n in (60_000, 40_000))
    start = time.time()
    got = G._greedy(pd.DataFrame({"cid": np.arange(60_000), "cap": cases}), pd.DataFrame({"cid": np.arange(40_000), "cap": controls}))
    assert len(got) == 40_000 and len({c for _, c in got}) == 40_000 and time.time() - start < 20


def test_merge_intervals_over_blocks(spark):
    rng = random.Random(1)
    rows = [("k", a, a + rng.randint(0, 9)) for a in rng.sample(range(0, 900), 90)]
    got = {(r["lo"], r["hi"]): r["span"] for r in G.merge_intervals(spark.createDataFrame(rows, "k string, lo long, hi long"), "k", "lo", "hi", block=32).collect()}
    want, reach, start = {}, None, None
    for _, lo, hi in sorted(rows):
        if reach is None or lo > reach:
            start, reach = lo, hi
        reach = max(reach, hi)
        want[(lo, hi)] = start
    assert got == want
