import random

import numpy as np
import pytest

from quoteloom.llm import percentiles as p


@pytest.mark.parametrize("few,run_rows", [(2, 40), (64, 10_000)])
def test_against_numpy(spark, few, run_rows):
    rng = random.Random(5)
    rows = [(g, c, rng.choice([7.0, 7.0, rng.uniform(0, 100), rng.uniform(-1e6, 1e6), None, float("nan")])) for g, c, n in (("a", "x", 900), ("a", None, 3), (None, "x", 60), ("b", "x", 1), ("c", "x", 400)) for _ in range(n)] + [("same", "x", 4.0)] * 300 + [("nothing", "x", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "g string, c string, v double, t int").repartition(5)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.c, r.percentile): (r.value, r.n_values) for r in p.multi_select(p.value_runs(df, ["g", "c"], "v", run_rows=run_rows), ["g", "c"], shares, few=few).collect()}
    want = {}
    for k in {(g, c) for g, c, _ in rows}:
        v = [x for g, c, x in rows if (g, c) == k and x is not None and x == x]
        for s in shares:
            if v:
                want[(*k, s)] = (float(np.quantile(v, s)), len(v))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], rel=1e-12) and got[k][1] == want[k][1], k


def test_stored_runs_are_put_together(spark):
    day = lambda k: spark.createDataFrame([("g", float(v)) for v in range(k * 10, k * 10 + 10)], "g string, v double")
    runs = [p.value_runs(day(k), ["g"], "v") for k in range(4)]
    union = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
    assert p.multi_select(union, ["g"], [0.5]).first().value == 19.5
    assert p.multi_select(runs[3], ["g"], [0.5]).first().value == 34.5
    assert p.multi_select(union.limit(0), ["g"], [0.5]).count() == 0


def test_infinities_are_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, inf, inf)] + [(2, v) for v in (-inf, -inf, 0.0, 0.0)] + [(3, inf)], "k int, v double")
    runs = p.value_runs(df, ["k"], "v")
    for few in (1, 512):
        got = {(r.k, r.percentile): r.value for r in p.multi_select(runs, ["k"], [0.0, 0.5, 0.9], few=few).collect()}
        assert got == {(1, 0.0): 1.0, (1, 0.5): inf, (1, 0.9): inf, (2, 0.0): -inf, (2, 0.5): -inf, (2, 0.9): 0.0, (3, 0.0): inf, (3, 0.5): inf, (3, 0.9): inf}


def test_stored_runs_put_together(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k % 7, k % 2, rng.gauss(0, 1)) for k in range(4000)], "load int, k int, v double")
    one = p.multi_select(p.value_runs(df, ["k"], "v"), ["k"], [0.25, 0.5], few=8)
    two = p.multi_select(p.merged_runs(p.value_runs(df, ["load", "k"], "v", run_rows=300), ["k"]), ["k"], [0.25, 0.5], few=8)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
