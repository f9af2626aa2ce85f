import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.operators import quantiles as Q


def data(seed=5):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.choice([1.0, 2.0, 2.0, 7.5]), lambda: rng.uniform(300, 301), lambda: float("inf"), lambda: None, lambda: float("nan")]
    out = []
    for k, n in ((1, 1), (2, 2), (3, 57), (4, 30_000), (None, 11)):
        w = [5, 5, 5, 0.2, 1, 1]
        out += [(k, rng.choices(kinds, w)[0](), rng.random()) for _ in range(n)]
    return out + [(9, None, None)]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact(spark, share):
    rows = data()
    df = spark.createDataFrame(rows, "k int, v double, w double")
    got = {r.k: (r.a, r.b) for r in Q.exact_quantiles(df, ["k"], {"a": (F.col("v"), share), "b": (F.col("w") * 2, share)}).collect()}
    for k in {r[0] for r in rows}:
        for at, c, f in ((0, 1, 1), (1, 2, 2)):
            v = sorted(r[c] * f for r in rows if r[0] == k and r[c] is not None and r[c] == r[c])
            i = share * (len(v) - 1)
            want = None if not v else v[int(i)] if i == int(i) or v[int(i)] == v[int(i) + 1] else v[int(i)] + (i - int(i)) * (v[int(i) + 1] - v[int(i)])
            assert got[k][at] == pytest.approx(want) if want is not None else got[k][at] is None, (k, at)


def test_no_keys_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert Q.exact_quantiles(df, [], {"m": Q.median(F.col("v")), "p": (F.col("v"), 0.25)}).collect() == [(2.0, 1.5)]
    assert Q.exact_quantiles(df.limit(0), [], {"m": Q.median(F.col("v"))}).collect() == [(None,)]


def test_mean_ranks(spark):
    rng = np.random.default_rng(1)
    v = [float(x) for x in np.concatenate([rng.integers(0, 9, 400), rng.normal(0, 1, 2000)])] + [None]
    got = {r.value: (r.rank, r.total) for r in Q.mean_ranks(spark.createDataFrame([(x,) for x in v], "v double"), "v").collect()}
    known = sorted(x for x in v if x is not None)
    for x in set(known):
        first, last = known.index(x) + 1, known.index(x) + known.count(x)
        assert got[x] == ((first + last) / 2, len(known))
