import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from quoteloom.operators import profile

Q = "load_id long, quoted boolean, premium double, n int"
R = "load_id long, voluntary_excess double, value int"
L = "load_id long, prior_load_id long, loaded_on date"


def issues(spark, quotes, risks, loads):
    p = profile.profile_loads(spark.createDataFrame([(*r, 0) for r in quotes], Q), spark.createDataFrame([(*r, 0) for r in risks], R))
    return {tuple(r) for r in profile.load_issues(p, spark.createDataFrame([(*x, dt.date(2024, 1, 1)) for x in loads], L)).collect()}


def test_masks(spark):
    df = spark.createDataFrame([("AB12 3cd",), ("£4.50",), (None,)], "t string")
    assert [r[0] for r in df.select(profile.value_mask(F.col("t"))).collect()] == ["AA99 9aa", "£9.99", None]
    assert [r[0] for r in df.select(profile.value_mask(F.col("t"), keep_runs=False)).collect()] == ["A9 9a", "£9.9", None]
    nums = spark.createDataFrame([(1.0,), (1250.5,), (0.125,), (-3.0,)], "x double")
    assert [r[0] for r in nums.select(profile.decimal_text(F.col("x"))).collect()] == ["1", "1250.5", "0.125", "-3"]


def test_each_issue(spark):
    nan = float("nan")
    base = [(1, k % 5 != 0, float(100 + k)) for k in range(100)]
    assert issues(spark, base, [], [(1, None)]) == set()
    assert issues(spark, base + [(1, True, -1.0)], [], [(1, None)]) == {(1, "premium", "value_range")}
    assert issues(spark, base + [(1, True, 100.125)], [], [(1, None)]) == {(1, "premium", "pattern")}
    assert issues(spark, [], [(7, 75.0), (7, 100.0)], [(7, None)]) == {(7, "voluntary_excess", "pattern")}
    assert issues(spark, [], [(7, 2050.0)], [(7, None)]) == {(7, "voluntary_excess", "value_range")}
    second = [(2, q, None if k < 20 else nan if k < 25 else p) for k, (_, q, p) in enumerate(base)]
    assert issues(spark, base + second, [], [(1, None), (2, 1)]) == {(2, "premium", "null_rate")}
    assert issues(spark, base + [(2, q, 150.0) for _, q, _ in base], [], [(1, None), (2, 1)]) == {(2, "premium", "distinct_count")}
    assert issues(spark, base + [(2, q, p * 2) for _, q, p in base], [], [(1, None), (2, 1)]) == {(2, "premium", "distribution")}
    assert issues(spark, base + [(2, k % 2 == 0, p) for k, (_, _, p) in enumerate(base)], [], [(1, None), (2, 1)]) == {(2, "quoted", "distribution")}
    assert issues(spark, base, [], [(1, 99)]) == set()


def test_empty_and_all_null(spark):
    assert issues(spark, [], [], []) == set()
    assert issues(spark, [(1, None, None)] * 3, [(1, None)] * 2, [(1, None)]) == set()


def test_exact_medians(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([rng.uniform(-5, 5), rng.uniform(0, 3e6), 7.0, None])) for k in (1, 2, 3) for _ in range(rng.randint(1, 400))] + [(None, 4.0), (None, 5.0)]
    got = {r[0]: r[1] for r in profile.exact_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    want = {k: statistics.median([v for a, v in rows if a == k and v is not None]) for k in {a for a, v in rows if v is not None}}
    assert got == want


def test_mask_divergence(spark):
    now = spark.createDataFrame([(1, "9", 10), (2, "9", 10)], "k int, mask string, n long")
    old = spark.createDataFrame([(1, "9", 5), (2, "a", 7)], "k int, mask string, n long")
    got = {r.k: round(r.divergence, 6) for r in profile.mask_divergence(now, old, ["k"]).collect()}
    assert got == {1: 0.0, 2: 1.0}
