import datetime as dt
import random

from quoteloom.llm import topn

S = "quote_id long, risk_id string, brand string, premium double, collected_on date, channel string, quoted boolean, _salt int"


def brute(rows, n=5):
    best = {}
    for q, r, b, p, d, c, ok, _ in rows:
        if ok and p is not None and p == p and p > 0 and b is not None:
            best[r, b] = min(best.get((r, b), (9e9,)), (p, d, c, q))
    groups = {}
    for (r, b), (p, _, _, q) in best.items():
        groups.setdefault(r, []).append((p, b, q))
    return {(r, k, q) for r, g in groups.items() for k, (_, _, q) in enumerate(sorted(g)[:n], 1)}


def test_against_brute_force(spark):
    rng = random.Random(1)
    days = [dt.date(2024, 1, d) for d in (1, 2)]
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", "ünter", ""]), rng.choice([None, *"ABCDEFGHIJ"]), rng.choice([None, float("nan"), 0.0, -1.0, 5.0, 5.0, 6.0, 7.5, rng.uniform(1, 9)]), rng.choice(days), rng.choice(["x", "y"]), rng.choice([True, True, True, False, None]), 0) for k in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, S).repartition(6)
    got = {(r.risk_id, r.rank_no, r.quote_id) for r in topn.cheapest_brands(df).collect()}
    assert got == brute(rows)


def test_few_subgroups_and_empty(spark):
    rows = [(k, "r", chr(65 + k), 1.0, dt.date(2024, 1, 1), "x", True, 0) for k in range(9)]
    df = spark.createDataFrame(rows, S)
    assert [r.brand for r in topn.cheapest_brands(df).orderBy("rank_no").collect()] == list("ABCDE")
    one = topn.top_n(df, ["risk_id"], [df.premium, df.brand], ["brand"], 3, subgroups=1)
    assert [r.brand for r in one.orderBy("rank_no").collect()] == list("ABC")
    assert topn.cheapest_brands(df.limit(0)).count() == 0
