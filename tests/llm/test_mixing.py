import random

from quoteloom.llm import mixing

S = "doc_id long, source string, tokens long, weight int"
T = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **kw):
    kept, w = mixing.mixture(spark.createDataFrame([(*d, 0) for d in docs], S), spark.createDataFrame(targets, T), **kw)
    return kept.collect(), {r.source: r for r in mixing.reached_shares(kept, w).collect()}


def test_shares_repeats_and_budget(spark):
    rng = random.Random(2)
    docs = [(k, s, rng.randint(20, 60)) for k, s in enumerate(["big"] * 3000 + ["mid"] * 600 + ["small"] * 100)] + [(9000, None, 50), (9001, "untargeted", 50), (9002, "big", 0)]
    targets = [("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.09, 3), ("absent", 0.01, 4)]
    kept, got = run(spark, docs, targets)
    total = sum(r.tokens for r in kept)
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.09)):
        assert abs(got[s].reached_share - share / 0.99) < 0.004
        assert got[s].repeats <= {"big": 1, "mid": 2, "small": 3}[s]
    assert got["absent"].tokens == 0 and got["absent"].reached_share == 0
    held = {s: sum(t for _, x, t in docs if x == s) for s in ("big", "mid", "small")}
    assert total <= min(held["big"] / 0.6, held["mid"] * 2 / 0.3, held["small"] * 3 / 0.09) * 0.99 + 1
    assert {r.source for r in kept} == {"big", "mid", "small"} and all(r.tokens > 0 for r in kept)
    assert len({(r.doc_id, r.copy_no) for r in kept}) == len(kept)
    # every prefix in the order of finish holds the shares too
    half = sorted(kept, key=lambda r: r.finish)[: len(kept) // 2]
    assert abs(sum(r.tokens for r in half if r.source == "big") / sum(r.tokens for r in half) - 0.6 / 0.99) < 0.01
    less, _ = run(spark, docs, targets, total_tokens=5000)
    assert 4800 <= sum(r.tokens for r in less) <= 5000


def test_same_whatever_the_partitions(spark):
    docs = [(k, "a" if k % 3 else "b", 10 + k % 7, 0) for k in range(300)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], T)
    one = sorted(map(tuple, mixing.mixture(spark.createDataFrame(docs, S).coalesce(1), t)[0].collect()))
    assert one == sorted(map(tuple, mixing.mixture(spark.createDataFrame(docs[::-1], S).repartition(5), t)[0].collect()))


def test_empty_and_null_targets(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    assert run(spark, [(1, "a", 5)], [])[0] == []
    kept, got = run(spark, [(1, "a", 5), (2, "b", 5)], [("a", None, 1), ("b", 1.0, None), (None, 0.5, 1)])
    assert [r.doc_id for r in kept] == [2] and got["a"].tokens == 0


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world", "s", 1), (2, None, "s", 1), (3, "", None, 1), (4, "a " * 50_000, "s", 1)], "doc_id long, text string, source string, tokens int")
    got = {r.doc_id: r.tokens for r in mixing.token_counts(d).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and 50_000 <= got[4] <= 50_001
