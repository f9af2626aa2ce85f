"""Exact quantiles and ranks of groups of any size, without a task that holds a group.

Bounded sketches, which merge on the way, give two values between which a quantile must lie. A second pass counts what
is below and the distinct values between, a small share of the rows, and the ranks among those are exact. Ranks of
all rows come from value counts spread over ranges of the values, with the ranges' sums added up in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.scalars import nan_to_null
from quoteloom.session import checkpointed

#: The sketch's error is a share of 1 / ACCURACY of the rows; the values looked at reach MARGIN to either side.
ACCURACY, MARGIN = 2_000, 4 / 2_000


def exact_quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], *, written: bool = True) -> DataFrame:
    """(keys, one column per name of ``wanted``): quantiles by linear interpolation, as ``percentile`` and ``median`` give.

    ``wanted``: name -> (value, share). Nulls and NaN are left out; a group without values has null. Null keys form
    a group, and without keys there is one row, also of an empty table. ``rows`` are read twice, so they are written once
    to the checkpoint folder unless ``written`` is false (a plain scan is cheaper read again).
    """
    values: list[Column] = []
    places: dict[str, int] = {}
    for name, (value, _) in wanted.items():
        seen = [k for k, v in enumerate(values) if str(v) == str(value)]
        places[name] = seen[0] if seen else len(values)
        if not seen:
            values.append(value)
    base = rows.select(*keys, *[nan_to_null(v.cast("double")).alias(f"v{k}_") for k, v in enumerate(values)])
    if written:
        base = checkpointed(base)
    by_place: dict[int, list[str]] = {}
    for name, k in places.items():
        by_place.setdefault(k, []).append(name)
    shares = {k: [s for n in names for s in (max(0.0, wanted[n][1] - MARGIN), min(1.0, wanted[n][1] + MARGIN))] for k, names in by_place.items()}
    sketches = base.groupBy(*keys).agg(*[F.struct(F.count(f"v{k}_").alias("n"), F.percentile_approx(f"v{k}_", shares[k], ACCURACY).alias("at")).alias(f"b{k}_") for k in by_place])
    # the ends of the range are open: what a sketch calls its first or last value need not be the least or greatest
    inf = float("inf")
    low = lambda k, i: F.lit(-inf) if shares[k][2 * i] == 0.0 else F.col(f"b{k}_.at")[2 * i]
    high = lambda k, i: F.lit(inf) if shares[k][2 * i + 1] == 1.0 else F.col(f"b{k}_.at")[2 * i + 1]
    bounds = sketches.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(k).alias("place"), low(k, i).alias("lo"), high(k, i).alias("hi"), (F.lit(wanted[name][1]) * (F.col(f"b{k}_.n") - 1)).alias("at"))
        for k, names in by_place.items() for i, name in enumerate(names)
    ])).alias("q")).select(*keys, "q.*")
    one = F.array(*[F.struct(F.lit(k).alias("place"), F.col(f"v{k}_").alias("v")) for k in by_place])
    long = base.select(*keys, F.explode(one).alias("x")).select(*keys, "x.*").where("v is not null").alias("r")
    limits = bounds.groupBy(*keys, "place").agg(F.collect_list(F.struct("name", "lo", "hi", "at")).alias("limits")).alias("b")  # an entry a quantile wanted
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys] + [F.col("r.place") == F.col("b.place")]
    near = long.join(limits, on).select(*[F.col(f"r.{c}").alias(c) for c in keys], "v", F.explode("limits").alias("q"))
    side = F.when(F.col("v") < F.col("q.lo"), -1).when(F.col("v") > F.col("q.hi"), 1).otherwise(0)
    counts = near.groupBy(*keys, "q.name", "q.at", side.alias("side"), F.when(side == 0, F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    order = Window.partitionBy(*keys, "name").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0)  # distinct values near one quantile
    ranked = counts.withColumn("upto", F.sum("n").over(order)).withColumn("from", F.col("upto") - F.col("n"))
    # of what is below only the last value is known, of what is above only the first
    held = lambda k: F.max(F.when((F.col("side") == 0) & (F.col("from") <= k) & (k < F.col("upto")), F.col("v")).when((F.col("side") < 0) & (k == F.col("upto") - 1), F.col("most")).when((F.col("side") > 0) & (k == F.col("from")), F.col("least")))
    k0, k1 = F.floor("at"), F.ceil("at")
    found = ranked.groupBy(*keys, "name", "at").agg(held(k0).alias("a"), held(k1).alias("b"))
    missed = F.raise_error(F.lit("a quantile lies outside its sketch's bounds"))
    found = found.withColumns({c: F.when(F.col(c).isNull(), missed.cast("double")).otherwise(F.col(c)) for c in ("a", "b")})
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("at") - k0) * (F.col("b") - F.col("a")))
    wide = found.withColumn("value", value).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])
    every = sketches.select(*keys) if keys else None
    if every is None:
        return wide
    match = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys]
    return every.alias("e").join(wide.alias("w"), match, "left").select(*[F.col(f"e.{c}").alias(c) for c in keys], *wanted)


def with_quantiles(aggregated: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], **how) -> DataFrame:
    """``aggregated`` (a row a group) with the quantiles of the groups' ``rows``."""
    q = exact_quantiles(rows, keys, wanted, **how)
    if not keys:
        return aggregated.crossJoin(q)  # single rows
    match = [F.col(f"a_.{c}").eqNullSafe(F.col(f"q_.{c}")) for c in keys]
    return aggregated.alias("a_").join(q.alias("q_"), match, "left").select("a_.*", *[F.col(f"q_.{n}").alias(n) for n in wanted])


def median(value: Column) -> tuple[Column, float]:
    return value, 0.5


def mean_ranks(df: DataFrame, value: str, *, ranges: int = 256) -> DataFrame:
    """(value, rank, total): the mean rank of each distinct non-null value among all rows, ties sharing theirs.

    Value counts are spread over ``ranges`` ranges of the values, cut by a sketch; each task ranks a range, and the rows of
    the ranges before it are added from their sums. A range holds about a 256th of the rows; equal values are one row.
    """
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("n_")))
    cuts = counts.agg(F.percentile_approx("v_", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts"))
    # how many cuts lie below a value; the cuts are one small row
    spread = counts.crossJoin(F.broadcast(cuts)).withColumn("range_", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("v_")))).drop("cuts")
    spread = checkpointed(spread)
    sums = spread.groupBy("range_").agg(F.sum("n_").alias("in_"))
    before = sums.withColumn("before_", F.sum("in_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_"))  # a row a range: 256
    before = before.withColumn("total", F.sum("in_").over(Window.partitionBy(F.lit(0)))).drop("in_")
    inner = Window.partitionBy("range_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.join(F.broadcast(before), "range_").withColumn("rank", F.col("before_") + F.sum("n_").over(inner) - (F.col("n_") - 1) / 2)
    return ranked.select(F.col("v_").alias("value"), "rank", "total")
