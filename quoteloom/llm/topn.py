"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(items: DataFrame, group: list[str], order: list[Column], salt_on: list[str], n: int, *, subgroups: int = 16, rank: str = "rank_no") -> DataFrame:
    """``items`` of rank 1 to ``n`` in their group, with the rank added as int column ``rank``, in place of one so named.

    Each group is hashed into ``subgroups`` by ``salt_on``; every subgroup keeps its n best, and the at most
    n * subgroups survivors of a group are ranked again. No task holds a whole hot group. ``order`` must end in
    an identifier, so that ties fall the same way whatever the partitioning; rows equal in all of it are
    interchangeable. Null group keys form one group. Groups with fewer than n items give all of them.
    """
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(subgroups))
    names = [c for c in items.columns if c != rank]
    free = "_" * (1 + max(len(c) for c in names))  # no column is named so
    inner = Window.partitionBy(*group, f"{free}s").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    survivors = items.withColumn(f"{free}s", salt).withColumn(f"{free}r", F.row_number().over(inner)).where(F.col(f"{free}r") <= n).drop(f"{free}s", f"{free}r")
    return survivors.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n).select(*names, rank)


def best_per(items: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per ``keys``: the least by ``order``, as a grouped minimum, which combines before the shuffle.

    Nulls in ``order`` come first, as in Spark's ascending order.
    """
    best = items.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys([*order, *keep])])


def cheapest_brands(quotes: DataFrame, n: int = 5) -> DataFrame:
    """(risk_id, rank_no, quote_id, brand, premium): the n cheapest brands of every risk.

    Only rows quoted, priced above zero, not NaN, with a brand and a risk. One row is kept per risk and brand
    (lowest premium, then earliest date, channel, quote_id), then ranked by premium and brand. Null dates come
    first among equals. Repeated rows count once. Empty input gives an empty table.
    """
    priced = quotes.where("quoted and premium > 0 and not isnan(premium) and brand is not null").select("risk_id", "brand", "premium", "collected_on", "channel", "quote_id")
    brands = best_per(priced, ["risk_id", "brand"], ["premium", "collected_on", "channel", "quote_id"], [])
    ranked = top_n(brands.select("risk_id", "brand", "premium", "quote_id"), ["risk_id"], [F.col("premium"), F.col("brand"), F.col("quote_id")], ["brand"], n)
    return ranked.select("risk_id", "rank_no", "quote_id", "brand", "premium")
