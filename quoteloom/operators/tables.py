"""Relational building blocks: profiles, duplicates, conflicts, upserts, unions, pivots, coverage and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.operators.quantiles import mean_ranks, median, with_quantiles
from quoteloom.session import checkpointed


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_null, n_unique, least, most) of each column, in one aggregation turned upright.

    Values are compared as text. Exact distinct counts of several columns expand every row, so name the columns wanted.
    """
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        t = F.col(f"`{c}`").cast("string")
        aggs += [F.count(t).alias(f"c{i}"), F.count_distinct(t).alias(f"u{i}"), F.min(t).alias(f"l{i}"), F.max(t).alias(f"m{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"u{i}").alias("n_unique"), F.col(f"l{i}").alias("least"), F.col(f"m{i}").alias("most")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, and occurrences after the first on the keys; nulls are equal to one another."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n_conflicting): how many keys hold more than one distinct non-null value of each column.

    Least against most, which combine before the shuffle, in place of distinct counts.
    """
    per = df.groupBy(key).agg(*[(F.min(F.col(c).cast("string")) != F.max(F.col(c).cast("string"))).alias(c) for c in columns])
    one = per.agg(*[F.count_if(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_conflicting")) for c in columns])).alias("r")).select("r.*")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the least by a declared order; as a grouped minimum, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(*[F.col(k) if k in keys else F.col(f"b.{k}").alias(k) for k in df.columns])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without the rows whose keys ``new`` holds, and ``new``; keys are compared as text, duplicates inside ``new`` stay."""
    text = lambda d: [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_{k}") for k in keys]
    old = existing.select("*", *text(existing)).join(new.select(*text(new)).distinct(), [f"_{k}" for k in keys], "left_anti").drop(*[f"_{k}" for k in keys])
    return old.unionByName(new, allowMissingColumns=True)


def jaccard(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: shared keys over all keys of two tables; null for two empty ones."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    shared = F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.agg(shared.alias("n_shared"), F.count("*").alias("n_all"), F.when(F.count("*") > 0, shared / F.count("*")).alias("jaccard"))


def melt_wide(df: DataFrame, keep: list[str], brands: list[str], *, blank: str = "absent") -> DataFrame:
    """One row per kept row and brand column: brand, premium_text, quoted. Blank cells are dropped, or kept as declined."""
    long = df.unpivot(keep, brands, "brand", "premium_text")
    empty = F.col("premium_text").isNull() | (F.trim("premium_text") == "")
    if blank == "absent":
        return long.where(~empty).withColumn("quoted", F.lit(True))
    if blank != "declined":
        raise ValueError("blank must be absent or declined")
    return long.withColumn("quoted", ~empty)


def percentile_rank(df: DataFrame, value: str, name: str = "pct_rank") -> DataFrame:
    """Rank over count, ties at their mean rank, nulls null. Ranks come from value counts in ranges, so no window holds all rows."""
    ranked = mean_ranks(df, value).select(F.col("value").alias("_v"), (F.col("rank") / F.col("total")).alias("_r"))
    return df.join(ranked, F.col(value) == F.col("_v"), "left").withColumn(name, F.col("_r")).drop("_v", "_r")


def top_per(df: DataFrame, group: list[str], order: list[str], n: int, rank: str, *, subgroups: int = 16) -> DataFrame:
    """Rows of rank 1 to ``n`` in their group, ranked within hashed subgroups first, so that no task holds a hot group. ``order`` breaks all ties."""
    salted = df.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(subgroups)))
    first = salted.withColumn(rank, F.row_number().over(Window.partitionBy(*group, "salt_").orderBy(*order))).where(F.col(rank) <= n).drop("salt_")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def coverage(expected: DataFrame, rows: DataFrame, cell: list[str], channel: str = "channel") -> DataFrame:
    """Per cell of an expected grid: rows quoted and declined, and the channels not seen."""
    seen = rows.groupBy(*cell).agg(F.count_if("quoted").alias("n_quoted"), F.count_if(~F.col("quoted")).alias("n_declined"), F.collect_set(channel).alias("_seen"))
    grid = expected.groupBy(*cell).agg(F.collect_set(channel).alias("_due"))
    both = grid.join(seen, cell, "left")
    missing = F.array_join(F.array_sort(F.array_except("_due", F.coalesce("_seen", F.array().cast("array<string>")))), "|")
    status = F.when(F.col("_seen").isNull(), "missing").when(missing == "", "complete").otherwise("partial")
    return both.select(*cell, F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_declined", F.lit(0)).alias("n_declined"), missing.alias("missing_channels"), status.alias("status"))


def grid(*sides: DataFrame) -> DataFrame:
    """The cross product of small declared lists (risks to collect, channels, brands), each of a checked size."""
    out = sides[0]
    for s in sides[1:]:
        if s.limit(10_001).count() > 10_000:
            raise ValueError("a side of a collection grid may hold 10,000 rows")
        out = out.crossJoin(F.broadcast(s))
    return out


def first_ranks(df: DataFrame, group: list[str], value: str, tie: list[str], name: str = "rank_no") -> DataFrame:
    """``df`` with the place of each non-null value in its group, ties by the order of ``tie``; null values have none."""
    w = Window.partitionBy(*group, F.col(value).isNull()).orderBy(value, *tie)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def groups_of_size(df: DataFrame, group: list[str], size: int) -> DataFrame:
    """Rows whose group has exactly ``size`` rows; counts combine before the shuffle, so a hot group is counted in parts."""
    whole = df.groupBy(*group).agg(F.count("*").alias("n_")).where(F.col("n_") == size).select(*[F.col(g).alias(f"{g}_") for g in group])
    return df.join(whole, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group], "left_semi")


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``problems``: the names of the rules that fail, empty for sound rows. A rule that is null fails."""
    return df.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def problem_summary(messages: DataFrame, column: str = "message") -> DataFrame:
    """Messages grouped by their text with quoted words and numbers masked."""
    masked = F.regexp_replace(F.regexp_replace(F.col(column), r"'[^']*'", "'...'"), r"\d+", "#")
    return messages.groupBy(masked.alias("problem")).agg(F.count("*").alias("n"))


#: Attributes of a risk without which no model of a brand can be fitted.
ESSENTIALS = ["postcode", "policy_type", "building_type", "buildings_sum_insured", "contents_sum_insured", "voluntary_excess"]


def attribute_findings(rows: DataFrame, essentials: list[str] = ESSENTIALS) -> DataFrame:
    """(severity, code, measure): essential attributes that are absent (a blocker), or there and under half filled; one row a code, counted."""
    here = [c for c in essentials if c in rows.columns]
    absent = len(essentials) - len(here)
    thin = F.lit(0)
    for c in here:
        thin = thin + F.when(F.count(F.col(c)) < 0.5 * F.count("*"), 1).otherwise(0)
    one = rows.agg(F.count("*").alias("n"), thin.alias("thin"))
    find = lambda when, sev, code, measure: F.when(when, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), measure.cast("double").alias("measure")))
    found = F.array_compact(F.array(find(F.lit(absent > 0), "BLOCKER", "no_risk_attributes", F.lit(absent)), find((F.col("n") > 0) & (F.col("thin") > 0), "WARN", "sparse_risk_attributes", F.col("thin"))))
    return one.select(F.explode(found).alias("f")).select("f.*")


def audit(quotes: DataFrame, *, declines_included: bool | None = None, truncated_to_top_n: int | None = None) -> DataFrame:
    """(severity, code, measure): what is wrong with an extract however clean it looks, blockers first.

    Measures come from one aggregate over rows, one over the sizes of risk, date and channel groups, and the
    overlap of the first and last date's risks; the findings are drawn from that single row.
    """
    q = quotes.select("risk_id", "brand", "channel", "collected_on", F.coalesce("quoted", F.lit(False)).alias("quoted"), F.when(~F.isnan("premium"), F.col("premium")).alias("premium"))
    rows = q.agg(F.count("*").alias("n"), F.count_if(~F.col("quoted")).alias("n_declined"), F.count_if(F.col("brand").isNull()).alias("n_unmapped"), F.min("collected_on").alias("first_on"), F.max("collected_on").alias("last_on"))
    rows = with_quantiles(rows, q, [], {"median_premium": median(F.col("premium"))}, written=False)
    size = checkpointed(q.groupBy("risk_id", "collected_on", "channel").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("times")))  # how often each size occurs
    upto = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)  # a row a size that occurs
    middle = size.withColumn("upto", F.sum("times").over(upto)).withColumn("all", F.sum("times").over(Window.partitionBy(F.lit(0))))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("size")))
    sizes = middle.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n_groups"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), ((at(F.floor((F.col("all") + 1) / 2)) + at(F.floor((F.col("all") + 2) / 2))) / 2).alias("size_median"))
    dup = duplicate_count(q, ["risk_id", "brand", "channel", "collected_on"])
    ends = q.select("risk_id", "collected_on").join(F.broadcast(rows), (F.col("collected_on") == F.col("first_on")) | (F.col("collected_on") == F.col("last_on")))  # one row
    per = ends.groupBy("risk_id").agg(F.bool_or(F.col("collected_on") == F.col("first_on")).alias("a"), F.bool_or(F.col("collected_on") == F.col("last_on")).alias("b"))
    overlap = per.agg(F.when(F.count("*") > 0, F.count_if(F.col("a") & F.col("b")) / F.count("*")).alias("overlap"))
    m = rows.crossJoin(sizes).crossJoin(dup.select("n_duplicates")).crossJoin(overlap)  # single rows
    n, declined, med = F.col("n"), F.col("n_declined"), F.col("median_premium")
    same = (F.col("n_groups") > 3) & (F.col("size_min") == F.col("size_max")) & (F.col("size_max") <= 10)
    find = lambda when, sev, code, measure: F.when(when, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), measure.cast("double").alias("measure")))
    some = n > 0
    findings = F.array_compact(F.array(
        find(~some, "BLOCKER", "empty", n),
        find(some & (declined == 0), "BLOCKER" if declines_included else "WARN", "no_declines", declined),
        find(some & (declined > 0), "WARN" if declines_included is False else "INFO", "declines_unexpected" if declines_included is False else "declines", declined),
        find(med < 90, "BLOCKER", "premium_basis", med), find(med > 1200, "WARN", "premium_basis", med), find(med.between(90, 1200), "INFO", "premium_basis", med),
        find(some & same & (declined > 0), "INFO", "panel_size", F.col("size_max")), find(some & same & (declined == 0), "WARN", "possible_truncation", F.col("size_max")),
        find(some & ~same, "BLOCKER" if truncated_to_top_n else "INFO", "truncated" if truncated_to_top_n else "panel_size", F.col("size_median")),
        find((F.col("first_on") < F.col("last_on")) & (F.col("overlap") < 0.5), "WARN", "rotating_panel", F.col("overlap")), find((F.col("first_on") < F.col("last_on")) & (F.col("overlap") >= 0.5), "INFO", "fixed_basket", F.col("overlap")),
        find(F.col("n_duplicates") > 0, "WARN", "duplicates", F.col("n_duplicates")), find(F.col("n_unmapped") > 0, "WARN", "unmapped_brands", F.col("n_unmapped")),
    ))
    found = m.select(F.explode(findings).alias("f")).select("f.*")
    rank = F.when(F.col("severity") == "BLOCKER", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return found.orderBy(rank, "code")
