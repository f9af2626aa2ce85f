"""Column profiles of loads: masks, nulls, distinct values, ranges and how they moved since the load before.

A value's mask is its text with characters generalised by class. The masks that stand in most loads are a column's
dominant patterns; values of any other mask are suspects, and an exact check of the field's step decides on them.
One shuffle counts each distinct value of a load and column, a second sums them up by mask; everything else, the mining
of patterns, the violations and how far mask distributions diverge between loads, is read from that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.session import checkpointed


def value_mask(text: Column, *, keep_runs: bool = True) -> Column:
    """The character-class mask of a text: digits 9, letters A or a; ``keep_runs=False`` folds runs into one."""
    plus = "" if keep_runs else "+"
    out = F.regexp_replace(text, rf"\d{plus}", "9")
    out = F.regexp_replace(out, rf"\p{{Lu}}{plus}", "A")
    return F.regexp_replace(out, rf"\p{{Ll}}{plus}", "a")


def decimal_text(value: Column, places: int = 6) -> Column:
    """A double as plain text without trailing zeros, so that its mask shows sign, size and decimal places."""
    return F.regexp_replace(F.regexp_replace(value.cast(f"decimal(24,{places})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def number_mask(value: Column, step: float) -> Column:
    """A number's mask, as fine as the field's step asks: places behind the point for a step below one, else the last digits by the classes 0, 5 and 9.

    312.5 is ``9.9`` by steps of 0.01; by steps of 50, 150 is ``#50`` and 153 is ``#59``, where # stands for the digits before.
    """
    text = decimal_text(value)
    if step < 1:
        return F.regexp_replace(F.regexp_replace(text, r"^(-?)\d+", "$1#"), r"\d", "9")
    last = len(str(round(step)))
    return F.regexp_replace(F.regexp_replace(text, rf"^(-?)\d+(\d{{{last}}})(\.|$)", "$1#$2$3"), "[1-46-9]", "9")


def mask_counts(values: DataFrame, keys: list[str], value: str = "value_text", count: str = "n") -> DataFrame:
    """(keys, mask, n, n_distinct) from counted values; a null value has the mask ``<null>``."""
    m = F.coalesce(value_mask(F.col(value), keep_runs=False), F.lit("<null>"))
    return values.withColumn("mask", m).groupBy(*keys, "mask").agg(F.sum(count).alias("n"), F.count("*").alias("n_distinct"))


def dominant_masks(masks: DataFrame, load: str, column_keys: list[str], *, share: float = 0.02, loads_share: float = 0.5) -> DataFrame:
    """(column keys, mask): the patterns of a column, masks that hold ``share`` of the values in ``loads_share`` of its loads.

    Loads are counted and not rows, so that a large damaged load makes no pattern of its damage.
    """
    known = masks.where("mask <> '<null>'").groupBy(load, *column_keys, "mask").agg(F.sum("n").alias("n"))
    per = known.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(load, *column_keys)))
    all_loads = known.groupBy(*column_keys).agg(F.count_distinct(load).alias("loads_"))
    seen = per.where(F.col("share") >= share).groupBy(*column_keys, "mask").agg(F.count("*").alias("in_"))
    return seen.join(all_loads, column_keys).where(F.col("in_") >= loads_share * F.col("loads_")).select(*column_keys, "mask")


def mask_divergence(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (bits, 0 to 1) between two mask distributions of the same keys."""
    def shares(d: DataFrame, name: str) -> DataFrame:
        return d.select(*keys, "mask", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(name))

    both = shares(now, "p").join(shares(before, "q"), [*keys, "mask"], "full").na.fill(0.0, ["p", "q"])
    mean = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mean)).otherwise(0.0)
    return both.groupBy(*keys).agg((F.sum(part("p") + part("q")) / 2).alias("divergence"))


def _value_counts(quotes: DataFrame, risks: DataFrame) -> DataFrame:
    """(load_id, field_id, value, n, n_true, n_false): each distinct value once, NaN as null.

    Both tables are counted by their own columns first, so only distinct combinations are shuffled.
    """
    nan_null = lambda c: F.when(~F.isnan(c), F.col(c)).alias("value")
    q = quotes.select("load_id", "quoted", nan_null("premium"))
    q = q.groupBy("load_id", "value").agg(F.count("*").alias("n"), F.count_if(F.col("quoted")).alias("n_true"), F.count_if(~F.col("quoted")).alias("n_false"))
    r = risks.select("load_id", nan_null("voluntary_excess")).groupBy("load_id", "value").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return q.withColumn("field_id", F.lit("premium")).unionByName(r.withColumns({"field_id": F.lit("voluntary_excess"), "n_true": zero, "n_false": zero}))


def exact_medians(rows: DataFrame, keys: list[str], value: str, *, width: float = 1.0) -> DataFrame:
    """(keys, median): the exact median of non-null values, the mean of the middle two where their number is even.

    A first light pass counts buckets of ``width`` (combined before the shuffle) and finds those that hold the
    middle ranks; a second keeps only their values and ranks the distinct ones. Values beyond a million widths
    share the outermost buckets. No group is sorted whole, and no rows but the middle buckets' are shuffled.
    """
    c = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_"))
    c = c.withColumn("b_", F.floor(F.greatest(F.least(F.col("v_") / F.lit(width), F.lit(1e6)), F.lit(-1e6))).cast("long"))
    buckets = c.groupBy(*keys, "b_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys)
    ranked = buckets.withColumn("total_", F.sum("n_").over(w)).withColumn("before_", F.sum("n_").over(w.orderBy("b_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_"))
    lo, hi = F.floor((F.col("total_") + 1) / 2), F.floor((F.col("total_") + 2) / 2)
    inside = lambda r: (F.col("before_") < r) & (r <= F.col("before_") + F.col("n_"))
    middle = ranked.where(inside(lo) | inside(hi)).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("b_").alias("bucket_"), "total_", "before_")
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("b_") == F.col("bucket_")]
    values = c.join(middle, on).groupBy(*keys, "bucket_", "total_", "before_", "v_").agg(F.count("*").alias("n_"))
    inner = Window.partitionBy(*keys, "bucket_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("before_", F.col("before_") + F.sum("n_").over(inner) - F.col("n_"))
    at = lambda r: F.max(F.when(inside(r), F.col("v_")))
    return found.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias("median"))


#: Bounds of a sound value and the step that sound values are multiples of.
BOUNDS: dict[str, tuple[float, float, float]] = {"premium": (0.0, 25000.0, 0.01), "voluntary_excess": (0.0, 2000.0, 50.0)}


def mask_state(quotes: DataFrame, risks: DataFrame, bounds: dict[str, tuple[float, float, float]] = BOUNDS) -> DataFrame:
    """(load_id, field_id, mask, n, n_distinct, n_off_step, ...), a row a load, field and mask, written once.

    ``n_off_step`` counts the values that the exact check finds to be no multiple of the field's step.
    """
    counted = _value_counts(quotes, risks)
    v, n = F.col("value"), F.col("n")
    off, outside, mask = F.lit(False), F.lit(False), F.lit(None).cast("string")
    for field, (least, most, step) in bounds.items():
        here = F.col("field_id") == field
        outside = outside | (here & ((v < least) | (v > most)))
        units = v / F.lit(step) if step >= 1 else v * F.lit(round(1 / step))
        off = off | (here & (F.abs(units - F.round(units)) > 1e-4))
        mask = F.when(here, number_mask(v, step)).otherwise(mask)
    none = F.lit(0).cast("long")
    counted = counted.withColumns({"mask": F.coalesce(mask, F.lit("<null>")), "off_": off, "outside_": outside})
    return checkpointed(counted.groupBy("load_id", "field_id", "mask").agg(
        F.sum("n").alias("n"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.sum(F.when(F.col("outside_"), n).otherwise(none)).alias("n_outside"),
        F.sum(F.when(F.col("off_"), n).otherwise(none)).alias("n_off_step"),
        F.sum("n_true").alias("n_true"),
        F.sum("n_false").alias("n_false"),
        F.sum(F.when(v.between(0, 2000), v * n)).alias("sum_inside"),
        F.sum(F.when(v.between(0, 2000), n)).alias("n_inside"),
    ))


def mined(state: DataFrame) -> DataFrame:
    """``state`` with ``rare``: whether a mask is no dominant pattern of its column. One that breaks the field's step itself is none."""
    broken = state.where("n_off_step > 0").select("field_id", "mask").distinct()
    common = dominant_masks(state, "load_id", ["field_id"]).join(broken, ["field_id", "mask"], "left_anti").withColumn("common_", F.lit(True))
    return state.join(F.broadcast(common), ["field_id", "mask"], "left").withColumn("rare", F.col("common_").isNull() & (F.col("mask") != "<null>")).drop("common_")  # at most 50 masks a field hold 2 % each


def profile_loads(quotes: DataFrame, risks: DataFrame, *, bounds: dict[str, tuple[float, float, float]] = BOUNDS, state: DataFrame | None = None) -> DataFrame:
    """One row per load and field: counts, null share, distinct values, range and pattern violations, and level.

    Fields: ``quoted``, ``premium`` (by load of quotes), ``voluntary_excess`` (by load of risks). NaN counts as
    null. Pattern violations are values of rare masks (a premium's decimals, an excess's last digits) that an exact
    check confirms. Empty tables give no rows; repeated rows count as often as they stand.
    """
    state = mask_state(quotes, risks, bounds) if state is None else state
    none = F.lit(0).cast("long")
    whole = mined(state).groupBy("load_id", "field_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("mask") == "<null>", F.col("n")).otherwise(none)).alias("n_null"),
        F.sum("n_distinct").alias("n_distinct"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sum("n_outside").alias("n_outside"),
        F.sum(F.when(F.col("rare"), F.col("n_off_step")).otherwise(none)).alias("n_pattern"),
        *[F.sum(c).alias(c) for c in ("n_true", "n_false", "sum_inside", "n_inside")],
    )
    medians = exact_medians(quotes.where("quoted and premium > 0 and not isnan(premium)"), ["load_id"], "premium")
    whole = whole.join(medians, "load_id", "left")
    level = F.when(F.col("field_id") == "premium", F.col("median")).otherwise(F.col("sum_inside") / F.col("n_inside"))
    known = F.col("n_true") + F.col("n_false")
    flagged = F.struct(
        F.lit("quoted").alias("field_id"), (F.col("n_rows") - known).alias("n_null"),
        (F.when(F.col("n_true") > 0, 1).otherwise(0) + F.when(F.col("n_false") > 0, 1).otherwise(0)).cast("long").alias("n_distinct"),
        F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"), none.alias("n_outside"), none.alias("n_pattern"),
        F.when(known > 0, F.col("n_true") / known).alias("level"),
    )
    own = F.struct("field_id", "n_null", "n_distinct", "least", "most", "n_outside", "n_pattern", level.alias("level"))
    rows = F.when(F.col("field_id") == "premium", F.array(own, flagged)).otherwise(F.array(own))
    out = whole.select("load_id", "n_rows", F.explode(rows).alias("p")).select("load_id", "n_rows", "p.*")
    return out.withColumn("null_share", F.col("n_null") / F.col("n_rows"))


def load_issues(profiles: DataFrame, loads: DataFrame) -> DataFrame:
    """(load_id, field_id, issue_code): what is out of bounds in a load, or has changed since the load before it.

    A load without a predecessor, or whose predecessor holds no rows, is judged alone. A level that is null on
    either side, or an earlier one of zero, gives no distribution issue; an earlier distinct count of zero is
    left only by one of zero.
    """
    profiles = checkpointed(profiles)  # a row a load and field; read twice below
    before = profiles.select(F.col("load_id").alias("prior_load_id"), "field_id", F.col("null_share").alias("null_before"), F.col("n_distinct").alias("distinct_before"), F.col("level").alias("level_before"))
    links = loads.select("load_id", "prior_load_id").dropDuplicates(["load_id"])
    both = profiles.join(links, "load_id", "left").join(before, ["prior_load_id", "field_id"], "left")
    ratio = F.when(F.col("level_before") != 0, F.col("level") / F.col("level_before"))
    moved = F.when(F.col("field_id") == "quoted", F.abs(F.col("level") - F.col("level_before")) > 0.08).otherwise((ratio > 1.25) | (ratio < 0.8))
    d, db = F.col("n_distinct"), F.col("distinct_before")
    tests = [
        ("value_range", F.col("n_outside") > 0),
        ("pattern", F.col("n_pattern") > 0),
        ("null_rate", F.abs(F.col("null_share") - F.col("null_before")) > 0.15),
        ("distinct_count", (d < 0.6 * db) | (d > 1.7 * db)),
        ("distribution", moved),
    ]
    codes = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests]))
    return both.select("load_id", "field_id", F.explode(codes).alias("issue_code"))


def load_masks(state: DataFrame, loads: DataFrame) -> DataFrame:
    """One row per load and field: rows of rare masks, the commonest rare mask, and the divergence of masks from the load before.

    ``state`` is that of ``mask_state``. The divergence is null for a load without a predecessor.
    """
    masks = mined(state).select("load_id", "field_id", "mask", "n", "rare")
    every = masks.groupBy("load_id", "field_id").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("rare"), F.col("n")).otherwise(F.lit(0))).alias("n_rare"), F.max_by("mask", F.when(F.col("rare"), F.struct("n", "mask"))).alias("rare_mask"))
    links = loads.select("load_id", "prior_load_id").dropDuplicates(["load_id"]).where("prior_load_id is not null")
    plain = state.select("load_id", "field_id", "mask", "n")
    before = plain.withColumnRenamed("load_id", "prior_load_id").join(links, "prior_load_id").select("load_id", "field_id", "mask", "n")
    now = plain.join(before.select("load_id", "field_id").distinct(), ["load_id", "field_id"], "left_semi")
    divergence = mask_divergence(now, before.join(plain.select("load_id", "field_id").distinct(), ["load_id", "field_id"], "left_semi"), ["load_id", "field_id"])
    return every.join(divergence, ["load_id", "field_id"], "left")
