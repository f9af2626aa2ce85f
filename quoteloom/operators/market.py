"""The observed market: best prices, the cheapest k, spreads, competitiveness, channel gaps and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoteloom.functions.scalars import hash_uniform, nan_to_null, period_start
from quoteloom.operators.profile import exact_medians
from quoteloom.operators.quantiles import median, with_quantiles
from quoteloom.operators.tables import top_per
from quoteloom.session import checkpointed


def prepared(quotes: DataFrame, period: str = "day") -> DataFrame:
    """risk_id, brand, channel, period, quoted, premium; declines carry no price, NaN is null, rows without a date or brand are left out."""
    channel = F.coalesce("channel", F.lit("unknown")) if "channel" in quotes.columns else F.lit("unknown")
    quoted = F.coalesce(F.col("quoted"), F.lit(False))
    return quotes.select("risk_id", "brand", channel.alias("channel"), period_start(F.col("collected_on"), period).alias("period"), quoted.alias("quoted"), F.when(quoted, nan_to_null(F.col("premium").cast("double"))).alias("premium")).where("period is not null and brand is not null and risk_id is not null")


def collapse_to_brand(priced: DataFrame, group: list[str], premium: str = "premium") -> DataFrame:
    """One row per group and brand at its cheapest channel, kept as best_channel; ties go to the first channel by name."""
    return priced.where(F.col(premium).isNotNull()).groupBy(*group, "brand").agg(F.min(F.struct(F.col(premium).alias("p"), F.col("channel").alias("c"))).alias("b")).select(*group, "brand", F.col("b.p").alias(premium), F.col("b.c").alias("best_channel"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _median(a: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(a)
    return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor((n + 2) / 2).cast("int"))) / 2


def _measures(k: int) -> list[Column]:
    """Of a group's ``top`` (sorted structs p, brand, channel; k at most), ``n_priced``, ``panel_median`` and ``panel_max``."""
    best, p = F.col("top")[0]["p"], F.transform("top", lambda s: s["p"])
    kth = F.element_at(p, -1)
    pct = lambda x: F.when(best > 0, (x - best) / best * 100)
    return [
        F.col("top")[0]["brand"].alias("cheapest_brand"), best.alias("cheapest_price"), F.col("top")[0]["channel"].alias("cheapest_channel"),
        _mean(p).alias(f"top{k}_mean"), _median(p).alias(f"top{k}_median"), kth.alias(f"top{k}_kth"), F.when(F.col("n_priced") > 0, F.col("n_priced") >= k).alias(f"top{k}_complete"),
        F.array_join(F.transform("top", lambda s: s["brand"]), "|").alias(f"top{k}_brands"),
        (kth - best).alias("spread_abs"), pct(kth).alias("spread_pct"), "panel_median", "panel_max", pct(F.col("panel_max")).alias("panel_spread_pct"),
    ]


def observed_market(quotes: DataFrame, *, k: int = 5, period: str = "day", by_channel: bool = False, subgroups: int = 16) -> DataFrame:
    """One row per risk and period (and channel): who was asked and quoted, the best price, the k cheapest and the spreads.

    Each brand counts once at its cheapest channel, so a group is at most the registry of brands and is ranked as
    one array. By channel, brands are not collapsed and a group has no bound: the k cheapest come from salted
    subgroups and the median from bucket counts. Groups in which nobody has a price keep their counts, with null
    prices. Ties go by brand, then channel.
    """
    q = prepared(quotes, period)
    group = ["risk_id", "period"] + (["channel"] if by_channel else [])
    if not by_channel:
        cheapest = F.min(F.when(F.col("premium").isNotNull(), F.struct(F.col("premium").alias("p"), F.col("channel").alias("c"))))
        brands = q.groupBy(*group, "brand").agg(F.bool_or("quoted").alias("quoted"), cheapest.alias("b"))
        priced = F.when(F.col("b").isNotNull(), F.struct(F.col("b.p").alias("p"), "brand", F.col("b.c").alias("channel")))
        per = brands.groupBy(*group).agg(F.count("*").alias("n_on_panel"), F.count_if("quoted").alias("n_quoting"), F.sort_array(F.collect_list(priced)).alias("panel"))
        prices = F.transform("panel", lambda s: s["p"])
        per = per.withColumns({"n_priced": F.size("panel"), "panel_median": F.when(F.size("panel") > 0, _median(prices)), "panel_max": F.when(F.size("panel") > 0, F.element_at(prices, -1)), "top": F.when(F.size("panel") > 0, F.slice("panel", 1, k))})
        return per.select(*group, "n_on_panel", "n_quoting", (F.col("n_on_panel") - F.col("n_quoting")).alias("n_declined"), *_measures(k))
    brands = q.groupBy(*group, "brand").agg(F.bool_or("quoted").alias("quoted"))
    counts = brands.groupBy(*group).agg(F.count("*").alias("n_on_panel"), F.count_if("quoted").alias("n_quoting"))
    priced = q.where("premium is not null").select(*group, F.struct(F.col("premium").alias("p"), "brand", "channel").alias("s"), "premium")
    best = top_per(priced, group, ["s"], k, "r", subgroups=subgroups).groupBy(*group).agg(F.sort_array(F.collect_list("s")).alias("top"))
    panel = priced.groupBy(*group).agg(F.count("*").alias("n_priced"), F.max("premium").alias("panel_max"))
    medians = exact_medians(priced, group, "premium").withColumnRenamed("median", "panel_median")
    per = counts.join(best, group, "left").join(panel, group, "left").join(medians, group, "left")
    return per.select(*group, "n_on_panel", "n_quoting", (F.col("n_on_panel") - F.col("n_quoting")).alias("n_declined"), *_measures(k))


def market_by_period(market: DataFrame, *, k: int = 5, basket: DataFrame | None = None, by_channel: bool = False) -> DataFrame:
    """Per period (and channel): risks, means, medians, an index on the first period and the change from the last.

    ``basket`` (risk_id) holds the panel fixed by a semi join; without one the index also measures the mix.
    """
    m = market.where("cheapest_price is not null")
    if basket is not None:
        m = m.join(basket.select("risk_id").distinct(), "risk_id", "left_semi")
    group = ["period"] + (["channel"] if by_channel else [])
    top = f"top{k}_mean"
    m = checkpointed(m.select(*group, "n_quoting", "cheapest_price", top, f"top{k}_median", "spread_abs", "spread_pct", "panel_spread_pct"))  # read twice
    # a risk has one row a period and channel, so rows count risks
    agg = m.groupBy(*group).agg(
        F.count("*").alias("n_risks"), F.avg("n_quoting").alias("n_quoting_mean"), F.avg("cheapest_price").alias("cheapest_mean"), F.avg(top).alias(top), F.avg("spread_abs").alias("spread_abs_mean"),
    )
    agg = with_quantiles(agg, m, group, {f"top{k}_median": median(F.col(f"top{k}_median")), "spread_pct_median": median(F.col("spread_pct")), "panel_spread_pct_median": median(F.col("panel_spread_pct"))}, written=False)
    w = Window.partitionBy(*(["channel"] if by_channel else [F.lit(0)])).orderBy("period")  # a row a period: hundreds
    return agg.withColumns({"index_100": F.col(top) / F.first(top).over(w) * 100, "wow_pct": (F.col(top) / F.lag(top).over(w) - 1) * 100})


def brand_competitiveness(quotes: DataFrame, *, k: int = 5, period: str = "day") -> DataFrame:
    """Per brand: how often it is asked, quotes, wins and makes the k cheapest, and its gaps to both in percent."""
    q = prepared(quotes, period)
    group = ["risk_id", "period"]
    asked = q.groupBy(*group, "brand").agg(F.bool_or("quoted").alias("quoted"), F.min("premium").alias("premium"))
    w = Window.partitionBy(*group)
    ordered = w.orderBy(F.col("premium").asc_nulls_last(), "brand")
    priced = asked.withColumns({"rank": F.when(F.col("premium").isNotNull(), F.rank().over(w.orderBy(F.col("premium").asc_nulls_last()))), "best": F.min("premium").over(w), "place": F.row_number().over(ordered)})
    priced = priced.withColumn("top_mean", F.avg(F.when(F.col("place") <= k, F.col("premium"))).over(w))
    gap = lambda c: F.when(F.col(c) != 0, (F.col("premium") / F.col(c) - 1) * 100)
    priced = checkpointed(priced.select("brand", "quoted", "rank", "premium", gap("best").alias("gap_best"), gap("top_mean").alias("gap_top")))  # read twice
    counts = priced.groupBy("brand").agg(
        F.count("*").alias("n_asked"), F.count_if("quoted").alias("n_quoted"), F.count_if(F.col("rank") == 1).alias("n_cheapest"), F.count_if(F.col("rank") <= k).alias(f"n_in_top{k}"),
    )
    medians = {"median_rank": median(F.col("rank")), "median_premium": median(F.col("premium")), "gap_to_cheapest_pct": median(F.col("gap_best")), f"gap_to_top{k}_pct": median(F.col("gap_top"))}
    return with_quantiles(counts, priced, ["brand"], medians, written=False).withColumns({f"{name}_pct": F.col(c) / F.col("n_asked") * 100 for name, c in (("quote_rate", "n_quoted"), ("cheapest_share", "n_cheapest"), (f"top{k}_share", f"n_in_top{k}"))})


def channel_gap(quotes: DataFrame, *, period: str = "day") -> DataFrame:
    """Per brand: direct price against its cheapest other channel on the same risk and period; positive means direct is dearer."""
    q = prepared(quotes, period).where("premium is not null")
    direct = F.col("channel") == "direct"
    pair = q.groupBy("risk_id", "period", "brand").agg(F.min(F.when(direct, F.col("premium"))).alias("direct"), F.min(F.when(~direct, F.col("premium"))).alias("other"))
    pair = pair.where("direct is not null and other is not null").withColumn("gap", F.when(F.col("other") != 0, (F.col("direct") / F.col("other") - 1) * 100))
    pair = checkpointed(pair.select("brand", "direct", "other", "gap"))  # read twice
    return with_quantiles(pair.groupBy("brand").agg(F.count("*").alias("n_pairs")), pair, ["brand"], {"direct_median": median(F.col("direct")), "pcw_median": median(F.col("other")), "direct_over_pcw_pct": median(F.col("gap"))}, written=False)


def spread_summary(market: DataFrame, *, k: int = 5) -> DataFrame:
    """One row: how many risk-periods, and the distribution of prices and spreads. An empty market gives counts of zero."""
    m = checkpointed(market.where("cheapest_price is not null").select("cheapest_price", f"top{k}_mean", f"top{k}_complete", "spread_abs", "spread_pct", "panel_spread_pct", "n_quoting"))  # read twice
    one = m.agg(F.count("*").alias("n_risk_periods"), F.count_if(f"top{k}_complete").alias("n_complete"), F.avg("cheapest_price").alias("cheapest_mean"), F.avg(f"top{k}_mean").alias(f"top{k}_mean"), F.avg("n_quoting").alias("n_quoting_mean"))
    spread = F.col("spread_pct")
    wanted = {"cheapest_median": median(F.col("cheapest_price")), "spread_abs_median": median(F.col("spread_abs")), "spread_pct_p10": (spread, 0.1), "spread_pct_median": (spread, 0.5), "spread_pct_p90": (spread, 0.9), "panel_spread_pct_median": median(F.col("panel_spread_pct"))}
    return with_quantiles(one, m, [], wanted, written=False)


def common_risks(market: DataFrame, period: str = "period") -> DataFrame:
    """(risk_id): risks with a row in every period, by relational division."""
    seen = market.select("risk_id", period).distinct()
    total = seen.agg(F.count_distinct(period).alias("n_all"))
    return seen.groupBy("risk_id").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") == F.col("n_all")).select("risk_id")  # one row


def winner_shares(market: DataFrame) -> DataFrame:
    """Per brand: the share of priced risk-periods in which it is cheapest."""
    won = market.where("cheapest_brand is not null").groupBy("cheapest_brand").agg(F.count("*").alias("n"))
    return won.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a brand


def top_k_table(predictions: DataFrame, *, k: int = 5, group: tuple[str, ...] = ("risk_id", "period")) -> DataFrame:
    """The k best offers of every group by price over quote probability (0.01 at least), each brand once."""
    g = [*group]
    best = predictions.groupBy(*g, "brand").agg(F.min(F.struct("premium", "channel", "p_quote")).alias("b")).select(*g, "brand", "b.*")
    scored = best.withColumn("expected_rank_score", F.col("premium") / F.greatest("p_quote", F.lit(0.01)))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*g).orderBy("expected_rank_score", "brand"))).where(F.col("place") <= k)


def simulate_market(predictions: DataFrame, *, k: int = 5, n_sims: int = 400, seed: int = 0, group: tuple[str, ...] = ("risk_id", "period")) -> DataFrame:
    """Draws which brands quote, ``n_sims`` times a group, and sums up the market price.

    ``predictions``: group, brand, channel, premium, p_quote. Each brand stands at its cheapest channel. Draws are
    hashes of (seed, group, brand, draw), so neither partitions nor retries change them. Draws in which nobody
    quotes have no price and count as zero quoting. A group is at most the registry of brands.
    """
    g = [*group]
    best = predictions.groupBy(*g, "brand").agg(F.min(F.struct("premium", "channel", "p_quote")).alias("b")).select(*g, "brand", "b.premium", "b.p_quote")
    panel = best.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("premium", "brand", "p_quote"))).alias("panel"))
    live = lambda sim: F.filter("panel", lambda s: hash_uniform(F.lit(seed), *[F.col(c) for c in g], s["brand"], sim) < s["p_quote"])
    # all draws of a group stay in its row: no copy of the panel a draw, and no further shuffle
    drawn = panel.select(*g, F.size("panel").alias("n_on_panel"), F.transform(F.transform(F.sequence(F.lit(0), F.lit(n_sims - 1)), live), lambda a: F.struct(
        F.size(a).alias("n"), F.when(F.size(a) > 0, _mean(F.transform(F.slice(a, 1, k), lambda s: s["premium"]))).alias("top"), F.try_element_at(a, F.lit(1))["premium"].alias("cheapest"), F.try_element_at(a, F.lit(1))["brand"].alias("winner"),
    )).alias("draws"))
    some = F.filter("draws", lambda x: x["n"] > 0)
    drawn = drawn.select(*g, "n_on_panel", F.sort_array(F.transform(some, lambda x: x["top"])).alias("tops"), F.transform(some, lambda x: x["cheapest"]).alias("firsts"), F.transform(some, lambda x: x["winner"]).alias("winners"), F.aggregate("draws", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("quoting"))

    def at(p: float) -> Column:
        place = F.lit(p) * (F.size("tops") - 1)
        low, high = F.element_at("tops", F.floor(place).cast("int") + 1), F.element_at("tops", F.ceil(place).cast("int") + 1)
        return F.when(F.size("tops") > 0, low + (place - F.floor(place)) * (high - low))

    modal = F.array_min(F.transform(F.array_distinct("winners"), lambda w: F.struct((-F.size(F.filter("winners", lambda x: x == w))).alias("n"), w.alias("winner"))))
    mean = lambda c: F.when(F.size(c) > 0, _mean(F.col(c)))
    out = drawn.select(*g, "n_on_panel", mean("tops").alias(f"top{k}_mean"), at(0.1).alias(f"top{k}_p10"), at(0.9).alias(f"top{k}_p90"), mean("firsts").alias("cheapest_mean"), (F.col("quoting") / n_sims).alias("n_quoting_mean"), modal.alias("m"))
    return out.select(*[c for c in out.columns if c != "m"], F.col("m.winner").alias("modal_winner"), F.coalesce(-F.col("m.n") / n_sims * 100, F.lit(0.0)).alias("modal_winner_share"))


def expected_cheapest(predictions: DataFrame, *, group: tuple[str, ...] = ("risk_id", "period")) -> DataFrame:
    """The closed form of the simulation's cheapest price: expectation given that somebody quotes, and expected quoting."""
    g = [*group]
    best = predictions.groupBy(*g, "brand").agg(F.min(F.struct("premium", "channel", "p_quote")).alias("b")).select(*g, "brand", "b.premium", "b.p_quote")
    before = Window.partitionBy(*g).orderBy("premium", "brand").rowsBetween(Window.unboundedPreceding, -1)
    none = F.when(F.coalesce(F.max(F.col("p_quote") >= 1).over(before), F.lit(False)), 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("p_quote") < 1, F.log1p(-F.col("p_quote")))).over(before), F.lit(0.0))))
    first = best.withColumn("p_first", F.col("p_quote") * none)
    return first.groupBy(*g).agg((F.sum(F.col("premium") * F.col("p_first")) / F.nullif(F.sum("p_first"), F.lit(0.0))).alias("cheapest_mean"), F.sum("p_quote").alias("n_quoting_mean"))
