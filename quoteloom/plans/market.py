"""Queries of the observed market over the quotes table, by month, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import market
from quoteloom.session import table

K = 5


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quotes")


def _market(spark: SparkSession, d: str, **kw) -> DataFrame:
    return market.observed_market(_quotes(spark, d), k=K, period="month", **kw)


def rounded(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    """Means rounded, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def observed_market(spark, d):
    return rounded(_market(spark, d), "top5_mean")


def observed_market_by_channel(spark, d):
    return rounded(_market(spark, d, by_channel=True), "top5_mean")


_PERIOD_MEANS = ["n_quoting_mean", "cheapest_mean", "top5_mean", "spread_abs_mean", "index_100", "wow_pct"]


def market_by_period(spark, d):
    return rounded(market.market_by_period(_market(spark, d), k=K), *_PERIOD_MEANS)


def market_by_period_channel(spark, d):
    return rounded(market.market_by_period(_market(spark, d, by_channel=True), k=K, by_channel=True), *_PERIOD_MEANS)


def market_index_basket(spark, d):
    """The index over the declared basket of risks."""
    basket = table(spark, d, "risks").where("in_basket").select("risk_id")
    return rounded(market.market_by_period(_market(spark, d), k=K, basket=basket).select("period", "n_risks", "top5_mean", "index_100", "wow_pct"), "top5_mean", "index_100", "wow_pct")


def brand_competitiveness(spark, d):
    """The brands that win most first, then those most often among the cheapest, then by median rank."""
    out = rounded(market.brand_competitiveness(_quotes(spark, d), k=K, period="month"), "quote_rate_pct", "cheapest_share_pct", "top5_share_pct", "gap_to_top5_pct")
    return out.orderBy(F.col("cheapest_share_pct").desc(), F.col("top5_share_pct").desc(), F.col("median_rank").asc_nulls_last(), "brand")


def channel_gap(spark, d):
    return market.channel_gap(_quotes(spark, d), period="month")


def spread_summary(spark, d):
    return rounded(market.spread_summary(_market(spark, d), k=K), "cheapest_mean", "top5_mean", "n_quoting_mean")


def common_risks(spark, d):
    """Risks seen in every quarter of a year's worth of months: here by month over the whole table."""
    return market.common_risks(market.prepared(_quotes(spark, d), "month"))


def winner_shares(spark, d):
    return rounded(market.winner_shares(_market(spark, d)), "share", places=8)


def _predictions(spark, d) -> DataFrame:
    """Prices as predictions, with each brand's rate of quoting as its probability."""
    q = market.prepared(_quotes(spark, d), "month")
    rate = q.groupBy("brand").agg((F.count_if("quoted") / F.count("*")).alias("p_quote"))
    return q.where("premium is not null").join(F.broadcast(rate), "brand")  # a row a brand


def top_k_table(spark, d):
    return rounded(market.top_k_table(_predictions(spark, d), k=K), "p_quote", "expected_rank_score", places=8)


def simulate_market(spark, d):
    out = market.simulate_market(_predictions(spark, d), k=K, n_sims=20)
    return rounded(out, "top5_mean", "top5_p10", "top5_p90", "cheapest_mean", "n_quoting_mean")


def simulate_market_400(spark, d):
    """The simulation with the operator's own 400 draws; ``simulate_market`` has the 20 that its SQL can follow on whole tables."""
    out = market.simulate_market(_predictions(spark, d), k=K)
    return rounded(out, "top5_mean", "top5_p10", "top5_p90", "cheapest_mean", "n_quoting_mean")


def expected_cheapest(spark, d):
    return rounded(market.expected_cheapest(_predictions(spark, d)), "cheapest_mean", "n_quoting_mean")


QUERIES = {f.__name__: f for f in (observed_market, observed_market_by_channel, market_by_period, market_by_period_channel, market_index_basket, brand_competitiveness, channel_gap, spread_summary, common_risks, winner_shares, top_k_table, simulate_market, simulate_market_400, expected_cheapest)}

_PREP = """prep AS (
  SELECT risk_id, brand, coalesce(channel, 'unknown') AS channel, CAST(date_trunc('month', collected_on) AS DATE) AS period, coalesce(quoted, FALSE) AS quoted,
         CASE WHEN quoted AND NOT isnan(premium) THEN premium END AS premium
  FROM quotes WHERE brand IS NOT NULL AND collected_on IS NOT NULL AND risk_id IS NOT NULL)"""


def _market_sql(by_channel: bool) -> str:
    g = "risk_id, period, channel" if by_channel else "risk_id, period"
    offers = "SELECT risk_id, period, channel, brand, premium FROM prep WHERE premium IS NOT NULL" if by_channel else "SELECT risk_id, period, brand, min(premium) AS premium, arg_min(channel, (premium, channel)) AS channel FROM prep WHERE premium IS NOT NULL GROUP BY risk_id, period, brand"
    return f"""{_PREP},
asked AS (SELECT {g}, brand, bool_or(quoted) AS quoted FROM prep GROUP BY {g}, brand),
counts AS (SELECT {g}, count(*) AS n_on_panel, count(*) FILTER (WHERE quoted) AS n_quoting FROM asked GROUP BY {g}),
offers AS ({offers}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY premium, brand, channel) AS place FROM offers),
priced AS (
  SELECT {g}, max(brand) FILTER (WHERE place = 1) AS cheapest_brand, min(premium) AS cheapest_price, max(p.channel) FILTER (WHERE place = 1) AS cheapest_channel_,
         avg(premium) FILTER (WHERE place <= 5) AS top5_mean, median(premium) FILTER (WHERE place <= 5) AS top5_median, max(premium) FILTER (WHERE place <= 5) AS top5_kth,
         count(*) >= 5 AS top5_complete, string_agg(brand, '|' ORDER BY place) FILTER (WHERE place <= 5) AS top5_brands, median(premium) AS panel_median, max(premium) AS panel_max
  FROM placed p GROUP BY {g}),
market AS (
  SELECT {", ".join("c." + x for x in g.split(", "))}, n_on_panel, n_quoting, n_on_panel - n_quoting AS n_declined, cheapest_brand, cheapest_price, cheapest_channel_ AS cheapest_channel, top5_mean, top5_median, top5_kth, top5_complete, top5_brands,
         top5_kth - cheapest_price AS spread_abs, CASE WHEN cheapest_price > 0 THEN (top5_kth - cheapest_price) / cheapest_price * 100 END AS spread_pct, panel_median, panel_max,
         CASE WHEN cheapest_price > 0 THEN (panel_max - cheapest_price) / cheapest_price * 100 END AS panel_spread_pct
  FROM counts c LEFT JOIN priced p USING ({g}))"""


def _period_sql(by_channel: bool, basket: str = "") -> str:
    g, part = ("period, channel", "PARTITION BY channel ") if by_channel else ("period", "")
    return f"""WITH {_market_sql(by_channel)},
per AS (
  SELECT {g}, count(*) AS n_risks, avg(n_quoting) AS n_quoting_mean, avg(cheapest_price) AS cheapest_mean, avg(top5_mean) AS top5_mean, median(top5_median) AS top5_median,
         avg(spread_abs) AS spread_abs_mean, median(spread_pct) AS spread_pct_median, median(panel_spread_pct) AS panel_spread_pct_median
  FROM market WHERE cheapest_price IS NOT NULL {basket} GROUP BY {g})
SELECT * REPLACE (round(n_quoting_mean, 8) AS n_quoting_mean, round(cheapest_mean, 8) AS cheapest_mean, round(top5_mean, 8) AS top5_mean, round(spread_abs_mean, 8) AS spread_abs_mean),
       round(top5_mean / first_value(top5_mean) OVER ({part}ORDER BY period) * 100, 8) AS index_100, round((top5_mean / lag(top5_mean) OVER ({part}ORDER BY period) - 1) * 100, 8) AS wow_pct
FROM per"""


_RATED = f"""{_PREP},
rate AS (SELECT brand, count(*) FILTER (WHERE quoted) / count(*) AS p_quote FROM prep GROUP BY brand),
offers AS (SELECT risk_id, period, brand, min(premium) AS premium, arg_min(channel, (premium, channel)) AS channel FROM prep WHERE premium IS NOT NULL GROUP BY ALL),
best AS (SELECT o.*, p_quote FROM offers o JOIN rate USING (brand))"""

SQL: dict[str, str] = {
    "observed_market": f"WITH {_market_sql(False)} SELECT * REPLACE (round(top5_mean, 8) AS top5_mean) FROM market",
    "observed_market_by_channel": f"WITH {_market_sql(True)} SELECT * REPLACE (round(top5_mean, 8) AS top5_mean) FROM market",
    "market_by_period": _period_sql(False),
    "market_by_period_channel": _period_sql(True),
    "market_index_basket": "SELECT period, n_risks, top5_mean, index_100, wow_pct FROM (" + _period_sql(False, "AND risk_id IN (SELECT risk_id FROM risks WHERE in_basket)") + ")",
    "brand_competitiveness": f"""WITH {_PREP},
      asked AS (SELECT risk_id, period, brand, bool_or(quoted) AS quoted, min(premium) AS premium FROM prep GROUP BY ALL),
      ranked AS (SELECT *, CASE WHEN premium IS NOT NULL THEN rank() OVER (PARTITION BY risk_id, period ORDER BY premium NULLS LAST) END AS rank,
                 min(premium) OVER (PARTITION BY risk_id, period) AS best, row_number() OVER (PARTITION BY risk_id, period ORDER BY premium NULLS LAST, brand) AS place FROM asked),
      topped AS (SELECT *, avg(CASE WHEN place <= 5 THEN premium END) OVER (PARTITION BY risk_id, period) AS top_mean FROM ranked)
      SELECT brand, count(*) AS n_asked, count(*) FILTER (WHERE quoted) AS n_quoted, count(*) FILTER (WHERE rank = 1) AS n_cheapest, count(*) FILTER (WHERE rank <= 5) AS n_in_top5,
             median(rank) AS median_rank, median(premium) AS median_premium, median(CASE WHEN best <> 0 THEN (premium / best - 1) * 100 END) AS gap_to_cheapest_pct,
             round(median(CASE WHEN top_mean <> 0 THEN (premium / top_mean - 1) * 100 END), 8) AS gap_to_top5_pct,
             round(count(*) FILTER (WHERE quoted) / count(*) * 100, 8) AS quote_rate_pct, round(count(*) FILTER (WHERE rank = 1) / count(*) * 100, 8) AS cheapest_share_pct, round(count(*) FILTER (WHERE rank <= 5) / count(*) * 100, 8) AS top5_share_pct
      FROM topped GROUP BY brand""",
    "channel_gap": f"""WITH {_PREP},
      pair AS (SELECT risk_id, period, brand, min(premium) FILTER (WHERE channel = 'direct') AS direct, min(premium) FILTER (WHERE channel <> 'direct') AS other FROM prep WHERE premium IS NOT NULL GROUP BY ALL)
      SELECT brand, count(*) AS n_pairs, median(direct) AS direct_median, median(other) AS pcw_median, median(CASE WHEN other <> 0 THEN (direct / other - 1) * 100 END) AS direct_over_pcw_pct
      FROM pair WHERE direct IS NOT NULL AND other IS NOT NULL GROUP BY brand""",
    "spread_summary": f"""WITH {_market_sql(False)}
      SELECT count(*) AS n_risk_periods, count(*) FILTER (WHERE top5_complete) AS n_complete, round(avg(cheapest_price), 8) AS cheapest_mean, median(cheapest_price) AS cheapest_median, round(avg(top5_mean), 8) AS top5_mean,
             median(spread_abs) AS spread_abs_median, quantile_cont(spread_pct, 0.1) AS spread_pct_p10, quantile_cont(spread_pct, 0.5) AS spread_pct_median, quantile_cont(spread_pct, 0.9) AS spread_pct_p90,
             median(panel_spread_pct) AS panel_spread_pct_median, round(avg(n_quoting), 8) AS n_quoting_mean FROM market WHERE cheapest_price IS NOT NULL""",
    "common_risks": f"WITH {_PREP} SELECT risk_id FROM prep GROUP BY risk_id HAVING count(DISTINCT period) = (SELECT count(DISTINCT period) FROM prep)",
    "winner_shares": f"WITH {_market_sql(False)} SELECT cheapest_brand, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM market WHERE cheapest_brand IS NOT NULL GROUP BY cheapest_brand",
    "top_k_table": f"""WITH {_RATED},
      scored AS (SELECT *, premium / greatest(p_quote, 0.01) AS score FROM best)
      SELECT risk_id, period, brand, premium, channel, round(p_quote, 8) AS p_quote, round(score, 8) AS expected_rank_score, place FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY risk_id, period ORDER BY score, brand) AS INTEGER) AS place FROM scored) WHERE place <= 5""",
    "simulate_market": f"""WITH {_RATED},
      drawn AS (SELECT risk_id, period, brand, premium, sim, CAST(('0x' || md5_part) AS UBIGINT) / 281474976710656.0 < p_quote AS live FROM (
        SELECT *, substr(md5('0|' || risk_id || '|' || period || '|' || brand || '|' || sim), 1, 12) AS md5_part FROM best, range(20) AS r(sim))),
      placed AS (SELECT *, row_number() OVER (PARTITION BY risk_id, period, sim ORDER BY premium, brand) AS place FROM drawn WHERE live),
      sims AS (SELECT risk_id, period, sim, count(*) AS n, avg(premium) FILTER (WHERE place <= 5) AS top, min(premium) AS cheapest, max(brand) FILTER (WHERE place = 1) AS winner FROM placed GROUP BY ALL),
      panel AS (SELECT risk_id, period, CAST(count(*) AS INTEGER) AS n_on_panel FROM best GROUP BY ALL),
      wins AS (SELECT risk_id, period, winner, count(*) AS n FROM sims GROUP BY ALL),
      modal AS (SELECT risk_id, period, arg_min(winner, (-n, winner)) AS modal_winner, max(n) / 20 * 100 AS modal_winner_share FROM wins GROUP BY ALL)
      SELECT p.risk_id, p.period, n_on_panel, round(avg(top), 8) AS top5_mean, round(quantile_cont(top, 0.1), 8) AS top5_p10, round(quantile_cont(top, 0.9), 8) AS top5_p90, round(avg(cheapest), 8) AS cheapest_mean,
             round(coalesce(sum(n), 0) / 20, 8) AS n_quoting_mean, any_value(modal_winner) AS modal_winner, coalesce(any_value(modal_winner_share), 0.0) AS modal_winner_share
      FROM panel p LEFT JOIN sims USING (risk_id, period) LEFT JOIN modal USING (risk_id, period) GROUP BY p.risk_id, p.period, n_on_panel""",
    "expected_cheapest": f"""WITH {_RATED},
      firsts AS (SELECT *, p_quote * CASE WHEN coalesce(max(p_quote >= 1) OVER w, FALSE) THEN 0 ELSE exp(coalesce(sum(CASE WHEN p_quote < 1 THEN ln(1 - p_quote) END) OVER w, 0)) END AS p_first
        FROM best WINDOW w AS (PARTITION BY risk_id, period ORDER BY premium, brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT risk_id, period, round(sum(premium * p_first) / nullif(sum(p_first), 0), 8) AS cheapest_mean, round(sum(p_quote), 8) AS n_quoting_mean FROM firsts GROUP BY ALL""",
}
