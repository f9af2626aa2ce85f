"""Queries of place features, model matrices, splits, level models, metrics and drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions.scalars import postcode_parts, scotland_or_ni
from quoteloom.operators import geo
from quoteloom.operators import modelling as M
from quoteloom.operators.tables import first_per, percentile_rank
from quoteloom.plans.market import rounded
from quoteloom.session import checkpointed, table

HOLD = 8
RISK = ["risk_id", "load_id", "risk_row_id", "postcode", "policy_type", "building_type", "occupancy", "construction", "year_built", "bedrooms", "buildings_sum_insured", "contents_sum_insured", "voluntary_excess", "claims_last_5y", "flood_history", "subsidence_history"]


def postcode_fields(spark, d):
    """Postcodes taken apart."""
    p = postcode_parts(F.col("postcode"))
    return table(spark, d, "risks").select("risk_row_id", *[v.alias(k) for k, v in p.items()], scotland_or_ni(p["area"]).alias("beyond_england"))


def _sums(spark, d) -> DataFrame:
    """Sums insured stand in for sales: postcode, price, date."""
    return table(spark, d, "risks").select("postcode", F.col("buildings_sum_insured").alias("price"), F.make_date("year_built", F.lit(1), F.lit(1)).alias("date"))


def sector_values(spark, d):
    return geo.sector_values(_sums(spark, d), min_sales=2, since_year=1900)


def outcode_rank(spark, d):
    """Percentile rank of the risks counted by outcode, ties at their mean."""
    outcode = postcode_parts(F.col("postcode"))["outcode"].alias("outcode")
    counts = table(spark, d, "risks").select(outcode).where("outcode is not null").groupBy("outcode").agg(F.count("*").alias("n"))
    return percentile_rank(counts, "n").withColumn("pct_rank", F.round("pct_rank", 8))


def area_bridge(spark, d):
    """One area a postcode: the policy type stands in for the area code."""
    return geo.area_bridge(table(spark, d, "risks").select("postcode", F.col("policy_type").alias("lsoa")))


def enriched_coverage(spark, d):
    risks = geo.with_postcode_parts(table(spark, d, "risks").select("risk_row_id", "postcode"))
    index = geo.crime_index(table(spark, d, "risks").select(F.col("policy_type").alias("lsoa")))
    enriched = geo.enrich(risks, [("lsoa", index), ("sector", geo.sector_values(_sums(spark, d), min_sales=2)), ("postcode", area_bridge(spark, d))])
    return rounded(geo.resolved_coverage(enriched), "resolved_pct")


def _matrix(spark, d) -> DataFrame:
    risks = first_per(table(spark, d, "risks").select(*RISK), ["risk_id"], ["load_id", "risk_row_id"]).drop("load_id", "risk_row_id")
    quotes = table(spark, d, "quotes").select("quote_id", "risk_id", "brand", "channel", "collected_on", "quoted", "premium").where("brand is not null")
    return M.model_matrix(quotes, risks)


def model_matrix(spark, d):
    return rounded(_matrix(spark, d).select("quote_id", "week", "log_premium", "log_sum_insured", "log_excess", "property_age"), "log_premium", "log_sum_insured", "log_excess")


def one_hot_occupancy(spark, d):
    levels = ["owner_occupied", "let", "second_home", "unoccupied"]
    return M.one_hot(table(spark, d, "risks").select("risk_row_id", "occupancy"), "occupancy", levels).drop("occupancy")


def adequacy(spark, d):
    """What can be held out: distinct values by column, nulls counting as one."""
    m = _matrix(spark, d)
    cols = ["week", "brand", "channel", "risk_id", "building_type", "occupancy", "bedrooms", "voluntary_excess"]
    n = lambda c: (F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("<null>")))).alias(f"n_{c}")
    return m.agg(F.count("*").alias("n_rows"), *[n(c) for c in cols])


def temporal_split(spark, d):
    return M.temporal_split(_matrix(spark, d), holdout_weeks=HOLD).groupBy("split", "week").agg(F.count("*").alias("n"))


def spatial_split(spark, d):
    risks = table(spark, d, "risks").select("risk_row_id", postcode_parts(F.col("postcode"))["outcode"].alias("outcode"))
    return M.spatial_split(risks, holdout_frac=0.2).groupBy("outcode", "split").agg(F.count("*").alias("n"))


def rolling_origins(spark, d):
    """Rows to train on and to judge by at each origin of a rolling window of ten weeks."""
    per = _matrix(spark, d).groupBy("week").agg(F.count("*").alias("n"))
    weeks = [r.week for r in per.select("week").orderBy("week").collect()]  # a row a week
    spans = spark.createDataFrame([(ahead, w) for past, ahead in M.rolling_windows(weeks, window=10) for w in past], "origin int, week int")
    now = per.select(F.col("week").alias("origin"), F.col("n").alias("n_judged"))
    return spans.join(per, "week").groupBy("origin").agg(F.sum("n").alias("n_trained")).join(now, "origin")


def _scored(spark, d, names=("global_geomean", "brand_geomean", "brand_last_level")) -> DataFrame:
    return M.compare(_matrix(spark, d), list(names), holdout_weeks=HOLD)[0]


def approach_metrics(spark, d):
    return rounded(M.premium_metrics(_scored(spark, d), ["approach"]), "mdape", "mape", "rmsle", "bias", "within_10pct", places=6)


def brand_metrics(spark, d):
    return rounded(M.premium_metrics(_scored(spark, d, ["brand_last_level"]), ["brand"]), "mdape", "mape", "rmsle", "bias", "within_10pct", places=6)


def rolling_metrics(spark, d):
    return rounded(M.rolling_metrics(_scored(spark, d)), "mape", "mdape", "bias", "mean_pe", "sd_pe", "var_pe", "within_5", "within_10", "within_20", "mae_gbp", places=5)


def top_k_metrics(spark, d):
    return rounded(M.top_k_metrics(_scored(spark, d, ["brand_last_level"])), "cheapest_hit", "top5_overlap", "top5_price_err", places=6)


def residual_profile(spark, d):
    m = _matrix(spark, d)
    return rounded(M.residual_profile(M.level_model(m, m, ["brand"]).withColumn("y_true", F.col("log_premium")), holdout_weeks=HOLD), "resid_pct", places=6)


def _levels(spark, d) -> DataFrame:
    m = _matrix(spark, d)
    resid = M.level_model(m, m, ["channel"]).select("brand", "week", (F.col("log_premium") - F.col("y_pred")).alias("resid"), F.lit(1.0).alias("weight"))
    return M.brand_levels(resid)


def brand_levels(spark, d):
    return rounded(_levels(spark, d), "level")


def level_trend(spark, d):
    return rounded(M.trend(_levels(spark, d)), "slope", "credibility", "used_slope", "anchor", places=7)


def forward_levels(spark, d):
    """What each brand's level is taken to be in the thirteen weeks past the last."""
    levels = checkpointed(_levels(spark, d))
    last = levels.agg(F.max("week")).first()[0]
    trends = M.trend(levels, trend_weight=M.trend_weight(levels))
    ahead = levels.select("brand").distinct().withColumn("week", F.explode(F.sequence(F.lit(last + 1), F.lit(last + 20))))
    return M.forward_delta(trends, ahead, last).join(trends.select("brand", "anchor"), "brand")


def rank_correlation(spark, d):
    return rounded(M.spearman(_scored(spark, d, ["brand_last_level"]), "y_true", "y_pred"), "spearman", places=7)


def quote_rate_model(spark, d):
    """Each brand's probability of quoting."""
    q = table(spark, d, "quotes").where("brand is not null")
    return rounded(M.quote_rates(q, table(spark, d, "providers").select("brand")), "p_quote")


def ridge_metrics(spark, d):
    """The ridge models, pooled and by brand, on the weeks held out."""
    return M.premium_metrics(_scored(spark, d, ["ridge_log", "ridge_per_brand"]), ["approach"])


def drift_residuals(spark, d):
    """Out-of-fold residuals as levels by brand and week."""
    m = _matrix(spark, d)
    resid = M.out_of_fold(m, M.RIDGE_FEATURES, categories=M.RIDGE_CATEGORIES, group="brand").select("brand", "week", "resid", F.lit(1.0).alias("weight"))
    return M.trend(M.brand_levels(resid))


def _regimes(spark, d) -> DataFrame:
    return M.premium_metrics(M.rolling_comparison(_matrix(spark, d), holdout_weeks=HOLD), ["approach", "regime", "week"])


def rolling_comparison(spark, d):
    """Errors week by week of one fit, blind and refreshed by each week once it is over."""
    return rounded(_regimes(spark, d), "mdape", "mape", "rmsle", "bias", "within_10pct", places=6)


def first_week_check(spark, d):
    """Both regimes score the first held-out week alike."""
    return rounded(M.first_week_identical(_regimes(spark, d)), "spread", places=6)


def additivity_gap(spark, d):
    """What the brand's mean costs against its last level, on the weeks held out."""
    board = M.leaderboard(_scored(spark, d).withColumn("split", F.lit("temporal")), ["split", "approach"])
    return M.additivity_gap(board, "brand_geomean", "brand_last_level")


def worst_brands(spark, d):
    """The three brands that are predicted worst."""
    m = M.premium_metrics(_scored(spark, d, ["brand_last_level"]), ["brand"])
    return rounded(m.orderBy(F.col("mape").desc(), "brand").limit(3).select("brand", "n", "mape"), "mape", places=6)


def drift_report(spark, d):
    return rounded(M.drift_report(M.trend(_levels(spark, d))), "weekly_pct", "annual_pct", places=6)


def levels_at(spark, d):
    """Levels asked for before, within and past the weeks observed; a brand nobody knows has the market's."""
    levels = checkpointed(_levels(spark, d))
    asked = levels.select("brand").distinct().unionByName(spark.createDataFrame([("nobody",)], "brand string")).withColumn("week", F.explode(F.sequence(F.lit(-5), F.lit(140), F.lit(5))))
    return rounded(M.level_at(levels, M.trend(levels), asked), "level", places=7)


def trend_adjusted_metrics(spark, d):
    """The trend over brand means: blind on the weeks held out, and the last of them after the others have come in."""
    m = M.temporal_split(_matrix(spark, d), holdout_weeks=HOLD)
    train, hold = checkpointed(m.where("split = 'train'").drop("split")), checkpointed(m.where("split = 'holdout'").drop("split"))
    model = M.TrendAdjusted(M.APPROACHES["brand_geomean"][1]).fit(train)
    score = lambda rows, regime: model.predict(rows).select("week", F.col("log_premium").alias("y_true"), "y_pred", F.lit(regime).alias("regime"))
    out = checkpointed(score(hold, "blind"))
    for (week,) in sorted(hold.select("week").distinct().collect()):  # the weeks held out
        out = out.unionByName(score(hold.where(F.col("week") == week), "rolling"))
        model.recalibrate(hold.where(F.col("week") == week))
    return M.premium_metrics(out, ["regime", "week"])


QUERIES = {f.__name__: f for f in (rolling_comparison, first_week_check, additivity_gap, worst_brands, drift_report, levels_at, trend_adjusted_metrics, postcode_fields, sector_values, outcode_rank, area_bridge, enriched_coverage, model_matrix, one_hot_occupancy, adequacy, temporal_split, spatial_split, rolling_origins, approach_metrics, brand_metrics, rolling_metrics, top_k_metrics, residual_profile, brand_levels, level_trend, forward_levels, rank_correlation, quote_rate_model, ridge_metrics, drift_residuals)}

_PC = r"^([A-PR-UWYZ][A-HK-Y]?)([0-9][0-9]?|[0-9][A-HJKPS-UW])([0-9])([ABD-HJLNP-UW-Z]{2})$"
_PARTS = f"""parts AS (
  SELECT *, CASE WHEN t = 'GIR0AA' THEN 'GIR 0AA' WHEN ok THEN a || b || ' ' || c || e END AS pc, CASE WHEN t = 'GIR0AA' THEN 'GIR' WHEN ok THEN a END AS area_, CASE WHEN t = 'GIR0AA' THEN '' WHEN ok THEN b END AS district_,
         CASE WHEN t = 'GIR0AA' THEN 'GIR' WHEN ok THEN a || b END AS outcode_, CASE WHEN t = 'GIR0AA' THEN 'GIR 0' WHEN ok THEN a || b || ' ' || c END AS sector_, CASE WHEN t = 'GIR0AA' THEN '0AA' WHEN ok THEN c || e END AS incode_, CASE WHEN t = 'GIR0AA' THEN 'AA' WHEN ok THEN e END AS unit_
  FROM (SELECT *, regexp_matches(t, '{_PC}') AS ok, regexp_extract(t, '{_PC}', 1) AS a, regexp_extract(t, '{_PC}', 2) AS b, regexp_extract(t, '{_PC}', 3) AS c, regexp_extract(t, '{_PC}', 4) AS e
        FROM (SELECT *, regexp_replace(upper(postcode), '[^A-Z0-9]', '', 'g') AS t FROM risks)))"""
_SECTORS = "SELECT sector_ AS sector, median(buildings_sum_insured) AS area_avg_value FROM parts WHERE buildings_sum_insured BETWEEN 10000 AND 20000000 AND sector_ IS NOT NULL {} GROUP BY sector_ HAVING count(*) >= 2"
_MATRIX = f"""r AS (SELECT * FROM risks QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY load_id, risk_row_id) = 1),
q AS (SELECT quote_id, risk_id, brand, channel, collected_on, quoted, CASE WHEN NOT isnan(premium) THEN premium END AS premium, CAST(floor((collected_on - (SELECT min(collected_on) FROM quotes WHERE brand IS NOT NULL)) / 7) AS INTEGER) AS week FROM quotes WHERE brand IS NOT NULL),
m AS (SELECT q.*, ln(premium) AS log_premium, r.* EXCLUDE (risk_id, load_id), ln(greatest(coalesce(buildings_sum_insured, 0) + 1.4 * coalesce(contents_sum_insured, 0), 10000) / 250000) AS log_sum_insured,
             ln(1 + CASE WHEN voluntary_excess >= 0 THEN voluntary_excess END / 250) AS log_excess, greatest(2026 - year_built, 0) AS property_age
      FROM q LEFT JOIN r USING (risk_id) WHERE quoted AND premium > 0),
cut AS (SELECT min(week) AS c FROM (SELECT DISTINCT week FROM m ORDER BY week DESC LIMIT {HOLD})),
train AS (SELECT * FROM m WHERE week < (SELECT c FROM cut)), hold AS (SELECT * FROM m WHERE week >= (SELECT c FROM cut))"""
_SCORED = f"""{_MATRIX},
lastw AS (SELECT * FROM train WHERE week = (SELECT max(week) FROM train)),
bc AS (SELECT brand, channel, median(log_premium) AS v FROM lastw GROUP BY ALL), bb AS (SELECT brand, median(log_premium) AS v FROM lastw GROUP BY ALL),
bm AS (SELECT brand, avg(log_premium) AS v FROM train GROUP BY brand),
scored AS (
  SELECT 'global_geomean' AS approach, risk_id, brand, channel, week, log_premium AS y_true, (SELECT avg(log_premium) FROM train) AS y_pred FROM hold
  UNION ALL SELECT 'brand_geomean', risk_id, brand, channel, week, log_premium, coalesce(bm.v, (SELECT avg(log_premium) FROM train)) FROM hold LEFT JOIN bm USING (brand)
  UNION ALL SELECT 'brand_last_level', risk_id, brand, channel, week, log_premium, coalesce(bc.v, bb.v, (SELECT median(log_premium) FROM lastw)) FROM hold LEFT JOIN bc USING (brand, channel) LEFT JOIN bb USING (brand))"""
_METRICS = """count(*) AS n, round(median(abs(exp(y_pred - y_true) - 1)) * 100, 6) AS mdape, round(avg(abs(exp(y_pred - y_true) - 1)) * 100, 6) AS mape, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmsle,
  round(median(exp(y_pred - y_true) - 1) * 100, 6) AS bias, round(avg(CAST(abs(exp(y_pred - y_true) - 1) <= 0.1 AS INTEGER)) * 100, 6) AS within_10pct"""
_LEVELS = f"""{_MATRIX},
cm AS (SELECT channel, avg(log_premium) AS v FROM m GROUP BY channel),
e AS (SELECT brand, week, log_premium - v AS e0 FROM m JOIN cm USING (channel)),
z AS (SELECT brand, week, e0 - avg(e0) OVER (PARTITION BY brand) AS e FROM e),
levels AS (SELECT brand, week, avg(e) AS level, CAST(count(*) AS DOUBLE) AS weight FROM z GROUP BY ALL UNION ALL SELECT 'MARKET', week, avg(e), CAST(count(*) AS DOUBLE) FROM z GROUP BY week)"""

_ROLLED = f"""{_SCORED},
wk AS (SELECT brand, channel, week, median(log_premium) AS v FROM (SELECT brand, channel, week, log_premium FROM lastw UNION ALL SELECT brand, channel, week, log_premium FROM hold) GROUP BY ALL),
fresh AS (SELECT h.risk_id, h.brand, h.channel, h.week, h.log_premium, (SELECT arg_max(w.v, w.week) FROM wk w WHERE w.brand = h.brand AND w.channel = h.channel AND w.week < h.week) AS v FROM hold h),
regimes AS (
  SELECT approach, 'blind' AS regime, week, y_true, y_pred FROM scored WHERE approach <> 'global_geomean'
  UNION ALL SELECT approach, 'rolling', week, y_true, y_pred FROM scored WHERE approach = 'brand_geomean'
  UNION ALL SELECT 'brand_last_level', 'rolling', week, log_premium, coalesce(fresh.v, bb.v, (SELECT median(log_premium) FROM lastw)) FROM fresh LEFT JOIN bb USING (brand))"""
_TRENDS = """s AS (SELECT brand, count(*) AS n_weeks, sum(weight) AS sw, sum(weight * week) AS sx, sum(weight * level) AS sy, sum(weight * week * week) AS sxx, sum(weight * week * level) AS sxy, sum(weight * level) FILTER (WHERE recent) / sum(weight) FILTER (WHERE recent) AS anchor
        FROM (SELECT *, week > max(week) OVER (PARTITION BY brand) - 4 AS recent FROM levels) GROUP BY brand),
      t0 AS (SELECT *, CASE WHEN n_weeks >= 2 AND sxx - sx * sx / sw > 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) ELSE 0 END AS slope, n_weeks / (n_weeks + 4.0) AS credibility FROM s),
      t AS (SELECT *, 0.25 * CASE WHEN brand = 'MARKET' THEN slope ELSE credibility * slope + (1 - credibility) * (SELECT slope FROM t0 WHERE brand = 'MARKET') END AS used_slope FROM t0)"""

SQL: dict[str, str] = {
    "rolling_comparison": f"WITH {_ROLLED} SELECT approach, regime, week, {_METRICS} FROM regimes GROUP BY ALL",
    "first_week_check": f"WITH {_ROLLED}, per AS (SELECT approach, regime, week, avg(abs(exp(y_pred - y_true) - 1)) * 100 AS mape FROM regimes WHERE week = (SELECT min(week) FROM hold) GROUP BY ALL) SELECT approach, week, round(max(mape) - min(mape), 6) AS spread, max(mape) - min(mape) <= 1e-9 AS identical FROM per GROUP BY ALL",
    "additivity_gap": f"WITH {_SCORED}, b AS (SELECT approach, round(median(abs(exp(y_pred - y_true) - 1)) * 100, 2) AS e FROM scored GROUP BY approach), w AS (SELECT max(e) FILTER (WHERE approach = 'brand_geomean') AS a, max(e) FILTER (WHERE approach = 'brand_last_level') AS f FROM b) SELECT 'temporal' AS split, a AS brand_geomean_mdape, f AS brand_last_level_mdape, round(a - f, 2) AS gap_pct_points FROM w",
    "worst_brands": f"WITH {_SCORED} SELECT brand, count(*) AS n, round(avg(abs(exp(y_pred - y_true) - 1)) * 100, 6) AS mape FROM scored WHERE approach = 'brand_last_level' GROUP BY brand ORDER BY avg(abs(exp(y_pred - y_true) - 1)) DESC, brand LIMIT 3",
    "drift_report": f"WITH {_LEVELS}, {_TRENDS} SELECT brand, n_weeks, round((exp(used_slope) - 1) * 100, 6) AS weekly_pct, round((exp(used_slope * 52) - 1) * 100, 6) AS annual_pct FROM t",
    "levels_at": f"""WITH {_LEVELS}, {_TRENDS}, asked AS (SELECT brand, CAST(w AS INTEGER) AS week, CASE WHEN brand = 'nobody' THEN 'MARKET' ELSE brand END AS of_ FROM (SELECT DISTINCT brand FROM levels UNION ALL SELECT 'nobody'), range(-5, 141, 5) AS r(w)),
      ends AS (SELECT brand AS of_, min(week) AS a, max(week) AS z, arg_min(level, week) AS first FROM levels GROUP BY brand)
      SELECT q.brand, q.week, round(CASE WHEN q.week > z THEN anchor + used_slope * least(q.week - z, 13) WHEN q.week < a THEN first - used_slope * least(a - q.week, 13) ELSE coalesce(l.level, sy / sw + slope * (q.week - sx / sw)) END, 7) AS level
      FROM asked q JOIN ends USING (of_) JOIN t ON t.brand = q.of_ LEFT JOIN levels l ON l.brand = q.of_ AND l.week = q.week""",
    "postcode_fields": f"WITH {_PARTS} SELECT risk_row_id, pc AS postcode, area_ AS area, district_ AS district, outcode_ AS outcode, sector_ AS sector, incode_ AS incode, unit_ AS unit, coalesce(ok OR t = 'GIR0AA', FALSE) AS postcode_valid, coalesce(area_ IN ('AB','DD','DG','EH','FK','G','HS','IV','KA','KW','KY','ML','PA','PH','TD','ZE','BT'), FALSE) AS beyond_england FROM parts",
    "sector_values": f"WITH {_PARTS} {_SECTORS.format('AND year_built >= 1900')}",
    "outcode_rank": f"WITH {_PARTS}, n AS (SELECT outcode_ AS outcode, count(*) AS n FROM parts WHERE outcode_ IS NOT NULL GROUP BY outcode_) SELECT outcode, n, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER (), 8) AS pct_rank FROM n",
    "area_bridge": f"WITH {_PARTS} SELECT pc AS postcode, min(policy_type) AS lsoa FROM parts WHERE pc IS NOT NULL GROUP BY pc",
    "enriched_coverage": f"""WITH {_PARTS}, s AS ({_SECTORS.format('')})
      SELECT 'lsoa' AS column, round(avg(CAST(pc IS NOT NULL AS INTEGER)) * 100, 8) AS resolved_pct, count(*) FILTER (WHERE pc IS NULL) AS n_missing FROM parts
      UNION ALL SELECT 'crime_index', round(avg(CAST(pc IS NOT NULL AS INTEGER)) * 100, 8), count(*) FILTER (WHERE pc IS NULL) FROM parts
      UNION ALL SELECT 'area_avg_value', round(avg(CAST(area_avg_value IS NOT NULL AS INTEGER)) * 100, 8), count(*) FILTER (WHERE area_avg_value IS NULL) FROM parts LEFT JOIN s ON s.sector = sector_""",
    "model_matrix": f"WITH {_MATRIX} SELECT quote_id, week, round(log_premium, 8) AS log_premium, round(log_sum_insured, 8) AS log_sum_insured, round(log_excess, 8) AS log_excess, property_age FROM m",
    "one_hot_occupancy": "SELECT risk_row_id, " + ", ".join(f"CAST(coalesce(occupancy = '{v}', FALSE) AS INTEGER) AS occupancy_{v}" for v in ("owner_occupied", "let", "second_home", "unoccupied")) + " FROM risks",
    "adequacy": f"WITH {_MATRIX} SELECT count(*) AS n_rows, " + ", ".join(f"count(DISTINCT coalesce(CAST({c} AS VARCHAR), '<null>')) AS n_{c}" for c in ("week", "brand", "channel", "risk_id", "building_type", "occupancy", "bedrooms", "voluntary_excess")) + " FROM m",
    "temporal_split": f"WITH {_MATRIX} SELECT CASE WHEN week >= c THEN 'holdout' ELSE 'train' END AS split, week, count(*) AS n FROM m, cut GROUP BY ALL",
    "spatial_split": f"""WITH {_PARTS}, a AS (SELECT DISTINCT outcode_ AS outcode FROM parts WHERE outcode_ IS NOT NULL),
      held AS (SELECT outcode FROM (SELECT outcode, row_number() OVER (ORDER BY substr(md5('0|' || outcode), 1, 12), outcode) AS r FROM a) WHERE r <= greatest(1, round((SELECT count(*) FROM a) * 0.2)))
      SELECT outcode_ AS outcode, CASE WHEN outcode_ IN (SELECT outcode FROM held) THEN 'holdout' ELSE 'train' END AS split, count(*) AS n FROM parts GROUP BY ALL""",
    "rolling_origins": f"""WITH {_MATRIX}, w AS (SELECT week, count(*) AS n, row_number() OVER (ORDER BY week) AS k FROM m GROUP BY week)
      SELECT a.week AS origin, CAST(sum(b.n) AS BIGINT) AS n_trained, any_value(a.n) AS n_judged FROM w a JOIN w b ON b.k BETWEEN a.k - 10 AND a.k - 1 WHERE a.k > 10 GROUP BY a.week""",
    "approach_metrics": f"WITH {_SCORED} SELECT approach, {_METRICS} FROM scored GROUP BY approach",
    "brand_metrics": f"WITH {_SCORED} SELECT brand, {_METRICS} FROM scored WHERE approach = 'brand_last_level' GROUP BY brand",
    "rolling_metrics": f"""WITH {_SCORED}, s AS (SELECT *, (exp(y_pred - y_true) - 1) * 100 AS e, abs(exp(y_pred) - exp(y_true)) AS p FROM scored)
      SELECT approach, week, brand, CAST(grouping(approach, week, brand) AS INTEGER) AS level, count(*) AS n, round(avg(abs(e)), 5) AS mape, round(median(abs(e)), 5) AS mdape, round(median(e), 5) AS bias, round(avg(e), 5) AS mean_pe, round(stddev_samp(e), 5) AS sd_pe, round(var_samp(e), 5) AS var_pe,
             round(avg(CAST(abs(e) <= 5 AS INTEGER)) * 100, 5) AS within_5, round(avg(CAST(abs(e) <= 10 AS INTEGER)) * 100, 5) AS within_10, round(avg(CAST(abs(e) <= 20 AS INTEGER)) * 100, 5) AS within_20, round(avg(p), 5) AS mae_gbp
      FROM s GROUP BY GROUPING SETS ((approach, week), (approach, brand), (approach), ())""",
    "top_k_metrics": f"""WITH {_SCORED}, s AS (SELECT * FROM scored WHERE approach = 'brand_last_level'),
      rk AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY risk_id, week ORDER BY y_true, brand, channel) AS t, row_number() OVER (PARTITION BY risk_id, week ORDER BY y_pred, brand, channel) AS p FROM s WINDOW g AS (PARTITION BY risk_id, week)),
      r2 AS (SELECT * FROM rk WHERE n > 1),
      per AS (SELECT risk_id, week, least(5, max(n)) AS kk, max(brand) FILTER (WHERE t = 1) AS t1, max(brand) FILTER (WHERE p = 1) AS p1, list(DISTINCT brand) FILTER (WHERE t <= 5) AS tb, list(DISTINCT brand) FILTER (WHERE p <= 5) AS pb, avg(exp(y_true)) FILTER (WHERE t <= 5) AS tm FROM r2 GROUP BY ALL),
      paid AS (SELECT a.risk_id, a.week, avg(exp(b.y_true)) AS pm FROM r2 a JOIN r2 b ON a.risk_id = b.risk_id AND a.week = b.week AND a.brand = b.brand WHERE a.p <= 5 GROUP BY ALL)
      SELECT round(avg(CAST(t1 = p1 AS INTEGER)) * 100, 6) AS cheapest_hit, round(avg(len(list_intersect(tb, pb)) / kk) * 100, 6) AS top5_overlap, round(median(abs(pm - tm) / tm) * 100, 6) AS top5_price_err, count(*) AS n_groups FROM per JOIN paid USING (risk_id, week)""",
    "residual_profile": f"""WITH {_MATRIX}, b AS (SELECT brand, avg(log_premium) AS v FROM m GROUP BY brand)
      SELECT brand, week, count(*) AS n, round((exp(avg(log_premium - v)) - 1) * 100, 6) AS resid_pct, CASE WHEN week >= (SELECT c FROM cut) THEN 'holdout' ELSE 'train' END AS split FROM m JOIN b USING (brand) GROUP BY ALL""",
    "brand_levels": f"WITH {_LEVELS} SELECT brand, week, round(level, 8) AS level, weight FROM levels",
    "level_trend": f"""WITH {_LEVELS},
      s AS (SELECT brand, count(*) AS n_weeks, sum(weight) AS sw, sum(weight * week) AS sx, sum(weight * level) AS sy, sum(weight * week * week) AS sxx, sum(weight * week * level) AS sxy, sum(weight * level) FILTER (WHERE recent) / sum(weight) FILTER (WHERE recent) AS anchor
        FROM (SELECT *, week > max(week) OVER (PARTITION BY brand) - 4 AS recent FROM levels) GROUP BY brand),
      t AS (SELECT *, CASE WHEN n_weeks >= 2 AND sxx - sx * sx / sw > 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) ELSE 0 END AS slope, n_weeks / (n_weeks + 4.0) AS credibility FROM s)
      SELECT brand, n_weeks, round(slope, 7) AS slope, round(credibility, 7) AS credibility, round(0.25 * CASE WHEN brand = 'MARKET' THEN slope ELSE credibility * slope + (1 - credibility) * (SELECT slope FROM t WHERE brand = 'MARKET') END, 7) AS used_slope, round(anchor, 7) AS anchor FROM t""",
    "rank_correlation": f"""WITH {_SCORED}, s AS (SELECT * FROM scored WHERE approach = 'brand_last_level'),
      rk AS (SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2 AS a, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS b FROM s)
      SELECT round(corr(a, b), 7) AS spearman, count(*) AS n FROM rk""",
    "quote_rate_model": """SELECT p.brand, round(coalesce(r.v, (SELECT avg(CAST(quoted AS INTEGER)) FROM quotes WHERE brand IS NOT NULL AND quoted IS NOT NULL)), 8) AS p_quote
      FROM providers p LEFT JOIN (SELECT brand, avg(CAST(quoted AS INTEGER)) AS v FROM quotes WHERE quoted IS NOT NULL GROUP BY brand) r USING (brand)""",
}
