"""Queries of mapping, checking and merging vendor extracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions import scalars as S
from quoteloom.operators import tables as T
from quoteloom.operators.quantiles import exact_quantiles, median
from quoteloom.session import table
from quoteloom.sources.spec import SPELLINGS
from quoteloom.streaming.feeds import windowed_levels

#: The spec's spellings, and the codes themselves.
CHANNELS = {v: v for v in SPELLINGS["channel"].values()} | SPELLINGS["channel"]
KEYS = ["risk_id", "brand", "channel", "collected_on"]


def _channel(c):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), S.norm_token(c))


def canonical_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Vendor rows by their spec: brand and underwriter from the registry, channel by its spellings, price in the spec's terms, outcome inferred where it says nothing."""
    q, specs, registry = (table(spark, d, n) for n in ("vendor_quotes", "vendor_specs", "providers"))
    names = registry.select("brand", "underwriter", S.brand_key(F.col("brand")).alias("key_"))
    price = S.to_float(F.col("premium_text"))
    price = price * F.when(F.col("premium_basis") == "monthly", 12).otherwise(1) * F.when(F.col("premium_includes_ipt"), 1.0).otherwise(1.12)
    joined = q.join(F.broadcast(specs), "spec_name").withColumn("key_", S.brand_key(F.col("brand_text"))).join(F.broadcast(names), "key_", "left")  # fixed tables
    quoted = F.coalesce(S.to_bool(F.col("status_text")), price.isNotNull())
    return joined.select("vq_id", "risk_id", "brand", "underwriter", _channel(F.col("channel_text")).alias("channel"), "collected_on", quoted.alias("quoted"), F.when(quoted, F.round(price, 4)).alias("premium"))


def unresolved_brands(spark, d):
    """Brand texts that the registry's keys do not resolve, with how often they stand."""
    q, names = table(spark, d, "vendor_quotes"), table(spark, d, "providers").select(S.brand_key(F.col("brand")).alias("key_"))
    keyed = q.where("brand_text is not null").select("brand_text", S.brand_key(F.col("brand_text")).alias("key_"))
    return keyed.join(F.broadcast(names), "key_", "left_anti").groupBy(F.col("brand_text").alias("vendor_brand")).agg(F.count("*").alias("n"))


def unknown_channels(spark, d):
    q = table(spark, d, "vendor_quotes").where(_channel(F.col("channel_text")).isNull())
    return q.groupBy(S.norm_token(F.col("channel_text")).alias("channel_text")).agg(F.count("*").alias("n"))


def money_texts(spark, d):
    return table(spark, d, "vendor_quotes").select("vq_id", S.to_float(F.col("premium_text")).alias("premium"))


def flag_texts(spark, d):
    return table(spark, d, "vendor_quotes").select("vq_id", S.to_bool(F.col("status_text")).alias("flag"))


def date_texts(spark, d):
    """The day-first reading of dates written three ways."""
    day = F.col("collected_on")
    return table(spark, d, "vendor_quotes").select("vq_id", S.day_first_date(F.date_format(day, "d/M/yyyy")).alias("slashes"), S.day_first_date(F.date_format(day, "yyyy-MM-dd")).alias("iso"), S.day_first_date(F.date_format(day, "dd-MMM-yyyy")).alias("named"))


PROFILED = ["risk_id", "postcode", "policy_type", "building_type", "occupancy", "year_built", "bedrooms", "in_basket"]


def risk_profile(spark, d):
    return T.column_profile(table(spark, d, "risks"), PROFILED)


def quote_duplicates(spark, d):
    return T.duplicate_count(table(spark, d, "quotes"), KEYS)


CONFLICTING = ["postcode", "building_type", "occupancy", "year_built", "bedrooms"]


def risk_conflicts(spark, d):
    return T.conflicts(table(spark, d, "risks"), "risk_id", CONFLICTING)


def first_risks(spark, d):
    """One row a risk: the first load's, then the first row's."""
    return T.first_per(table(spark, d, "risks").select("risk_id", "load_id", "risk_row_id", "postcode", "building_type", "year_built"), ["risk_id"], ["load_id", "risk_row_id"])


def upsert_quotes(spark, d):
    """Vendor quotes over the collected ones: a vendor's row replaces those of its key."""
    old = table(spark, d, "quotes").select(F.col("quote_id").alias("id"), *KEYS, F.lit("quotes").alias("origin"))
    new = table(spark, d, "vendor_quotes").select(F.col("vq_id").alias("id"), "risk_id", F.col("brand_text").alias("brand"), _channel(F.col("channel_text")).alias("channel"), "collected_on", F.lit("vendor").alias("origin"))
    return T.upsert(old, new, KEYS)


def union_by_name(spark, d):
    """Both tables stacked by name, what one lacks null: rows and prices by source and month."""
    a = table(spark, d, "quotes").select("source", "risk_id", "collected_on", S.nan_to_null(F.col("premium")).alias("premium"))
    b = table(spark, d, "vendor_quotes").select(F.lit("vendor_text").alias("source"), "risk_id", "collected_on", "premium_text")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("source", S.period_start(F.col("collected_on"), "month").alias("month")).agg(F.count("*").alias("n"), F.count("premium").alias("n_premium"), F.count("premium_text").alias("n_text"))


def panel_overlap(spark, d):
    """Risks of the first and the last month of collection, and their Jaccard overlap."""
    q = table(spark, d, "quotes").select("risk_id", S.period_start(F.col("collected_on"), "month").alias("m"))
    ends = F.broadcast(q.agg(F.min("m").alias("a"), F.max("m").alias("b")))  # one row
    both = q.crossJoin(ends)
    return T.jaccard(both.where("m = a"), both.where("m = b"), "risk_id").withColumn("jaccard", F.round("jaccard", 8))


def quote_audit(spark, d):
    return T.audit(table(spark, d, "quotes")).withColumn("measure", F.round("measure", 6))


def quote_problems(spark, d):
    """Rows by the set of rules they break."""
    q = table(spark, d, "quotes").withColumn("premium", S.nan_to_null(F.col("premium")))
    c = F.col
    rules = {
        "brand": c("brand").isNotNull(),
        "quoted_has_premium": ~c("quoted") | c("premium").isNotNull(),
        "declined_has_none": c("quoted") | c("premium").isNull() | (c("premium") == 0),
        "premium_sign": F.coalesce(c("premium"), F.lit(0.0)) >= 0,
        "excess_sign": F.coalesce(c("compulsory_excess"), F.lit(0.0)) >= 0,
        "rank": F.coalesce(c("rank_on_page"), F.lit(1)) >= 1,
    }
    return T.rejects(q, rules).groupBy(F.array_join("problems", "|").alias("problems")).agg(F.count("*").alias("n"))


def brand_channel_pivot(spark, d):
    """Median price by brand and channel, a column a channel."""
    q = table(spark, d, "quotes").where("quoted and premium > 0 and not isnan(premium) and brand is not null")
    medians = exact_quantiles(q, ["brand", "channel"], {"premium": median(F.col("premium"))}, written=False)
    return medians.groupBy("brand").pivot("channel", ["direct", "pcw_ctm", "pcw_msm", "pcw_confused", "pcw_gocompare"]).agg(F.first("premium"))


def channel_unpivot(spark, d):
    """The pivot turned long again; blank cells are absent."""
    wide = brand_channel_pivot(spark, d)
    return wide.unpivot(["brand"], [c for c in wide.columns if c != "brand"], "channel", "premium").where("premium is not null")


def basket_coverage(spark, d):
    """Declared basket by channel: quoted, declined and missing channels of each risk."""
    risks = table(spark, d, "risks").where("in_basket").select("risk_id").distinct()
    channels = table(spark, d, "quotes").select("channel").distinct()
    rows = table(spark, d, "quotes").select("risk_id", "channel", F.coalesce("quoted", F.lit(False)).alias("quoted"))
    return T.coverage(T.grid(risks, channels), rows.join(risks, "risk_id", "left_semi"), ["risk_id"])


def note_summary(spark, d):
    q = table(spark, d, "quotes").select(F.explode(F.array_compact(F.array("incentive_note", "collector_note"))).alias("message"))
    return T.problem_summary(q)


def reachable_brands(spark, d):
    """Brands by whether a comparison site reaches them."""
    kinds = F.split("channel_list", r"\|")
    return table(spark, d, "providers").select("brand", F.arrays_overlap(kinds, F.array(F.lit("pcw"))).alias("reachable"), "tier")


def weekly_levels(spark, d):
    """Price levels by brand and Monday week of ingestion: the batch form of the streaming windows."""
    out = windowed_levels(table(spark, d, "quotes").where("brand is not null"))
    return out.withColumn("log_sum", F.round("log_sum", 6))


QUERIES = {f.__name__: f for f in (canonical_quotes, unresolved_brands, unknown_channels, money_texts, flag_texts, date_texts, risk_profile, quote_duplicates, risk_conflicts, first_risks, upsert_quotes, union_by_name, panel_overlap, quote_audit, quote_problems, brand_channel_pivot, channel_unpivot, basket_coverage, note_summary, reachable_brands, weekly_levels)}


def _key_sql(c: str) -> str:
    t = f"regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g')"
    for noise in S.BRAND_NOISE:
        t = f"regexp_replace({t}, '\\b{noise}\\b', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_TOKEN = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_words = lambda ws: ", ".join(f"'{w}'" for w in ws)
_BOOL = f"CASE WHEN {_TOKEN} IN ({_words(S.TRUE_WORDS)}) THEN TRUE WHEN {_TOKEN} IN ({_words(S.FALSE_WORDS)}) THEN FALSE END"
_STRIPPED = "regexp_replace({}, '[£$,\\s]', '', 'g')"
_FLOAT = f"CASE WHEN regexp_full_match({_STRIPPED}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({_STRIPPED} AS DOUBLE) END"
_CHANNEL = "CASE " + " ".join(f"WHEN {_TOKEN} = '{k}' THEN '{v}'" for k, v in CHANNELS.items()) + " END"
at = lambda t, c: t.replace("{}", c)

SQL: dict[str, str] = {
    "canonical_quotes": f"""WITH names AS (SELECT brand, underwriter, {_key_sql("brand")} AS k FROM providers),
      parsed AS (SELECT *, ({at(_FLOAT, "premium_text")}) * CASE WHEN premium_basis = 'monthly' THEN 12 ELSE 1 END * CASE WHEN premium_includes_ipt THEN 1.0 ELSE 1.12 END AS price, {at(_BOOL, "status_text")} AS said, {_key_sql("brand_text")} AS k
        FROM vendor_quotes JOIN vendor_specs USING (spec_name))
      SELECT vq_id, risk_id, n.brand, n.underwriter, {at(_CHANNEL, "channel_text")} AS channel, collected_on, coalesce(said, price IS NOT NULL) AS quoted, CASE WHEN coalesce(said, price IS NOT NULL) THEN round(price, 4) END AS premium
      FROM parsed p LEFT JOIN names n USING (k)""",
    "unresolved_brands": f"SELECT brand_text AS vendor_brand, count(*) AS n FROM vendor_quotes WHERE brand_text IS NOT NULL AND {_key_sql('brand_text')} NOT IN (SELECT {_key_sql('brand')} FROM providers) GROUP BY brand_text",
    "unknown_channels": f"SELECT {at(_TOKEN, 'channel_text')} AS channel_text, count(*) AS n FROM vendor_quotes WHERE {at(_CHANNEL, 'channel_text')} IS NULL GROUP BY 1",
    "money_texts": f"SELECT vq_id, {at(_FLOAT, 'premium_text')} AS premium FROM vendor_quotes",
    "flag_texts": f"SELECT vq_id, {at(_BOOL, 'status_text')} AS flag FROM vendor_quotes",
    "date_texts": "SELECT vq_id, collected_on AS slashes, collected_on AS iso, collected_on AS named FROM vendor_quotes",
    "risk_profile": " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, min(CAST({c} AS VARCHAR)) AS least, max(CAST({c} AS VARCHAR)) AS most FROM risks" for c in PROFILED),
    "quote_duplicates": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM quotes GROUP BY risk_id, brand, channel, collected_on)",
    "risk_conflicts": " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n_conflicting FROM (SELECT risk_id FROM risks GROUP BY risk_id HAVING count(DISTINCT {c}) > 1)" for c in CONFLICTING),
    "first_risks": "SELECT risk_id, load_id, risk_row_id, postcode, building_type, year_built FROM risks QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY load_id, risk_row_id) = 1",
    "upsert_quotes": f"""WITH fresh AS (SELECT vq_id AS id, risk_id, brand_text AS brand, {at(_CHANNEL, 'channel_text')} AS channel, collected_on, 'vendor' AS origin FROM vendor_quotes)
      SELECT quote_id AS id, risk_id, brand, channel, collected_on, 'quotes' AS origin FROM quotes q
      WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.risk_id IS NOT DISTINCT FROM q.risk_id AND f.brand IS NOT DISTINCT FROM q.brand AND f.channel IS NOT DISTINCT FROM q.channel AND f.collected_on = q.collected_on)
      UNION ALL SELECT * FROM fresh""",
    "union_by_name": """SELECT source, CAST(date_trunc('month', collected_on) AS DATE) AS month, count(*) AS n, count(premium) AS n_premium, count(premium_text) AS n_text FROM (
      SELECT source, collected_on, CASE WHEN NOT isnan(premium) THEN premium END AS premium, NULL AS premium_text FROM quotes UNION ALL SELECT 'vendor_text', collected_on, NULL, premium_text FROM vendor_quotes) GROUP BY ALL""",
    "panel_overlap": """WITH q AS (SELECT DISTINCT risk_id, date_trunc('month', collected_on) AS m FROM quotes), a AS (SELECT risk_id FROM q WHERE m = (SELECT min(m) FROM q)), b AS (SELECT risk_id FROM q WHERE m = (SELECT max(m) FROM q)),
      n AS (SELECT (SELECT count(*) FROM a JOIN b USING (risk_id)) AS n_shared, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_all)
      SELECT n_shared, n_all, round(n_shared / n_all, 8) AS jaccard FROM n""",
    "quote_audit": """WITH q AS (SELECT risk_id, brand, channel, collected_on, coalesce(quoted, FALSE) AS quoted, CASE WHEN NOT isnan(premium) THEN premium END AS premium FROM quotes),
      r AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT quoted) AS d, median(premium) AS med, count(*) FILTER (WHERE brand IS NULL) AS u, min(collected_on) AS f, max(collected_on) AS l FROM q),
      z AS (SELECT count(*) AS g, min(s) AS lo, max(s) AS hi, median(s) AS mid FROM (SELECT count(*) AS s FROM q GROUP BY risk_id, collected_on, channel)),
      x AS (SELECT sum(s - 1) AS dup FROM (SELECT count(*) AS s FROM q GROUP BY risk_id, brand, channel, collected_on)),
      o AS (SELECT count(*) FILTER (WHERE a AND b) / count(*) AS ov FROM (SELECT risk_id, bool_or(collected_on = f) AS a, bool_or(collected_on = l) AS b FROM q, r WHERE collected_on IN (f, l) GROUP BY risk_id))
      SELECT severity, code, round(CAST(measure AS DOUBLE), 6) AS measure FROM (
        SELECT 'BLOCKER' AS severity, 'empty' AS code, n AS measure FROM r WHERE n = 0
        UNION ALL SELECT 'WARN', 'no_declines', d FROM r WHERE n > 0 AND d = 0 UNION ALL SELECT 'INFO', 'declines', d FROM r WHERE d > 0
        UNION ALL SELECT CASE WHEN med < 90 THEN 'BLOCKER' WHEN med > 1200 THEN 'WARN' ELSE 'INFO' END, 'premium_basis', med FROM r WHERE med IS NOT NULL
        UNION ALL SELECT CASE WHEN g > 3 AND lo = hi AND hi <= 10 AND d = 0 THEN 'WARN' ELSE 'INFO' END, CASE WHEN g > 3 AND lo = hi AND hi <= 10 AND d = 0 THEN 'possible_truncation' ELSE 'panel_size' END, CASE WHEN g > 3 AND lo = hi AND hi <= 10 THEN hi ELSE mid END FROM z, r WHERE n > 0
        UNION ALL SELECT CASE WHEN ov < 0.5 THEN 'WARN' ELSE 'INFO' END, CASE WHEN ov < 0.5 THEN 'rotating_panel' ELSE 'fixed_basket' END, ov FROM o, r WHERE f < l
        UNION ALL SELECT 'WARN', 'duplicates', dup FROM x WHERE dup > 0 UNION ALL SELECT 'WARN', 'unmapped_brands', u FROM r WHERE u > 0)""",
    "quote_problems": """WITH q AS (SELECT *, CASE WHEN NOT isnan(premium) THEN premium END AS p FROM quotes)
      SELECT problems, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN NOT coalesce(NOT quoted OR p IS NOT NULL, FALSE) THEN 'quoted_has_premium' END,
        CASE WHEN NOT coalesce(quoted OR p IS NULL OR p = 0, FALSE) THEN 'declined_has_none' END, CASE WHEN coalesce(p, 0) < 0 THEN 'premium_sign' END, CASE WHEN coalesce(compulsory_excess, 0) < 0 THEN 'excess_sign' END,
        CASE WHEN coalesce(rank_on_page, 1) < 1 THEN 'rank' END) AS problems FROM q) GROUP BY problems""",
    "brand_channel_pivot": "SELECT brand, " + ", ".join(f"median(premium) FILTER (WHERE channel = '{c}') AS {c}" for c in ("direct", "pcw_ctm", "pcw_msm", "pcw_confused", "pcw_gocompare")) + " FROM quotes WHERE quoted AND premium > 0 AND NOT isnan(premium) AND brand IS NOT NULL GROUP BY brand",
    "channel_unpivot": "SELECT brand, channel, median(premium) AS premium FROM quotes WHERE quoted AND premium > 0 AND NOT isnan(premium) AND brand IS NOT NULL GROUP BY brand, channel",
    "basket_coverage": """WITH b AS (SELECT DISTINCT risk_id FROM risks WHERE in_basket), c AS (SELECT DISTINCT channel FROM quotes), q AS (SELECT risk_id, channel, coalesce(quoted, FALSE) AS quoted FROM quotes WHERE risk_id IN (SELECT risk_id FROM b)),
      n AS (SELECT risk_id, count(*) FILTER (WHERE quoted) AS n_quoted, count(*) FILTER (WHERE NOT quoted) AS n_declined FROM q GROUP BY risk_id),
      m AS (SELECT risk_id, string_agg(channel, '|' ORDER BY channel) AS missing FROM (SELECT risk_id, channel FROM b, c EXCEPT SELECT risk_id, channel FROM q) GROUP BY risk_id)
      SELECT risk_id, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_declined, 0) AS n_declined, coalesce(missing, '') AS missing_channels, CASE WHEN n_quoted IS NULL THEN 'missing' WHEN missing IS NULL THEN 'complete' ELSE 'partial' END AS status
      FROM b LEFT JOIN n USING (risk_id) LEFT JOIN m USING (risk_id)""",
    "note_summary": """SELECT regexp_replace(regexp_replace(message, '''[^'']*''', '''...''', 'g'), '\\d+', '#', 'g') AS problem, count(*) AS n FROM (SELECT incentive_note AS message FROM quotes UNION ALL SELECT collector_note FROM quotes) WHERE message IS NOT NULL GROUP BY 1""",
    "weekly_levels": "SELECT CAST(date_trunc('week', ingested_at) AS DATE) AS window_start, brand, count(*) AS n, round(sum(ln(premium)), 6) AS log_sum FROM quotes WHERE brand IS NOT NULL AND quoted AND premium > 0 AND NOT isnan(premium) GROUP BY ALL",
    "reachable_brands": "SELECT brand, list_contains(string_split(channel_list, '|'), 'pcw') AS reachable, tier FROM providers",
}
