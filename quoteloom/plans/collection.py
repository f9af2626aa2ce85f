"""Queries of records, sessions and attributes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions import scalars as S
from quoteloom.operators import collection as C
from quoteloom.operators import geo
from quoteloom.operators import tables as T
from quoteloom.plans import vendor
from quoteloom.session import table

DAY = "2026-07-06"
ATTRIBUTES = [c for c in C.RISK_COLUMNS if c != "risk_id"]


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    """Quotes with the attributes of their risk beside them, as a vendor's extract has them; a risk sent twice gives a quote two rows."""
    risks = table(spark, d, "risks").select("risk_id", "risk_row_id", *ATTRIBUTES)
    quotes = table(spark, d, "quotes").select(*C.QUOTE_COLUMNS, "quote_id").withColumn("quoted", F.coalesce("quoted", F.lit(False)))
    return quotes.join(risks, "risk_id")


def record_risks(spark, d):
    return C.to_records(_canonical(spark, d), order=["risk_row_id"])[0]


def record_quotes(spark, d):
    """Sound quotes of sound risks, by channel."""
    q = C.to_records(_canonical(spark, d), order=["risk_row_id"])[1]
    return q.groupBy("brand", "channel").agg(F.count("*").alias("n"), F.count("premium").alias("n_priced"), F.round(F.avg("premium"), 6).alias("mean_premium"))


def record_problems(spark, d):
    return C.to_records(_canonical(spark, d), order=["risk_row_id"])[2]


def collection_template(spark, d):
    """The grid of the declared basket by channel and brand."""
    risks = table(spark, d, "risks").where("in_basket").select("risk_id").distinct()
    channels = spark.createDataFrame([(c,) for c in C.CHANNELS], "channel string")
    return C.session_template(risks, channels, table(spark, d, "providers"), DAY).select("risk_id", "channel", "brand", "collected_on", "premium")


def _session(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = vendor.table(spark, d, "vendor_quotes")
    answered = rows.withColumn("quoted", S.to_bool(F.col("status_text"))).where("quoted is not null")
    filled = answered.select("vq_id", "risk_id", F.col("brand_text").alias("brand"), vendor._channel(F.col("channel_text")).alias("channel"), "collected_on", "quoted", F.when(F.col("quoted"), S.to_float(F.col("premium_text"))).alias("premium"))
    return C.session_to_canonical(filled, table(spark, d, "risks"), table(spark, d, "providers"))


def session_quotes(spark, d):
    return _session(spark, d)[0].select("vq_id", "risk_id", "brand", "underwriter", "channel", "quoted", "premium")


def session_problems(spark, d):
    return _session(spark, d)[1].groupBy("problem").agg(F.count("*").alias("n"))


def attribute_audit(spark, d):
    """Essential attributes of quotes joined to nothing: those a table of risks has, and those it lacks."""
    thin = table(spark, d, "risks").withColumn("contents_sum_insured", F.when(F.col("in_basket"), F.col("contents_sum_insured"))).drop("policy_type")
    return T.attribute_findings(thin)


def full_panels(spark, d):
    """Rows of risk, date and channel groups of exactly three."""
    q = table(spark, d, "quotes").select("quote_id", "risk_id", "collected_on", "channel")
    return T.groups_of_size(q, ["risk_id", "collected_on", "channel"], 3).select("quote_id")


def page_ranks(spark, d):
    """Places by price on each risk, date and channel's page; rows without a price have none."""
    q = table(spark, d, "quotes").where("collected_on is not null").select("quote_id", "risk_id", "collected_on", "channel", F.when(F.col("quoted") & ~F.isnan("premium"), F.col("premium")).alias("premium"))
    return T.first_ranks(q, ["risk_id", "collected_on", "channel"], "premium", ["quote_id"]).select("quote_id", "rank_no")


def subsidence_bands(spark, d):
    """The highest band a postcode; the bedrooms stand in for the band."""
    return geo.subsidence(table(spark, d, "risks").select("postcode", F.col("bedrooms").alias("band")))


QUERIES = {f.__name__: f for f in (record_risks, record_quotes, record_problems, collection_template, session_quotes, session_problems, attribute_audit, full_panels, page_ranks, subsidence_bands)}

_in = lambda c, vs: f"coalesce({c} IN ({', '.join(repr(v) for v in vs)}), FALSE)"
_RISK_RULES = {
    "postcode": "coalesce(length(regexp_replace(postcode, '\\s', '', 'g')) >= 5, FALSE)", "policy_type": _in("policy_type", C.POLICY_TYPES), "building_type": _in("building_type", C.BUILDING_TYPES), "construction": _in("construction", C.CONSTRUCTIONS), "occupancy": _in("occupancy", C.OCCUPANCIES),
    "year_built": "coalesce(year_built BETWEEN 1000 AND 2100, FALSE)", "bedrooms": "coalesce(bedrooms BETWEEN 1 AND 20, FALSE)", "voluntary_excess": "coalesce(voluntary_excess >= 0, FALSE)", "claims_last_5y": "coalesce(claims_last_5y >= 0, FALSE)",
    "buildings_sum_insured": "coalesce(policy_type NOT IN ('buildings', 'combined') OR coalesce(buildings_sum_insured, 0) > 0, FALSE)", "contents_sum_insured": "coalesce(policy_type NOT IN ('contents', 'combined') OR coalesce(contents_sum_insured, 0) > 0, FALSE)",
}
_QUOTE_RULES = {"channel": _in("channel", C.CHANNELS), "collected_on": "collected_on IS NOT NULL", "premium": "coalesce(CASE WHEN quoted THEN premium >= 0 ELSE premium IS NULL END, FALSE)", "compulsory_excess": "coalesce(compulsory_excess, 0) >= 0", "cashback": "coalesce(cashback, 0) >= 0", "rank_on_page": "coalesce(rank_on_page, 1) >= 1"}
_RECORDS = f"""both_ AS (SELECT q.* EXCLUDE (quoted, premium, load_id), coalesce(q.quoted, FALSE) AS quoted, CASE WHEN NOT isnan(q.premium) THEN q.premium END AS raw_premium, r.risk_row_id, {', '.join('r.' + c for c in ATTRIBUTES)} FROM quotes q JOIN risks r USING (risk_id)),
    kept AS (SELECT *, CASE WHEN quoted THEN raw_premium END AS premium FROM both_ WHERE brand IS NOT NULL),
    firsts AS (SELECT risk_id, {', '.join(ATTRIBUTES)} FROM kept QUALIFY row_number() OVER (PARTITION BY risk_id ORDER BY risk_row_id) = 1),
    sound AS (SELECT * FROM firsts WHERE {' AND '.join(_RISK_RULES.values())}),
    offered AS (SELECT * FROM kept WHERE risk_id IN (SELECT risk_id FROM sound))"""

SQL: dict[str, str] = {
    "record_risks": f"WITH {_RECORDS} SELECT * FROM sound",
    "record_quotes": f"WITH {_RECORDS} SELECT brand, channel, count(*) AS n, count(premium) AS n_priced, round(avg(premium), 6) AS mean_premium FROM offered WHERE {' AND '.join(_QUOTE_RULES.values())} GROUP BY ALL",
    "record_problems": f"WITH {_RECORDS}, found AS (SELECT 'rows' AS kind, 'no_brand' AS problem, count(*) FILTER (WHERE brand IS NULL) AS n FROM both_ UNION ALL SELECT 'rows', 'priced_decline', count(*) FILTER (WHERE brand IS NOT NULL AND NOT quoted AND raw_premium IS NOT NULL) FROM both_"
    + "".join(f" UNION ALL SELECT 'conflict', '{c}', count(*) FROM (SELECT risk_id FROM kept GROUP BY risk_id HAVING count(DISTINCT {c}) > 1)" for c in ATTRIBUTES)
    + "".join(f" UNION ALL SELECT 'risk', '{c}', count(*) FROM firsts WHERE NOT ({r})" for c, r in _RISK_RULES.items())
    + "".join(f" UNION ALL SELECT 'quote', '{c}', count(*) FROM offered WHERE NOT ({r})" for c, r in _QUOTE_RULES.items())
    + ") SELECT * FROM found WHERE n > 0",
    "collection_template": f"SELECT risk_id, channel, brand, DATE '{DAY}' AS collected_on, CAST(NULL AS VARCHAR) AS premium FROM (SELECT DISTINCT risk_id FROM risks WHERE in_basket), (SELECT unnest([{', '.join(repr(c) for c in C.CHANNELS)}]) AS channel), (SELECT brand FROM providers)",
    "attribute_audit": "SELECT 'BLOCKER' AS severity, 'no_risk_attributes' AS code, 1.0 AS measure UNION ALL SELECT * FROM (SELECT 'WARN', 'sparse_risk_attributes', CAST(" + " + ".join(f"CAST(count({c}) < 0.5 * count(*) AS INTEGER)" for c in ("postcode", "building_type", "buildings_sum_insured", "CASE WHEN in_basket THEN contents_sum_insured END", "voluntary_excess")) + " AS DOUBLE) AS m FROM risks) WHERE m > 0",
    "full_panels": "SELECT quote_id FROM (SELECT quote_id, count(*) OVER (PARTITION BY risk_id, collected_on, channel) AS n FROM quotes) WHERE n = 3",
    "page_ranks": "WITH q AS (SELECT *, CASE WHEN quoted AND NOT isnan(premium) THEN premium END AS p FROM quotes WHERE collected_on IS NOT NULL) SELECT quote_id, CAST(CASE WHEN p IS NOT NULL THEN row_number() OVER (PARTITION BY risk_id, collected_on, channel, p IS NULL ORDER BY p, quote_id) END AS INTEGER) AS rank_no FROM q",
    "subsidence_bands": "WITH t AS (SELECT regexp_replace(upper(postcode), '[^A-Z0-9]', '', 'g') AS t, bedrooms FROM risks), p AS (SELECT CASE WHEN t = 'GIR0AA' THEN 'GIR 0AA' WHEN regexp_matches(t, '" + S.POSTCODE + "') THEN substr(t, 1, length(t) - 3) || ' ' || substr(t, length(t) - 2) END AS postcode, bedrooms FROM t) SELECT postcode, CAST(max(bedrooms) AS DOUBLE) AS subsidence_band FROM p WHERE postcode IS NOT NULL GROUP BY postcode",
}
_FILLED = f"""names AS (SELECT min(brand) AS brand, any_value(underwriter) AS underwriter, k FROM (SELECT brand, underwriter, {vendor._key_sql('brand')} AS k FROM providers) GROUP BY k),
    filled AS (SELECT vq_id, risk_id, brand_text, {vendor.at(vendor._CHANNEL, 'channel_text')} AS channel, collected_on, {vendor.at(vendor._BOOL, 'status_text')} AS quoted, {vendor.at(vendor._FLOAT, 'premium_text')} AS price, {vendor._key_sql('brand_text')} AS k FROM vendor_quotes),
    joined AS (SELECT f.*, n.brand, n.underwriter, CASE WHEN quoted THEN price END AS premium, f.risk_id IN (SELECT risk_id FROM risks) AS known FROM filled f LEFT JOIN names n USING (k) WHERE quoted IS NOT NULL),
    told AS (SELECT *, CASE WHEN NOT coalesce(known, FALSE) THEN 'the risk has no definition' WHEN brand IS NULL THEN 'the brand is not in the registry'
      ELSE nullif(concat_ws('|', CASE WHEN NOT {_QUOTE_RULES['channel']} THEN 'channel' END, CASE WHEN collected_on IS NULL THEN 'collected_on' END, CASE WHEN NOT {_QUOTE_RULES['premium']} THEN 'premium' END), '') END AS problem FROM joined)"""
SQL["session_quotes"] = f"WITH {_FILLED} SELECT vq_id, risk_id, brand, underwriter, channel, quoted, premium FROM told WHERE problem IS NULL"
SQL["session_problems"] = f"WITH {_FILLED} SELECT problem, count(*) AS n FROM told WHERE problem IS NOT NULL GROUP BY problem"
