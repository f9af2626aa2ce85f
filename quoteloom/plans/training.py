"""Queries of the general training-data problems (units, rejects, profiles, drifting schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.operators import profile, units
from quoteloom.session import table
from quoteloom.sources import feeds


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Prices recorded otherwise than as whole-year pounds with tax, converted."""
    got = units.normalise_prices(table(spark, d, "vendor_quotes"), table(spark, d, "vendor_specs"))
    return got.where(~F.col("recorded_as_is") & F.col("annual_pence").isNotNull()).select("vq_id", "annual_pence")


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """Every price in common units, counted and summed by the unit it came in; figures too large to convert and texts not wholly read are counted."""
    got = units.normalise_prices(table(spark, d, "vendor_quotes"), table(spark, d, "vendor_specs"))
    return got.groupBy("unit", "taxed", "unit_from_row").agg(F.count("*").alias("n"), F.sum("annual_pence").alias("annual_pence"), F.count_if(F.col("annual_pence").isNull()).alias("n_too_large"), F.count_if(F.col("unread").isNotNull()).alias("n_unread"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    profiles = profile.profile_loads(table(spark, d, "quotes"), table(spark, d, "risks"))
    return profile.load_issues(profiles, table(spark, d, "loads"))


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    """The state of each load and field."""
    return profile.profile_loads(table(spark, d, "quotes"), table(spark, d, "risks")).select("load_id", "field_id", "n_rows", "n_null", "n_distinct", "least", "most", "n_outside", "n_pattern")


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    """Rare masks and mask divergence of each load and field."""
    state = profile.mask_state(table(spark, d, "quotes"), table(spark, d, "risks"))
    return profile.load_masks(state, table(spark, d, "loads")).withColumn("divergence", F.round("divergence", 6))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """(records with approved columns replayed, the names approved: by a spec, by the fixed list, or by their values)."""
    lines, files, names = (table(spark, d, n) for n in ("vendor_lines", "vendor_files", "spec_columns"))
    approved = feeds.declared_names(names)[1]
    heads = feeds.file_heads(lines, files)
    approved = feeds.learned_names(lines, files, names, approved, heads) | approved
    return feeds.read_feeds(lines, files, names, approved, heads=heads), approved


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return feeds.judged(_records(spark, d)[0]).where("reason_code is not null").select("line_id", "reason_code")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The sound records as typed quotes."""
    return feeds.typed(feeds.judged(_records(spark, d)[0]).where("reason_code is null").drop("reason_code", "error_type", "feed_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    headers, kinds = feeds.file_summary(*_records(spark, d))
    return feeds.feed_changes(headers, kinds, table(spark, d, "vendor_files")).select("file_id", "change_kind", "header_text")


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable records of all files as one table, what does not fit kept as JSON."""
    return feeds.typed(_records(spark, d)[0].where("reason is null and columns is null").drop("reason", "error_type", "columns", "has", "feed_id"))


QUERIES = {"p1_found": p1_found, "p1_units": p1_units, "p5_found": p5_found, "p5_loaded": p5_loaded, "p6_found": p6_found, "p6_profile": p6_profile, "p6_masks": p6_masks, "p7_found": p7_found, "p7_table": p7_table}

_P6_STATE = """
    state AS (
      SELECT load_id, 'premium' AS field_id, CASE WHEN NOT isnan(premium) THEN premium END AS v FROM quotes
      UNION ALL SELECT load_id, 'voluntary_excess', CASE WHEN NOT isnan(voluntary_excess) THEN voluntary_excess END FROM risks),
    profiles AS (
      SELECT load_id, field_id, count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, min(v) AS least, max(v) AS most,
             count(*) FILTER (WHERE v < 0 OR v > CASE field_id WHEN 'premium' THEN 25000 ELSE 2000 END) AS n_outside,
             count(*) FILTER (WHERE CASE field_id WHEN 'premium' THEN abs(v * 100 - round(v * 100)) ELSE abs(v / 50 - round(v / 50)) END > 0.0001) AS n_pattern
      FROM state GROUP BY load_id, field_id
      UNION ALL
      SELECT load_id, 'quoted', count(*), count(*) - count(quoted), count(DISTINCT quoted), NULL, NULL, 0, 0 FROM quotes GROUP BY load_id)"""

_TEXT = "regexp_replace(regexp_replace(CAST(CAST(v AS DECIMAL(24,6)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_P6_MASKS = f"""
    state AS (
      SELECT load_id, 'premium' AS field_id, CASE WHEN NOT isnan(premium) THEN premium END AS v FROM quotes
      UNION ALL SELECT load_id, 'voluntary_excess', CASE WHEN NOT isnan(voluntary_excess) THEN voluntary_excess END FROM risks),
    marked AS (
      SELECT load_id, field_id, CASE field_id WHEN 'premium' THEN abs(v * 100 - round(v * 100)) ELSE abs(v / 50 - round(v / 50)) END > 0.0001 AS off_step,
             coalesce(CASE field_id WHEN 'premium' THEN regexp_replace(regexp_replace({_TEXT}, '^(-?)\\d+', '\\1#'), '\\d', '9', 'g')
               ELSE regexp_replace(regexp_replace({_TEXT}, '^(-?)\\d+(\\d\\d)(\\.|$)', '\\1#\\2\\3'), '[1-46-9]', '9', 'g') END, '<null>') AS mask FROM state),
    masks AS (SELECT load_id, field_id, mask, count(*) AS n, count(*) FILTER (WHERE off_step) AS n_off FROM marked GROUP BY ALL),
    shares AS (SELECT *, n / sum(n) OVER (PARTITION BY load_id, field_id) AS p, n / sum(n) FILTER (WHERE mask <> '<null>') OVER (PARTITION BY load_id, field_id) AS s FROM masks),
    dominant AS (SELECT field_id, mask FROM shares WHERE mask <> '<null>' GROUP BY field_id, mask
      HAVING sum(n_off) = 0 AND count(*) FILTER (WHERE s >= 0.02) >= 0.5 * (SELECT count(DISTINCT load_id) FROM masks x WHERE x.field_id = shares.field_id AND mask <> '<null>')),
    judged AS (SELECT m.*, d.mask IS NULL AND m.mask <> '<null>' AS rare FROM masks m LEFT JOIN dominant d USING (field_id, mask))"""

SQL: dict[str, str] = {
    "p6_masks": f"""WITH {_P6_MASKS},
    every AS (SELECT load_id, field_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE rare), 0) AS BIGINT) AS n_rare, max(mask) FILTER (WHERE rare AND place = 1) AS rare_mask
      FROM (SELECT *, row_number() OVER (PARTITION BY load_id, field_id, rare ORDER BY n DESC, mask DESC) AS place FROM judged) GROUP BY ALL),
    pairs AS (SELECT a.load_id, a.field_id FROM every a JOIN loads l ON l.load_id = a.load_id JOIN every b ON b.load_id = l.prior_load_id AND b.field_id = a.field_id),
    grams AS (SELECT load_id, field_id, mask FROM pairs JOIN shares USING (load_id, field_id) UNION SELECT p.load_id, p.field_id, s.mask FROM pairs p JOIN loads l USING (load_id) JOIN shares s ON s.load_id = l.prior_load_id AND s.field_id = p.field_id),
    parts AS (SELECT g.load_id, g.field_id, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM grams g JOIN loads l USING (load_id)
      LEFT JOIN shares a ON a.load_id = g.load_id AND a.field_id = g.field_id AND a.mask = g.mask LEFT JOIN shares b ON b.load_id = l.prior_load_id AND b.field_id = g.field_id AND b.mask = g.mask),
    diverged AS (SELECT load_id, field_id, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS divergence FROM parts GROUP BY ALL)
    SELECT * FROM every LEFT JOIN diverged USING (load_id, field_id)""",
    "p6_profile": f"WITH {_P6_STATE} SELECT * FROM profiles",
    "p6_found": f"""WITH {_P6_STATE},
    levels AS (
      SELECT load_id, 'quoted' AS field_id, avg(CAST(quoted AS INTEGER)) AS level FROM quotes GROUP BY load_id
      UNION ALL SELECT load_id, 'premium', median(premium) FROM quotes WHERE quoted AND premium > 0 AND NOT isnan(premium) GROUP BY load_id
      UNION ALL SELECT load_id, 'voluntary_excess', avg(voluntary_excess) FROM risks WHERE voluntary_excess BETWEEN 0 AND 2000 GROUP BY load_id),
    both_ AS (
      SELECT p.*, v.level, b.n_rows AS n_rows_b, b.n_null AS n_null_b, b.n_distinct AS n_distinct_b, lb.level AS level_b
      FROM profiles p LEFT JOIN levels v USING (load_id, field_id) LEFT JOIN loads l USING (load_id)
      LEFT JOIN profiles b ON b.load_id = l.prior_load_id AND b.field_id = p.field_id
      LEFT JOIN levels lb ON lb.load_id = l.prior_load_id AND lb.field_id = p.field_id)
    SELECT load_id, field_id, 'value_range' AS issue_code FROM both_ WHERE n_outside > 0
    UNION ALL SELECT load_id, field_id, 'pattern' FROM both_ WHERE n_pattern > 0
    UNION ALL SELECT load_id, field_id, 'null_rate' FROM both_ WHERE abs(n_null / n_rows - n_null_b / n_rows_b) > 0.15
    UNION ALL SELECT load_id, field_id, 'distinct_count' FROM both_ WHERE n_distinct < 0.6 * n_distinct_b OR n_distinct > 1.7 * n_distinct_b
    UNION ALL SELECT load_id, field_id, 'distribution' FROM both_
      WHERE CASE WHEN field_id = 'quoted' THEN abs(level - level_b) > 0.08 WHEN level_b <> 0 THEN level / level_b > 1.25 OR level / level_b < 0.8 ELSE FALSE END""",
}
