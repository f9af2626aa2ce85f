"""Queries of the problems on text and large groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.llm import language, leakage, mapping, mixing, percentiles, topn
from quoteloom.session import checkpointed, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.cheapest_brands(table(spark, d, "quotes")).select("risk_id", "rank_no", "quote_id")


def _sides(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("vendor_quotes", "providers", "brand_aliases", "building_types")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mapping.map_values(*_sides(spark, d))


def p3_misses(spark: SparkSession, d: str) -> DataFrame:
    """What no entry was found for, with how often it stands."""
    missed = mapping.mapped_values(*_sides(spark, d))[1].where(F.col("mapped_to") == mapping.UNMATCHED)
    return missed.groupBy("field_id", "text").agg(F.sum("n").alias("n"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaked spans removed."""
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return leakage.without_leaks(documents, leakage.find_leaks(documents, table(spark, d, "eval_items")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_issues(table(spark, d, "documents")).select("doc_id", "para_no", "lang")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and paragraph with its language and confidence."""
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.labelled_sample(documents))
    return language.detect(documents, model).drop("doc_lang")


SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of premium by brand and channel, over the runs of all loads put together."""
    runs = percentiles.value_runs(table(spark, d, "quotes"), ["brand", "channel"], "premium")
    return percentiles.multi_select(runs, ["brand", "channel"], SHARES)


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles from runs that were stored by load, put together by brand and channel."""
    stored = checkpointed(percentiles.value_runs(table(spark, d, "quotes"), ["load_id", "brand", "channel"], "premium"))
    return percentiles.multi_select(percentiles.merged_runs(stored, ["brand", "channel"]), ["brand", "channel"], SHARES)


def p4_by_load(spark: SparkSession, d: str) -> DataFrame:
    """Medians by load and channel."""
    runs = percentiles.value_runs(table(spark, d, "quotes"), ["load_id", "channel"], "premium")
    return percentiles.multi_select(runs, ["load_id", "channel"], [0.5]).drop("percentile")


def p4_by_channel(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by channel, whose groups go through many rounds of pivots at any size of the data."""
    runs = percentiles.value_runs(table(spark, d, "quotes"), ["channel"], "premium")
    return percentiles.multi_select(runs, ["channel"], SHARES)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = checkpointed(mixing.token_counts(table(spark, d, "documents")))
    return mixing.mixture(sizes, table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].orderBy("finish", "doc_id", "copy_no")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(*_mixed(spark, d))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_misses": p3_misses, "p4_percentiles": p4_percentiles, "p4_combined": p4_combined, "p4_by_load": p4_by_load, "p4_by_channel": p4_by_channel, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p10_found": p10_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_languages": p10_languages}



def _percentiles_sql(groups: str) -> str:
    return " UNION ALL ".join(f"SELECT {groups}, CAST({p} AS DOUBLE) AS percentile, quantile_cont(premium, {p}) AS value, count(*) AS n_values FROM quotes WHERE premium IS NOT NULL AND NOT isnan(premium) GROUP BY {groups}" for p in SHARES)


SQL: dict[str, str] = {
    "p2_found": """
        WITH priced AS (
          SELECT risk_id, brand, premium, collected_on, channel, quote_id,
                 row_number() OVER (PARTITION BY risk_id, brand ORDER BY premium, collected_on, channel, quote_id) AS n
          FROM quotes WHERE quoted AND premium > 0 AND NOT isnan(premium) AND brand IS NOT NULL),
        ranked AS (
          SELECT risk_id, quote_id, row_number() OVER (PARTITION BY risk_id ORDER BY premium, brand) AS rank_no FROM priced WHERE n = 1)
        SELECT risk_id, CAST(rank_no AS INTEGER) AS rank_no, quote_id FROM ranked WHERE rank_no <= 5""",
    "p4_percentiles": _percentiles_sql("brand, channel"),
    "p4_combined": _percentiles_sql("brand, channel"),
    "p4_by_channel": _percentiles_sql("channel"),
    "p4_by_load": """
        SELECT load_id, channel, quantile_cont(premium, 0.5) AS value, count(*) AS n_values FROM quotes WHERE premium IS NOT NULL AND NOT isnan(premium) GROUP BY load_id, channel""",
}
