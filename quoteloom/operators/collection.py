"""From canonical rows to validated risks and quotes, and collection sessions: the grid to fill in, what came back, and why rows fell out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoteloom.functions import scalars as S
from quoteloom.operators.tables import conflicts, first_per, grid

# The closed domains of a risk and a channel, and defaults of what a record may leave out.
POLICY_TYPES = ["buildings", "contents", "combined"]
BUILDING_TYPES = ["detached", "semi_detached", "terraced", "end_terrace", "flat", "bungalow"]
CONSTRUCTIONS = ["standard", "non_standard_walls", "non_standard_roof", "listed"]
OCCUPANCIES = ["owner_occupied", "let", "second_home", "unoccupied"]
CHANNELS = ["direct", "pcw_ctm", "pcw_msm", "pcw_confused", "pcw_gocompare"]
RISK_DEFAULTS: dict[str, object] = {"construction": "standard", "occupancy": "owner_occupied", "claims_last_5y": 0, "flood_history": False, "subsidence_history": False, "in_basket": False}
RISK_COLUMNS = ["risk_id", "postcode", "policy_type", "building_type", "construction", "occupancy", "year_built", "bedrooms", "buildings_sum_insured", "contents_sum_insured", "voluntary_excess", "claims_last_5y", "flood_history", "subsidence_history", "in_basket"]
QUOTE_COLUMNS = ["risk_id", "brand", "underwriter", "channel", "collected_on", "source", "quoted", "premium", "compulsory_excess", "accidental_damage", "rank_on_page", "cashback", "incentive_note", "collector_note"]
SESSION_COLUMNS = ["risk_id", "brand", "channel", "collected_on", "quoted", "premium", "compulsory_excess", "accidental_damage", "rank_on_page", "cashback", "incentive_note", "collector_note"]


def risk_rules() -> dict[str, Column]:
    """What a risk must satisfy, by name; a rule that is null is broken."""
    c = F.col
    bare = F.length(F.regexp_replace(c("postcode"), r"\s", ""))
    covers = lambda kinds, column: ~c("policy_type").isin(kinds) | (F.coalesce(c(column), F.lit(0.0)) > 0)
    return {
        "postcode": bare >= 5, "policy_type": c("policy_type").isin(POLICY_TYPES), "building_type": c("building_type").isin(BUILDING_TYPES), "construction": c("construction").isin(CONSTRUCTIONS), "occupancy": c("occupancy").isin(OCCUPANCIES),
        "year_built": c("year_built").between(1000, 2100), "bedrooms": c("bedrooms").between(1, 20), "voluntary_excess": c("voluntary_excess") >= 0, "claims_last_5y": c("claims_last_5y") >= 0,
        "buildings_sum_insured": covers(["buildings", "combined"], "buildings_sum_insured"), "contents_sum_insured": covers(["contents", "combined"], "contents_sum_insured"),
    }


def quote_rules() -> dict[str, Column]:
    c = F.col
    least = lambda column, least: F.coalesce(c(column), F.lit(least)) >= least
    return {
        "brand": c("brand").isNotNull(), "channel": c("channel").isin(CHANNELS), "collected_on": c("collected_on").isNotNull(), "quoted": c("quoted").isNotNull(),
        "premium": F.when(c("quoted"), c("premium") >= 0).otherwise(c("premium").isNull()), "compulsory_excess": least("compulsory_excess", 0.0), "cashback": least("cashback", 0.0), "rank_on_page": least("rank_on_page", 1),
    }


def with_problem(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``problem``: the names of the rules broken, joined by bars; null for sound rows. Rules on columns that are absent are passed over."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items() if name in rows.columns]))
    return rows.withColumn("problem", F.nullif(F.array_join(broken, "|"), F.lit("")))


def with_defaults(rows: DataFrame, defaults: dict[str, object] = RISK_DEFAULTS) -> DataFrame:
    """Nulls and NaN of columns with a default replaced by it."""
    floats = {f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")}
    clean = rows.withColumns({c: S.nan_to_null(F.col(c)) for c in floats})
    return clean.withColumns({c: F.coalesce(c, F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def to_records(canonical: DataFrame, *, order: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(risks, quotes, problems) of canonical rows: one row a risk (the first by ``order``), quotes of sound risks only.

    Rows without a risk or brand are left out; declines lose a price. ``problems`` is (kind, problem, n): unresolved
    brands, declines with a price, attributes that differ within a risk, and the rules that risks and quotes break.
    Quotes of a risk that is not sound fall with it. Empty input gives three empty tables, but for counts of zero.
    """
    c = F.col
    rows = canonical.where("risk_id is not null")
    premium = S.nan_to_null(c("premium"))
    kept = rows.where("brand is not null").withColumn("premium", F.when(c("quoted"), premium))
    attributes = [x for x in RISK_COLUMNS if x in canonical.columns]
    tie = order or [x for x in attributes if x != "risk_id"]
    first = first_per(kept.select(*dict.fromkeys([*attributes, *tie])), ["risk_id"], tie).select(*attributes)
    risks = with_problem(with_defaults(first), risk_rules())
    sound = risks.where("problem is null").drop("problem")
    quotes = with_problem(kept.select(*[x for x in QUOTE_COLUMNS if x in kept.columns]), quote_rules()).join(sound.select("risk_id"), "risk_id", "left_semi")
    one = rows.agg(F.count_if(c("brand").isNull()).alias("no_brand"), F.count_if(c("brand").isNotNull() & ~c("quoted") & premium.isNotNull()).alias("priced_decline"))
    counted = one.select(F.explode(F.array(*[F.struct(F.lit("rows").alias("kind"), F.lit(x).alias("problem"), c(x).alias("n")) for x in ("no_brand", "priced_decline")])).alias("p")).select("p.*")
    differing = conflicts(kept, "risk_id", [x for x in attributes if x != "risk_id"]).select(F.lit("conflict").alias("kind"), c("column").alias("problem"), c("n_conflicting").alias("n"))
    each = lambda df, kind: df.where("problem is not null").select(F.lit(kind).alias("kind"), F.explode(F.split("problem", r"\|")).alias("problem")).groupBy("kind", "problem").agg(F.count("*").alias("n"))
    problems = counted.unionByName(differing).unionByName(each(risks, "risk")).unionByName(each(quotes, "quote"))
    return sound, quotes.where("problem is null").drop("problem"), problems.where("n > 0")


def session_template(risks: DataFrame, channels: DataFrame, brands: DataFrame, collected_on) -> DataFrame:
    """The grid to fill in: a row per risk, channel and brand, the answers empty, in that order."""
    cells = grid(risks.select("risk_id"), channels.select("channel"), brands.select("brand")).withColumn("collected_on", F.lit(collected_on).cast("date"))
    return cells.select(*[F.col(x) if x in cells.columns else F.lit(None).cast("string").alias(x) for x in SESSION_COLUMNS]).orderBy("risk_id", "channel", "brand")


def session_to_canonical(rows: DataFrame, risks: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, problems) of a filled-in grid: rows of defined risks and brands of the registry, by their keys, with the underwriter.

    ``problems``: risk_id, brand, problem. A row is told its first problem only: its risk, its brand, then the rules of a quote.
    """
    names = F.broadcast(registry.select(F.col("brand").alias("name_"), F.col("underwriter").alias("under_"), S.brand_key(F.col("brand")).alias("key_")).dropDuplicates(["key_"]))  # a row a provider
    known = risks.select(F.col("risk_id").alias("known_")).distinct()
    both = rows.drop("underwriter").withColumn("key_", S.brand_key(F.col("brand"))).join(names, "key_", "left").join(known, F.col("risk_id") == F.col("known_"), "left")
    both = both.withColumns({"brand_raw": F.col("brand"), "brand": F.col("name_"), "underwriter": F.col("under_")})
    judged = with_problem(both, {k: v for k, v in quote_rules().items() if k != "brand"})
    why = F.when(F.col("known_").isNull(), "the risk has no definition").when(F.col("brand").isNull(), "the brand is not in the registry").otherwise(F.col("problem"))
    judged = judged.withColumn("problem", why).drop("known_", "key_", "name_", "under_")
    return judged.where("problem is null").drop("problem", "brand_raw"), judged.where("problem is not null").select("risk_id", F.col("brand_raw").alias("brand"), "problem")


def read_risk_definitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(risks, problems) of a YAML file with a list ``risks``; entries that fail are reported and left out, as is a second one of an id."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("risks") or []
    kinds = {"year_built": "int", "bedrooms": "int", "claims_last_5y": "int", "buildings_sum_insured": "double", "contents_sum_insured": "double", "voluntary_excess": "double", "flood_history": "boolean", "subsidence_history": "boolean", "in_basket": "boolean"}
    rows = [(k, *[None if not isinstance(e, dict) or e.get(c) in (None, "") else str(e[c]) for c in RISK_COLUMNS]) for k, e in enumerate(entries, 1)]
    raw = spark.createDataFrame(rows, "at_ int, " + ", ".join(f"{c} string" for c in RISK_COLUMNS))
    typed = raw.withColumns({c: F.lower(c).try_cast(t) for c, t in kinds.items()})
    judged = with_problem(with_defaults(typed), {"risk_id": F.col("risk_id").isNotNull(), **risk_rules()})
    again = F.row_number().over(Window.partitionBy("risk_id").orderBy(F.col("problem").isNotNull(), "at_")) > 1  # a file's entries
    judged = judged.withColumn("problem", F.coalesce("problem", F.when(again, "defined twice")))
    return judged.where("problem is null").drop("problem", "at_"), judged.where("problem is not null").select("risk_id", "problem")


def load_providers(spark: SparkSession, path: str) -> DataFrame:
    """(brand, underwriter, channel_list, tier) of a YAML list ``providers``; a row a brand."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("providers") or []
    rows = [(e["brand"], e.get("underwriter"), "|".join(e.get("channels") or []), e.get("tier")) for e in entries]
    return spark.createDataFrame(rows, "brand string, underwriter string, channel_list string, tier int").dropDuplicates(["brand"])


def write_risk_template(path: str, risk_id: str = "R-001") -> None:
    """A YAML file with one risk to fill in, each field with what it may hold."""
    domains = {"policy_type": POLICY_TYPES, "building_type": BUILDING_TYPES, "construction": CONSTRUCTIONS, "occupancy": OCCUPANCIES}
    with open(path, "w", encoding="utf-8") as f:
        f.write("risks:\n")
        for k, c in enumerate(RISK_COLUMNS):
            value = risk_id if c == "risk_id" else RISK_DEFAULTS.get(c, "")
            f.write(f"  {'- ' if k == 0 else '  '}{c}: {str(value).lower() if isinstance(value, bool) else value}{'  # ' + ', '.join(domains[c]) if c in domains else ''}\n")
