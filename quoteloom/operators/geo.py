"""Features joined by place: reference tables by postcode, sector or area, coverage flags and a gate before modelling."""

from __future__ import annotations

import csv
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoteloom.functions.scalars import postcode_parts
from quoteloom.operators.tables import first_per, percentile_rank


def with_postcode_parts(df: DataFrame, column: str = "postcode") -> DataFrame:
    """postcode (normalised), postcode_raw, outcode, sector, area, postcode_valid; earlier ones are replaced."""
    parts = postcode_parts(F.col(column))
    kept = df.drop("postcode_raw", "outcode", "sector", "area", "postcode_valid") if column == "postcode" else df
    return kept.withColumns({"postcode_raw": F.col(column), "postcode": parts["postcode"], "outcode": parts["outcode"], "sector": parts["sector"], "area": parts["area"], "postcode_valid": parts["postcode_valid"]})


def sector_values(sales: DataFrame, *, least: float = 10_000, most: float = 20_000_000, min_sales: int = 5, since_year: int | None = None) -> DataFrame:
    """(sector, area_avg_value): the median price of sectors with enough sales within bounds. ``sales``: postcode, price, date."""
    s = sales.where(F.col("price").between(least, most))
    if since_year is not None:
        s = s.where(F.year("date") >= since_year)
    s = s.withColumn("sector", postcode_parts(F.col("postcode"))["sector"]).where("sector is not null")
    return s.groupBy("sector").agg(F.median("price").alias("area_avg_value"), F.count("*").alias("n")).where(F.col("n") >= min_sales).drop("n")


def flood_bands(counts: DataFrame) -> DataFrame:
    """(postcode, flood_band, flood_high_share): the highest occupied of four bands and the share in the upper two; the worst row of a postcode."""
    c = {b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in ("very_low", "low", "medium", "high")}
    band = F.greatest(*[F.when(v > 0, float(k)).otherwise(0.0) for k, v in enumerate(c.values())])
    total = c["very_low"] + c["low"] + c["medium"] + c["high"]
    share = F.when(total > 0, (c["medium"] + c["high"]) / total).otherwise(0.0)
    return counts.withColumn("postcode", postcode_parts(F.col("postcode"))["postcode"]).where("postcode is not null").groupBy("postcode").agg(F.max(band).alias("flood_band"), F.max(share).alias("flood_high_share"))


def subsidence(rows: DataFrame) -> DataFrame:
    """(postcode, subsidence_band): the highest band of a postcode. ``rows``: postcode, band."""
    return rows.withColumn("postcode", postcode_parts(F.col("postcode"))["postcode"]).where("postcode is not null").groupBy("postcode").agg(F.max(F.col("band").cast("double")).alias("subsidence_band"))


def deprivation(rows: DataFrame, key: str = "postcode") -> DataFrame:
    return rows.groupBy(key).agg(F.median("decile").alias("imd_decile"))


def crime_index(crimes: DataFrame) -> DataFrame:
    """(lsoa, crime_index): percentile rank of the count of crimes, ties at their mean."""
    return percentile_rank(crimes.where("lsoa is not null").groupBy("lsoa").agg(F.count("*").alias("n")), "n", "crime_index").drop("n")


def area_bridge(rows: DataFrame) -> DataFrame:
    """(postcode, lsoa): one area a postcode, the least by name."""
    return first_per(rows.select(postcode_parts(F.col("postcode"))["postcode"].alias("postcode"), "lsoa").where("postcode is not null"), ["postcode"], ["lsoa"])


def enrich(risks: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Left joins of keyed tables, each column with a ``_resolved`` flag. A missing value stays missing.

    ``sources``: (key, table unique on it). Tables that supply a key of others come first. Columns that risks
    already have are replaced, so enriching twice is enriching once.
    """
    out = risks
    for key, source in sorted(sources, key=lambda s: "lsoa" not in s[1].columns or s[0] == "lsoa"):
        values = [c for c in source.columns if c != key]
        out = out.drop(*values, *[f"{v}_resolved" for v in values]).join(source, key, "left").withColumns({f"{v}_resolved": F.col(v).isNotNull() for v in values})
    return out


def resolved_coverage(enriched: DataFrame) -> DataFrame:
    """(column, resolved_pct, n_missing) of every ``_resolved`` flag."""
    flags = [c for c in enriched.columns if c.endswith("_resolved")]
    one = enriched.agg(*[F.struct((F.avg(F.col(c).cast("int")) * 100).alias("p"), F.count_if(~F.col(c)).alias("m")).alias(c) for c in flags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_resolved")).alias("column"), F.col(f"{c}.p").alias("resolved_pct"), F.col(f"{c}.m").alias("n_missing")) for c in flags])).alias("r")).select("r.*")


def check_ready(enriched: DataFrame, *, min_resolved: float = 95.0) -> None:
    """Raises with the columns resolved for less than ``min_resolved`` percent of the rows."""
    short = [(r.column, round(r.resolved_pct or 0.0, 1)) for r in resolved_coverage(enriched).where(F.coalesce("resolved_pct", F.lit(0.0)) < min_resolved).collect()]  # a row a column
    if short:
        raise ValueError(f"not ready for modelling: {short}")


# ---- files ----------------------------------------------------------------------------------------------------

#: The flood bands' names, from the lowest.
FLOOD_BANDS = ["very low", "low", "medium", "high"]
#: A reference file's name by source.
FILES = {"flood": "ea_flood.csv", "sales": "price_paid.csv", "deprivation": "imd.csv", "crimes": "police", "bridge": "onspd.csv", "subsidence": "subsidence.csv"}


def pick_column(columns: list[str], candidates: list[str], what: str) -> str:
    """The first candidate that is a column, letter case aside; an error names the columns there are."""
    have = {c.lower().strip(): c for c in columns}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    if found is None:
        raise ValueError(f"no column holds the {what}; there are {', '.join(columns)}")
    return found


def band_columns(columns: list[str]) -> dict[str, str]:
    """Flood band -> column: equal names first, then the longest band contained in a name; no column twice ("very low" holds "low")."""
    plain = {c: re.sub(r"[^a-z]", "", c.lower()) for c in columns}
    out: dict[str, str] = {}
    for exact in (True, False):
        for band in sorted(FLOOD_BANDS, key=len, reverse=True):
            key = band.replace(" ", "")
            hit = next((c for c in columns if c not in out.values() and (plain[c] == key if exact else key in plain[c])), None)
            if band not in out and hit:
                out[band] = hit
    return out


def _head(path: str) -> list[str]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        return next(csv.reader(f), [])


def _csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, header=True)


def load_flood(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    bands = band_columns(raw.columns)
    count = lambda band: F.col(f"`{bands[band]}`").try_cast("double") if band in bands else F.lit(0.0)
    return flood_bands(raw.select(F.col(f"`{pick_column(raw.columns, ['postcode', 'post_code', 'pcds'], 'postcode')}`").alias("postcode"), *[count(b).alias(b.replace(" ", "_")) for b in FLOOD_BANDS]))


def load_sales(spark: SparkSession, path: str, **bounds) -> DataFrame:
    """Sales by sector. A first line of 15 cells or more whose second is no word has no names: its second to fourth cells are price, date and postcode."""
    first = _head(path)
    if len(first) >= 15 and not re.fullmatch(r"[A-Za-z _]+", first[1].strip() or "x"):
        raw = spark.read.csv(path, header=False)
        at = {"price": raw.columns[1], "date": raw.columns[2], "postcode": raw.columns[3]}
    else:
        raw = _csv(spark, path)
        at = {"price": pick_column(raw.columns, ["price", "price_paid"], "price"), "date": pick_column(raw.columns, ["date_of_transfer", "date", "deed_date"], "date"), "postcode": pick_column(raw.columns, ["postcode"], "postcode")}
    rows = raw.select(F.col(f"`{at['postcode']}`").alias("postcode"), F.col(f"`{at['price']}`").try_cast("double").alias("price"), F.try_to_date(F.substring(F.col(f"`{at['date']}`"), 1, 10), "yyyy-MM-dd").alias("date"))
    return sector_values(rows, **bounds)


def load_deprivation(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    decile = next((c for c in raw.columns if "decile" in c.lower()), None)
    if decile is None:
        raise ValueError(f"no column holds the decile; there are {', '.join(raw.columns)}")
    key = pick_column(raw.columns, ["postcode", "lsoa", "lsoa code", "lsoa11", "lsoa21"], "place")
    if key.lower() == "postcode":
        return deprivation(raw.select(postcode_parts(F.col(f"`{key}`"))["postcode"].alias("postcode"), F.col(f"`{decile}`").try_cast("double").alias("decile")).where("postcode is not null"))
    return deprivation(raw.select(F.col(f"`{key}`").alias("lsoa"), F.col(f"`{decile}`").try_cast("double").alias("decile")), "lsoa")


def load_crimes(spark: SparkSession, folder: str) -> DataFrame:
    """The crime index of all street files below a folder; files without a column of areas are passed over, a folder without any is an error."""
    files = sorted(str(p) for p in Path(folder).rglob("*street.csv"))
    column = lambda p: next((c for c in _head(p) if c.lower().strip() in ("lsoa code", "lsoa_code", "lsoa")), None)
    with_area = {p: c for p in files if (c := column(p))}
    if not with_area:
        raise ValueError(f"no street file below {folder} has a column of areas")
    out = None
    for name in sorted(set(with_area.values())):
        one = _csv(spark, [p for p, c in with_area.items() if c == name]).select(F.col(f"`{name}`").alias("lsoa"))
        out = one if out is None else out.unionByName(one)
    return crime_index(out)


def load_bridge(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    return area_bridge(raw.select(F.col(f"`{pick_column(raw.columns, ['pcds', 'postcode', 'pcd'], 'postcode')}`").alias("postcode"), F.col(f"`{pick_column(raw.columns, ['lsoa21', 'lsoa11', 'lsoa'], 'area')}`").alias("lsoa")))


def load_subsidence(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    return subsidence(raw.select(F.col(f"`{pick_column(raw.columns, ['postcode', 'post_code'], 'postcode')}`").alias("postcode"), F.col(f"`{pick_column(raw.columns, ['subsidence_band', 'band', 'susceptibility'], 'subsidence band')}`").try_cast("double").alias("band")))


LOADERS = {"flood": load_flood, "sales": load_sales, "deprivation": load_deprivation, "crimes": load_crimes, "bridge": load_bridge, "subsidence": load_subsidence}


def missing_files(folder: str) -> list[str]:
    """The sources whose file a folder lacks."""
    return [name for name, f in FILES.items() if not (Path(folder) / f).exists()]


def default_sources(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    """(key, table) of the sources whose file is there, as ``enrich`` takes them."""
    out = []
    for name in FILES:
        if name not in missing_files(folder):
            t = LOADERS[name](spark, str(Path(folder) / FILES[name]))
            out.append((next(k for k in ("sector", "postcode", "lsoa") if k in t.columns), t))
    return out
