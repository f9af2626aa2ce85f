"""Scalar functions as Column expressions: text, money, flags, dates, postcodes, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies of a flag.
TRUE_WORDS = ["y", "yes", "true", "1", "t", "included", "quoted"]
FALSE_WORDS = ["n", "no", "false", "0", "f", "excluded", "declined", "refused", "referred"]

# Words without identity in a brand's name, removed in this order.
BRAND_NOISE = ["home insurance", "buildings and contents", "buildings", "contents", "insurance", "underwriting", "limited", "ltd", "plc", "uk", "group", "the", "com"]

# Postcode grammar, and the areas mostly in Scotland.
POSTCODE = r"^([A-PR-UWYZ][A-HK-Y]?)([0-9][0-9]?|[0-9][A-HJKPS-UW])([0-9])([ABD-HJLNP-UW-Z]{2})$"
SCOTLAND = ["AB", "DD", "DG", "EH", "FK", "G", "HS", "IV", "KA", "KW", "KY", "ML", "PA", "PH", "TD", "ZE"]


def nan_to_null(value: Column) -> Column:
    """A float with NaN as null: Spark orders NaN above all numbers and lets it into means and medians."""
    return F.when(~F.isnan(value), value)


def norm_token(text: Column) -> Column:
    """Trimmed, lower case, inner white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def to_bool(text: Column) -> Column:
    """True, false, or null for a word of neither vocabulary."""
    t = norm_token(text)
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def to_float(text: Column) -> Column:
    """A money-like text as a double: pound, dollar, commas and blanks dropped; no number, no value."""
    t = F.regexp_replace(text, r"[£$,\s]", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def to_int(text: Column) -> Column:
    """``to_float`` rounded half to even."""
    return F.bround(to_float(text)).cast("int")


def day_first_date(text: Column) -> Column:
    """A date from the usual layouts, day before month; null if none fits."""
    t = F.trim(text)
    one = lambda pattern, fmt: F.when(t.rlike(pattern), F.try_to_date(t, fmt))
    return F.coalesce(one(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), one(r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), one(r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), one(r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), one(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"), one(r"^\d{8}$", "yyyyMMdd"))


def brand_key(text: Column) -> Column:
    """A brand's comparison key: lower case letters and digits, noise words removed, blanks collapsed."""
    t = F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " ")
    for noise in BRAND_NOISE:
        t = F.regexp_replace(t, rf"\b{noise}\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def period_start(day: Column, period: str) -> Column:
    """``day`` itself, the Monday of its week, or the first of its month."""
    if period == "day":
        return day.cast("date")
    if period not in ("week", "month"):
        raise ValueError(f"period must be day, week or month, not {period!r}")
    return F.date_trunc(period, day).cast("date")


def postcode_parts(text: Column) -> dict[str, Column]:
    """postcode, area, district, outcode, sector, incode, unit and postcode_valid of a text; all null but the last if invalid."""
    t = F.regexp_replace(F.upper(text), r"[^A-Z0-9]", "")
    special = t == "GIR0AA"
    valid = F.coalesce(special | t.rlike(POSTCODE), F.lit(False))
    part = lambda k: F.regexp_extract(t, POSTCODE, k)
    pick = lambda c, fixed: F.when(special, F.lit(fixed)).when(valid, c)
    return {
        "postcode": pick(F.concat(part(1), part(2), F.lit(" "), part(3), part(4)), "GIR 0AA"),
        "area": pick(part(1), "GIR"),
        "district": pick(part(2), ""),
        "outcode": pick(F.concat(part(1), part(2)), "GIR"),
        "sector": pick(F.concat(part(1), part(2), F.lit(" "), part(3)), "GIR 0"),
        "incode": pick(F.concat(part(3), part(4)), "0AA"),
        "unit": pick(part(4), "AA"),
        "postcode_valid": valid,
    }


def scotland_or_ni(area: Column) -> Column:
    return F.coalesce(area.isin([*SCOTLAND, "BT"]), F.lit(False))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from md5 of the parts joined by bars: the same in any engine and any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
