"""Declarative mapping of a vendor's columns to canonical fields, compiled to one projection."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoteloom.functions import scalars as S
from quoteloom.operators.tables import melt_wide

# The type of each canonical field; all others are text.
NUMBERS = {"premium", "compulsory_excess", "cashback", "buildings_sum_insured", "contents_sum_insured", "voluntary_excess"}
WHOLE = {"rank_on_page", "year_built", "bedrooms", "claims_last_5y"}
FLAGS = {"quoted", "accidental_damage", "flood_history", "subsidence_history"}
DATES = {"collected_on"}

# Spellings of the closed domains; a spec's own go before them.
SPELLINGS: dict[str, dict[str, str]] = {
    "policy_type": {"buildings only": "buildings", "buildings": "buildings", "contents only": "contents", "contents": "contents", "combined": "combined", "buildings and contents": "combined", "buildings & contents": "combined", "home": "combined"},
    "occupancy": {"owner occupied": "owner_occupied", "owner-occupied": "owner_occupied", "main residence": "owner_occupied", "let": "let", "landlord": "let", "tenanted": "let", "second home": "second_home", "holiday home": "second_home", "unoccupied": "unoccupied", "vacant": "unoccupied"},
    "channel": {"direct": "direct", "insurer direct": "direct", "own site": "direct", "compare the market": "pcw_ctm", "comparethemarket": "pcw_ctm", "ctm": "pcw_ctm", "moneysupermarket": "pcw_msm", "money supermarket": "pcw_msm", "msm": "pcw_msm", "confused": "pcw_confused", "confused.com": "pcw_confused", "gocompare": "pcw_gocompare", "go compare": "pcw_gocompare"},
}

#: Words of a header that name its field; of those that fit the longest decides, then the first.
NAME_HINTS: list[tuple[str, str]] = [
    ("postcode", r"post ?code|pcode|postal|zip"),
    ("bedrooms", r"bedrooms?|beds?"),
    ("year_built", r"year built|built|construction year|build year"),
    ("voluntary_excess", r"voluntary excess|excess|\bxs\b|deductible"),
    ("underwriter", r"underwriter|underwrit|carrier|written by"),
    ("incentive_note", r"offer|promotion|promo|incentive|gift"),
    ("cashback", r"cash ?back|cash|reward|rebate"),
    ("rank_on_page", r"rank|position|place"),
    ("collected_on", r"quote ?date|date|\bday\b|collected"),
    ("quoted", r"outcome|result|flag|response ?type|status|decision"),
    ("premium", r"premium|price|cost|amount|payable"),
    ("channel", r"channel|site|route|where|aggregator"),
    ("brand", r"brand|insurer|company|provider"),
    ("building_type", r"building ?type|building|dwelling|house|property ?type|home type"),
    ("risk_id", r"risk ?id|risk|case|profile|property ?ref"),
    ("quote_ref", r"quote ?ref(?:erence)?|quote|enquiry|reference|\bref\b|\bkey\b"),
]


def hinted_field(name: str) -> str | None:
    """The field whose hint covers most of a header's words; the first of equals."""
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).replace("_", " ").lower()
    best, most = None, 0
    for field_id, hint in NAME_HINTS:
        longest = max((len(m.group()) for m in re.finditer(hint, words)), default=0)
        if longest > most:
            best, most = field_id, longest
    return best


@dataclass
class VendorSpec:
    """Columns by canonical field, and facts that are declared and never inferred."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    values: dict[str, dict[str, str]] = field(default_factory=dict)
    brand_columns: list[str] = field(default_factory=list)
    blank_means: str = "absent"
    date_format: str | None = None
    channel_default: str | None = None
    premium_basis: str = "annual"
    premium_includes_ipt: bool = True
    declines_included: bool | None = None
    truncated_to_top_n: int | None = None

    def __post_init__(self):
        if self.premium_basis not in ("annual", "monthly"):
            raise ValueError(f"premium_basis must be annual or monthly, not {self.premium_basis!r}")

    @classmethod
    def from_dict(cls, d: dict) -> VendorSpec:
        unknown = set(d) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"a spec has no {sorted(unknown)}")
        return cls(**d)

    @classmethod
    def from_yaml(cls, path: str) -> VendorSpec:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False, allow_unicode=True))


def spelled(text: Column, spellings: dict[str, str]) -> Column:
    """The canonical value of a spelling; canonical values spell themselves; null for any other."""
    every = {v: v for v in spellings.values()} | {" ".join(k.lower().split()): v for k, v in spellings.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), S.norm_token(text))


def _reading(spec: VendorSpec, name: str, c: Column) -> Column:
    own = spec.values.get(name)
    if name in NUMBERS:
        return S.to_float(c)
    if name in WHOLE:
        return S.to_int(c)
    if name in FLAGS:
        if not own:
            return S.to_bool(c)
        said = spelled(c, {k: str(v).lower() for k, v in own.items()})
        return F.coalesce(said == "true", S.to_bool(c))
    if name in DATES:
        return F.try_to_date(F.trim(c), spec.date_format) if spec.date_format else S.day_first_date(c)
    if name in SPELLINGS or own:
        return spelled(c, SPELLINGS.get(name, {}) | (own or {}))
    return F.nullif(F.trim(c), F.lit(""))


def apply_spec(source: DataFrame, spec: VendorSpec, registry: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Canonical rows: one projection of the source's columns, declared facts applied to the price, the outcome inferred where absent.

    ``registry`` (brand, underwriter) resolves brands by their keys, and ``aliases`` (spec_name, alias_text, brand) the short names
    of this spec; unresolved ones are null, with the text kept in brand_raw, as the file's own underwriter is in underwriter_raw. ``unread`` names the fields whose text was there and could not be read. Columns that the
    source lacks are null. Declines carry no price. A wide layout is melted first.
    """
    if spec.brand_columns:
        keep = [c for c in source.columns if c not in spec.brand_columns]
        source = melt_wide(source, keep, spec.brand_columns, blank=spec.blank_means).withColumn("quoted", F.col("quoted").cast("string"))
        spec = VendorSpec(**{**asdict(spec), "columns": {"brand": "brand", "premium": "premium_text", "quoted": "quoted", **spec.columns}, "brand_columns": []})
    have = {c.lower(): c for c in source.columns}
    text = {f: F.col(f"`{have[c.lower()]}`").cast("string") for f, c in spec.columns.items() if c.lower() in have}
    read = {f: _reading(spec, f, c) for f, c in text.items()}
    empty = lambda c: c.isNull() | (F.trim(c) == "") | F.lower(F.trim(c)).isin("-", "n/a", "na")
    unread = F.array_compact(F.array(*[F.when(~empty(text[f]) & read[f].isNull(), F.lit(f)) for f in read]))
    absent = {f: F.lit(None).cast("string") for f in spec.columns if f not in read}
    out = source.select(*[c.alias(f) for f, c in (read | absent).items()], unread.alias("unread"))
    for f, kind in (("premium", "double"), ("quoted", "boolean"), ("channel", "string"), ("brand", "string")):
        if f not in out.columns:
            out = out.withColumn(f, F.lit(None).cast(kind))
    if spec.channel_default:
        out = out.withColumn("channel", F.coalesce("channel", F.lit(spec.channel_default)))
    factor = (12.0 if spec.premium_basis == "monthly" else 1.0) * (1.0 if spec.premium_includes_ipt else 1.12)
    out = out.withColumn("premium", F.col("premium").cast("double") * factor).withColumn("quoted", F.coalesce(F.col("quoted").cast("boolean"), F.col("premium").isNotNull()))
    out = out.withColumn("premium", F.when(F.col("quoted"), F.col("premium")))
    if registry is None:
        return out
    names = registry.select(F.col("brand").alias("name_"), F.col("underwriter").alias("under_"), S.brand_key(F.col("brand")).alias("key_"))
    if aliases is not None:
        short = aliases.where(F.col("spec_name") == spec.name).select(F.col("brand").alias("name_"), S.brand_key(F.col("alias_text")).alias("key_"))
        names = names.unionByName(short.join(names.select("name_", "under_"), "name_").select("name_", "under_", "key_"))
    names = names.groupBy("key_").agg(F.min(F.struct("name_", "under_")).alias("n_")).select("key_", "n_.*")
    if "underwriter" in out.columns:
        out = out.withColumn("underwriter_raw", F.col("underwriter"))
    out = out.withColumn("brand_raw", F.col("brand")).withColumn("key_", S.brand_key(F.col("brand"))).join(F.broadcast(names), "key_", "left")  # a row a provider
    return out.drop("key_", "brand", "underwriter").withColumnsRenamed({"name_": "brand", "under_": "underwriter"})


def unread_summary(canonical: DataFrame) -> DataFrame:
    """(field, n): how often each field's text could not be read."""
    return canonical.select(F.explode("unread").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def spec_problems(source: DataFrame, spec: VendorSpec, canonical: DataFrame) -> DataFrame:
    """(kind, name, n): columns that the source lacks, columns overlooked though a name hints at a field, texts that could not be read, brands not resolved and underwriters that differ from the registry's."""
    have = {c.lower() for c in source.columns}
    used = {c.lower() for c in spec.columns.values()} | {c.lower() for c in spec.brand_columns}
    fixed = [("missing", c, None) for c in spec.columns.values() if c.lower() not in have]
    fixed += [("overlooked", c, None) for c in source.columns if c.lower() not in used and (f := hinted_field(c)) and f not in spec.columns]
    known = canonical.sparkSession.createDataFrame(fixed, "kind string, name string, n long")
    out = known.unionByName(unread_summary(canonical).select(F.when(F.col("field") == "quoted", "status").otherwise("unread").alias("kind"), F.col("field").alias("name"), "n"))
    if "brand_raw" in canonical.columns:
        lost = canonical.where("brand is null and brand_raw is not null").groupBy("brand_raw").agg(F.count("*").alias("n"))
        out = out.unionByName(lost.select(F.lit("brand").alias("kind"), F.col("brand_raw").alias("name"), "n"))
    if {"underwriter", "underwriter_raw"} <= set(canonical.columns):
        other = canonical.where(S.norm_token(F.col("underwriter")) != S.norm_token(F.col("underwriter_raw"))).groupBy("brand").agg(F.count("*").alias("n"))
        out = out.unionByName(other.select(F.lit("underwriter").alias("kind"), F.col("brand").alias("name"), "n"))
    return out


def draft_spec(source: DataFrame, name: str) -> tuple[VendorSpec, list[str]]:
    """A spec guessed from the headers, the first column of each guess, and the columns that no field was found for."""
    columns: dict[str, str] = {}
    rest = []
    for c in source.columns:
        f = hinted_field(c)
        if f and f not in columns:
            columns[f] = c
        else:
            rest.append(c)
    return VendorSpec(name, columns), rest
