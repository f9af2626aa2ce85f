"""Quantities recorded in different units, brought to one unit.

An Aho-Corasick automaton over unit aliases reads the text around the numbers; the longest match at a place
wins, and where the row says nothing the declared facts of its source decide. What is found becomes a unit key
and a count, and the conversion factors, a small broadcast table, are joined on the key. The arithmetic is
exact: integers all the way, one rounding at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unit aliases. ``#`` stands for a number.
PERIOD_ALIASES: dict[str, list[str]] = {
    "month": ["per month", "a month", "each month", "every month", "monthly", "mthly", "mnthly", "p/m", "pm", "pcm", "/mo", "/month", "/mth", "per mo", "per mth", "p.m.", "per calendar month", "month"],
    "quarter": ["per quarter", "a quarter", "each quarter", "every quarter", "quarterly", "/qtr", "per qtr", "/quarter", "p/q"],
    "week": ["per week", "a week", "each week", "every week", "weekly", "pw", "p/w", "/wk", "/week", "per wk", "p.w."],
    "year": ["per year", "a year", "each year", "every year", "per annum", "p.a.", "pa", "p/a", "annual", "annually", "yearly", "/yr", "/year", "per yr", "/annum"],
    "two_years": ["for two years", "two-year price", "two year price", "biennial", "biennially", "per two years", "every two years"],
    "three_years": ["for three years", "three-year price", "three year price", "triennial"],
    "fortnight": ["per fortnight", "a fortnight", "each fortnight", "every fortnight", "fortnightly"],
    "n_months": ["for # months", "every # months", "per # months", "/# months", "# months", "#-month price", "# month price", "for # month"],
    "n_weeks": ["for # weeks", "every # weeks", "per # weeks", "/# weeks", "# weeks", "every # wks"],
    "n_years": ["for # years", "every # years", "per # years", "/# years", "/# yrs", "per # yrs", "for # yrs", "# years", "#-year price", "# year price"],
    "payments": ["# x #", "# payments of #", "# payments @ #", "# payments at #", "# instalments of #", "# installments of #", "# instalments @ #", "# monthly payments of #", "# in each of # instalments", "# in # instalments", "# times #", "# * #"],
}
SCALE_ALIASES: dict[str, list[str]] = {
    "pence": ["#p", "# p", "#pence", "# pence", "#penny", "# pennies"],
    "thousand": ["#k", "# k", "# thousand", "#thousand"],
}
TAX_ALIASES: dict[str, list[str]] = {
    "with": ["with tax", "with ipt", "incl. tax", "incl tax", "inc tax", "inc. tax", "including tax", "tax included", "incl. ipt", "incl ipt", "inc ipt", "inc. ipt", "including ipt", "ipt included", "including insurance premium tax", "inclusive of tax", "inclusive of ipt", "tax paid", "after tax", "gross of ipt"],
    "without": ["before tax", "before ipt", "plus tax", "plus ipt", "+ ipt", "+ tax", "+ipt", "tax to be added", "ipt to be added", "net of ipt", "net of tax", "ipt extra", "tax extra", "ex ipt", "ex. ipt", "ex tax", "excl. ipt", "excl ipt", "excl. tax", "excl tax", "excluding ipt", "excluding tax", "excluding insurance premium tax", "exclusive of ipt", "exclusive of tax", "without ipt", "without tax"],
}
#: Words that may stand beside a unit in a clause that states it. A clause with any other word is a remark.
PRICE_WORDS = set("price prices priced premium figure figures amount cost rate total sum quote quoted shown given stated is are was as at of the this our all in and payable due charged only approx from £".split())
#: What one number of a period's aliases means where it turns out to be the price itself.
SINGLE = {"n_months": "month", "n_weeks": "week", "n_years": "year"}

#: How one recorded figure becomes a year's. figure * num / den, and by the count as the role says.
FACTORS: list[tuple[str, int, int, str]] = [
    ("year", 1, 1, "none"), ("month", 12, 1, "none"), ("quarter", 4, 1, "none"), ("week", 52, 1, "none"), ("fortnight", 26, 1, "none"),
    ("two_years", 1, 2, "none"), ("three_years", 1, 3, "none"),
    ("n_months", 12, 1, "divide"), ("n_weeks", 52, 1, "divide"), ("n_years", 1, 1, "divide"), ("payments", 1, 1, "multiply"),
]

_NUMBER = re.compile(r"(?<![\w.])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\d])")
_CLAUSE = re.compile(r"[;()|\[\]]|,(?!\d)|\s/\s|\.\s|\s-\s")
_READ = "amount_micro long, unit_said string, unit_count long, scale string, tax_said string, too_large boolean, unread string"
#: Figures whose sums stay within 64 bits at any factor; what is larger is reported, not converted.
MOST_MICRO = 2**63 // (4 * 52 * 200)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, table in (("period", PERIOD_ALIASES), ("scale", SCALE_ALIASES), ("tax", TAX_ALIASES)):
        for key, aliases in table.items():
            for alias in aliases:
                a.add_word(alias, (len(alias), kind, key, alias))
    a.make_automaton()
    return a


def _plain(text: str) -> tuple[str, list[str], list[bool]]:
    """Text in lower case with ``#`` for each number, the numbers, and whether each carries a currency mark."""
    text = re.sub(r"\s+", " ", text.lower().replace("×", "x").replace("#", " ")).strip()
    text = re.sub(r"(?<=[\d.])\s*(?:gbp|pounds?|sterling)\b", "£", text)
    text = re.sub(r"\bgbp\s*(?=[\d.])", "£", text)
    out, numbers, marked, at = [], [], [], 0
    for m in _NUMBER.finditer(text):
        before = text[at : m.start()].rstrip() if text[at : m.start()].rstrip().endswith("£") else text[at : m.start()]
        mark = before.endswith("£")
        out.append(before[:-1] if mark else before)
        end = m.end()
        if text[end : end + 1] == "£":
            mark, end = True, end + 1
        out.append("#")
        numbers.append(m.group().replace(",", ""))
        marked.append(mark)
        at = end
    out.append(text[at:])
    return re.sub(r" +", " ", "".join(out)), numbers, marked


def _hits(plain: str) -> list[tuple[int, int, str, str, str]]:
    """Alias hits at word bounds; of overlapping ones the longest stays, of equals a period before a scale, then the earlier."""
    found = []
    for end, (n, kind, key, alias) in _automaton().iter(plain):
        start = end - n + 1
        if (alias[0].isalnum() and start and plain[start - 1].isalnum()) or (alias[-1].isalnum() and end + 1 < len(plain) and plain[end + 1].isalnum()):
            continue
        found.append((start, end + 1, kind, key, alias))
    found.sort(key=lambda h: (-(h[1] - h[0]), h[2] == "scale", h[0]))
    kept: list[tuple[int, int, str, str, str]] = []
    for h in found:
        # a scale keeps the number it follows, and so may share "#" with a period's alias
        if all(h[1] <= k[0] or h[0] >= k[1] or (h[2] != k[2] and plain[max(h[0], k[0]) : min(h[1], k[1])].strip() == "#") for k in kept):
            kept.append(h)
    return sorted(kept)


@lru_cache(maxsize=100_000)
def _stated(plain: str, marked: tuple[bool, ...], note: bool) -> tuple[list[tuple[str, str, str, list[int]]], str | None]:
    """((kind, key, alias, places of its numbers) of the hits that state something, and the words that were not read).

    A hit counts in a clause of price words and numbers alone, or where it touches the amount: any number of the
    text, but one with a currency mark in the note. All else is a remark, whatever unit its words name.
    """
    hits = _hits(plain)
    numbers = [m.start() for m in re.finditer("#", plain)]
    ends = [0, *[x for m in _CLAUSE.finditer(plain) if not any(h[0] < m.end() and m.start() < h[1] for h in hits) for x in m.span()], len(plain)]
    out, unread = [], []
    for start, stop in zip(ends[::2], ends[1::2]):
        inside = [h for h in hits if start <= h[0] < stop]
        rest, at = [], start
        for h in inside:
            rest.append(plain[at : h[0]])
            at = max(at, h[1])
        rest.append(plain[at:stop])
        other = [w for w in re.findall(r"[^\W\d_]+", " ".join(rest)) if w not in PRICE_WORDS]
        unread += other
        for h in inside:
            own = [i for i, p in enumerate(numbers) if h[0] <= p < h[1]]
            beside = [i for i, p in enumerate(numbers) if p + 1 <= h[0] and not plain[p + 1 : h[0]].strip(" (+-") or p >= h[1] and not plain[h[1] : p].strip(" £:=")]
            if not other or any(marked[i] or not note for i in own + beside):
                out.append((h[2], h[3], h[4], own))
    return out, " ".join(unread) or None


def read_quantity(text: str | None, note: str | None) -> tuple:
    """(amount in millionths of a pound, unit key, count, scale, tax, too large, words not read) of a free text and the note beside it.

    None where not said. The text goes before the note. Without a number in the text there is no amount; ``nan`` is
    no number. A count of months, weeks or years is a whole number without a currency mark that leaves another
    number for the price: "£12.50 monthly" and "£40 month price" are prices of a month. An amount too large to convert is None
    and ``too large`` is true.
    """
    nothing = (None, None, None, None, None, False, None)
    if text is None:
        return nothing
    plain, numbers, marked = _plain(text)
    if not numbers:
        return nothing
    unit = count = scale = tax = None
    amount = None
    spent: set[int] = set()
    hits, unread = _stated(plain, tuple(marked), False)
    for kind, key, alias, inside in hits:
        if kind == "tax" and tax is None:
            tax = key
        elif kind == "scale" and scale is None:
            scale = key
        elif kind == "period" and unit is None:
            unit = key
            if key == "payments" and len(inside) == 2:
                i, j = inside
                if alias in ("# x #", "# * #", "# times #"):
                    whole = [numbers[k].isdigit() and not marked[k] for k in inside]
                    n = (i if int(numbers[i]) <= int(numbers[j]) else j) if whole[0] and whole[1] else i if whole[0] else j
                else:
                    n = j if alias.startswith("# in") and not alias.startswith("# inst") else i
                amount = numbers[j if n == i else i]
                count = int(float(numbers[n]))
                spent.update(inside)
            elif key in SINGLE and inside:
                if numbers[inside[0]].isdigit() and not marked[inside[0]] and len(numbers) > len(spent) + 1:
                    count = int(numbers[inside[0]])
                    spent.update(inside)
                else:
                    unit = SINGLE[key]
    if amount is None:
        left = [i for i in range(len(numbers)) if i not in spent]
        amount = numbers[next((i for i in left if marked[i]), left[0])]
    if note is not None and (unit is None or tax is None or scale is None):
        plain, figures, signs = _plain(note)
        noted = None
        for kind, key, _alias, inside in _stated(plain, tuple(signs), True)[0]:
            if kind == "tax" and tax is None:
                tax = key
            elif kind == "period" and unit is None and noted is None and key != "payments":
                noted = key
                if inside:
                    count = int(float(figures[inside[0]]))
        if unit is None and noted:
            unit = noted
        if scale is None and re.search(r"\bpence\b", note.lower()):
            scale = "pence"
    whole, _, part = amount.partition(".")
    micro = int(whole) * 1_000_000 + int((part + "000000")[:6])
    if scale == "pence":
        micro //= 100
    elif scale == "thousand":
        micro *= 1000
    if count is not None and count <= 0:
        unit = count = None
    large = micro * max(1, count or 1) >= MOST_MICRO
    return (None if large else micro), unit, (None if large else count), scale, tax, large, unread


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        read = [read_quantity(t if isinstance(t, str) else None, n if isinstance(n, str) else None) for t, n in zip(pdf["text_"], pdf["note_"])]
        got = pd.DataFrame(read, columns=["amount_micro", "unit_said", "unit_count", "scale", "tax_said", "too_large", "unread"], index=pdf.index)
        for c in ("amount_micro", "unit_count"):
            got[c] = got[c].astype("Int64")
        yield pd.concat([pdf[["key_", "basis_", "taxed_"]], got], axis=1)


def conversion_factors(spark: SparkSession) -> DataFrame:
    """The factors as a table: ten fixed rows, so broadcasting it is safe at any size of the data."""
    return spark.createDataFrame(FACTORS, "unit string, num long, den long, count_role string")


def normalise_prices(quotes: DataFrame, specs: DataFrame, *, tax_percent: int = 12) -> DataFrame:
    """One row per priced quote: vq_id, annual_pence, recorded_as_is, unit, what the text said, and what of it was not read.

    A figure that comes to hundreds of millions of pounds, beyond what 64-bit integers convert exactly, keeps its
    row with a null ``annual_pence``.
    ``quotes``: vq_id, spec_name, status_text, premium_text, price_note. ``specs``: spec_name, premium_basis,
    premium_includes_ipt (the declared facts). Rows whose status is a refusal or referral, whose text is null or
    empty, or holds no number give no row. A null note says nothing. A spec that is missing counts as annual
    with tax. Repeated rows come out repeated. Empty input gives an empty table.
    """
    spark = quotes.sparkSession
    status = F.lower(F.trim("status_text"))
    # The words of a quote that gives no price.
    kept = quotes.where(F.col("premium_text").isNotNull() & (F.col("status_text").isNull() | ~status.isin("0", "n", "no", "false", "declined", "decline", "refused", "referred", "refer", "not quoted", "no quote")))
    s = specs.select(F.col("spec_name").alias("spec_"), F.col("premium_basis").alias("basis_"), F.col("premium_includes_ipt").alias("taxed_"))
    said = (
        kept.select(F.col("vq_id").alias("key_"), "spec_name", F.col("premium_text").alias("text_"), F.col("price_note").alias("note_"))
        .join(F.broadcast(s), F.col("spec_name") == F.col("spec_"), "left")  # one row a spec: eight here, hundreds at most
        .select("key_", "text_", "note_", F.coalesce("basis_", F.lit("annual")).alias("basis_"), F.coalesce("taxed_", F.lit(True)).alias("taxed_"))
        .mapInPandas(_read_batches, f"key_ {kept.schema['vq_id'].dataType.simpleString()}, basis_ string, taxed_ boolean, {_READ}")
        .where(F.col("amount_micro").isNotNull() | F.col("too_large"))
        .withColumn("unit", F.coalesce("unit_said", F.when(F.col("basis_") == "monthly", "month").when(F.col("basis_") == "quarterly", "quarter").when(F.col("basis_") == "weekly", "week").otherwise("year")))
        .withColumn("taxed", F.when(F.col("tax_said").isNotNull(), F.col("tax_said") == "with").otherwise(F.col("taxed_")))
    )
    n = F.coalesce("unit_count", F.lit(1))
    up = F.col("num") * F.when(F.col("count_role") == "multiply", n).otherwise(F.lit(1))
    down = F.col("den") * F.when(F.col("count_role") == "divide", n).otherwise(F.lit(1))
    return (
        said.join(F.broadcast(conversion_factors(spark)), "unit")
        .withColumn("up_", up)
        .withColumn("down_", down)
        .withColumn("recorded_as_is", F.col("scale").isNull() & F.col("taxed") & (F.col("up_") == F.col("down_")))
        .withColumn("up_", F.col("up_") * F.when(F.col("taxed"), F.lit(100)).otherwise(F.lit(100 + tax_percent)))
        # millionths of a pound to pennies, and the percent taken out again
        .withColumn("down_", F.col("down_") * F.lit(1_000_000))
        .withColumn("annual_pence", F.expr("(2 * amount_micro * up_ + down_) div (2 * down_)"))
        .select(F.col("key_").alias("vq_id"), "annual_pence", "recorded_as_is", "unit", F.col("unit_said").isNotNull().alias("unit_from_row"), "taxed", "unread")
    )
