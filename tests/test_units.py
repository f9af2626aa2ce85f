from decimal import ROUND_HALF_UP, Decimal

import pytest

from quoteloom.operators import units

CASES = [
    ("£340.12", None, (340_120_000, None, None, None, None)),
    ("1,234.50 GBP", "per month", (1_234_500_000, "month", None, None, None)),
    ("GBP 24.87 x 9", "paperless policy; + IPT", (24_870_000, "payments", 9, None, "without")),
    ("10 x £25", None, (25_000_000, "payments", 10, None, None)),
    ("52586 pence/2 yrs", None, (525_860_000, "n_years", 2, "pence", None)),
    ("£1.12414 THOUSAND TWO-YEAR PRICE", None, (1_124_140_000, "two_years", None, "thousand", None)),
    ("22.85 in each of 11 instalments", "quote valid 30 days", (22_850_000, "payments", 11, None, None)),
    ("6272p p/m", None, (62_720_000, "month", None, "pence", None)),
    ("19.82 p/m", None, (19_820_000, "month", None, None, None)),
    ("64.95 every 3 months", "instalments on request / excluding insurance premium tax", (64_950_000, "n_months", 3, None, "without")),
    ("£ 9.91 pa", "two-year price", (9_910_000, "year", None, None, None)),
    ("refer", None, (None,) * 5),
    ("nan", None, (None,) * 5),
    ("", "", (None,) * 5),
    (None, "per month", (None,) * 5),
]


@pytest.mark.parametrize("text,note,want", CASES)
def test_reading(text, note, want):
    assert units.read_quantity(text, note)[:5] == want


@pytest.mark.parametrize("text,note,want", [
    ("£12.50 monthly", None, (12_500_000, "month")), ("45 monthly", None, (45_000_000, "month")), ("GBP 37.10 monthly", None, (37_100_000, "month")), ("monthly £45", None, (45_000_000, "month")),
    ("£40 month price", None, (40_000_000, "month")), ("£30 pm", None, (30_000_000, "month")), ("£45 per fortnight", None, (45_000_000, "fortnight")), ("60 for 3 months", None, (60_000_000, "n_months")),
    ("£300", "monthly instalments available", (300_000_000, None)), ("£300", "renewal in 3 months", (300_000_000, None)), ("£300", "annual travel included", (300_000_000, None)),
    ("£300", "figure per month; call back promised", (300_000_000, "month")), ("£300", "we charge £25 per month on request", (300_000_000, "month")), ("£300", "call after 3 pm", (300_000_000, None)),
])
def test_units_touch_the_price(text, note, want):
    assert units.read_quantity(text, note)[:2] == want


def test_payments_with_at():
    assert units.read_quantity("12 payments @ £30", None)[:3] == (30_000_000, "payments", 12)


def test_unread_words_are_reported():
    assert units.read_quantity("£30 per lunar cycle", None)[6] == "per lunar cycle"


def test_too_large_is_reported(spark):
    q = spark.createDataFrame([(1, "a", "Y", "9999999 x 9999999", None), (2, "a", "Y", "9" * 40, None), (3, "a", "Y", "£20,000,000 a month", "plus tax")], "vq_id long, spec_name string, status_text string, premium_text string, price_note string")
    s = spark.createDataFrame([("a", "annual", True)], "spec_name string, premium_basis string, premium_includes_ipt boolean")
    assert {r.vq_id: r.annual_pence for r in units.normalise_prices(q, s).collect()} == {1: None, 2: None, 3: 26_880_000_000}


def test_long_text():
    assert units.read_quantity("£12.50 a month " + "excess varies " * 20_000, None)[:2] == (12_500_000, "month")


def test_conversion(spark):
    rows = [
        (1, "m", "quoted", "10.005", None), (2, "m", None, "£100", "per annum"), (3, "x", "Declined", "£100", None), (4, "x", "Y", "33.33", None), (5, "x", "Y", None, None),
        (6, "none", "Y", "50", None), (7, "a", "Y", "£300.00", None), (7, "a", "Y", "£300.00", None), (8, "a", "Y", "12 x £25", None), (9, "a", "Y", "£600 for two years", "plus tax"), (10, "a", "Y", "30000p", None),
    ]
    q = spark.createDataFrame([r + ("clash",) for r in rows], "vq_id long, spec_name string, status_text string, premium_text string, price_note string, unit string")
    s = spark.createDataFrame([("m", "monthly", True, 1), ("x", "annual", False, 1), ("a", "annual", True, 1)], "spec_name string, premium_basis string, premium_includes_ipt boolean, vq_id int")
    got = {(r.vq_id): (r.annual_pence, r.recorded_as_is) for r in units.normalise_prices(q, s).collect()}
    assert got == {1: (12006, False), 2: (10000, True), 4: (3733, False), 6: (5000, True), 7: (30000, True), 8: (30000, False), 9: (33600, False), 10: (30000, False)}
    assert units.normalise_prices(q, s).where("vq_id = 7").count() == 2
    assert units.normalise_prices(q.limit(0), s).count() == 0


def test_rounding_is_half_up(spark):
    amounts = [f"{k / 1000:.3f}" for k in range(10_000, 10_060)]
    q = spark.createDataFrame([(k, "w", "Y", f"{a} a week plus tax", None) for k, a in enumerate(amounts)], "vq_id long, spec_name string, status_text string, premium_text string, price_note string")
    s = spark.createDataFrame([("w", "annual", True)], "spec_name string, premium_basis string, premium_includes_ipt boolean")
    for r in units.normalise_prices(q, s).collect():
        assert r.annual_pence == int((Decimal(amounts[r.vq_id]) * 100 * 52 * Decimal("1.12")).quantize(Decimal(1), ROUND_HALF_UP))
