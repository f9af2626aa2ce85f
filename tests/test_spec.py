import datetime as dt

import pytest

from quoteloom.sources import spec as sp

ROWS = [("Q1", "AVIARY Insurance", "Compare the Market", "01/07/2026", "Quoted", "£310.00", "250,000"), ("Q2", "Nobody", "go compare", "02/07/2026", "Declined", "", "x"), ("Q3", None, "fax", "soon", None, "20", "")]
COLS = "QuoteReference string, Brand string, Channel string, QuoteDate string, Status string, AnnualPremium string, Sum string"


def test_long(spark, tmp_path):
    s = sp.VendorSpec("v", {"risk_id": "QuoteReference", "brand": "brand", "channel": "Channel", "collected_on": "QuoteDate", "quoted": "Status", "premium": "AnnualPremium", "buildings_sum_insured": "Sum", "postcode": "Missing"}, premium_includes_ipt=False)
    s.to_yaml(str(tmp_path / "v.yml"))
    s = sp.VendorSpec.from_yaml(str(tmp_path / "v.yml"))
    registry = spark.createDataFrame([("Aviary", "U")], "brand string, underwriter string")
    out = sp.apply_spec(spark.createDataFrame(ROWS, COLS), s, registry)
    got = {r.risk_id: r for r in out.collect()}
    assert (got["Q1"].brand, got["Q1"].underwriter, got["Q1"].channel, got["Q1"].collected_on, round(got["Q1"].premium, 2), got["Q1"].buildings_sum_insured) == ("Aviary", "U", "pcw_ctm", dt.date(2026, 7, 1), 347.2, 250000.0)
    assert got["Q2"].quoted is False and got["Q2"].premium is None and got["Q2"].brand is None and got["Q2"].brand_raw == "Nobody" and got["Q2"].unread == ["buildings_sum_insured"]
    assert got["Q3"].quoted is True and got["Q3"].channel is None and set(got["Q3"].unread) == {"channel", "collected_on"} and got["Q3"].postcode is None
    assert {r.field: r.n for r in sp.unread_summary(out).collect()} == {"buildings_sum_insured": 1, "channel": 1, "collected_on": 1}


def test_wide_and_own_values(spark):
    wide = spark.createDataFrame([("R1", "£30", "", "y"), ("R2", None, "45", "x")], "Id string, Aviary string, Beacon string, Kind string")
    s = sp.VendorSpec("w", {"risk_id": "Id", "occupancy": "Kind"}, values={"occupancy": {"Y": "let"}}, brand_columns=["Aviary", "Beacon"], blank_means="declined", premium_basis="monthly", channel_default="direct")
    got = {(r.risk_id, r.brand): r for r in sp.apply_spec(wide, s).collect()}
    assert len(got) == 4 and got["R1", "Aviary"].premium == 360.0 and got["R1", "Beacon"].quoted is False and got["R2", "Beacon"].channel == "direct"
    assert got["R1", "Aviary"].occupancy == "let" and got["R2", "Aviary"].occupancy is None


def test_errors_and_draft(spark):
    with pytest.raises(ValueError):
        sp.VendorSpec.from_dict({"name": "x", "colour": 1})
    with pytest.raises(ValueError):
        sp.VendorSpec("x", premium_basis="daily")
    s, rest = sp.draft_spec(spark.createDataFrame(ROWS, COLS), "d")
    assert s.columns["brand"] == "Brand" and s.columns["premium"] == "AnnualPremium" and s.columns["collected_on"] == "QuoteDate" and "Sum" in rest
