import datetime as dt

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import collection as C
from quoteloom.operators import geo, modelling, tables
from quoteloom.sources import readers, spec

D = dt.date(2026, 7, 6)
CANON = "risk_id string, brand string, channel string, collected_on date, quoted boolean, premium double, postcode string, policy_type string, building_type string, year_built int, bedrooms int, buildings_sum_insured double, voluntary_excess double, problem string"


def canonical(spark):
    ok = ("BS1 4DJ", "buildings", "flat", 1990, 2, 250000.0, 100.0, "clash")
    rows = [("R1", "A", "direct", D, True, 300.0, *ok), ("R1", "B", "direct", D, False, 0.0, *ok), ("R1", None, "direct", D, True, 310.0, *ok), ("R1", "C", "fax", D, True, 310.0, *ok), ("R1", "A", "direct", D, True, 300.0, *ok)]
    rows += [("R2", "A", "direct", D, True, 300.0, "BS1", *ok[1:]), (None, "A", "direct", D, True, 1.0, *ok), ("R3", "A", "direct", D, None, None, *ok), ("R1", "D", "direct", D, True, float("nan"), "M1 1AE", *ok[1:])]
    return spark.createDataFrame(rows, CANON)


def test_records(spark):
    risks, quotes, problems = C.to_records(canonical(spark))
    assert {r.risk_id: (r.construction, r.claims_last_5y, r.in_basket) for r in risks.collect()} == {"R1": ("standard", 0, False), "R3": ("standard", 0, False)}
    assert sorted((r.risk_id, r.brand, r.premium) for r in quotes.collect()) == [("R1", "A", 300.0), ("R1", "A", 300.0), ("R1", "B", None)]
    assert {(r.kind, r.problem): r.n for r in problems.collect()} == {("rows", "no_brand"): 1, ("rows", "priced_decline"): 1, ("conflict", "postcode"): 1, ("risk", "postcode"): 1, ("quote", "channel"): 1, ("quote", "premium"): 1, ("quote", "quoted"): 1}
    assert [x.count() for x in C.to_records(canonical(spark).limit(0))] == [0, 0, 0]


def test_session(spark, tmp_path):
    risks = spark.createDataFrame([("R1",), ("R2",)], "risk_id string")
    registry = spark.createDataFrame([("Aviary", "U"), ("Beacon", "V")], "brand string, underwriter string")
    grid = C.session_template(risks, spark.createDataFrame([("direct",)], "channel string"), registry, D)
    assert grid.columns == C.SESSION_COLUMNS and [(r.risk_id, r.brand, r.collected_on) for r in grid.collect()] == [("R1", "Aviary", D), ("R1", "Beacon", D), ("R2", "Aviary", D), ("R2", "Beacon", D)]
    rows = spark.createDataFrame([("R1", "aviary insurance", "direct", D, True, 10.0), ("R9", "Aviary", "direct", D, True, 10.0), ("R2", "Nobody", "direct", D, True, 10.0), ("R2", "Beacon", "direct", D, True, None), (None, None, None, None, None, None)], "risk_id string, brand string, channel string, collected_on date, quoted boolean, premium double")
    good, bad = C.session_to_canonical(rows, risks, registry)
    assert [(r.brand, r.underwriter) for r in good.collect()] == [("Aviary", "U")]
    assert {(r.risk_id, r.problem) for r in bad.collect()} == {("R9", "the risk has no definition"), ("R2", "the brand is not in the registry"), ("R2", "premium"), (None, "the risk has no definition")}
    C.write_risk_template(str(tmp_path / "t.yml"))
    (tmp_path / "r.yml").write_text("risks:\n- {risk_id: R1, postcode: BS1 4DJ, policy_type: buildings, building_type: flat, year_built: 1990, bedrooms: 2, buildings_sum_insured: 1e5, voluntary_excess: 0}\n- {risk_id: R1, postcode: BS1 4DJ, policy_type: buildings, building_type: flat, year_built: 1990, bedrooms: 2, buildings_sum_insured: 1e5, voluntary_excess: 0}\n- {risk_id: R2, postcode: X, bedrooms: many}\n- nonsense\n")
    risks, problems = C.read_risk_definitions(spark, str(tmp_path / "r.yml"))
    assert [(r.risk_id, r.bedrooms) for r in risks.collect()] == [("R1", 2)] and problems.where("problem = 'defined twice'").count() == 1 and problems.count() == 3
    assert C.read_risk_definitions(spark, str(tmp_path / "t.yml"))[1].count() == 1
    (tmp_path / "p.yml").write_text("providers:\n- {brand: Aviary, underwriter: U, channels: [direct, pcw], tier: 1}\n- {brand: Beacon}\n")
    assert {tuple(r) for r in C.load_providers(spark, str(tmp_path / "p.yml")).collect()} == {("Aviary", "U", "direct|pcw", 1), ("Beacon", None, "", None)}


def test_line_breaks_and_title_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title\n\nWeek 7\na,b\n1,"two\nlines"\na,b\nTitle,x\n')
    rows = [tuple(r) for r in readers.read_extract(spark, str(tmp_path / "a.csv"), header_row=3).collect()]
    assert rows == [("1", "two\nlines"), ("a", "b"), ("Title", "x")]
    (tmp_path / "b.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert [tuple(r) for r in readers.read_extract(spark, str(tmp_path / "b.csv")).collect()] == [("1", "two\nlines"), ("2", "x")]


def test_reference_files(spark, tmp_path):
    assert geo.band_columns(["Postcode", "VeryLow count", "Low", "medium_", "High"]) == {"low": "Low", "high": "High", "very low": "VeryLow count", "medium": "medium_"}
    with pytest.raises(ValueError, match="there are a, b"):
        geo.pick_column(["a", "b"], ["postcode"], "postcode")
    (tmp_path / "ea_flood.csv").write_text("Postcode,Very Low,Low,Medium,High\nBS1 4DJ,5,0,0,0\nM1 1AE,1,2,0,0\nSW1A 1AA,10,10,0,2\n")
    sale = "\"{id}\",\"{p}\",\"2024-01-02 00:00\",\"BS1 4DJ\"" + ",\"x\"" * 12
    (tmp_path / "price_paid.csv").write_text("\n".join(sale.format(id=k, p=p) for k, p in enumerate([100000, 200000, 300000, 400000, 500000, 1])) + "\n")
    (tmp_path / "onspd.csv").write_text("pcds,lsoa11\nBS1 4DJ,E1\nM1 1AE,E2\n")
    (tmp_path / "subsidence.csv").write_text("postcode,subsidence_band\nBS1 4DJ,1\nBS14DJ,3\nnowhere,2\n")
    (tmp_path / "imd.csv").write_text("Postcode,Index of Multiple Deprivation Decile\nBS1 4DJ,4\n")
    assert geo.missing_files(str(tmp_path)) == ["crimes"]
    (tmp_path / "police" / "2024").mkdir(parents=True)
    (tmp_path / "police" / "2024" / "a-street.csv").write_text("Crime ID,LSOA code\n1,E1\n2,E1\n3,E2\n")
    (tmp_path / "police" / "b-street.csv").write_text("Crime ID\n1\n")
    risks = geo.with_postcode_parts(spark.createDataFrame([("R1", "bs1 4dj"), ("R2", "M1 1AE"), ("R3", "?")], "risk_id string, postcode string"))
    got = {r.risk_id: r for r in geo.enrich(risks, geo.default_sources(spark, str(tmp_path))).collect()}
    r = got["R1"]
    assert (r.flood_band, r.area_avg_value, r.imd_decile, r.crime_index, r.subsidence_band, r.lsoa) == (0.0, 300000.0, 4.0, 1.0, 3.0, "E1")
    assert got["R2"].flood_band == 1.0 and got["R3"].flood_band is None and got["R3"].subsidence_band_resolved is False


def test_spec_problems_and_aliases(spark):
    src = spark.createDataFrame([("R1", "AV", "maybe", "9", "other", "BS1 4DJ"), ("R2", "zz", "Y", "9", "U", None)], "Id string, Brand string, Status string, Price string, Carrier string, Postcode string")
    s = spec.VendorSpec("v", {"risk_id": "Id", "brand": "Brand", "quoted": "Status", "premium": "Price", "underwriter": "Carrier", "channel": "Channel"})
    registry = spark.createDataFrame([("Aviary", "U")], "brand string, underwriter string")
    aliases = spark.createDataFrame([("v", "av", "Aviary"), ("w", "zz", "Aviary")], "spec_name string, alias_text string, brand string")
    out = spec.apply_spec(src, s, registry, aliases)
    assert {r.risk_id: r.brand for r in out.collect()} == {"R1": "Aviary", "R2": None}
    assert {tuple(r) for r in spec.spec_problems(src, s, out).collect()} == {("missing", "Channel", None), ("overlooked", "Postcode", None), ("status", "quoted", 1), ("brand", "zz", 1), ("underwriter", "Aviary", 1)}


def panel(spark, drift=0.02):
    rows = [(f"R{k}", b, "direct", w, 5.0 + 0.1 * (b == "B") + 0.01 * k + (drift * w if b == "B" else 0.0)) for k in range(30) for b in "AB" for w in range(12)]
    return spark.createDataFrame(rows, "risk_id string, brand string, channel string, week int, log_premium double")


def test_trend_adjusted(spark):
    m = panel(spark)
    train, hold = m.where("week < 9"), m.where("week >= 9")
    inner = modelling.APPROACHES["brand_geomean"][1]
    model = modelling.TrendAdjusted(inner, weight=1.0).fit(train)
    plain = {(r.risk_id, r.brand, r.week): r.y_pred for r in inner(train, train).collect()}
    assert all(abs(r.y_pred - plain[r.risk_id, r.brand, r.week]) < 1e-9 for r in model.predict(train).collect())  # nothing changes within the window
    slope = {r.brand: r.slope for r in model.trends.collect()}
    assert slope["B"] == pytest.approx(0.02, abs=1e-6) and slope["A"] == pytest.approx(0.0, abs=1e-6)
    before = model.predict(hold.where("week = 11")).agg(F.avg(F.abs(F.col("log_premium") - F.col("y_pred")))).first()[0]
    model.recalibrate(hold.where("week = 9")).recalibrate(hold.where("week = 10"))
    after = model.predict(hold.where("week = 11")).agg(F.avg(F.abs(F.col("log_premium") - F.col("y_pred")))).first()[0]
    assert after < before and model.as_of == 10 and {r.brand for r in model.report().collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        modelling.TrendAdjusted(inner).fit(train.drop("week"))


def test_rolling_levels_against_brute_force(spark):
    m = panel(spark).where("not (brand = 'A' and week = 10)")
    train, hold = m.where("week < 9"), m.where("week >= 9")
    got = {(r.risk_id, r.brand, r.week): r.y_pred for r in modelling.rolling_last_level(train, hold).collect()}
    rows = m.collect()
    for (risk, brand, week), y in got.items():
        last = max(r.week for r in rows if r.brand == brand and 8 <= r.week < week)
        values = sorted(r.log_premium for r in rows if r.brand == brand and r.week == last)
        assert y == pytest.approx((values[14] + values[15]) / 2)


def test_too_few_weeks(spark):
    with pytest.raises(Exception, match="too few weeks"):
        modelling.temporal_split(panel(spark).where("week < 2"), holdout_weeks=2).collect()
    assert modelling.temporal_split(panel(spark).limit(0), holdout_weeks=2).count() == 0


def test_group_sizes_and_places(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 1.0, 2), ("a", None, 3), ("b", 1.0, 4), (None, 1.0, 5), (None, 1.0, 6), (None, 3.0, 7)], "g string, v double, i int")
    assert sorted(r.i for r in tables.groups_of_size(df, ["g"], 3).collect()) == [1, 2, 3, 5, 6, 7]
    assert {r.i: r.rank_no for r in tables.first_ranks(df, ["g"], "v", ["i"]).collect()} == {1: 2, 2: 1, 3: None, 4: 1, 5: 1, 6: 2, 7: 3}
