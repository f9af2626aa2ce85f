import datetime as dt
import gzip
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoteloom.functions import scalars as S
from quoteloom.operators import geo, modelling, tables
from quoteloom.sources import readers


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_scalars(spark):
    money = ["£1,234.50", " 12 ", "", "-", "n/a", "12d", "1_000", "nan", "-5", None]
    assert [r[0] for r in column(spark, money).select(S.to_float(F.col("x"))).collect()] == [1234.5, 12.0, None, None, None, None, None, None, -5.0, None]
    assert [r[0] for r in column(spark, ["Yes", "QUOTED", "0", "maybe", None]).select(S.to_bool(F.col("x"))).collect()] == [True, True, False, None, None]
    assert [r[0] for r in column(spark, ["2.5", "3.5"]).select(S.to_int(F.col("x"))).collect()] == [2, 4]
    days = column(spark, ["1/2/2024", "2024-02-01", "01-Feb-2024", "31/02/2024", "x"]).select(S.day_first_date(F.col("x"))).collect()
    assert [r[0] for r in days] == [dt.date(2024, 2, 1)] * 3 + [None, None]
    assert [r[0] for r in column(spark, ["The Aviva Home Insurance Ltd", "AXA  UK plc"]).select(S.brand_key(F.col("x"))).collect()] == ["aviva", "axa"]
    parts = S.postcode_parts(F.col("x"))
    got = [tuple(r) for r in column(spark, ["bs14dj", "SW1A-1AA", "gir 0aa", "rubbish", None]).select(parts["postcode"], parts["area"], parts["sector"], parts["postcode_valid"]).collect()]
    assert got == [("BS1 4DJ", "BS", "BS1 4", True), ("SW1A 1AA", "SW", "SW1A 1", True), ("GIR 0AA", "GIR", "GIR 0", True), (None, None, None, False), (None, None, None, False)]


def test_upsert_and_duplicates(spark):
    s = "risk_id string, brand string, premium double"
    old = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", 3.0)], s)
    new = spark.createDataFrame([("a", None, 9.0), ("a", None, 9.5), ("c", "x", 7.0)], s)
    got = sorted((r.risk_id, r.brand or "", r.premium) for r in tables.upsert(old, new, ["risk_id", "brand"]).collect())
    assert got == [("a", "", 9.0), ("a", "", 9.5), ("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", 7.0)]
    assert tuple(tables.duplicate_count(new, ["risk_id", "brand"]).first()) == (3, 1)
    assert tuple(tables.duplicate_count(new.limit(0), ["risk_id"]).first()) == (0, 0)
    assert {r["column"]: r.n_conflicting for r in tables.conflicts(new, "risk_id", ["premium", "brand"]).collect()} == {"premium": 1, "brand": 0}


def test_melt_and_percentile_rank(spark):
    wide = spark.createDataFrame([("r", "£300", ""), ("s", None, "450")], "risk_id string, Aviary string, Beacon string")
    assert tables.melt_wide(wide, ["risk_id"], ["Aviary", "Beacon"]).count() == 2
    assert tables.melt_wide(wide, ["risk_id"], ["Aviary", "Beacon"], blank="declined").where("not quoted").count() == 2
    got = sorted(r.pct_rank for r in tables.percentile_rank(spark.createDataFrame([(1,), (1,), (2,), (3,)], "v int"), "v").collect())
    assert got == [0.375, 0.375, 0.75, 1.0]


def test_audit(spark):
    s = "risk_id string, brand string, channel string, collected_on date, quoted boolean, premium double"
    day = lambda k: dt.date(2024, 1, 1 + 7 * k)
    grid = [(f"r{i}", b, "d", day(k), True, 300.0) for i in range(4) for k in range(2) for b in "AB"]
    codes = lambda rows, **kw: {(r.severity, r.code) for r in tables.audit(spark.createDataFrame(rows, s), **kw).collect()}
    assert codes([]) == {("BLOCKER", "empty")}
    assert codes(grid) == {("WARN", "no_declines"), ("INFO", "premium_basis"), ("WARN", "possible_truncation"), ("INFO", "fixed_basket")}
    assert ("BLOCKER", "no_declines") in codes(grid, declines_included=True)
    assert ("BLOCKER", "premium_basis") in codes([(*r[:5], 20.0) for r in grid])
    assert ("INFO", "panel_size") in codes(grid[:-1] + [(*grid[-1][:4], False, None)])
    assert ("WARN", "duplicates") in codes(grid + grid[:1]) and ("WARN", "unmapped_brands") in codes(grid + [("r0", None, "d", day(0), True, 1.0)])
    assert ("WARN", "rotating_panel") in codes([r for r in grid if (r[0] < "r2") == (r[3] == day(0))])
    assert ("BLOCKER", "truncated") in codes(grid[:-1], truncated_to_top_n=2)


def test_geo(spark):
    flood = spark.createDataFrame([("BS1 4DJ", 9, 0, 0, 0), ("SW1A1AA", 0, 20, 0, 2), ("sw1a 1aa", 1, 1, 1, 0)], "postcode string, very_low int, low int, medium int, high int")
    got = {r.postcode: (r.flood_band, round(r.flood_high_share, 6)) for r in geo.flood_bands(flood).collect()}
    assert got == {"BS1 4DJ": (0.0, 0.0), "SW1A 1AA": (3.0, round(1 / 3, 6))}
    risks = spark.createDataFrame([("R1", "BS1 4DJ", 5.0), ("R2", "nonsense", 6.0), ("R3", "SW1A 1AA", 7.0)], "risk_id string, postcode string, flood_band double")
    bridge = geo.area_bridge(spark.createDataFrame([("BS1 4DJ", "E2"), ("bs14dj", "E1")], "postcode string, lsoa string"))
    crime = spark.createDataFrame([("E1", 0.5)], "lsoa string, crime_index double")
    once = geo.enrich(geo.with_postcode_parts(risks), [("lsoa", crime), ("postcode", geo.flood_bands(flood)), ("postcode", bridge)])
    assert once.count() == 3 and {r.risk_id: r.crime_index for r in once.collect()} == {"R1": 0.5, "R2": None, "R3": None}
    twice = geo.enrich(once, [("lsoa", crime), ("postcode", geo.flood_bands(flood)), ("postcode", bridge)])
    assert sorted(twice.columns) == sorted(once.columns)
    assert {r["column"]: r.n_missing for r in geo.resolved_coverage(once).collect()}["flood_band"] == 1
    with pytest.raises(ValueError):
        geo.check_ready(once)


def rated(seed=3, n=900):
    """Rows whose price hangs on brand and on whether the excess is known; a third have none."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, e, brand, kind = rng.gauss(0, 1), None if rng.random() < 0.33 else rng.uniform(0, 500), rng.choice("ABC"), rng.choice(["flat", "terraced", None])
        y = 5 + 0.3 * a + (0.4 if e is None else -0.001 * e) + {"A": 0.0, "B": 0.5, "C": -0.7}[brand] + {"flat": 0.2, "terraced": -0.1, None: 0.0}[kind]
        rows.append((f"R{len(rows)}", a, e, brand, kind, y))
    return rows


RATED = "risk_id string, a double, e double, brand string, kind string, log_premium double"


def test_ridge_with_categories_and_missing_values(spark):
    rows = rated()
    df = spark.createDataFrame(rows, RATED)
    got = {r.risk_id: r.y_pred for r in modelling.Ridge(["a", "e"], categories=["kind"], group="brand").fit(df).predict(df).collect()}
    x = np.array([[a, e or 0.0, a is None, e is None, k == "flat", k == "terraced", b == "A", b == "B", b == "C"] for _, a, e, b, k, _ in rows], float)
    y = np.array([r[-1] for r in rows])
    sd = np.where(x.std(0) < 1e-12, 1, x.std(0))
    z = (x - x.mean(0)) / sd
    want = y.mean() + z @ np.linalg.solve(z.T @ z + np.eye(9), z.T @ (y - y.mean()))
    assert len(got) == len(rows) and np.allclose([got[r[0]] for r in rows], want)
    assert max(abs(got[r[0]] - r[-1]) for r in rows) < 0.02
    new = spark.createDataFrame([("X", None, 100.0, "A", "flat", None)], RATED)  # a was never missing: it stands at its mean
    at_mean = spark.createDataFrame([("X", float(np.mean([r[1] for r in rows])), 100.0, "A", "flat", None)], RATED)
    model = modelling.Ridge(["a", "e"], categories=["kind"], group="brand").fit(df)
    assert math.isclose(model.predict(new).first().y_pred, model.predict(at_mean).first().y_pred)
    folded = modelling.out_of_fold(df, ["a", "e"], categories=["kind"], group="brand").collect()
    assert len(folded) == len(rows) and max(abs(r.resid) for r in folded) < 0.05


def test_ridge_per_brand_has_slopes_of_its_own(spark):
    rng = random.Random(9)
    rows = []
    for j in range(1500):
        brand, age, excess = "AB"[j % 2] if j < 1400 else "thin", rng.randint(0, 90), rng.choice([None, 100.0, 250.0])
        y = 5 + (0.01 if brand == "A" else -0.01) * age + (0.3 if excess is None else 0.0)
        rows.append((f"R{j}", brand, "d", j % 6, "combined", "flat", "standard", rng.choice(["let", "second_home"]), 0.0, excess, math.log1p(excess / 250) if excess else None, age, 3, 0, False, False, y))
    m = spark.createDataFrame(rows, "risk_id string, brand string, channel string, week int, policy_type string, building_type string, construction string, occupancy string, log_sum_insured double, voluntary_excess double, log_excess double, property_age int, bedrooms int, claims_last_5y int, flood_history boolean, subsidence_history boolean, log_premium double")
    scored, why = modelling.compare(m, ["ridge_log", "ridge_per_brand"], holdout_weeks=1)
    got = [r for r in scored.collect() if r.approach == "ridge_per_brand"]
    assert not why and len(got) == 250 and max(abs(r.y_pred - r.y_true) for r in got if r.brand != "thin") < 0.02


def test_trees_score_rows_with_missing_values(spark):
    from pyspark.ml.regression import RandomForestRegressor

    rows = [(f"R{j}", "AB"[j % 2], "d", j % 6, "combined", "flat" if j % 5 else None, "standard", "let", 0.0, None if j % 3 else 100.0, None if j % 3 else 0.3, 10 if j % 4 else None, 3, 0, False, None, 5.0 + j % 2) for j in range(120)]
    m = spark.createDataFrame(rows, "risk_id string, brand string, channel string, week int, policy_type string, building_type string, construction string, occupancy string, log_sum_insured double, voluntary_excess double, log_excess double, property_age int, bedrooms int, claims_last_5y int, flood_history boolean, subsidence_history boolean, log_premium double")
    got = modelling._trees(m.where("week < 5"), m.where("week = 5"), RandomForestRegressor(numTrees=3, seed=7)).collect()
    assert len(got) == 20 and all(r.y_pred is not None for r in got)


def test_ridge_against_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 2), rng.gauss(5, 1), 1.0) for _ in range(200)]
    rows = [(a, b, c, 3 + 0.5 * a - 0.2 * b + rng.gauss(0, 0.1)) for a, b, c in rows]
    m = modelling.Ridge(["a", "b", "c"]).fit(spark.createDataFrame(rows, "a double, b double, c double, log_premium double"))
    x, y = np.array(rows)[:, :3], np.array(rows)[:, 3]
    sd = np.where(x.std(0) < 1e-12, 1, x.std(0))
    z = (x - x.mean(0)) / sd
    beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / sd
    assert np.allclose(m.coefficients, beta) and math.isclose(m.intercept, y.mean() - beta @ x.mean(0))


def test_drift(spark):
    rows = [("up", k, 0.02 * k, 100.0) for k in range(10)] + [("flat", k, 0.0, 100.0) for k in range(10)]
    levels = modelling.brand_levels(spark.createDataFrame(rows, "brand string, week int, resid double, weight double"))
    got = {r.brand: r for r in modelling.trend(levels, trend_weight=1.0).collect()}
    assert math.isclose(got["up"].slope, 0.02) and abs(got["flat"].slope) < 1e-12 and math.isclose(got["MARKET"].slope, 0.01)
    assert math.isclose(got["up"].used_slope, 10 / 14 * 0.02 + 4 / 14 * 0.01)
    assert modelling.trend_weight(levels) > 0 and modelling.trend_weight(levels.where("week < 3")) == 0.0
    ahead = spark.createDataFrame([("up", 9), ("up", 10), ("up", 40), ("new", 10)], "brand string, week int")
    d = {(r.brand, r.week): r.delta for r in modelling.forward_delta(modelling.trend(levels, trend_weight=1.0), ahead, 9).collect()}
    assert d["up", 9] == 0 and math.isclose(d["up", 40], 13 * d["up", 10]) and math.isclose(d["new", 10], 0.01)


def test_approaches_and_last_level(spark):
    usable, missing = modelling.approaches()
    assert {"ridge_log", "brand_last_level", "random_forest"} <= set(usable) and "catboost_pooled" in missing
    rows = [("R", b, "d", w, lv + 0.02 * w) for b, lv in (("A", 5.0), ("B", 5.2)) for w in range(6)]
    m = spark.createDataFrame(rows, "risk_id string, brand string, channel string, week int, log_premium double")
    scored, why = modelling.compare(m, ["brand_last_level", "ridge_log", "catboost_pooled"], holdout_weeks=1)
    assert set(why) == {"ridge_log", "catboost_pooled"}
    assert {r.brand: round(r.y_pred, 9) for r in scored.collect()} == {"A": 5.08, "B": 5.28}


def test_top_k_metrics_by_hand(spark):
    rows = [("R", 1, "A", "d", math.log(100), math.log(110)), ("R", 1, "B", "d", math.log(120), math.log(105)), ("R", 1, "C", "d", math.log(150), math.log(160)), ("S", 1, "A", "d", 1.0, 1.0)]
    one = modelling.top_k_metrics(spark.createDataFrame(rows, "risk_id string, week int, brand string, channel string, y_true double, y_pred double"), 1).first()
    assert (one.cheapest_hit, one.top1_overlap, one.n_groups) == (0.0, 0.0, 1) and math.isclose(one.top1_price_err, 20.0)


BODY = "ref;brand;premium\n1;Aviary;£1,2\n2;\"Bea;con\";\n"


def test_formats(spark, tmp_path):
    want = [("1", "Aviary", "£1,2"), ("2", "Bea;con", None)]
    (tmp_path / "a.csv").write_text(BODY, encoding="utf-8")
    (tmp_path / "b.csv").write_bytes(BODY.encode("cp1252"))
    (tmp_path / "t.txt").write_text("Title\nMade on Monday\n" + BODY, encoding="utf-8")
    with gzip.open(tmp_path / "c.csv.gz", "wt", encoding="utf-8") as f:
        f.write(BODY)
    with zipfile.ZipFile(tmp_path / "d.csv.zip", "w") as z:
        z.writestr("d.csv", BODY)
    (tmp_path / "e.psv").write_text(BODY.replace(";", "|").replace("Bea|con", "Bea;con"), encoding="utf-8")
    (tmp_path / "f.json").write_text('[{"ref": 1, "brand": "Aviary", "premium": "£1,2"}, {"ref": 2, "brand": "Bea;con", "premium": null}]')
    for name, kw in (("a.csv", {}), ("b.csv", {}), ("c.csv.gz", {}), ("d.csv.zip", {}), ("e.psv", {}), ("f.json", {}), ("t.txt", {"header_row": 2})):
        got = sorted(tuple(r) for r in readers.read_extract(spark, str(tmp_path / name), **kw).select("ref", "brand", "premium").collect())
        assert got == want, name
    (tmp_path / ".hidden.csv").write_text("x")
    (tmp_path / "a.csv.NOTE.txt").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in readers.expand_paths(str(tmp_path / "*.csv"))] == ["a.csv", "b.csv"]
    both = readers.read_extracts(spark, [str(tmp_path / "a.csv"), str(tmp_path / "f.json")])
    assert both.count() == 4 and {r.source_file for r in both.collect()} == {"a.csv", "f.json"}
    with pytest.raises(ValueError):
        readers.read_extract(spark, str(tmp_path / "x.xyz"))
    with pytest.raises(FileNotFoundError):
        readers.expand_paths(str(tmp_path / "none*.csv"))


def test_grid_and_sinks(spark, tmp_path):
    (tmp_path / "g.csv").write_text("risk_id,brand,channel,collected_on,quoted,premium\nr,A,d,2024-01-02,y,10\nr,B,d,2024-01-02,,\nr,C,d,2024-01-02,y,\nr,D,d,2024-01-02,n,5\n")
    got = {r.brand: r.problem for r in readers.read_grid(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {"A": None, "C": "quoted without a premium", "D": "declined with a premium"}
    df = readers.read_grid(spark, str(tmp_path / "g.csv"))
    readers.write_table(df, str(tmp_path / "out"), by_month="collected_on")
    assert spark.read.parquet(str(tmp_path / "out")).where("month = date'2024-01-01'").count() == 3
    readers.write_report(df, str(tmp_path / "report"))
    with pytest.raises(ValueError):
        readers.write_report(df, str(tmp_path / "report"), most_rows=2)


def test_stream_replaces_and_survives_a_rerun(spark, tmp_path):
    from quoteloom.streaming import feeds as st

    s = "risk_id string, brand string, premium double"
    src, table, ck = (str(tmp_path / x) for x in ("in", "table", "ck"))
    spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], s).write.parquet(src)
    run = lambda: st.upsert_stream(spark.readStream.schema(s).parquet(src), table, ["risk_id", "brand"], ck).awaitTermination()
    run()
    spark.createDataFrame([("a", "x", 5.0)], s).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(map(tuple, st.read_upserted(spark, table).collect())) == [("a", "x", 5.0), ("b", "x", 2.0)]
