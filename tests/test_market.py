import datetime as dt

import pytest
from pyspark.sql import functions as F

from quoteloom.operators import market

D1, D2 = dt.date(2026, 7, 1), dt.date(2026, 7, 8)
SCHEMA = "risk_id string, collected_on date, brand string, channel string, quoted boolean, premium double"


def panel(up=1.1):
    day = [("A", "pcw_ctm", 100.0), ("B", "pcw_ctm", 120.0), ("C", "pcw_ctm", 130.0), ("D", "pcw_ctm", 140.0), ("E", "pcw_ctm", 200.0), ("C", "direct", 150.0), ("F", "pcw_ctm", None)]
    rows = [("R1", d, b, c, p is not None, p * f if p else None) for d, f in ((D1, 1.0), (D2, up)) for b, c, p in day]
    return rows + [("R2", D1, "A", "pcw_ctm", True, 300.0), ("R2", D1, "B", "pcw_ctm", True, 330.0), ("R2", D1, "C", "direct", False, None)]


@pytest.fixture(scope="module")
def quotes(spark):
    return spark.createDataFrame(panel(), SCHEMA)


def test_by_hand(quotes):
    got = {(r.risk_id, r.period): r for r in market.observed_market(quotes).collect()}
    r = got["R1", D1]
    assert (r.n_on_panel, r.n_quoting, r.n_declined, r.cheapest_brand, r.cheapest_price, r.cheapest_channel) == (6, 5, 1, "A", 100.0, "pcw_ctm")
    assert (r.top5_mean, r.top5_median, r.top5_kth, r.top5_complete, r.top5_brands) == (138.0, 130.0, 200.0, True, "A|B|C|D|E")
    assert (r.spread_abs, r.spread_pct, r.panel_max) == (100.0, 100.0, 200.0)
    r = got["R2", D1]
    assert (r.n_quoting, r.n_declined, r.top5_mean, r.top5_kth, r.spread_abs, r.top5_complete) == (2, 1, 315.0, 330.0, 30.0, False)


def test_by_channel(quotes):
    got = {(r.risk_id, r.period, r.channel): r for r in market.observed_market(quotes, by_channel=True).collect()}
    r = got["R1", D1, "direct"]
    assert (r.n_quoting, r.cheapest_brand, r.cheapest_price, r.top5_complete) == (1, "C", 150.0, False)


def test_declines_with_prices_do_not_win(spark):
    rows = [("R", D1, "A", "d", False, 0.0), ("R", D1, "B", "d", True, 90.0), ("R", D1, "C", "d", True, float("nan")), ("S", D1, "A", "d", False, 5.0)]
    got = {r.risk_id: r for r in market.observed_market(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["R"].cheapest_brand == "B" and got["R"].n_quoting == 2
    assert got["S"].n_quoting == 0 and got["S"].cheapest_price is None


def test_periods(spark):
    days = spark.createDataFrame([(dt.date(2026, 7, d),) for d in (1, 5, 6)], "d date")
    assert [r[0] for r in days.select(market.period_start(F.col("d"), "week")).collect()] == [dt.date(2026, 6, 29), dt.date(2026, 6, 29), dt.date(2026, 7, 6)]


def test_index_and_basket(spark, quotes):
    m = market.observed_market(quotes)
    basket = spark.createDataFrame([("R1",)], "risk_id string")
    got = market.market_by_period(m, basket=basket).orderBy("period").collect()
    assert [r.n_risks for r in got] == [1, 1] and [round(r.index_100, 6) for r in got] == [100.0, 110.0] and got[0].wow_pct is None and round(got[1].wow_pct, 6) == 10.0
    assert [r.n_risks for r in market.market_by_period(m).orderBy("period").collect()] == [2, 1]
    assert [r.risk_id for r in market.common_risks(m).collect()] == ["R1"]


def test_competitiveness_and_gap(quotes):
    got = {r.brand: r for r in market.brand_competitiveness(quotes).collect()}
    assert (got["A"].n_asked, got["A"].n_cheapest, got["A"].cheapest_share_pct, got["A"].gap_to_cheapest_pct) == (3, 3, 100.0, 0.0)
    assert got["F"].n_quoted == 0 and (got["E"].n_in_top5, got["E"].median_rank) == (2, 5.0)
    gap = market.channel_gap(quotes).collect()
    assert len(gap) == 1 and gap[0].brand == "C" and gap[0].n_pairs == 2 and round(gap[0].direct_over_pcw_pct, 1) == 15.4
    s = market.spread_summary(market.observed_market(quotes)).first()
    assert (s.n_risk_periods, s.n_complete, round(s.spread_pct_median, 9)) == (3, 2, 100.0)


def test_order_and_partitions_do_not_matter(quotes):
    a = sorted(map(tuple, market.observed_market(quotes).collect()))
    b = sorted(map(tuple, market.observed_market(quotes.repartition(7, "premium").orderBy(F.desc("brand"))).collect()))
    assert a == b


def test_simulation_meets_closed_form(spark):
    rows = [("R", D1, "A", "d", 100.0, 0.3), ("R", D1, "B", "d", 120.0, 0.8), ("R", D1, "C", "d", 90.0, 0.1), ("R", D1, "D", "d", 200.0, 1.0)]
    p = spark.createDataFrame(rows, "risk_id string, period date, brand string, channel string, premium double, p_quote double")
    s, e = market.simulate_market(p, n_sims=4000).first(), market.expected_cheapest(p).first()
    assert abs(s.cheapest_mean - e.cheapest_mean) < 2 and abs(s.n_quoting_mean - e.n_quoting_mean) < 0.05 and s.modal_winner == "B"
    sure = market.simulate_market(p.withColumn("p_quote", F.lit(1.0)), n_sims=5).first()
    assert sure.top5_mean < s.top5_mean and sure.cheapest_mean == 90.0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert market.observed_market(none).count() == 0 and market.channel_gap(none).count() == 0 and market.spread_summary(market.observed_market(none)).first().n_risk_periods == 0


def test_400_draws_against_brute_force(spark, tmp_path):
    import hashlib
    import statistics

    from quoteloom.plans import market as plans

    rows = [("R1", D1, b, "d", True, p) for b, p in (("A", 100.0), ("B", 120.0), ("C", 90.0))]
    rows += [("R2", D1, "A", "d", False, None), ("R2", D1, "B", "d", True, 50.0), ("R2", D1, "C", "d", False, None), ("R3", D1, "C", "d", False, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "quotes.parquet"))
    got = {r.risk_id: r for r in plans.QUERIES["simulate_market_400"](spark, str(tmp_path)).collect()}
    assert set(got) == {"R1", "R2"}
    rate, month = {"A": 1 / 2, "B": 1.0, "C": 1 / 3}, D1.replace(day=1)
    for risk, offers in (("R1", [(90.0, "C"), (100.0, "A"), (120.0, "B")]), ("R2", [(50.0, "B")])):
        live = [[(p, b) for p, b in offers if int(hashlib.md5(f"0|{risk}|{month}|{b}|{k}".encode()).hexdigest()[:12], 16) / 16**12 < rate[b]] for k in range(400)]
        wins = [x[0][1] for x in live]
        best = min(set(wins), key=lambda b: (-wins.count(b), b))
        r = got[risk]
        assert (r.modal_winner, r.modal_winner_share) == (best, wins.count(best) / 4)
        assert abs(r.top5_mean - statistics.mean(statistics.mean(p for p, _ in x) for x in live)) < 1e-7
        assert abs(r.cheapest_mean - statistics.mean(x[0][0] for x in live)) < 1e-7 and abs(r.n_quoting_mean - statistics.mean(map(len, live))) < 1e-7
