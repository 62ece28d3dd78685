"""Index, price and risk operators against brute force and worked examples."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketpulse.operators import fundamentals, indices, prices, risk
from marketpulse.plans import REGISTRY
from marketpulse.sources.views import Views


def water_fill(w: np.ndarray, cap: float) -> np.ndarray:
    """Cap and share out until nothing exceeds the cap."""
    n = len(w)
    if cap * n < 1:
        return np.full(n, 1 / n)
    capped, x = np.zeros(n, bool), w.copy()
    while ((x > cap + 1e-15) & ~capped).any():
        capped |= x > cap + 1e-15
        x = np.where(capped, cap, w * (1 - cap * capped.sum()) / max(w[~capped].sum(), 1e-300))
    return x


def group_fill(w: np.ndarray, cap: float, limit: float) -> np.ndarray:
    """Lower the cap by bisection until the three largest fit the limit."""
    x = water_fill(w, cap)
    if np.sort(x)[-3:].sum() <= limit + 1e-12:
        return x
    low, high = 1 / len(w), cap
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sort(water_fill(w, mid))[-3:].sum() <= limit else (low, mid)
    return water_fill(w, low)


@pytest.fixture(scope="module")
def weight_lists():
    rng = random.Random(7)
    lists = {}
    for i in range(60):
        raw = np.array([rng.expovariate(1) ** rng.choice((1, 2, 3)) + 1e-6 for _ in range(rng.randint(5, 15))])
        lists[f"I{i}"] = np.sort(raw / raw.sum())[::-1]
    return lists


@pytest.mark.parametrize("cap,limit", [(0.33, None), (0.12, None), (0.33, 0.62), (0.25, 0.65)])
def test_capping_equals_iteration(spark, weight_lists, cap, limit):
    data = [(name, f"T{i:02d}", float(x)) for name, w in weight_lists.items() for i, x in enumerate(w)]
    df = spark.createDataFrame(data, "index_name string, ticker string, weight double")
    got: dict[str, dict[str, float]] = {}
    for r in indices.capped_weights(df, cap, limit).collect():
        got.setdefault(r.index_name, {})[r.ticker] = r.capped_weight
    for name, w in weight_lists.items():
        want = water_fill(w, cap) if limit is None else group_fill(w, cap, limit)
        mine = np.array([got[name][f"T{i:02d}"] for i in range(len(w))])
        assert np.allclose(mine, want, atol=1e-7), name
        assert abs(mine.sum() - 1) < 1e-9


def test_impact_cost_example(spark):
    book = [("X", "bid", 99, 1000), ("X", "bid", 98, 2000), ("X", "ask", 102, 300), ("X", "ask", 102, 200), ("X", "ask", 104, 2000)]
    df = spark.createDataFrame(book, "ticker string, side string, price bigint, qty bigint")
    row = indices.impact_cost(df, F.lit(1500)).first()
    assert (row.filled, row.mid, round(row.average_price, 2), round(row.impact_cost, 3)) == (1500, 100.5, 103.33, 0.028)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def test_index_value_carries_values_forward(spark):
    rows = [
        ("I", "A", d("2024-01-01"), 100), ("I", "A", d("2024-01-03"), 110), ("I", "B", d("2024-01-02"), 50),
        ("I", "B", d("2024-01-05"), 40), ("I", "A", d("2024-01-05"), 130),
    ]
    df = spark.createDataFrame(rows, "index_name string, ticker string, date date, ffmc int")
    df = df.withColumn("ffmc", F.col("ffmc").cast("decimal(30,6)"))
    values = indices.index_values(indices.combined_mcap(df), 1000)
    got = {str(r.date): (float(r.combined), round(r.index_value, 6)) for r in values.collect()}
    assert got == {"2024-01-02": (150.0, 1000.0), "2024-01-03": (160.0, 1066.666667), "2024-01-05": (170.0, 1133.333333)}


def test_total_return_reinvests_dividends(spark):
    values = spark.createDataFrame(
        [("I", d("2024-01-01"), 100.0, 1000.0), ("I", d("2024-01-02"), 90.0, 900.0)],
        "index_name string, date date, combined double, index_value double",
    )
    paid = spark.createDataFrame([("I", d("2024-01-02"), 10.0)], "index_name string, date date, dividend double")
    got = [round(r.total_return_value, 6) for r in indices.total_return(values, paid).orderBy("date").collect()]
    assert got == [1000.0, 1000.0]


def test_adjusted_close_multiplies_later_actions(spark):
    px = spark.createDataFrame(
        [("A", d(f"2024-01-0{i}"), 100.0) for i in (1, 2, 3, 4)], "ticker string, date date, close double"
    )
    schema = "ticker string, action_date date, action_type string, ratio_numerator int, ratio_denominator int"
    acts = [
        ("A", d("2024-01-02"), "split", 1, 2), ("A", d("2024-01-04"), "bonus", 2, 3),
        ("A", d("2024-01-04"), "split", 1, 5), ("A", d("2024-01-03"), "dividend", None, None),
    ]
    out = prices.adjusted_close(px, spark.createDataFrame(acts, schema)).orderBy("date").collect()
    assert [round(r.adjusted_close, 6) for r in out] == [6.666667, 13.333333, 13.333333, 100.0]


def test_membership_and_turnover(spark):
    q1, q2, q3 = d("2024-03-31"), d("2024-06-30"), d("2024-09-30")
    picks = spark.createDataFrame([("A", q1), ("A", q2), ("B", q1), ("C", q2), ("A", q3), ("C", q3)], "ticker string, quarter date")
    members = indices.membership(picks, "I")
    spans = {(r.ticker, str(r.effective_date)): r.end_date for r in members.collect()}
    assert spans[("B", "2024-04-01")] == d("2024-07-01") and spans[("A", "2024-10-01")] is None
    moves = sorted((r.ticker, str(r.rebalance_date), r.change) for r in indices.turnover(members).collect())
    assert moves == [
        ("A", "2024-04-01", "added"), ("B", "2024-04-01", "added"),
        ("B", "2024-07-01", "removed"), ("C", "2024-07-01", "added"),
    ]
    days = spark.createDataFrame([("B", d("2024-06-30")), ("B", d("2024-07-01")), ("A", d("2030-01-01"))], "ticker string, date date")
    active = sorted((r.ticker, str(r.date)) for r in indices.active_on(days, members).collect())
    assert active == [("A", "2030-01-01"), ("B", "2024-06-30")]


def test_covariance_over_many_tiles_equals_numpy(spark):
    rng = np.random.default_rng(3)
    names, days = [f"N{i:02d}" for i in range(23)], [d("2024-01-01") + dt.timedelta(days=i) for i in range(75)]
    grid = rng.normal(0, 0.02, (len(days), len(names)))
    grid[rng.random(grid.shape) < 0.2] = np.nan
    data = [(n, day, float(grid[i, j])) for i, day in enumerate(days) for j, n in enumerate(names) if not np.isnan(grid[i, j])]
    df = spark.createDataFrame(data, "ticker string, date date, ret double")
    got = {(r.a, r.b): (r.n_days, r.covariance) for r in risk.return_covariance(df, tile=5).collect()}
    assert len(got) == 23 * 24 // 2
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            both = ~np.isnan(grid[:, i]) & ~np.isnan(grid[:, j])
            want = np.cov(grid[both, i], grid[both, j])[0, 1]
            assert got[(a, names[j])][0] == both.sum() and abs(got[(a, names[j])][1] - want) < 1e-12


def test_asof_takes_the_latest_known_quarter(spark):
    px = spark.createDataFrame([("A", d("2024-03-30")), ("A", d("2024-03-31")), ("A", d("2024-07-15"))], "ticker string, date date")
    fund = spark.createDataFrame([("A", d("2024-03-31"), 1.0), ("A", d("2024-06-30"), None)], "ticker string, quarter date, eps double")
    got = [(str(r.date), r.asof_date, r.eps) for r in fundamentals.asof(px, fund, ["eps"], "quarter").orderBy("date").collect()]
    # The newest quarter counts even where one of its values is missing.
    assert got == [("2024-03-30", None, None), ("2024-03-31", d("2024-03-31"), 1.0), ("2024-07-15", d("2024-06-30"), None)]


def test_eps_streak_needs_consecutive_quarters(spark):
    ends = ["2023-12-31", "2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31"]
    data = [("UP", d(q), float(i - 1)) for i, q in enumerate(ends)]
    data += [("GAP", d(q), float(i + 1)) for i, q in enumerate(ends) if q != "2024-06-30"]
    data += [("NEG", d(q), float(i - 9)) for i, q in enumerate(ends)]
    data += [("DIP", d(q), x) for q, x in zip(ends[1:], (1.0, 3.0, 2.0, 4.0))]
    data += [("NEW", d(q), float(i + 1)) for i, q in enumerate(ends[2:])]
    df = spark.createDataFrame(data, "ticker string, quarter date, eps double")
    assert [r.ticker for r in fundamentals.screen_eps_streak(df).collect()] == ["UP"]


def test_every_dividend_is_accounted_for(spark):
    days = spark.sql("SELECT * FROM VALUES ('I', DATE'2024-01-02'), ('I', DATE'2024-01-05'), ('J', DATE'2024-01-03') AS t(index_name, date)")
    paid = spark.sql(
        "SELECT * FROM VALUES ('I', DATE'2024-01-01', 1.0), ('I', DATE'2024-01-03', 2.0), ('I', DATE'2024-01-04', 4.0), "
        "('I', DATE'2024-01-05', 8.0), ('I', DATE'2024-01-06', 16.0), ('J', DATE'2024-01-04', 32.0) AS t(index_name, date, dividend)"
    )
    got = {(r.index_name, str(r.date), r.pending): r.dividend for r in indices.on_index_days(days, paid).collect()}
    assert got == {("I", "2024-01-02", False): 1.0, ("I", "2024-01-05", False): 14.0, ("I", "2024-01-06", True): 16.0, ("J", "2024-01-04", True): 32.0}


def test_limits_that_few_names_cannot_keep(spark):
    rows = [(f"I{n}", f"T{k}", 1.0 / n) for n in (2, 3, 4, 5) for k in range(n)]
    weighted = spark.createDataFrame(rows, "index_name string, ticker string, weight double")

    def feasible(cap, top=None):
        out = indices.capped_weights(weighted, cap, top)
        return {r.index_name: r.feasible for r in out.select("index_name", "feasible").distinct().collect()}

    assert feasible(0.33, 0.62) == {"I2": False, "I3": False, "I4": False, "I5": True}
    assert feasible(0.5) == {"I2": True, "I3": True, "I4": True, "I5": True}
    assert feasible(0.25) == {"I2": False, "I3": False, "I4": True, "I5": True}


def test_price_range_reaches_the_scan(spark, small):
    wanted = REGISTRY["price_range_scan"].build(Views(spark, small))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1]
    assert "In(l_suppkey" in pushed and "GreaterThanOrEqual(l_shipdate" in pushed


def test_computed_metrics_aggregates_trades_once(spark, small, monkeypatch):
    from marketpulse.plans import REGISTRY
    from marketpulse.sources import views

    made = []
    bars = views.daily_bars
    monkeypatch.setattr(views, "daily_bars", lambda trades: made.append(1) or bars(trades))
    REGISTRY["computed_metrics"].build(views.Views(spark, small))
    assert len(made) == 1
