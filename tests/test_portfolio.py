import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratafin.operators import allocation, rebalance, weights
from stratafin.params import Constraints
from stratafin.plans import backtest, calendar, metrics


def universe(n=50, seed=1):
    rng = np.random.default_rng(seed)
    sectors = ["Tech"] * 20 + ["Health"] * 15 + ["Energy"] * 10 + ["Unknown"] * 5
    return pd.DataFrame({"k": "p", "symbol": [f"S{i:03d}" for i in range(n)], "sector": sectors[:n], "score_composite": rng.uniform(0.4, 1.0, n), "vol_30d": rng.uniform(10, 60, n)})


def test_optimised_weights_respect_caps(spark):
    c = Constraints()
    frames = [universe(seed=s).assign(k=f"p{s}") for s in range(3)]
    out = allocation.optimise(spark.createDataFrame(pd.concat(frames)), ["k"], c=c).toPandas()
    for _, p in out.groupby("k"):
        assert len(p) == c.max_positions
        assert p.weight.sum() == pytest.approx(1.0, abs=1e-3)
        assert p.weight.max() <= c.max_weight + c.tolerance
        named = p[p.sector != "Unknown"].groupby("sector").weight.sum()
        assert named.max() <= c.max_sector + c.tolerance or len(named) * c.max_sector < 1


def test_optimise_does_not_depend_on_row_order(spark):
    df = universe()
    a = allocation.optimise(spark.createDataFrame(df), ["k"]).toPandas().sort_values("symbol").reset_index(drop=True)
    b = allocation.optimise(spark.createDataFrame(df.sample(frac=1, random_state=5)).repartition(7), ["k"]).toPandas().sort_values("symbol").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns])


def brute_ward(d):
    """Ward clusters recomputed from scratch: cost = |a||b|/(|a|+|b|) gap of centroids on points."""
    n = len(d)
    clusters = {i: [i] for i in range(n)}
    names = {i: i for i in range(n)}
    order = {i: [i] for i in range(n)}

    def dist(a, b):
        inter = sum(d[i][j] ** 2 for i in a for j in b) / (len(a) * len(b))
        inner = lambda x: sum(d[i][j] ** 2 for i in x for j in x) / (2 * len(x) ** 2)
        return np.sqrt(max(2 * len(a) * len(b) / (len(a) + len(b)) * (inter - inner(a) - inner(b)), 0))

    step = n
    while len(clusters) > 1:
        keys = sorted(clusters)
        i, j = min(((a, b) for x, a in enumerate(keys) for b in keys[x + 1 :]), key=lambda p: (round(dist(clusters[p[0]], clusters[p[1]]), 12), p))
        low, high = (i, j) if names[i] < names[j] else (j, i)
        clusters[step], order[step], names[step] = clusters[i] + clusters[j], order[low] + order[high], step
        for x in (i, j):
            del clusters[x]
        step += 1
    return order[step - 1]


@pytest.mark.parametrize("seed", range(6))
def test_leaf_order_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(9, 4))
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    rows = spark.createDataFrame([(d.tolist(),), ([[0.0]],)], "d array<array<double>>")
    got = [r[0] for r in rows.select(allocation.ward_leaf_order(F.col("d"), F.size("d"))).collect()]
    assert got == [brute_ward(d), [0]]


def brute_halves(variances):
    if len(variances) == 1:
        return [1.0]
    mid = len(variances) // 2
    left, right = np.mean(variances[:mid]), np.mean(variances[mid:])
    share = right / (left + right) if left + right > 0 else 0.5
    return [w * share for w in brute_halves(variances[:mid])] + [w * (1 - share) for w in brute_halves(variances[mid:])]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_halved_weights_against_brute_force(spark, n):
    v = np.random.default_rng(n).uniform(0, 1, n).tolist()
    got = spark.createDataFrame([(v,)], "v array<double>").select(allocation.halved_weights(F.col("v"), F.size("v"))).first()[0]
    assert got == pytest.approx(brute_halves(v))


def test_risk_parity_gates_its_candidates_and_keeps_rows(spark):
    rows = [(k, f"s{i:02d}", None if i % 3 else "A", None if i == 4 else 10.0 + i, float(i)) for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "p int, symbol string, sector string, vol_30d double, score double")
    out = allocation.hrp_weights(df, ["p"], gate=[F.col("score").desc()], most=12).toPandas()
    assert out.columns.tolist() == [*df.columns, "weight"] and sorted(set(out.symbol)) == [f"s{i}" for i in range(38, 50)]
    assert out.groupby("p").weight.sum().to_numpy() == pytest.approx(np.ones(2)) and (out.weight > 0).all()
    assert (out.vol_30d == 10.0 + out.score).all()
    assert allocation.hrp_weights(df.where("false"), ["p"]).count() == 0


def test_sample_correlation_moves_twins_together(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=60), rng.normal(size=60)
    series = {"a1": a, "a2": a + 0.01 * rng.normal(size=60), "b": b}
    returns = [(1, s, i, float(x)) for s, v in series.items() for i, x in enumerate(v)]
    names = spark.createDataFrame([(1, s, "X", 20.0) for s in series], "p int, symbol string, sector string, vol_30d double")
    out = allocation.hrp_weights(names, ["p"], spark.createDataFrame(returns, "p int, symbol string, date int, ret double"))
    w = {r["symbol"]: r["weight"] for r in out.collect()}
    assert w["b"] == pytest.approx(0.5) and w["a1"] == pytest.approx(0.25)


def test_caps_invariants(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(25):
        raw = rng.uniform(0.01, 1.0, rng.integers(10, 31))
        rows += [(p, f"s{i:02d}", "ABCDE"[(i + p) % 5], float(x)) for i, x in enumerate(raw / raw.sum())]
    rows += [(100, "a", "A", 0.5), (100, "b", "B", 0.5), (101, "a", None, 0.9), (101, "b", None, 0.1)]  # caps that cannot hold
    df = spark.createDataFrame(rows, "p int, symbol string, sector string, weight double")
    out = allocation.iterative_caps(df, ["p"], Constraints(max_weight=0.15, max_sector=0.30)).toPandas()
    assert out.columns.tolist() == df.columns and len(out) == len(rows)
    assert out.groupby("p").weight.sum().to_numpy() == pytest.approx(np.ones(27))
    feasible = out[out.p < 100]
    assert feasible.weight.max() <= 0.15 + 0.02
    assert feasible.groupby(["p", "sector"]).weight.sum().max() <= 0.30 + 0.02


def test_sample_correlation_matches_pandas(spark):
    rng = np.random.default_rng(0)
    wide = pd.DataFrame(rng.normal(size=(60, 4)), columns=list("ABCD"), index=pd.date_range("2020-01-01", periods=60).date)
    wide.iloc[5, 1] = np.nan
    long = wide.stack().rename("ret").reset_index().rename(columns={"level_0": "date", "level_1": "symbol"}).assign(k="p")
    got = allocation.return_correlations(spark.createDataFrame(long), ["k"]).toPandas()
    want = 0.8 * wide.dropna().corr() + 0.2 * np.eye(4)
    for r in got.itertuples():
        assert r.correlation == pytest.approx(want.loc[r.symbol, r.other])
    assert len(got) == 10


def test_correlation_has_no_limit_on_names(spark):
    days, names = spark.range(3), spark.range(60).select(F.col("id").alias("n"))
    df = days.join(names).select(F.lit("p").alias("k"), F.col("n").cast("string").alias("symbol"), F.col("id").alias("date"), F.sin(F.col("id") * (F.col("n") + 1)).alias("ret"))
    assert allocation.return_correlations(df, ["k"]).count() == 60 * 61 // 2


# --- returns, metrics -------------------------------------------------------------------------


def series(spark, values, start="2020-01-01", key="p"):
    days = pd.date_range(start, periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"portfolio_id": key, "date": days, "ret": values}))


def test_metrics_against_pandas(spark):
    rng = np.random.default_rng(2)
    r = pd.Series(rng.normal(0.0005, 0.01, 300))
    got = metrics.performance_metrics(series(spark, r), ["portfolio_id"]).first()
    growth = (1 + r).cumprod()
    dd = growth / growth.cummax() - 1
    assert got.total_return == pytest.approx((growth.iloc[-1] - 1) * 100, abs=0.006)
    assert got.max_drawdown == pytest.approx(dd.min() * 100, abs=0.006)
    assert got.avg_drawdown == pytest.approx(dd[dd < 0].mean() * 100, abs=0.006)
    assert got.sharpe_ratio == pytest.approx((r.mean() - 0.045 / 252) / r.std() * np.sqrt(252), abs=6e-4)
    assert got.sortino_ratio == pytest.approx((r.mean() - 0.045 / 252) / r[r < 0].std() * np.sqrt(252), abs=6e-4)
    assert got.hit_ratio == pytest.approx((r > 0).mean() * 100, abs=0.06)
    # longest time below the peak, in days
    best, since = 0, None
    for i, below in enumerate(dd < 0):
        if below and since is None:
            since = i
        if since is not None and (not below or i == len(dd) - 1):
            best, since = max(best, i - since), None
    assert got.max_drawdown_duration_days == best


def test_short_series_has_no_metrics(spark):
    assert metrics.performance_metrics(series(spark, [0.01] * 9), ["portfolio_id"]).count() == 0


def test_known_drawdown(spark):
    close = [100.0, 110.0, 105.0, 95.0, 90.0, 100.0, 110.0]
    days = pd.date_range("2020-01-01", periods=7).date
    df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "date": days, "close": close}))
    got = metrics.benchmark_metrics(df, ["symbol"]).first()
    assert got.max_drawdown_pct == pytest.approx(-18.18) and got.return_pct == pytest.approx(10.0) and got.days == 7


def test_quarterly_cagr(spark):
    rows = [("c", dt.date(2020, 1 + 3 * i, 1), 5.0, 0.0, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, "config_id string, period_start date, portfolio_return double, benchmark_return double, alpha double")
    got = metrics.walk_forward_summary(df, ["config_id"]).first()
    assert got.portfolio_cagr == pytest.approx(21.55) and got.hit_rate == 100.0 and got.tracking_error == 0.0


def test_snapshot_differences(spark):
    rows = [("p", dt.date(2020, 1, 1), "A", 0.5), ("p", dt.date(2020, 1, 1), "B", 0.5), ("p", dt.date(2020, 4, 1), "B", 0.4), ("p", dt.date(2020, 4, 1), "C", 0.6)]
    df = spark.createDataFrame(rows, "portfolio_id string, date date, symbol string, weight double")
    per = weights.turnover(weights.snapshot_changes(df, ["portfolio_id"]), ["portfolio_id"]).first()
    assert per.turnover == pytest.approx(0.6) and (per.entries, per.exits, per.unchanged) == (1, 1, 1)
    annual = weights.annual_turnover(df, ["portfolio_id"]).first()
    assert annual.turnover_annual == pytest.approx(0.6 * 252 / 2 * 100) and annual.num_trades == 3


def test_hold_unless_score_falls(spark):
    d = dt.date(2020, 4, 1)
    changes = spark.createDataFrame([("p", d, "A", 0.5, 0.0, -0.5), ("p", d, "B", 0.5, 1.0, 0.5), ("p", d, "C", 0.2, 0.0, -0.2)], "portfolio_id string, date date, symbol string, old_weight double, new_weight double, change double")
    scores = spark.createDataFrame([("p", d, "A", 0.8, 0.75), ("p", d, "C", 0.8, 0.5)], "portfolio_id string, date date, symbol string, old_score double, new_score double")
    got = {r.symbol: r.weight for r in weights.hold_unless_score_falls(changes, scores, ["portfolio_id"]).collect()}
    assert got == pytest.approx({"A": 0.5 / 1.5, "B": 1.0 / 1.5})


def loop_returns(weights_by_date, wide, bps):
    """Day by day, as a plain loop."""
    out, current = {}, {}
    for day in wide.index:
        cost = 0.0
        if day in weights_by_date:
            new = weights_by_date[day]
            if current:
                names = set(current) | set(new)
                cost = sum(abs(new.get(s, 0) - current.get(s, 0)) for s in names) / 2 * bps / 10000
            current = new
        if current:
            out[day] = sum(w * wide.loc[day, s] for s, w in current.items() if not np.isnan(wide.loc[day, s])) - cost
    return out


def test_portfolio_returns_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    days = pd.date_range("2020-01-01", periods=200).date
    wide = pd.DataFrame(rng.normal(0, 0.01, (200, 5)), index=days, columns=list("ABCDE"))
    wide.iloc[17, 2] = np.nan
    sets = {days[10]: {"A": 0.5, "B": 0.5}, days[80]: {"B": 0.3, "C": 0.7}, days[150]: {"A": 0.2, "D": 0.4, "E": 0.4}}
    w = spark.createDataFrame([("p", d, s, x) for d, ws in sets.items() for s, x in ws.items()], "portfolio_id string, rebalance_date date, symbol string, weight double")
    r = spark.createDataFrame(wide.stack().rename("ret").reset_index().rename(columns={"level_0": "date", "level_1": "symbol"}))
    got = {x.date: x.ret for x in backtest.portfolio_returns(w, r, ["portfolio_id"], 12.0).collect()}
    want = loop_returns(sets, wide, 12.0)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-12)


def test_walk_forward_by_brute_force(spark):
    """Rebalance dates, availability, skipped dates and weights on a tiny panel."""
    rng = np.random.default_rng(7)
    days = pd.date_range("2019-06-01", "2021-03-31").date
    symbols = [f"S{i}" for i in range(8)]
    prices = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (len(days), 8)), axis=0)), index=days, columns=symbols)
    long = prices.stack().rename("close").reset_index().rename(columns={"level_0": "date", "level_1": "symbol"})
    fin = pd.DataFrame(
        [
            (s, y, "T" if i % 2 else "H", 100.0 + i, 10.0 + i, 8.0 + i, 5.0 + i, 20.0, 5.0, 50.0 + i, 1.0, 10.0)
            for i, s in enumerate(symbols)
            for y in (2017, 2018, 2019)
            if not (s == "S7" and y == 2018)
        ],
        columns="symbol year sector revenue ebit net_income fcf total_debt cash equity interest_expense shares_outstanding".split(),
    )
    p = backtest.WalkForward(constraints=Constraints(min_positions=5, max_positions=6))
    w = backtest.fundamental_weights(spark.createDataFrame(long), spark.createDataFrame(fin), p).toPandas()
    quarter_ends = [d for d in days if d.month in (3, 6, 9, 12) and (d + dt.timedelta(days=1)).day == 1]
    assert sorted(w.rebalance_date.unique()) == quarter_ends
    assert (w.groupby("rebalance_date").size() == 6).all() and np.allclose(w.groupby("rebalance_date").weight.sum(), 1.0)
    # 2019 accounts become usable 120 days after the year end
    known = {d: (2019 if d >= dt.date(2019, 12, 31) + dt.timedelta(days=120) else 2018) for d in quarter_ends}
    for r in w.itertuples():
        want = known[r.rebalance_date]
        assert r.year == (2017 if r.symbol == "S7" and want == 2018 else want)
        assert r.price == pytest.approx(prices.loc[r.rebalance_date, r.symbol])
    few = backtest.WalkForward(constraints=Constraints(min_positions=9, max_positions=20))
    assert backtest.fundamental_weights(spark.createDataFrame(long), spark.createDataFrame(fin), few).count() == 0


def test_publication_rules(spark):
    fin = spark.createDataFrame([("A", y) for y in range(2019, 2025)], "symbol string, year int")
    got = {r.year for r in calendar.point_in_time(fin, "2024-01-15").collect()}
    assert 2023 not in got and 2024 not in got and 2022 in got
    day = spark.createDataFrame([(dt.date(2024, 4, 15),), (dt.date(2024, 2, 15),)], "d date")
    years = {r.d: r.y for r in day.select("d", calendar.latest_available_year("d").alias("y")).collect()}
    assert years == {dt.date(2024, 4, 15): 2023, dt.date(2024, 2, 15): 2022}


def test_rebalance_calendars(spark):
    days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2020-01-01", "2020-12-31")], "date date")
    q = sorted(r.date for r in calendar.rebalance_dates(days, "Q").collect())
    assert q == [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]
    assert calendar.rebalance_dates(days, "M").count() == 9  # February, May and October end on a weekend
    assert calendar.rebalance_dates(days, "M", "last_trading_day").count() == 12
    with pytest.raises(ValueError):
        calendar.rebalance_dates(days, "D")
    starts = [r.date for r in calendar.quarter_starts(days.sparkSession, "2020-01-15", "2020-12-31").collect()]
    assert starts == [dt.date(2020, 4, 1), dt.date(2020, 7, 1), dt.date(2020, 10, 1)]


def plain_held(targets, zone, budget):
    """{date: (held, turnover, used)} of one portfolio; ``targets``: {date: {symbol: weight}}."""
    held, year, used, out = None, None, 0.0, {}
    for day in sorted(targets):
        want, used = targets[day], used if day.year == year else 0.0
        year, spent = day.year, 0.0
        if held is None:
            held = dict(want)
        else:
            new = {s: held[s] if s in held and s in want and abs(want[s] - held[s]) < zone else want.get(s, 0.0) for s in {*held, *want}}
            total = sum(new.values())
            move = {s: new[s] / total - held.get(s, 0.0) for s in new}
            spent = sum(map(abs, move.values())) / 2
            part = min(1.0, max(budget - used, 0.0) / spent) if spent else 1.0
            held = {s: held.get(s, 0.0) + part * move[s] for s in new}
            held = {s: w for s, w in held.items() if w > 1e-15}
            spent *= part
        used += spent
        out[day] = (dict(held), spent, used)
    return out


def test_held_weights_carry_state(spark):
    rng = np.random.default_rng(5)
    books = {}
    for p in range(4):
        books[p] = {}
        for q in range(12):
            names = rng.choice(12, size=8, replace=False)
            w = rng.dirichlet(np.full(8, 30.0))
            books[p][dt.date(2020 + q // 4, 3 * (q % 4) + 1, 1)] = {f"S{n}": float(x) for n, x in zip(names, w, strict=True)}
    # below the zone twice in a row: measured against the weight held, not against the last target
    books[9] = {dt.date(2021, m, 1): {"A": a, "B": 1 - a} for m, a in ((1, 0.500), (4, 0.507), (7, 0.513))}
    rows = [(p, d, s, w) for p, book in books.items() for d, t in book.items() for s, w in t.items()]
    rows += [(9, dt.date(2021, 1, 1), None, 1.0), (9, dt.date(2021, 1, 1), "C", None), (9, None, "A", 1.0)]
    df = spark.createDataFrame(rows, "portfolio_id int, date date, symbol string, weight double")
    got = rebalance.held_weights(df, ["portfolio_id"]).toPandas()
    assert got.groupby(["portfolio_id", "date"])["weight"].sum().sub(1).abs().max() < 1e-9
    assert got["turnover_year"].max() <= 0.80 + 1e-9
    for p, book in books.items():
        for day, (held, spent, used) in plain_held(book, 0.01, 0.80).items():
            mine = got[(got.portfolio_id == p) & (got.date == day)]
            assert {r.symbol: round(r.weight, 9) for r in mine.itertuples()} == {s: round(w, 9) for s, w in held.items()}
            assert np.allclose(mine["turnover"], spent) and np.allclose(mine["turnover_year"], used)
    last = got[(got.portfolio_id == 9) & (got.symbol == "A")].set_index("date")["weight"]
    assert last[dt.date(2021, 4, 1)] == 0.5 and last[dt.date(2021, 7, 1)] == pytest.approx(0.513)
    assert rebalance.held_weights(df.limit(0), ["portfolio_id"]).count() == 0
