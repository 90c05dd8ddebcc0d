"""Behaviour on planted series: what the analyzers have to find, refuse, or leave alone."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators import clusters, confluence, flows, index_pattern, knn, macro, observations, outcomes, paths, scan, seasonality
from tidemark.operators.asof import asof
from tidemark.sources import catalogue, tables

NETS, SHARES = knn.NETS, knn.SHARES


def weekly(n, start="2000-01-04"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="7D")]


def frame(spark, **columns):
    data = pd.DataFrame({"market": "M", **columns})
    return spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), ", ".join(f"{c} {'string' if c in ('market', 'label') else 'date' if c == 'date' else 'double'}" for c in data.columns))


def days(n, start="2010-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def test_asof_edges(spark):
    d = lambda x: dt.date(2020, 1, x)
    px = spark.createDataFrame([("M", d(5), 1.0), ("M", d(10), 2.0)], "market string, date date, close double")
    left = spark.createDataFrame([("M", x) for x in (d(4), d(5), d(7), d(10), d(25), None)], "market string, date date")
    back = {r.date: r.close for r in asof(left, px, ["market"], "date", "date", {"close": "close"}).collect()}
    assert back == {d(4): None, d(5): 1.0, d(7): 1.0, d(10): 2.0, d(25): 2.0, None: None}
    ahead = {r.date: r.close for r in asof(left, px, ["market"], "date", "date", {"close": "close"}, "forward").collect()}
    assert ahead == {d(4): 1.0, d(5): 1.0, d(7): 2.0, d(10): 2.0, d(25): None, None: None}
    near = {r.date: r.close for r in asof(left, px, ["market"], "date", "date", {"close": "close"}, "backward", 3).collect()}
    assert near[d(25)] is None and near[d(7)] == 1.0
    with pytest.raises(ValueError):
        asof(left, px, ["market"], "date", "date", {"close": "close"}, "sideways")


def test_normalized_positions(spark):
    cols = [a[0] for k, a in tables.ALIASES.items() if k != "code"]
    row = lambda date, x: (date, "GOLD", *[x] * 7)
    raw = spark.createDataFrame([row("2020-01-07T00:00:00", "5"), row("2020-01-07", "7"), row("bad", "1"), row("2020-01-14", "x")], ", ".join(f"`{c.upper()}` string" for c in cols))
    out = {r.date: r for r in tables.normalize_positions(raw.coalesce(1), F.lit("M")).collect()}
    assert set(out) == {dt.date(2020, 1, 7), dt.date(2020, 1, 14)}
    assert out[dt.date(2020, 1, 7)].oi == 7.0 and out[dt.date(2020, 1, 7)].commercial_net == 0.0 and out[dt.date(2020, 1, 14)].oi is None
    with pytest.raises(ValueError):
        tables.resolve(["a"], ["b"])
    assert tables.resolve(["a"], ["b"], False) is None


def test_prices_and_macro_files(spark, tmp_path):
    raw = spark.createDataFrame([("2020-01-02", "1.5", "x"), ("2020-01-03", None, "y"), (None, "2", "z")], "`Date` string, `Close` string, `Other` string")
    assert [tuple(r) for r in tables.normalize_prices(raw, F.lit("M")).collect()] == [("M", dt.date(2020, 1, 2), 1.5)]
    (tmp_path / "m.csv").write_text("DATE,CPI\n2020-01-01,1.0\n2020-02-01,.\n")
    assert [tuple(r) for r in tables.read_macro(spark, str(tmp_path / "m.csv"), "CPI").collect()] == [("CPI", dt.date(2020, 1, 1), 1.0)]
    (tmp_path / "e.csv").write_text("DATE,CPI\n2020-02-01,.\n")
    with pytest.raises(ValueError):
        tables.read_macro(spark, str(tmp_path / "e.csv"), "CPI")


def test_cache_keeps_other_markets(spark, tmp_path):
    path = str(tmp_path / "cache")
    a = spark.createDataFrame([("Euro FX", 1.0), ("Gold!", 2.0)], "market string, close double")
    tables.write_cache(a, path)
    tables.write_cache(spark.createDataFrame([("Gold!", 3.0)], "market string, close double"), path)
    assert sorted((r.cache_key, r.close) for r in tables.read_cache(spark, path).collect()) == [("euro_fx", 1.0), ("gold", 3.0)]


def test_freshness(spark):
    rows = spark.createDataFrame([("A", dt.date(2026, 8, 1)), ("B", dt.date(2026, 7, 1))], "market string, date date")
    markets = spark.createDataFrame([("A",), ("B",), ("C",)], "market string")
    got = {r.market: r.p_status for r in tables.freshness(rows, markets, F.lit("2026-08-04").cast("date"), 14, "p").collect()}
    assert got == {"A": "current", "B": "stale", "C": "missing"}


def test_wilson(spark):
    r = spark.range(1).select(*(expr.wilson(F.lit(s), F.lit(n), u).alias(f"x{i}") for i, (s, n, u) in enumerate([(8, 10, False), (8, 10, True), (0, 0, False), (5, 3, False)]))).first()
    assert r.x0 == pytest.approx(0.4902, abs=1e-3) and r.x1 == pytest.approx(0.9433, abs=1e-3) and r.x2 is None and r.x3 is None


def test_dominant_range_has_the_sign_of_the_majority(spark):
    for sign in (1, -1):
        rows = spark.createDataFrame([("M", sign * x) for x in (0.01, 0.03, 0.05, 0.09, -0.20)], "market string, r double")
        got = outcomes.dominant(rows, ["market"], "r").first()
        assert got.range_low * sign > 0 and got.range_high * sign > 0
    tie = outcomes.levels(spark.createDataFrame([("M", 0.1), ("M", -0.1), ("M", 0.0)], "market string, r double"), ["market"], "r").first()
    assert (tie.direction, tie.hit_rate, tie.range_low) == ("neutral", 0.5, None)


def sine(spark, n=240):
    x = np.sin(np.linspace(-2, 2, n) * 7)
    columns = {"date": weekly(n), "return_8w": np.where(x > 0, 0.03, -0.02)}
    for i, c in enumerate(NETS):
        columns[c], columns[f"{c}_oi"] = 1000 * x + i, x / 10
    return frame(spark, **columns)


def test_analogs_keep_their_distance(spark):
    rows = knn.pure_net(sine(spark), n=20).orderBy("rank").collect()
    dates = [r.date for r in rows]
    assert 0 < len(rows) <= 20 and all(abs((a - b).days) >= 56 for i, a in enumerate(dates) for b in dates[:i])
    assert [r.distance for r in rows] == sorted(r.distance for r in rows)
    assert knn.pure_net(sine(spark, 2)).count() == 0
    with pytest.raises(KeyError):
        knn.group_net(sine(spark), "nobody")


def test_constant_feature_does_not_scale_to_null(spark):
    df = sine(spark).withColumn("commercial_net", F.lit(5.0))
    assert all(r.distance is not None for r in knn.pure_net(df).collect())


def test_zones_have_one_current(spark):
    zones = clusters.zone_table(clusters.zoned(sine(spark), "commercial_net")).collect()
    assert len(zones) >= 3 and sum(r.is_current for r in zones) == 1
    assert [r.center for r in sorted(zones, key=lambda r: r.place)] == sorted(r.center for r in zones)


def test_planted_cluster(spark):
    rng = np.random.default_rng(7)
    state = np.tile(np.arange(4), 60)
    columns = {"date": weekly(240), "return_8w": np.where(state == 3, 0.05, -0.01) + rng.normal(0, 0.005, 240)}
    for c in NETS + SHARES:
        columns[c] = 3.0 * state + rng.normal(0, 0.25, 240)
    fit = clusters.fitted(frame(spark, **columns))
    result, _ = clusters.analyze(fit, gap_weeks=1, min_sample=8)
    got = result.first()
    assert got.direction == "bullish" and got.n >= 8 and got.k == 4 and got.silhouette > 0.5
    assert clusters.fitted(frame(spark, **{k: v[:60] for k, v in columns.items()})).count() == 0


def test_planted_onset(spark):
    dates = days(900)
    close = np.full(900, 100.0)
    events = list(range(0, 840, 60))[:12]
    for e in events:
        close[e : e + 60] = 100 * np.concatenate([np.ones(5), np.linspace(1, 1.06, 36), np.ones(19)])
    prices = frame(spark, date=dates, close=close)
    at = frame(spark, date=[dates[e] for e in events])
    bias = spark.createDataFrame([("M", "bullish")], "market string, bias string")
    reports = spark.createDataFrame([("M", dates[890])], "market string, report_date date")
    got = paths.cluster_timing(at, prices, bias, reports).first()
    assert got.onset_day >= 5 and got.peak_day >= got.onset_day and got.n_paths == 12 and got.window_start <= got.window_end and got.status in ("before", "onset", "active", "late")
    assert paths.cluster_timing(at, prices, bias.withColumn("bias", F.lit("neutral")), reports).count() == 0
    ends = paths.timing(at, prices).first()
    assert ends.bias == "bullish" and ends.window_start >= 1


def flow_rows(spark, longs, shorts, close):
    n = len(close)
    return frame(spark, date=weekly(n), close=close, noncomm_long=longs, noncomm_short=shorts)


def test_flows(spark):
    rng = np.random.default_rng(42)
    n = 180
    longs, shorts, close = 1000 + rng.normal(0, 5, n).cumsum(), 1000 + rng.normal(0, 5, n).cumsum(), 100 + rng.normal(0, 0.1, n).cumsum()
    longs[-9:] = longs[-10] + 400 * np.arange(1, 10)
    shorts[-9:] = shorts[-10]
    close[-9:] = close[-10] * (1 - 0.02 * np.arange(1, 10))
    got = flows.divergence(flows.horizons(flow_rows(spark, longs, shorts, close))).first()
    assert got.signal == "bullish" and got.confirmed >= 1
    both = flows.horizons(flow_rows(spark, longs, longs, close), min_z=-10.0).where("weeks = 8").first()
    assert both.state == "bullish_accumulation_mixed" and both.signal == "none"
    falling = longs[::-1].copy()
    only_less = flows.divergence(flows.horizons(flow_rows(spark, falling, falling, close))).first()
    assert only_less.signal == "none"
    assert flows.horizons(flow_rows(spark, longs[:50], shorts[:50], close[:50])).count() == 0


def test_extremes_and_transition(spark):
    n = 180
    ramp = np.linspace(-1, 1, n)
    columns = {"date": weekly(n), "close": 100 + 5 * ramp, "oi": np.full(n, 1e6)}
    wave = np.sin(np.arange(n) / 5)
    for name, sign in (("comm", 1), ("noncomm", -1), ("nonrep", -1)):
        columns[f"{name}_long"], columns[f"{name}_short"] = 5e4 + 2e4 * wave * sign, 5e4 - 2e4 * wave * sign
    for name, sign in (("comm", 1), ("noncomm", -1), ("nonrep", -1)):
        columns[f"{name}_long"][-1] += 9e4 * sign
        columns[f"{name}_short"][-1] -= 4e4 * sign
    for net, (a, b) in tables.NETS.items():
        columns[net] = columns[a] - columns[b]
        columns[f"{net}_oi"] = columns[net] / 1e6
    df = frame(spark, **columns)
    got = flows.extremes(df).first()
    assert got.signal == "bullish_reversal_zone" and got.confirmed and got.retail_support == "bullish"
    assert flows.transition(df).first().phase >= 1
    assert flows.extremes(df.limit(100)).count() == 0


def test_index_pattern_refuses_and_matches(spark):
    n = 260
    wave = np.sin(2 * np.pi * np.arange(n) / 52)
    base = {"date": weekly(n), "return_8w": 0.01 * wave, "commercial_net": 1e5 * wave, "nonreportable_net": 4e4 * wave}
    quiet = {k: np.array(v, dtype=object) for k, v in base.items()}
    quiet["commercial_net"][-1], quiet["nonreportable_net"][-1] = 0.0, 0.0
    r = index_pattern.analyze(frame(spark, **quiet), min_history=80, gap_weeks=4).first()
    assert not r.available and r.reason == "not_confirmed"
    loud = {k: np.array(v, dtype=object) for k, v in base.items()}
    loud["commercial_net"][-1], loud["nonreportable_net"][-1] = 120_000.0, 50_000.0
    r = index_pattern.analyze(frame(spark, **loud), min_history=80, gap_weeks=4).first()
    assert r.available and r.n > 0 and r.commercial_zone == "high" and 0 <= r.wilson_low <= r.wilson_high <= 1
    short = index_pattern.analyze(frame(spark, **{k: v[:120] for k, v in base.items()})).first()
    assert not short.available and short.reason == "too_few_rows"
    indexed = observations.with_indices(frame(spark, **base))
    assert indexed.where("commercial_index NOT BETWEEN 0 AND 100 OR commercial_net_percentile NOT BETWEEN 0 AND 100").count() == 0


def test_release_lag_and_transforms(spark):
    specs = spark.createDataFrame([("m", "monthly", "level", 14), ("q", "quarterly", "level", 30), ("y", "monthly", "yoy_pct", 0), ("r", "weekly", "rolling4", 2)], "series_key string, frequency string, transform string, release_lag_days int")
    months = [d.date() for d in pd.date_range("2020-01-01", periods=14, freq="MS")]
    rows = [("m", months[0], 1.0), ("q", dt.date(2020, 2, 1), 1.0)] + [("y", d, 100 * 1.002**i) for i, d in enumerate(months)] + [("r", d, float(i)) for i, d in enumerate(months[:4])]
    got = macro.transformed(spark.createDataFrame(rows, "series_key string, date date, value double"), specs).collect()
    by = {(r.series_key, r.observation_date): r for r in got}
    assert by["m", months[0]].available_date == dt.date(2020, 2, 14) and by["q", dt.date(2020, 2, 1)].available_date == dt.date(2020, 4, 30)
    assert by["y", months[12]].feature_value == pytest.approx(100 * (1.002**12 - 1)) and ("y", months[11]) not in by
    assert by["r", months[2]].feature_value == 1.0 and ("r", months[1]) not in by and by["r", months[3]].feature_value == 1.5


def test_regime_needs_three_series(spark):
    specs = spark.createDataFrame([("a", "monthly", "level", 0)], "series_key string, frequency string, transform string, release_lag_days int")
    weights = spark.createDataFrame([("M", "a", 1.0), ("M", "b", 1.0)], "market string, series_key string, weight double")
    months = [d.date() for d in pd.date_range("2010-01-01", periods=80, freq="MS")]
    series = spark.createDataFrame([("a", d, float(i % 7)) for i, d in enumerate(months)], "series_key string, date date, value double")
    prices = frame(spark, date=days(50), close=np.arange(50) + 1.0)
    got = macro.regime(series, specs, weights, prices).first()
    assert not got.available and got.reason == "too_few_series"
    assert [tuple(r) for r in macro.missing_series(series, weights).collect()] == [("M", "b")]


def test_profiles(spark):
    markets = spark.createDataFrame([("Gold", "Edelmetalle"), ("Euro FX", "Währungen"), ("US Dollar Index", "Währungen"), ("Nasdaq 100 E-mini", "Aktienindizes"), ("X", "none"), ("Y", None)], "market string, category string")
    got = {(r.market, r.series_key): r.weight for r in catalogue.profiles(markets).collect()}
    assert got["Gold", "dollar"] == -1.0 and got["Euro FX", "gdp"] == -0.65 and got["US Dollar Index", "gdp"] == 0.65
    assert got["Nasdaq 100 E-mini", "fed_funds"] == -0.85 and got["X", "gdp"] == 0.3 and got["Y", "gdp"] == 0.3
    assert catalogue.us_specs(spark).count() == 17
    specs = spark.createDataFrame([("Japan", "cpi"), ("Japan", "zzz")], "country string, series_key string")
    assert [r.series_key for r in catalogue.country_profiles(spark.createDataFrame([("Yen", "Japan")], "market string, country string"), specs).collect()] == ["cpi"]
    order = spark.createDataFrame([("Währungen", 2), ("Edelmetalle", 1)], "category string, place int")
    assert [(r.category, r.markets) for r in catalogue.grouped(markets, order).collect()] == [("Edelmetalle", ["Gold"]), ("Währungen", ["Euro FX", "US Dollar Index"])]


def test_rising_market_rises_every_season(spark):
    dates = [d.date() for d in pd.bdate_range("2010-01-04", "2025-12-31")]
    prices = frame(spark, date=dates, close=100.0 + np.arange(len(dates)))
    rows = seasonality.same_week_matrix(prices, as_of="2025-08-06").collect()
    assert len(rows) == 12 and all(r.hit_rate == 1.0 and r.direction == "bullish" for r in rows)
    with pytest.raises(ValueError):
        seasonality.same_week_returns(prices, 5)


def test_calibration(spark):
    dates = [d.date() for d in pd.bdate_range("2005-01-03", "2026-08-06")]
    i = np.arange(len(dates))
    prices = frame(spark, date=dates, close=(100 + 10 * np.sin(2 * np.pi * i / 252)) * (1 + i / 20000))
    result, chart, ahead = seasonality.calibrate(prices)
    got = result.first()
    assert len(got.shifts) == 5 and got["shift"] == round(float(np.median(list(got.shifts.values())))) and 1 <= got.phase <= 52
    weeks = [r.week for r in chart.orderBy("week").collect()]
    assert weeks == list(range(1, 53)) and ahead.count() <= 3


def test_iso_weeks(spark):
    row = spark.createDataFrame([(dt.date(2021, 1, 1),)], "d date").select(expr.iso_year(F.col("d")).alias("y"), F.weekofyear("d").alias("w"), expr.curve_week(F.col("d")).alias("c")).first()
    assert (row.y, row.w, row.c) == (2020, 53, 52)


def module(market, name, direction, n, up, down, median, available=True):
    return (market, name, direction, n, up, down, median, None, None, available)


def test_confluence_states_and_ranking(spark):
    rows = []
    for market, directions in {"full": "UUU", "part": "UU-", "clash": "UUD", "even": "UD-", "one": "U--", "none": "---"}.items():
        for name, d in zip(confluence.MODULES, directions):
            up = 18 if d == "U" else 2
            rows.append(module(market, name, {"U": "Bullish", "D": "Bearish", "-": "Neutral"}[d], 20, up, 20 - up, 0.03 if d == "U" else -0.03))
    schema = "market string, module string, direction string, n int, up int, down int, median double, range_low double, range_high double, available boolean"
    evidence = confluence.evidence(spark.createDataFrame(rows, schema))
    got = [(r.market, r.status, r.direction, r.confirmations) for r in confluence.ranked(confluence.combine(evidence)).collect()]
    assert got == [
        ("full", "confirmed", "bullish", 3), ("part", "partly_confirmed", "bullish", 2), ("clash", "conflicting", "bullish", 2), ("even", "conflicting", "conflict", 1),
        ("one", "insufficient", "bullish", 1), ("none", "insufficient", "none", 0),
    ]
    unavailable = confluence.evidence(spark.createDataFrame([module("M", "macro", None, None, None, None, None, True)], schema)).first()
    assert not unavailable.available and unavailable.direction == "n.a." and unavailable.wilson_low is None


def test_common_years(spark):
    d = lambda s: F.lit(s).cast("date")
    r = spark.range(1).select(confluence.common_years([d("2000-01-01"), d(None)], [d("2010-01-01"), d("2020-01-01")]).alias("a"), confluence.common_years([d("2010-01-01")], [d("2000-01-01")]).alias("b")).first()
    assert r.a == pytest.approx(3653 / 365.25) and r.b is None


def test_rankings(spark):
    rows = spark.createDataFrame([(f"m{i}", 30, "bullish", 0.8, 0.02 + i / 100) for i in range(7)], "market string, net8_n int, net8_direction string, net8_hit_rate double, net8_median double")
    assert [r.market for r in scan.top_pure_net(rows, 8).collect()] == ["m6", "m5", "m4", "m3", "m2"]
    with pytest.raises(ValueError):
        scan.top_pure_net(rows, 6)
    turns = spark.createDataFrame([("A", "", 1, 80, True, True, True), ("B", "", 3, 50, True, False, False), ("C", "bad", 4, 99, True, True, True)], "market string, error string, transition_phase int, transition_score int, transition_convergence boolean, transition_sustained boolean, transition_price_confirmed boolean")
    assert [r.market for r in scan.top_transitions(turns).collect()] == ["B", "A"]


def test_zero_open_interest_and_latest_z(spark):
    df = spark.createDataFrame([("M", 1.0, 0.0)], "market string, commercial_net double, oi double")
    assert df.select(expr.share(F.col("commercial_net"), F.col("oi")).alias("s")).first().s is None
    flat = windows.with_place(frame(spark, date=weekly(60), x=np.ones(60)))
    assert flat.groupBy("market").agg(windows.latest_z(F.col("x"), F.col("is_last")).alias("z")).first().z == 0.0


def test_cache_with_fallback(spark):
    from tidemark.sources import tables

    cached = spark.createDataFrame([("A", "2024-01-10", 1.0), ("B", "2023-01-10", 2.0), ("C", "2023-01-10", 3.0)], "market string, date string, close double").withColumn("date", F.col("date").cast("date"))
    loaded = spark.createDataFrame([("A", "2024-01-12", 9.0), ("B", "2024-01-12", 8.0), ("D", "2024-01-12", 7.0)], "market string, date string, close double").withColumn("date", F.col("date").cast("date"))
    failed = spark.createDataFrame([("C", "timeout"), ("E", "no such market")], "market string, reason string")
    got = {r.market: (r.close, r.origin) for r in tables.served(cached, loaded, "market", F.lit("2024-01-13").cast("date"), 7, failed).collect()}
    assert got == {"A": (1.0, "cache"), "B": (8.0, "loaded"), "C": (3.0, "stale_cache: timeout"), "D": (7.0, "loaded")}
    assert [tuple(r) for r in tables.unserved(cached, loaded, "market", failed).collect()] == [("E", "no such market")]


def test_coverage_and_countries(spark):
    from tidemark.sources import catalogue

    markets = spark.createDataFrame([("Euro FX", "Währungen"), ("Gold", "Edelmetalle"), ("X", "Y"), ("Z", "Währungen")], "market string, category string")
    got = {r.market: r for r in catalogue.coverage(markets).collect()}
    assert got["Euro FX"].country == "Eurozone" and got["Euro FX"].covered == ["own_economy"] and got["Euro FX"].missing == ["us_side", "positions"]
    assert got["Gold"].grade == "medium_high" and got["X"].grade == "low" and got["Z"].grade == "low_medium" and got["Gold"].country is None and got["Gold"].missing == ["physical_demand"]
    from tidemark.plans import display

    shown = {r.market: r for r in display.coverage_view(catalogue.coverage(markets)).collect()}
    assert shown["Gold"].grade == "mittel bis hoch" and shown["X"].missing == "–" and shown["Euro FX"].covered == "eigene Volkswirtschaft"
    used = {w for g in [*catalogue.COVERAGE.values(), catalogue.COVERAGE_OTHERWISE, catalogue.COVERAGE_OWN] for part in g[1:] for w in part.split()}
    assert used <= set(display.INPUTS)
    assert [r.category for r in catalogue.grouped(markets, catalogue.categories(spark)).collect()] == catalogue.CATEGORIES


def test_one_market_with_infinite_values_leaves_the_others_fitted(spark):
    import math
    import random
    from datetime import date, timedelta

    from tidemark.operators import clusters

    rng = random.Random(1)
    rows = []
    for market in ("A", "B"):
        for i in range(120):
            values = [3 * (i % 3) + rng.gauss(0, 0.2) for _ in range(6)]
            rows.append((market, date(2000, 1, 4) + timedelta(7 * i), *values[:5], math.inf if market == "B" and i == 119 else values[5], 0.01))
    df = spark.createDataFrame(rows, "market string, date date, " + ", ".join(f"{c} double" for c in clusters.FEATURES) + ", return_8w double")
    assert {r.market for r in clusters.fitted(df).select("market").distinct().collect()} == {"A"}
