"""Queries of macro regimes and of seasonality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import macro, seasonality
from tidemark.plans.shape import shaped, sql, sql_counted, sql_greedy
from tidemark.session import materialized
from tidemark.sources import proxies

#: How the test series are read: a monthly series for each order priority, released some days after its month.
SPECS = [("1", "monthly", "level", 10), ("2", "monthly", "diff", 0), ("3", "monthly", "rolling4", 5), ("4", "monthly", "level", 0), ("5", "monthly", "diff", 20)]
WEIGHTS = [
    ("ASIA", "1", 1.0), ("ASIA", "2", -0.5), ("ASIA", "3", 0.75), ("ASIA", "4", 0.25),
    ("EUROPE", "2", 0.5), ("EUROPE", "3", -1.0), ("EUROPE", "4", 1.0), ("EUROPE", "5", -0.25), ("EUROPE", "9", 0.1),
]
DIMENSIONS = [("inflation", "1", 1.0), ("inflation", "2", 1.0), ("growth", "3", 1.0), ("labor", "4", -1.0), ("policy", "5", 0.5), ("policy", "1", 1.0), ("liquidity", "9", 1.0)]


def specs(spark):
    return spark.createDataFrame(SPECS, "series_key string, frequency string, transform string, release_lag_days int")


def weights(spark, known: bool = False):
    rows = [w for w in WEIGHTS if w[1] != "9"] if known else WEIGHTS
    return spark.createDataFrame(rows, "market string, series_key string, weight double")


def feature_rows(spark, sf_dir):
    return macro.transformed(proxies.macro(spark, sf_dir), specs(spark))


def values(rows: list[tuple], head: str) -> str:
    show = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"{head} AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


FEATURES = "series_key:s observation_date:t available_date:t raw_value feature_value"
SQL_FEATURES = values(SPECS, "specs(series_key, frequency, transform, lag_days)") + """,
mj AS (SELECT macro.*, frequency, transform, lag_days, lag(value, 12) OVER w AS v12, lag(value, 1) OVER w AS v1, avg(value) OVER w4 AS a4, count(value) OVER w4 AS c4 FROM macro JOIN specs USING (series_key)
  WINDOW w AS (PARTITION BY series_key ORDER BY date), w4 AS (PARTITION BY series_key ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
mf AS (SELECT series_key, date AS observation_date, last_day(date) + lag_days AS available_date, value AS raw_value,
  CASE transform WHEN 'level' THEN value WHEN 'yoy_pct' THEN 100 * (value / nullif(v12, 0) - 1) WHEN 'diff' THEN value - v1 WHEN 'rolling4' THEN CASE WHEN c4 >= 3 THEN a4 END END AS feature_value FROM mj),
feats AS (SELECT * FROM mf WHERE feature_value IS NOT NULL)"""
SNAPS = "series_key:s date:t raw_value feature_value observation_date:t available_date:t z"
SQL_SNAPS = SQL_FEATURES + """,
ends AS (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', CAST((SELECT max(available_date) FROM feats) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m) WHERE last_day(CAST(m AS DATE)) <= (SELECT max(available_date) FROM feats)),
grid AS (SELECT s.series_key, date FROM (SELECT DISTINCT series_key FROM feats) s CROSS JOIN ends),
ga AS (SELECT grid.series_key, grid.date, feats.* EXCLUDE (series_key) FROM grid ASOF LEFT JOIN feats ON grid.series_key = feats.series_key AND grid.date >= feats.available_date),
snaps AS (SELECT *, CASE WHEN count(feature_value) OVER w >= 36 THEN (feature_value - avg(feature_value) OVER w) / nullif(stddev_pop(feature_value) OVER w, 0) END AS z FROM ga WINDOW w AS (PARTITION BY series_key ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))"""
SCORES = "market:s date:t score coverage n_known:l n_series:l"


def sql_scores(known: bool = False) -> str:
    rows = [w for w in WEIGHTS if w[1] != "9"] if known else WEIGHTS
    return SQL_SNAPS + "," + values(rows, "weights(market, series_key, weight)") + """,
wa AS (SELECT market, sum(abs(weight)) AS aw, count(*) AS n_series FROM weights GROUP BY 1),
wb AS (SELECT market, date, sum(coalesce(z, 0) * weight) AS top, sum(CASE WHEN z IS NOT NULL THEN abs(weight) ELSE 0 END) AS bottom, count(z) AS n_known FROM snaps JOIN weights USING (series_key) GROUP BY 1, 2),
scored AS (SELECT market, date, tanh(top / nullif(bottom, 0) / 1.25) * 100 AS score, bottom / greatest(aw, 1e-9) AS coverage, n_known, n_series FROM wb JOIN wa USING (market)),
usable AS (SELECT * FROM scored WHERE score IS NOT NULL AND coverage >= 0.55),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS k FROM usable) WHERE k = 1)"""


def score_rows(spark, sf_dir, known=False):
    snaps = macro.snapshots(feature_rows(spark, sf_dir))
    w = weights(spark, known)
    return snaps, w, macro.scores(snaps, w)


DRIVERS = "market:s rank:l series_key:s date:t z weight contribution effect:s"
REGIMES = "market:s dimension:s z regime:s"
ANALOGS = "market:s rank:l date:t distance similarity start_close return_4w return_8w return_12w"


def sql_analogs(n: int = 20) -> str:
    ret = "".join(
        f"""ar{h} AS (SELECT a.*, CASE WHEN px.date - (a.date + {7 * h}) <= 10 THEN px.close END / nullif(a.start_close, 0) - 1 AS return_{h}w FROM {src} a ASOF LEFT JOIN prices px ON a.market = px.market AND a.date + {7 * h} <= px.date),
"""
        for h, src in ((4, "a0"), (8, "ar4"), (12, "ar8"))
    )
    return sql_scores(True) + f""",
ua AS (SELECT *, count(*) OVER (PARTITION BY market) AS nn, date = max(date) OVER (PARTITION BY market) AS is_last FROM usable WHERE n_known = n_series AND n_series >= 3),
ub AS (SELECT s.series_key, s.z, u.market, u.date, u.is_last, abs(w.weight) / wa.aw AS sh FROM snaps s JOIN weights w USING (series_key) JOIN wa ON wa.market = w.market JOIN ua u ON u.market = w.market AND u.date = s.date WHERE u.nn >= 40),
uc AS (SELECT *, z - max(z) FILTER (is_last) OVER (PARTITION BY market, series_key) AS gap FROM ub),
ud AS (SELECT market, date, round(sqrt(sum(sh * gap * gap)), 9) AS distance FROM uc WHERE NOT is_last GROUP BY 1, 2),
{sql_greedy('ud', 'distance, date', 84, 2 * n, 'am')},
a0 AS (SELECT am.market, am.date, am.distance, CASE WHEN px.date - am.date <= 10 THEN px.close END AS start_close FROM am ASOF LEFT JOIN prices px ON am.market = px.market AND am.date <= px.date),
{ret}ak AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY distance, date) AS rank FROM ar12 WHERE return_8w IS NOT NULL),
an AS (SELECT *, 100 * exp(-distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY market), 1e-9)) AS similarity FROM ak WHERE rank <= {n})"""


REGIME = "market:s date:t score label:s coverage n:l hit_rate median range_low range_high confidence:s reason:s"


def analog_rows(spark, sf_dir):
    snaps, w, scored = score_rows(spark, sf_dir, True)
    return macro.analogs(snaps, w, scored, proxies.prices(spark, sf_dir))


SQL_REGIME = f"""oc AS ({sql_counted('an', 'return_8w')}),
od AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction FROM oc),
result AS (SELECT cur.market, cur.date, score, CASE WHEN score >= 50 THEN 'strongly_bullish' WHEN score >= 20 THEN 'slightly_bullish' WHEN score <= -50 THEN 'strongly_bearish' WHEN score <= -20 THEN 'slightly_bearish' ELSE 'mixed' END AS label, coverage, coalesce(n, 0) AS n, greatest(up, down) / n AS hit_rate, median,
  CASE direction WHEN 'bullish' THEN up_25 WHEN 'bearish' THEN down_25 END AS range_low, CASE direction WHEN 'bullish' THEN up_75 WHEN 'bearish' THEN down_75 END AS range_high,
  CASE WHEN coverage >= 0.85 AND coalesce(n, 0) >= 15 THEN 'high' WHEN coverage >= 0.65 AND coalesce(n, 0) >= 8 THEN 'medium' ELSE 'low' END AS confidence, '' AS reason FROM cur LEFT JOIN od ON cur.market = od.market)"""

# Seasonality
SQL_DATED = """dp AS (SELECT market, date, close, max(date) OVER (PARTITION BY market) AS cutoff, isoyear(date) AS iso_year, weekofyear(date) AS iso_week, least(weekofyear(date), 52) AS week FROM prices)"""
SQL_PATHS = SQL_DATED + """,
pa AS (SELECT market, iso_year, week, arg_max(close, date) AS close FROM dp WHERE iso_year < isoyear(cutoff) GROUP BY 1, 2, 3),
pb AS (SELECT market, iso_year FROM pa GROUP BY 1, 2 HAVING count(*) >= 35),
pc AS (SELECT market, iso_year, w.week, pa.close FROM pb CROSS JOIN (SELECT unnest(generate_series(1, 52)) AS week) w LEFT JOIN pa USING (market, iso_year, week)),
pd AS (SELECT market, iso_year, week, close, max(CASE WHEN close IS NOT NULL THEN week END) OVER (PARTITION BY market, iso_year ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wb, min(CASE WHEN close IS NOT NULL THEN week END) OVER (PARTITION BY market, iso_year ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa FROM pc),
pe AS (SELECT pd.market, pd.iso_year, pd.week, coalesce(pd.close, CASE WHEN wb IS NULL THEN a.close WHEN wa IS NULL THEN b.close ELSE b.close + (a.close - b.close) * ((pd.week - wb) / (wa - wb)) END) AS close
  FROM pd LEFT JOIN pa b ON b.market = pd.market AND b.iso_year = pd.iso_year AND b.week = pd.wb LEFT JOIN pa a ON a.market = pd.market AND a.iso_year = pd.iso_year AND a.week = pd.wa),
yp AS (SELECT market, iso_year, week, close / first_value(close) OVER (PARTITION BY market, iso_year ORDER BY week) - 1 AS path FROM pe),
yn AS (SELECT DISTINCT market, isoyear(cutoff) AS this_year FROM dp),
yw AS (SELECT yp.*, years FROM yp JOIN yn USING (market) CROSS JOIN (VALUES (5), (10), (15), (0)) t(years) WHERE years = 0 OR iso_year >= this_year - years)"""
PATHS = "market:s iso_year:l week:l path"
CURVES = "market:s years:l week:l mean median q25 q75 n_years:l"
SQL_CURVES = SQL_PATHS + ", cv AS (SELECT market, years, week, avg(path) AS mean, quantile_cont(path, 0.5) AS median, quantile_cont(path, 0.25) AS q25, quantile_cont(path, 0.75) AS q75, count(path) AS n_years FROM yw GROUP BY 1, 2, 3)"
MATRIX = "market:s years:l weeks:l n:l up:l down:l direction:s hit_rate median range_low range_high"
SQL_MATRIX = SQL_DATED + """,
sr AS (""" + " UNION ALL ".join(f"SELECT *, {h} AS weeks, lead(close, {d}) OVER (PARTITION BY market ORDER BY date) / nullif(close, 0) - 1 AS ret FROM dp" for h, d in seasonality.TRADING_DAYS.items()) + """),
sa AS (SELECT market, iso_year, iso_week, weeks, arg_min(coalesce(ret, 'nan'::DOUBLE), date) AS ret, any_value(cutoff) AS cutoff FROM sr GROUP BY 1, 2, 3, 4),
sb AS (SELECT sa.*, years FROM sa CROSS JOIN (VALUES (5), (10), (15), (0)) t(years) WHERE NOT isnan(ret) AND iso_week = weekofyear(cutoff) AND iso_year < isoyear(cutoff) AND (years = 0 OR iso_year >= isoyear(cutoff) - years)),
sc AS (""" + sql_counted("sb", "ret", "market, years, weeks") + """),
result AS (SELECT *, CASE WHEN up > down THEN up / nullif(up + down, 0) WHEN down > up THEN down / nullif(up + down, 0) WHEN up + down > 0 THEN 0.5 END AS hit_rate, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction,
  CASE WHEN up > down THEN up_25 WHEN down > up THEN down_25 ELSE all_25 END AS range_low, CASE WHEN up > down THEN up_75 WHEN down > up THEN down_75 ELSE all_75 END AS range_high FROM sc)"""
PHASES = 20
FORECAST = "market:s weeks:l n:l up:l down:l direction:s hit_rate median q25 q75"


def seasonal(spark, sf_dir):
    return materialized(proxies.prices(spark, sf_dir))


def paths_of(spark, sf_dir):
    return seasonality.year_paths(seasonal(spark, sf_dir))


def windowed(spark, sf_dir):
    prices = seasonal(spark, sf_dir)
    return seasonality.in_windows(seasonality.year_paths(prices), seasonality.current_years(prices))


def forecast_query(spark, sf_dir):
    paths = paths_of(spark, sf_dir)
    return shaped(seasonality.forecast(paths, paths.select("market").distinct().withColumn("phase", F.lit(PHASES))), FORECAST)


SHIFTS = "market:s window:s shift:l similarity"
CALIBRATED = "market:s shift:l phase:l latest_week:l n_weeks:l n_years:l similarity move_2w season_2w gap progress progress_status:s status:s stability"
CHART = "market:s week:l median q25 q75 calibrated move"


def calibration(part: int, spec: str):
    return lambda spark, sf_dir: shaped(seasonality.calibrate(seasonal(spark, sf_dir), 15, 8)[part], spec)


def shifts_query(spark, sf_dir):
    prices = materialized(seasonality.clean(seasonal(spark, sf_dir)))
    paths = seasonality.in_windows(seasonality.year_paths(prices), seasonality.current_years(prices), (15,))
    return shaped(seasonality.shifts(prices, materialized(seasonality.curves(paths)), materialized(seasonality.current_curve(prices)), 15, 8), SHIFTS)


def warping(spark, sf_dir):
    """Similarity of the last five quantities, at every report that has nine before it, to the five before those."""
    w = windows.series()
    rows = proxies.positions(spark, sf_dir).select("market", "date", *(F.array(*(F.lag("oi", i).over(w) for i in span)).alias(n) for n, span in (("a", range(5)), ("b", range(5, 10)))), F.row_number().over(w).alias("place"))
    return shaped(seasonality.warped_similarity(rows.where("place >= 10"), "a", "b"), "market:s date:t similarity")


SQL_WARP = """w0 AS (SELECT market, date, [lag(oi, 0) OVER w, lag(oi, 1) OVER w, lag(oi, 2) OVER w, lag(oi, 3) OVER w, lag(oi, 4) OVER w] AS a, [lag(oi, 5) OVER w, lag(oi, 6) OVER w, lag(oi, 7) OVER w, lag(oi, 8) OVER w, lag(oi, 9) OVER w] AS b, row_number() OVER w AS place FROM positions WINDOW w AS (PARTITION BY market ORDER BY date)),
w3 AS (SELECT market AS of_market, date, market || '|' || date AS market, list_transform(a, lambda v: (v - list_avg(a)) / CASE WHEN list_stddev_pop(a) < 1e-12 THEN 1.0 ELSE list_stddev_pop(a) END) AS x, list_transform(b, lambda v: (v - list_avg(b)) / CASE WHEN list_stddev_pop(b) < 1e-12 THEN 1.0 ELSE list_stddev_pop(b) END) AS y FROM w0 WHERE place >= 10),
dt(market, i, j, before, done) AS (
  SELECT market, CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST([0.0, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE, 'inf'::DOUBLE] AS DOUBLE[]), CAST(['inf'::DOUBLE] AS DOUBLE[]) FROM w3
  UNION ALL
  SELECT dt.market, CASE WHEN j = 5 THEN i + 1 ELSE i END, CASE WHEN j = 5 THEN 0 ELSE j + 1 END, CASE WHEN j = 5 THEN done ELSE before END,
    CASE WHEN j = 5 THEN ['inf'::DOUBLE] ELSE list_append(done, abs(x[i] - y[j + 1]) + least(before[j + 2], done[j + 1], before[j + 1])) END
  FROM dt JOIN w3 ON w3.market = dt.market WHERE i < 6 AND NOT (i = 5 AND j = 5)
),
result AS (SELECT of_market AS market, date, exp(-done[6] / 10) AS similarity FROM dt JOIN w3 USING (market) WHERE i = 5 AND j = 5)"""


#: Warping of sequences of any length: ``wz`` has the standardized values, ``wl`` the lists, ``wr`` a similarity for each key.
SQL_WARPS = """wz AS (SELECT market, win, shift, k, (x - avg(x) OVER g) / CASE WHEN stddev_pop(x) OVER g < 1e-12 THEN 1.0 ELSE stddev_pop(x) OVER g END AS zx, (y - avg(y) OVER g) / CASE WHEN stddev_pop(y) OVER g < 1e-12 THEN 1.0 ELSE stddev_pop(y) OVER g END AS zy
  FROM seqs WINDOW g AS (PARTITION BY market, win, shift)),
wl AS (SELECT market, win, shift, count(*) AS n, list(zx ORDER BY k) AS xs, list(zy ORDER BY k) AS ys FROM wz GROUP BY 1, 2, 3 HAVING count(*) >= 2),
wd(market, win, shift, i, j, before, done) AS (
  SELECT market, win, shift, CAST(1 AS BIGINT), CAST(0 AS BIGINT), list_concat(CAST([0.0] AS DOUBLE[]), list_transform(range(n), lambda u: 'inf'::DOUBLE)), CAST(['inf'::DOUBLE] AS DOUBLE[]) FROM wl
  UNION ALL
  SELECT wd.market, wd.win, wd.shift, CASE WHEN j = n THEN i + 1 ELSE i END, CASE WHEN j = n THEN 0 ELSE j + 1 END, CASE WHEN j = n THEN done ELSE before END,
    CASE WHEN j = n THEN ['inf'::DOUBLE] ELSE list_append(done, abs(xs[i] - ys[j + 1]) + least(before[j + 2], done[j + 1], before[j + 1])) END
  FROM wd JOIN wl ON wl.market = wd.market AND wl.win = wd.win AND wl.shift = wd.shift WHERE i <= n AND NOT (i = n AND j = n)
),
wr AS (SELECT wd.market, wd.win, wd.shift, round(exp(-done[n + 1] / (2 * n)), 12) AS similarity FROM wd JOIN wl ON wl.market = wd.market AND wl.win = wd.win AND wl.shift = wd.shift WHERE i = n AND j = n)"""
#: ``sh``: the best shift of each window.
SQL_SHIFTS = SQL_CURVES + """,
c15 AS (SELECT * FROM cv WHERE years = 15),
sn AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY date) AS place, close / nullif(lag(close) OVER (PARTITION BY market ORDER BY date), 0) - 1 AS r FROM dp),
sg AS (SELECT market, year(cutoff) - b AS year, s AS shift, cutoff + CAST(7 * s AS INTEGER) AS target FROM (SELECT DISTINCT market, cutoff FROM dp) CROSS JOIN (SELECT unnest(generate_series(1, 15)) AS b) CROSS JOIN (SELECT unnest(generate_series(-8, 8)) AS s)),
sa0 AS (SELECT market, year, shift, make_date(year, month(target), least(day(target), day(last_day(make_date(year, month(target), 1))))) AS anchor FROM sg),
sf AS (SELECT sa0.*, sn.place AS spot, sn.date AS found_on FROM sa0 ASOF JOIN sn ON sa0.market = sn.market AND sa0.anchor >= sn.date),
sp0 AS (SELECT sf.market, d AS days, shift, k, quantile_cont(sn.r, 0.5) AS pattern FROM sf CROSS JOIN (VALUES (3), (10)) t(d) CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS k) JOIN sn ON sn.market = sf.market AND sn.place = spot - d + k WHERE k <= d AND spot > d AND year(found_on) = year GROUP BY 1, 2, 3, 4),
so AS (SELECT market, r AS own, row_number() OVER (PARTITION BY market ORDER BY date DESC) AS back FROM sn WHERE date <= cutoff),
sd0 AS (SELECT market, d AS days, d + 1 - back AS k, own, count(*) OVER (PARTITION BY market, d) AS c FROM so CROSS JOIN (VALUES (3), (10)) t(d) WHERE back <= d AND own IS NOT NULL),
cc AS (SELECT market, week, arg_max(close, date) AS close FROM dp WHERE iso_year = isoyear(cutoff) AND date <= cutoff GROUP BY 1, 2),
cm AS (SELECT market, week, close / first_value(close) OVER (PARTITION BY market ORDER BY week) - 1 AS move FROM cc),
sw AS (SELECT cm.market, s AS shift, cm.week, move, median FROM cm CROSS JOIN (SELECT unnest(generate_series(-8, 8)) AS s) JOIN c15 ON c15.market = cm.market AND c15.week = cm.week + s),
sx AS (SELECT *, move - lag(move) OVER w AS own, median - lag(median) OVER w AS season, row_number() OVER (PARTITION BY market, shift ORDER BY week DESC) AS back FROM sw WINDOW w AS (PARTITION BY market, shift ORDER BY week)),
sy AS (SELECT market, m AS weeks, shift, week, own, season, count(*) OVER (PARTITION BY market, m, shift) AS c FROM sx CROSS JOIN (VALUES (2), (4), (8)) t(m) WHERE back <= m AND own IS NOT NULL AND season IS NOT NULL),
seqs AS (SELECT p.market, p.days || 'd' AS win, p.shift, p.k, own AS x, pattern AS y FROM sp0 p JOIN sd0 o ON o.market = p.market AND o.days = p.days AND o.k = p.k WHERE o.c = p.days UNION ALL SELECT market, weeks || 'w', shift, week, own, season FROM sy WHERE c = weeks),
""" + SQL_WARPS + """,
sh AS (SELECT market, win, shift, similarity FROM (SELECT *, row_number() OVER (PARTITION BY market, win ORDER BY similarity DESC, shift) AS place FROM wr) WHERE place = 1)"""
SQL_STABILITY = """st AS (SELECT market, years, week, median - lag(median) OVER (PARTITION BY market, years ORDER BY week) AS step FROM cv WHERE n_years >= 4),
sp AS (SELECT a.market, a.years AS ya, b.years AS yb, corr(a.step, b.step) AS r FROM st a JOIN st b ON a.market = b.market AND a.week = b.week AND a.years < b.years WHERE a.step IS NOT NULL AND b.step IS NOT NULL GROUP BY 1, 2, 3),
stab AS (SELECT market, avg(greatest(0.0, r)) AS stability FROM sp WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1)"""
#: ``cal``: the calibration, one row a market.
SQL_CALIBRATED = SQL_SHIFTS + "," + SQL_STABILITY + """,
ka AS (SELECT market, CAST(round_even(quantile_cont(shift, 0.5), 0) AS BIGINT) AS shift, quantile_cont(similarity, 0.5) AS similarity FROM sh GROUP BY 1),
kb AS (SELECT market, max(week) AS latest_week, count(*) AS n_weeks, list(move ORDER BY week) AS moves FROM cm GROUP BY 1 HAVING count(*) >= 9),
kc AS (SELECT market, list(median ORDER BY week) AS lev, max(n_years) AS n_years FROM c15 GROUP BY 1),
kd AS (SELECT *, greatest(1, least(52, latest_week + shift)) AS phase FROM ka JOIN kb USING (market) JOIN kc USING (market)),
ke AS (SELECT *, moves[-1] - moves[-3] AS move_2w, lev[phase] - lev[greatest(1, phase - 2)] AS season_2w, moves[-1] - moves[-9] AS move_8w, CASE WHEN phase >= 9 THEN lev[phase] - lev[greatest(1, phase - 8)] END AS season_8w FROM kd),
kf AS (SELECT *, move_2w - season_2w AS gap, CASE WHEN abs(season_8w) > 1e-8 THEN abs(move_8w / season_8w) * CASE WHEN sign(move_8w) = sign(season_8w) THEN 1 ELSE -1 END END AS progress FROM ke),
cal AS (SELECT kf.*, stability, CASE WHEN progress IS NULL THEN 'unreliable' WHEN progress < 0 THEN 'against' WHEN progress < 0.8 THEN 'behind' WHEN progress <= 1.2 THEN 'on_course' ELSE 'ahead' END AS progress_status,
  CASE WHEN shift >= 2 THEN 'season_ahead' WHEN shift <= -2 THEN 'season_behind' ELSE 'in_step' END AS status FROM kf LEFT JOIN stab USING (market))"""
SQL_CHART = SQL_CALIBRATED + """,
result AS (SELECT c.market, c.week, c.median, c.q25, c.q75, m.median AS calibrated, cm.move FROM c15 c JOIN cal USING (market) LEFT JOIN c15 m ON m.market = c.market AND m.week = greatest(1, least(52, c.week + cal.shift)) LEFT JOIN cm ON cm.market = c.market AND cm.week = c.week)"""
SQL_AHEAD = SQL_CALIBRATED + """,
fa AS (SELECT a.market, a.iso_year, t.weeks, b.path - a.path AS ret FROM yw a JOIN cal ON cal.market = a.market AND a.week = cal.phase CROSS JOIN (VALUES (4), (8), (12)) t(weeks) JOIN yw b ON b.market = a.market AND b.iso_year = a.iso_year AND b.week = a.week + t.weeks AND b.years = a.years WHERE a.years = 15),
fb AS (""" + sql_counted("fa", "ret", "market, weeks") + """),
ahead AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction, greatest(up, down) / n AS hit_rate, all_25 AS q25, all_75 AS q75 FROM fb)"""


def entries() -> dict[str, tuple]:
    return {
        "macro_features": (lambda spark, sf_dir: shaped(feature_rows(spark, sf_dir), FEATURES), sql(SQL_FEATURES + ", result AS (SELECT * FROM feats)", FEATURES, "tables")),
        "macro_snapshots": (lambda spark, sf_dir: shaped(macro.snapshots(feature_rows(spark, sf_dir)), SNAPS), sql(SQL_SNAPS + ", result AS (SELECT * FROM snaps)", SNAPS, "tables")),
        "macro_scores": (lambda spark, sf_dir: shaped(score_rows(spark, sf_dir)[2], SCORES), sql(sql_scores() + ", result AS (SELECT * FROM scored)", SCORES, "tables")),
        "macro_drivers": (
            lambda spark, sf_dir: (lambda s, w, c: shaped(macro.drivers(s, w, macro.current(macro.usable(c))), DRIVERS))(*score_rows(spark, sf_dir)),
            sql(
                sql_scores() + """, dr AS (SELECT w.market, s.series_key, s.date, z, weight, z * weight AS contribution FROM snaps s JOIN weights w USING (series_key) JOIN cur ON cur.market = w.market AND cur.date = s.date WHERE z IS NOT NULL),
result AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY abs(contribution) DESC, series_key) AS rank, CASE WHEN contribution > 0.10 THEN 'supportive' WHEN contribution < -0.10 THEN 'burdening' ELSE 'neutral' END AS effect FROM dr)""",
                DRIVERS, "tables",
            ),
        ),
        "macro_regimes": (
            lambda spark, sf_dir: (lambda s, w, c: shaped(macro.regimes(s, macro.current(macro.usable(c)), spark.createDataFrame(DIMENSIONS, "dimension string, series_key string, sign double")), REGIMES))(*score_rows(spark, sf_dir)),
            sql(
                sql_scores() + "," + values(DIMENSIONS, "dims(dimension, series_key, sign)") + """, rg AS (SELECT cur.market, dimension, avg(z * sign) AS z FROM snaps JOIN dims USING (series_key) JOIN cur ON cur.date = snaps.date WHERE z IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT DISTINCT cur.market, dimension FROM cur CROSS JOIN dims),
result AS (SELECT ra.market, ra.dimension, z, CASE WHEN z IS NULL THEN 'n.a.' WHEN z >= 0.5 THEN 'positive' WHEN z <= -0.5 THEN 'negative' ELSE 'neutral' END AS regime FROM ra LEFT JOIN rg ON ra.market = rg.market AND ra.dimension = rg.dimension)""",
                REGIMES, "tables",
            ),
        ),
        "macro_analogs": (lambda spark, sf_dir: shaped(analog_rows(spark, sf_dir), ANALOGS), sql(sql_analogs() + ", result AS (SELECT * FROM an)", ANALOGS, "tables")),
        "macro_regime": (
            lambda spark, sf_dir: shaped(macro.regime(proxies.macro(spark, sf_dir), specs(spark), weights(spark, True), proxies.prices(spark, sf_dir)), REGIME),
            sql(sql_analogs() + "," + SQL_REGIME, REGIME, "tables"),
        ),
        "macro_missing": (
            lambda spark, sf_dir: shaped(macro.missing_series(proxies.macro(spark, sf_dir), weights(spark)), "market:s series_key:s"),
            sql(values(WEIGHTS, "weights(market, series_key, weight)") + ", result AS (SELECT market, series_key FROM weights WHERE series_key NOT IN (SELECT series_key FROM macro))", "market:s series_key:s", "tables"),
        ),
        "year_paths": (lambda spark, sf_dir: shaped(paths_of(spark, sf_dir), PATHS), sql(SQL_PATHS + ", result AS (SELECT * FROM yp)", PATHS, "tables")),
        "seasonal_curves": (lambda spark, sf_dir: shaped(seasonality.curves(windowed(spark, sf_dir), ("market", "years")), CURVES), sql(SQL_CURVES + ", result AS (SELECT * FROM cv)", CURVES, "tables")),
        "season_curves_wide": (
            lambda spark, sf_dir: shaped(seasonality.curves_by_window(windowed(spark, sf_dir)), "market:s week:l median_5 median_10 median_15 median_all"),
            sql(SQL_CURVES + ", result AS (SELECT market, week, " + ", ".join(f"max(median) FILTER (years = {k}) AS median_{n}" for k, n in ((5, 5), (10, 10), (15, 15), (0, "all"))) + " FROM cv GROUP BY 1, 2)", "market:s week:l median_5 median_10 median_15 median_all", "tables"),
        ),
        "current_curve": (
            lambda spark, sf_dir: shaped(seasonality.current_curve(seasonal(spark, sf_dir)), "market:s week:l move"),
            sql(SQL_DATED + ", cc AS (SELECT market, week, arg_max(close, date) AS close FROM dp WHERE iso_year = isoyear(cutoff) AND date <= cutoff GROUP BY 1, 2), result AS (SELECT market, week, close / first_value(close) OVER (PARTITION BY market ORDER BY week) - 1 AS move FROM cc)", "market:s week:l move", "tables"),
        ),
        "same_week_matrix": (lambda spark, sf_dir: shaped(seasonality.same_week_matrix(seasonal(spark, sf_dir)), MATRIX), sql(SQL_MATRIX, MATRIX, "tables")),
        "seasonal_stability": (
            lambda spark, sf_dir: shaped(seasonality.stability(windowed(spark, sf_dir)), "market:s stability"),
            sql(
                SQL_CURVES + "," + SQL_STABILITY + ", result AS (SELECT * FROM stab)",
                "market:s stability", "tables",
            ),
        ),
        "seasonal_forecast": (
            forecast_query,
            sql(
                SQL_PATHS + f""", fa AS (SELECT a.market, a.iso_year, t.weeks, b.path - a.path AS ret FROM yp a CROSS JOIN (VALUES (4), (8), (12)) t(weeks) JOIN yp b ON b.market = a.market AND b.iso_year = a.iso_year AND b.week = a.week + t.weeks WHERE a.week = {PHASES}),
fb AS ({sql_counted('fa', 'ret', 'market, weeks')}),
result AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction, greatest(up, down) / n AS hit_rate, all_25 AS q25, all_75 AS q75 FROM fb)""",
                FORECAST, "tables",
            ),
        ),
        "warped_similarity": (warping, sql(SQL_WARP, "market:s date:t similarity", "tables")),
        "season_shifts": (shifts_query, sql(SQL_SHIFTS + ", result AS (SELECT market, win AS \"window\", shift, similarity FROM sh)", SHIFTS, "tables")),
        "season_calibration": (calibration(0, CALIBRATED), sql(SQL_CALIBRATED + ", result AS (SELECT * FROM cal)", CALIBRATED, "tables")),
        "season_chart": (calibration(1, CHART), sql(SQL_CHART, CHART, "tables")),
        "season_forecast_calibrated": (calibration(2, FORECAST), sql(SQL_AHEAD + ", result AS (SELECT * FROM ahead)", FORECAST, "tables")),
    }
