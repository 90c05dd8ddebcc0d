"""Seasonality: yearly paths by ISO week, same-week outcomes, and calibration of the season's phase by time warping.

Everything is keyed by market and computed for all markets at once; ``as_of`` limits what counts as the present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators import outcomes
from tidemark.session import materialized

#: Trading days of each horizon in weeks.
TRADING_DAYS = {4: 20, 8: 40, 12: 60}
WINDOWS = (5, 10, 15, None)
WEEKS = 52


def clean(prices: DataFrame) -> DataFrame:
    return prices.select("market", F.col("date").cast("date").alias("date"), expr.number(F.col("close")).alias("close")).na.drop()


def dated(prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """Prices with ISO year and week, and each market's cutoff: ``as_of`` or its last price if that is earlier."""
    last = F.max("date").over(windows.whole())
    cutoff = F.least(F.lit(as_of).cast("date"), last) if as_of else last
    return clean(prices).withColumns({"cutoff": cutoff, "iso_year": expr.iso_year(F.col("date")), "iso_week": F.weekofyear("date"), "week": expr.curve_week(F.col("date"))})


def same_week_returns(prices: DataFrame, weeks: int, window: int | None = None, as_of: str | None = None) -> DataFrame:
    """Returns over the horizon's trading days from the first price of the current ISO week in each earlier year."""
    if weeks not in TRADING_DAYS:
        raise ValueError("weeks must be 4, 8 or 12")
    w = windows.series()
    rows = dated(prices, as_of).withColumn("return", F.try_divide(F.lead("close", TRADING_DAYS[weeks]).over(w), F.col("close")) - 1)
    anchors = rows.groupBy("market", "iso_year", "iso_week").agg(F.min_by("return", "date").alias("return"), F.first("cutoff").alias("cutoff"))
    target = expr.iso_year(F.col("cutoff"))
    kept = anchors.where((F.col("iso_week") == F.weekofyear("cutoff")) & (F.col("iso_year") < target) & F.col("return").isNotNull())
    return kept.where(F.col("iso_year") >= target - window) if window else kept


def same_week_matrix(prices: DataFrame, span: tuple = WINDOWS, horizons: tuple[int, ...] = (4, 8, 12), as_of: str | None = None) -> DataFrame:
    """Same-week outcomes for each window of years (0: all) and horizon."""
    parts = [same_week_returns(prices, h, None, as_of).withColumn("weeks", F.lit(h)) for h in horizons]
    years = F.explode(F.array(*(F.lit(s or 0) for s in span)))
    rows = reduce(DataFrame.unionByName, parts).select("*", years.alias("years")).where((F.col("years") == 0) | (F.col("iso_year") >= expr.iso_year(F.col("cutoff")) - F.col("years")))
    return outcomes.same_week(rows, ["market", "years", "weeks"], "return")


def year_paths(prices: DataFrame, as_of: str | None = None, least_weeks: int = 35) -> DataFrame:
    """``market, iso_year, week, path``: the move since week 1 in each earlier year with enough weeks; gaps are straight lines."""
    rows = dated(prices, as_of)
    weekly = rows.where(F.col("iso_year") < expr.iso_year(F.col("cutoff"))).groupBy("market", "iso_year", "week").agg(F.max_by("close", "date").alias("close"))
    full = weekly.withColumn("n", F.count("*").over(windows.whole("market", "iso_year"))).where(F.col("n") >= least_weeks).drop("n")
    grid = full.select("market", "iso_year").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(WEEKS))).alias("week"))
    w = windows.series("market", "iso_year", order="week")
    filled = grid.join(full, ["market", "iso_year", "week"], "left").withColumn("close", windows.interpolated(F.col("close"), F.col("week"), w))
    base = F.first("close").over(w)
    return filled.withColumn("base", base).where("base > 0").select("market", "iso_year", "week", (F.col("close") / F.col("base") - 1).alias("path"))


def current_years(prices: DataFrame, as_of: str | None = None) -> DataFrame:
    return dated(prices, as_of).select("market", "cutoff").distinct().select("market", "cutoff", expr.iso_year(F.col("cutoff")).alias("this_year"))


def in_windows(paths: DataFrame, years_now: DataFrame, span: tuple = WINDOWS) -> DataFrame:
    """Paths repeated for each window of years that they are in (0: all)."""
    each = F.explode(F.array(*(F.lit(s or 0) for s in span))).alias("years")
    return paths.join(years_now.select("market", "this_year"), "market").select("*", each).where((F.col("years") == 0) | (F.col("iso_year") >= F.col("this_year") - F.col("years")))


def curves(paths: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Mean, median and quartiles over the years, per week."""
    p = F.col("path")
    return paths.groupBy(*keys, "week").agg(F.avg(p).alias("mean"), *(F.percentile(p, q).alias(n) for n, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))), F.count(p).alias("n_years"))


def curves_by_window(windowed: DataFrame, span: tuple = WINDOWS) -> DataFrame:
    """One row per market and week with the median curve of each window of years side by side: ``median_5``, ..., ``median_all``."""
    by = curves(windowed, ("market", "years"))
    return by.groupBy("market", "week").agg(*(F.max(F.when(F.col("years") == (s or 0), F.col("median"))).alias(f"median_{s or 'all'}") for s in span))


def current_curve(prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """This year's move since its first week with a price."""
    rows = dated(prices, as_of).where((F.col("iso_year") == expr.iso_year(F.col("cutoff"))) & (F.col("date") <= F.col("cutoff")))
    weekly = rows.groupBy("market", "week").agg(F.max_by("close", "date").alias("close"))
    return weekly.select("market", "week", (F.col("close") / F.first("close").over(windows.series(order="week")) - 1).alias("move"))


def stability(windowed: DataFrame, least_years: int = 4) -> DataFrame:
    """Mean correlation of the weekly changes of the windows' median curves, negative ones as zero; windows of fewer years are left out."""
    by = curves(windowed, ("market", "years")).where(F.col("n_years") >= least_years)
    steps = by.withColumn("step", F.col("median") - F.lag("median", 1).over(windows.series("market", "years", order="week"))).where("step IS NOT NULL")
    a = steps.select("market", "week", F.col("years").alias("a"), F.col("step").alias("x"))
    b = steps.select("market", "week", F.col("years").alias("b"), F.col("step").alias("y"))
    pairs = a.join(b, ["market", "week"]).where("a < b").groupBy("market", "a", "b").agg(F.corr("x", "y").alias("r"))
    return pairs.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy("market").agg(F.avg(F.greatest(F.lit(0.0), F.col("r"))).alias("stability"))


def forecast(paths: DataFrame, phases: DataFrame, horizons: tuple[int, ...] = (4, 8, 12)) -> DataFrame:
    """Outcomes over the years of the difference between the path at the phase's week and that of each horizon; none beyond week 52.

    ``phases`` has ``market, phase``.
    """
    start = paths.join(phases, "market").where("week = phase").select("market", "iso_year", "phase", F.col("path").alias("from"), F.explode(F.array(*map(F.lit, horizons))).alias("weeks"))
    end = paths.select("market", "iso_year", F.col("week").alias("end_week"), F.col("path").alias("to"))
    moved = start.withColumn("end_week", F.col("phase") + F.col("weeks")).join(end, ["market", "iso_year", "end_week"]).withColumn("return", F.col("to") - F.col("from"))
    return outcomes.forecast(moved, ["market", "weeks"], "return")


def z_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns ``z_<column>``: sequences in population deviations from their means; only centred if they hardly vary.

    Means and deviations are columns of their own, so each is computed once a row.
    """
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))
    out = df.withColumns({f"m_{c}": total(F.col(c), lambda v: v) / F.size(c) for c in columns})
    square = lambda c: lambda v: (v - F.col(f"m_{c}")) * (v - F.col(f"m_{c}"))
    out = out.withColumns({f"s_{c}": F.sqrt(total(F.col(c), square(c)) / F.size(c)) for c in columns})
    scale = {c: F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    out = out.withColumns({f"d_{c}": scale[c] for c in columns})
    standard = lambda c: lambda v: (v - F.col(f"m_{c}")) / F.col(f"d_{c}")
    out = out.withColumns({f"z_{c}": F.transform(c, standard(c)) for c in columns})
    return out.drop(*(f"{k}_{c}" for k in "msd" for c in columns))


def warped_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``similarity`` of two short sequences from 0 to 1 by dynamic time warping of their z-scores; 0 if one has fewer than two values.

    The table of partial distances is folded row by row, inside the JVM. Rounded to 12 places, so that ties are ties.
    """
    x, y = F.col(f"z_{a}"), F.col(f"z_{b}")
    infinite = F.lit(float("inf"))
    top = F.concat(F.array(F.lit(0.0)), F.transform(y, lambda v: infinite))

    def row(before: Column, xi: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            cost = F.abs(xi - F.element_at(y, j))
            return F.array_append(done, cost + F.least(F.element_at(before, j + 1), F.element_at(done, j), F.element_at(before, j)))

        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(infinite), cell)

    total = F.element_at(F.aggregate(x, top, row), -1)
    similarity = F.when((F.size(a) < 2) | (F.size(b) < 2), 0.0).otherwise(F.exp(-total / (F.size(a) + F.size(b))))
    return z_arrays(df, [a, b]).withColumn("similarity", F.round(similarity, 12)).drop(f"z_{a}", f"z_{b}")


def warped_groups(rows: DataFrame, keys: list[str], order: str, a: str, b: str, least: int = 2) -> DataFrame:
    """``warped_similarity`` of two columns of equally many rows per key, in ``order``: ``keys`` and ``similarity``.

    The z-scores come from windows over the rows, so the arrays only hold what the fold needs.
    """
    w = windows.whole(*keys)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.when(F.stddev_pop(c).over(w) < 1e-12, 1.0).otherwise(F.stddev_pop(c).over(w))
    items = rows.select(*keys, F.col(order).alias("k"), z(a).alias("x"), z(b).alias("y")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("s"))
    infinite = F.lit(float("inf"))
    n = F.size("s")

    def row(before: Column, item: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            cost = F.abs(item["x"] - F.element_at("s", j)["y"])
            return F.array_append(done, cost + F.least(F.element_at(before, j + 1), F.element_at(done, j), F.element_at(before, j)))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(infinite), cell)

    total = F.element_at(F.aggregate("s", F.concat(F.array(F.lit(0.0)), F.array_repeat(infinite, n)), row), -1)
    return items.where(n >= least).select(*keys, F.round(F.exp(-total / (2 * n)), 12).alias("similarity"))


def daily_returns(prices: DataFrame, days: int, as_of: str | None = None) -> DataFrame:
    """The last ``days`` daily returns up to the cutoff as rows: ``k`` from 1 (the oldest) and ``own``."""
    rows = dated(prices, as_of).where("date <= cutoff").withColumn("own", windows.row_return(F.col("close"), windows.series(), 1))
    last = rows.withColumn("back", F.row_number().over(Window.partitionBy("market").orderBy(F.col("date").desc()))).where(F.col("back") <= days)
    full = last.where("own IS NOT NULL").withColumn("n", F.count("*").over(windows.whole())).where(F.col("n") == days)
    return full.select("market", (days + 1 - F.col("back")).alias("k"), "own")


def daily_patterns(prices: DataFrame, days: int, shifts: range, window: int | None = 15, as_of: str | None = None) -> DataFrame:
    """Per shift in weeks, the median over earlier years of the daily returns before the same calendar day; ``market, shift, k, pattern``."""
    rows = dated(prices, as_of)
    w = windows.series()
    numbered = rows.withColumns({"place": F.row_number().over(w), "r": windows.row_return(F.col("close"), w, 1)})
    first = rows.groupBy("market").agg(F.first("cutoff").alias("cutoff"), F.min(F.year("date")).alias("first_year"))
    year_now = F.year("cutoff")
    from_year = year_now - window if window else F.col("first_year")
    # years before this one, shifted anchors on the same month and day, cut to the month's length
    grid = first.where(from_year < year_now).select("market", "cutoff", F.explode(F.sequence(from_year, year_now - 1)).alias("year")).select("*", F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    target = F.expr("date_add(cutoff, 7 * shift)")
    month_start = F.make_date("year", F.month(target), F.lit(1))
    anchor = F.make_date("year", F.month(target), F.least(F.day(target), F.day(F.last_day(month_start))))
    grid = grid.withColumn("anchor", anchor)
    from tidemark.operators.asof import asof

    found = asof(grid, numbered, ["market"], "anchor", "date", {"place": "at", "date": "on"}).where((F.col("at") > days) & (F.year("on") == F.col("year")))
    each = found.select("market", "shift", "year", "at", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("k")).withColumn("place", F.col("at") - days + F.col("k"))
    by_place = each.join(numbered.select("market", "place", "r"), ["market", "place"])
    return by_place.groupBy("market", "shift", "k").agg(F.percentile("r", 0.5).alias("pattern"))


def best_shift(candidates: DataFrame, name: str) -> DataFrame:
    """Per market the shift with the highest similarity; of equal ones the first."""
    best = F.max_by(F.struct("shift", "similarity"), F.struct(F.col("similarity"), -F.col("shift")))
    return candidates.where("similarity IS NOT NULL").groupBy("market").agg(best.alias("b")).select("market", F.lit(name).alias("window"), F.col("b.shift").alias("shift"), F.col("b.similarity").alias("similarity"))


def daily_shift(prices: DataFrame, days: int, most: int = 8, window: int | None = 15, as_of: str | None = None) -> DataFrame:
    pattern = daily_patterns(prices, days, range(-most, most + 1), window, as_of)
    both = pattern.join(daily_returns(prices, days, as_of), ["market", "k"])
    return best_shift(warped_groups(both, ["market", "shift"], "k", "own", "pattern"), f"{days}d")


def weekly_shift(current: DataFrame, medians: DataFrame, weeks: int, most: int = 8) -> DataFrame:
    """The shift at which the last ``weeks`` weekly changes of this year resemble those of the median curve most."""
    shifted = current.select("market", "week", "move", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).withColumn("phase", F.col("week") + F.col("shift"))
    pairs = shifted.join(medians.select("market", F.col("week").alias("phase"), "median"), ["market", "phase"])
    w = Window.partitionBy("market", "shift").orderBy("week")
    steps = pairs.withColumns({"own": windows.row_change(F.col("move"), w, 1), "season": windows.row_change(F.col("median"), w, 1), "back": F.row_number().over(Window.partitionBy("market", "shift").orderBy(F.col("week").desc()))})
    tail = steps.where((F.col("back") <= weeks) & F.col("own").isNotNull() & F.col("season").isNotNull())
    whole = tail.withColumn("n", F.count("*").over(windows.whole("market", "shift"))).where(F.col("n") == weeks)
    return best_shift(warped_groups(whole, ["market", "shift"], "week", "own", "season"), f"{weeks}w")


def shifts(prices: DataFrame, medians: DataFrame, current: DataFrame, window: int | None = 15, most: int = 8, as_of: str | None = None) -> DataFrame:
    """``market, window, shift, similarity`` of five windows, each calibrated on its own, from prices, the median curve and this year's."""
    parts = [daily_shift(prices, d, most, window, as_of) for d in (3, 10)] + [weekly_shift(current, medians, k, most) for k in (2, 4, 8)]
    return reduce(DataFrame.unionByName, parts)


def calibrate(prices: DataFrame, window: int | None = 15, most: int = 8, as_of: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per market the consensus shift of the five windows with what it says about this year; the chart by week; and the forecast.

    Markets with fewer than nine weeks this year, or without any shift, are left out. Prices, paths and curves are used several times and
    are small beside what they come from, so they are materialized.
    """
    prices = materialized(clean(prices))
    years_now = current_years(prices, as_of)
    paths = materialized(year_paths(prices, as_of))
    windowed = in_windows(paths, years_now, (window,))
    curve, current = materialized(curves(windowed)), materialized(current_curve(prices, as_of))
    found = materialized(shifts(prices, curve, current, window, most, as_of))
    consensus = found.groupBy("market").agg(
        F.rint(F.percentile("shift", 0.5)).cast("int").alias("shift"), F.percentile("similarity", 0.5).alias("similarity"), F.map_from_entries(F.collect_list(F.struct("window", "shift"))).alias("shifts")
    )
    moves = current.groupBy("market").agg(F.max("week").alias("latest_week"), F.count("*").alias("n_weeks"), F.transform(F.array_sort(F.collect_list(F.struct("week", "move"))), lambda s: s["move"]).alias("moves")).where("n_weeks >= 9")
    level = curve.groupBy("market").agg(F.map_from_entries(F.collect_list(F.struct("week", "median"))).alias("level"), F.max("n_years").alias("n_years"))
    joined = consensus.join(moves, "market").join(level, "market")
    joined = joined.withColumn("phase", F.greatest(F.lit(1), F.least(F.lit(WEEKS), F.col("latest_week") + F.col("shift"))))
    at = lambda week: F.try_element_at("level", week)
    back = lambda k: F.element_at("moves", -1) - F.element_at("moves", -1 - k)
    joined = joined.withColumns({"move_2w": back(2), "season_2w": at(F.col("phase")) - at(F.greatest(F.lit(1), F.col("phase") - 2)), "move_8w": back(8), "season_8w": F.when(F.col("phase") >= 9, at(F.col("phase")) - at(F.greatest(F.lit(1), F.col("phase") - 8)))})
    size = F.abs(F.col("move_8w") / F.col("season_8w"))
    progress = F.when(F.abs("season_8w") > 1e-8, F.when(F.signum("move_8w") == F.signum("season_8w"), size).otherwise(-size))
    p = F.col("progress")
    state = F.when(p.isNull(), "unreliable").when(p < 0, "against").when(p < 0.8, "behind").when(p <= 1.2, "on_course").otherwise("ahead")
    status = F.when(F.col("shift") >= 2, "season_ahead").when(F.col("shift") <= -2, "season_behind").otherwise("in_step")
    steady = stability(in_windows(paths, years_now))
    result = joined.withColumns({"gap": F.col("move_2w") - F.col("season_2w"), "progress": progress}).withColumns({"progress_status": state, "status": status}).join(steady, "market", "left").drop("moves", "level")
    result = materialized(result)
    shifted = curve.join(result.select("market", "shift"), "market")
    moved_week = F.greatest(F.lit(1), F.least(F.lit(WEEKS), F.col("week") + F.col("shift")))
    own = shifted.withColumn("moved_week", moved_week)
    chart = own.join(curve.select("market", F.col("week").alias("moved_week"), F.col("median").alias("calibrated")), ["market", "moved_week"], "left").join(current, ["market", "week"], "left")
    ahead = forecast(windowed, result.select("market", "phase"))
    return result, chart.select("market", "week", "median", "q25", "q75", "calibrated", "move"), ahead
