"""Macro regimes: transformed series that count from their release on, monthly snapshots, weighted scores, drivers and analogs.

Snapshots stay long (one row per month and series), so series are rows and their number is data. The small tables of specs
and weights are joined; profiles of any number of markets are scored at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators.asof import asof
from tidemark.operators.knn import greedy
from tidemark.session import materialized

#: Rows in a year, by frequency.
PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12, "quarterly": 4}
TRANSFORMS = ("level", "yoy_pct", "diff", "rolling4")
#: The series of each regime dimension and their signs; a sign of one half weighs its series less.
DIMENSIONS = {
    "inflation": {"cpi": 1.0, "core_cpi": 1.0, "core_pce": 1.0, "breakeven_10y": 1.0},
    "growth": {"gdp": 1.0, "industrial_production": 1.0, "retail_sales": 1.0},
    "labor": {"nfp": 1.0, "unemployment": -1.0, "initial_claims": -1.0},
    "policy": {"fed_funds": 1.0, "policy_rate": 1.0, "yield_2y": 1.0, "yield_10y": 0.5, "real_yield_10y": 1.0},
    "liquidity": {"m2": 1.0, "financial_stress": -1.0},
}
START = "1990-01-31"


def transformed(macro: DataFrame, specs: DataFrame) -> DataFrame:
    """``series_key, observation_date, available_date, raw_value, feature_value``.

    ``specs`` has ``series_key, frequency, transform, release_lag_days``; a transform that isn't known raises an error when it is met.
    """
    w = windows.series("series_key")
    joined = macro.where("value IS NOT NULL").join(F.broadcast(specs.select("series_key", "frequency", "transform", "release_lag_days")), "series_key")
    value = F.col("value")
    year_ago = F.coalesce(*(F.when(F.col("frequency") == f, F.lag("value", n).over(w)) for f, n in PER_YEAR.items()))
    mean4 = F.when(F.count("value").over(w.rowsBetween(-3, 0)) >= 3, F.avg("value").over(w.rowsBetween(-3, 0)))
    feature = (
        F.when(F.col("transform") == "level", value)
        .when(F.col("transform") == "yoy_pct", 100 * (F.try_divide(value, year_ago) - 1))
        .when(F.col("transform") == "diff", value - F.lag("value", 1).over(w))
        .when(F.col("transform") == "rolling4", mean4)
        .otherwise(F.raise_error(F.concat(F.lit("unknown transform "), F.col("transform"))).cast("double"))
    )
    available = expr.availability(F.col("date"), F.col("frequency"), F.col("release_lag_days"))
    out = joined.select("series_key", F.col("date").alias("observation_date"), available.alias("available_date"), value.alias("raw_value"), feature.alias("feature_value"))
    return out.where("feature_value IS NOT NULL")


def snapshots(features: DataFrame, rows: int = 120, least: int = 36, start: str = START) -> DataFrame:
    """What was known at each month's end, long: the newest available value of each series and its z-score over the last ``rows`` months.

    Months run from ``start`` to the last availability of any series; a value that is carried forward counts every month.
    """
    last = features.agg(F.max("available_date").alias("end"))
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    ends = last.where("end IS NOT NULL").select(F.explode(months).alias("m"), "end").select(F.last_day("m").alias("date"), "end").where("date <= end").select("date")
    grid = features.select("series_key").distinct().join(F.broadcast(ends))
    values = {c: c for c in ("feature_value", "raw_value", "observation_date", "available_date")}
    filled = asof(grid, features, ["series_key"], "date", "available_date", values)
    return filled.withColumn("z", windows.rolling_z(F.col("feature_value"), windows.series("series_key"), rows, least))


def scores(snaps: DataFrame, weights: DataFrame) -> DataFrame:
    """Per market and month the score from -100 to 100 and the share of all weights that it rests on.

    ``weights`` has ``market, series_key, weight``; series without a z-score leave both numerator and denominator.
    """
    whole = weights.groupBy("market").agg(F.sum(F.abs("weight")).alias("all_weights"), F.count("*").alias("n_series"))
    known = F.col("z").isNotNull()
    sums = snaps.join(F.broadcast(weights), "series_key").groupBy("market", "date").agg(
        F.sum(F.coalesce(F.col("z"), F.lit(0.0)) * F.col("weight")).alias("top"), F.sum(F.when(known, F.abs("weight")).otherwise(0.0)).alias("bottom"), F.count(F.when(known, 1)).alias("n_known")
    )
    out = sums.join(whole, "market").withColumns({"score": expr.squash(F.try_divide("top", F.nullif(F.col("bottom"), F.lit(0.0)))), "coverage": F.col("bottom") / F.greatest("all_weights", F.lit(1e-9))})
    return out.select("market", "date", "score", "coverage", "n_known", "n_series")


def usable(scored: DataFrame, least: float = 0.55) -> DataFrame:
    return scored.where(F.col("score").isNotNull() & (F.col("coverage") >= least))


def current(scored: DataFrame) -> DataFrame:
    """Each market's newest usable month."""
    return windows.with_place(scored).where("is_last").drop("is_last")


def drivers(snaps: DataFrame, weights: DataFrame, now: DataFrame) -> DataFrame:
    """Each series' contribution to the current score, the largest first."""
    rows = snaps.where("z IS NOT NULL").join(F.broadcast(weights), "series_key").join(now.select("market", "date"), ["market", "date"])
    contribution = F.col("z") * F.col("weight")
    out = rows.withColumns({"contribution": contribution, "effect": expr.effect(contribution)})
    place = F.row_number().over(Window.partitionBy("market").orderBy(F.abs("contribution").desc(), "series_key"))
    return out.withColumn("rank", place)


def regimes(snaps: DataFrame, now: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Mean signed z-score of each dimension at each market's current month; ``dimensions`` has ``dimension, series_key, sign``."""
    rows = dimensions.select("dimension").distinct().join(now.select("market", "date"))
    found = snaps.where("z IS NOT NULL").join(F.broadcast(dimensions), "series_key").join(now.select("market", "date"), "date")
    means = found.groupBy("market", "dimension").agg(F.avg(F.col("z") * F.col("sign")).alias("z"))
    out = rows.join(means, ["market", "dimension"], "left")
    return out.withColumn("regime", expr.regime_label(F.col("z")))


def forward_returns(events: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (4, 8, 12), tolerance: int = 10) -> DataFrame:
    """``events`` (market, date) with returns from the first price within ``tolerance`` days of the event to that of each horizon after the event."""
    out = asof(events, prices, ["market"], "date", "date", {"close": "start_close"}, "forward", tolerance)
    for weeks in horizons:
        out = out.withColumn("end_target", F.date_add("date", 7 * weeks))
        out = asof(out, prices, ["market"], "end_target", "date", {"close": "end_close"}, "forward", tolerance)
        out = out.withColumn(f"return_{weeks}w", expr.change(F.col("end_close"), F.col("start_close"))).drop("end_target", "end_close")
    return out


def analogs(snaps: DataFrame, weights: DataFrame, scored: DataFrame, prices: DataFrame, weeks: int = 8, n: int = 20, gap_days: int = 84, least_rows: int = 40) -> DataFrame:
    """Earlier months with the most similar z-scores to the newest month that has all of them, thinned, with their forward returns.

    Needs three series and ``least_rows`` months; takes ``2 n`` independent months, of which the first ``n`` with a known outcome stay.
    """
    ready = usable(scored).where((F.col("n_known") == F.col("n_series")) & (F.col("n_series") >= 3))
    ready = windows.with_place(ready).withColumn("n_rows", F.count("*").over(windows.whole())).where(F.col("n_rows") >= least_rows)
    share = F.abs("weight") / F.sum(F.abs("weight")).over(windows.whole())
    rows = snaps.select("series_key", "date", "z").join(F.broadcast(weights.withColumn("share", share)), "series_key").join(ready.select("market", "date", "is_last"), ["market", "date"])
    now = F.max(F.when(F.col("is_last"), F.col("z"))).over(Window.partitionBy("market", "series_key"))
    apart = rows.withColumn("gap", F.col("z") - now).where(~F.col("is_last")).groupBy("market", "date").agg(F.round(F.sqrt(F.sum(F.col("share") * F.col("gap") * F.col("gap"))), 9).alias("distance"))
    chosen = greedy(apart, ["market"], [F.col("distance"), F.col("date")], ["date", "distance"], gap_days, 2 * n).drop("rank")
    ret = f"return_{weeks}w"
    known = forward_returns(chosen, prices).where(F.col(ret).isNotNull())
    place = F.row_number().over(Window.partitionBy("market").orderBy("distance", "date"))
    kept = known.withColumn("rank", place).where(F.col("rank") <= n)
    return kept.withColumn("similarity", expr.similarity(F.col("distance"), F.percentile("distance", 0.5).over(windows.whole())))


def regime(macro: DataFrame, specs: DataFrame, weights: DataFrame, prices: DataFrame, weeks: int = 8, n: int = 20) -> DataFrame:
    """One row per market: current score and label, the analogs' outcome, confidence, or the reason why there is no result."""
    from tidemark.operators import outcomes

    snaps = materialized(snapshots(transformed(macro, specs)))
    scored = materialized(scores(snaps, weights))
    now = current(usable(scored))
    result = outcomes.dominant(analogs(snaps, weights, scored, prices, weeks, n), ["market"], f"return_{weeks}w")
    found = macro.select("series_key").distinct().join(F.broadcast(weights), "series_key").groupBy("market").agg(F.count("*").alias("n_found"))
    out = weights.select("market").distinct().join(found, "market", "left").join(now, "market", "left").join(result, "market", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.coalesce("n_found", F.lit(0)) < 3, "too_few_series").when(F.col("score").isNull(), "too_little_history").otherwise("")
    confidence = F.when((F.col("coverage") >= 0.85) & (F.col("n") >= 15), "high").when((F.col("coverage") >= 0.65) & (F.col("n") >= 8), "medium").otherwise("low")
    return out.withColumns({"label": F.when(F.col("score").isNotNull(), expr.score_label(F.col("score"))), "confidence": confidence, "reason": reason, "available": reason == ""})


def missing_series(macro: DataFrame, weights: DataFrame) -> DataFrame:
    """Series that a market's profile asks for and that have no values."""
    return weights.join(macro.where("value IS NOT NULL").select("series_key").distinct(), "series_key", "left_anti").select("market", "series_key")
