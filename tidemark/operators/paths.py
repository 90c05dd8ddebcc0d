"""What price did after events: the next trading days as rows, without a join by range.

Prices are numbered per market; an event finds its first price at or after its date by a forward as-of join and the following ones by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators.asof import asof


def numbered(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("date").isNotNull() & F.col("close").isNotNull()).select("market", "date", "close", F.row_number().over(windows.series()).alias("place"))


def after_events(events: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """``events`` with a row for each of the first ``days + 1`` prices at or after ``date``: ``day`` from 0 and ``move`` since day 0."""
    px = numbered(prices)
    placed = asof(events, px, ["market"], "date", "date", {"place": "first_place", "close": "first_close"}, "forward")
    each = placed.where(F.col("first_place").isNotNull()).select("*", F.explode(F.sequence(F.lit(0), F.lit(days))).alias("day")).withColumn("place", F.col("first_place") + F.col("day"))
    joined = each.join(px.select("market", "place", F.col("close").alias("later_close")), ["market", "place"])
    return joined.withColumn("move", F.try_divide(F.col("later_close"), F.col("first_close")) - 1).drop("place", "first_place")


def event_paths(events: DataFrame, prices: DataFrame, weeks: int) -> DataFrame:
    """Mean and median move per day over all paths of at least two prices."""
    moves = after_events(events.select("market", "date"), prices, 5 * weeks)
    long_enough = moves.withColumn("n", F.count("*").over(Window.partitionBy("market", "date"))).where("n >= 2")
    return long_enough.groupBy("market", "day").agg(F.count("*").alias("n"), F.avg("move").alias("mean"), F.percentile("move", 0.5).alias("median"))


def whole_paths(events: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Moves of the events with all days, with their last move as ``final``."""
    by_event = Window.partitionBy("market", "date")
    moves = after_events(events, prices, days).withColumns({"n": F.count("*").over(by_event), "final": F.max(F.when(F.col("day") == days, F.col("move"))).over(by_event)})
    return moves.where(F.col("n") == days + 1).drop("n")


def window_of(onset: Column) -> dict[str, Column]:
    """Aggregates: from the lower quartile (day 1 at least) to the upper one, in whole days."""
    start = F.greatest(F.lit(1), F.floor(F.percentile(onset, 0.25)))
    return {"window_start": start, "window_end": F.greatest(start, F.ceil(F.percentile(onset, 0.75)))}


def timing(events: DataFrame, prices: DataFrame, weeks: int = 8, threshold: float = 0.01) -> DataFrame:
    """Per market the bias of the events with whole paths (60 % at the end), and when winners first reach the threshold."""
    moves = whole_paths(events.select("market", "date"), prices, 5 * weeks)
    ends = moves.where(F.col("day") == 5 * weeks).groupBy("market").agg(F.count("*").alias("n"), F.count(F.when(F.col("final") > 0, 1)).alias("up"), F.count(F.when(F.col("final") < 0, 1)).alias("down"))
    bias = F.when(F.col("up") / F.col("n") >= 0.6, "bullish").when(F.col("down") / F.col("n") >= 0.6, "bearish").otherwise("neutral")
    ends = ends.withColumns({"bias": bias, "sign": F.when(bias == "bullish", 1).when(bias == "bearish", -1).otherwise(0)})
    directed = moves.join(ends.select("market", "sign"), "market").where((F.col("sign") != 0) & (F.col("final") * F.col("sign") > 0))
    onsets = directed.where(F.col("move") * F.col("sign") >= threshold).groupBy("market", "date").agg(F.min("day").alias("onset"))
    when = onsets.groupBy("market").agg(F.count("*").alias("n_onsets"), *(c.alias(n) for n, c in window_of(F.col("onset")).items()), F.rint(F.percentile("onset", 0.5)).alias("median_onset"))
    return ends.drop("sign").join(when, "market", "left").withColumn("n_onsets", F.coalesce("n_onsets", F.lit(0)))


def onset_days(moves: DataFrame, keys: list[str], value: Column, threshold: Column) -> DataFrame:
    """The first day at the threshold from which three of the next five days (itself included, fewer at the end) are positive."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(0, 4)
    held = F.sum(F.when(value > 0, 1).otherwise(0)).over(w) >= F.least(F.lit(3), F.count(F.lit(1)).over(w))
    return moves.withColumns({"reached": value >= threshold, "held": held}).where("reached AND held").groupBy(*keys).agg(F.min("day").alias("onset"))


def cluster_timing(events: DataFrame, prices: DataFrame, biases: DataFrame, reports: DataFrame, weeks: int = 8, least_move: float = 0.005, min_paths: int = 5) -> DataFrame:
    """Per market with a bias: when the median path of its events starts and peaks, the winners' onset window, and where the market is in it.

    ``biases`` has ``market, bias``, ``reports`` the current report's date as ``market, report_date``. Markets with fewer than ``min_paths`` whole
    paths are left out.
    """
    days = 5 * weeks
    signed = biases.where(F.col("bias").isin("bullish", "bearish")).select("market", F.when(F.col("bias") == "bullish", 1.0).otherwise(-1.0).alias("sign"))
    px = numbered(prices.withColumn("date", F.col("date").cast("date")).dropDuplicates(["market", "date"]))
    moves = whole_paths(events.select("market", "date"), px, days).join(signed, "market").withColumns({"toward": F.col("move") * F.col("sign"), "final_toward": F.col("final") * F.col("sign")})
    winners = moves.where("final_toward > 0")
    own = onset_days(winners, ["market", "date"], F.col("toward"), F.greatest(F.lit(least_move), 0.25 * F.col("final_toward")))
    window = own.groupBy("market").agg(*(c.alias(n) for n, c in window_of(F.col("onset")).items()))
    median = moves.groupBy("market", "day").agg(F.count("*").alias("n_paths"), F.first("sign").alias("sign"), *(F.percentile("move", p).alias(n) for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))))
    median = median.where(F.col("n_paths") >= min_paths).withColumn("toward", F.col("median") * F.col("sign"))
    median = median.withColumn("terminal", F.max(F.when(F.col("day") == days, F.col("toward"))).over(windows.whole()))
    start = onset_days(median, ["market"], F.col("toward"), F.greatest(F.lit(least_move), 0.25 * F.greatest(F.col("terminal"), F.lit(0.0))))
    peak = median.groupBy("market").agg(
        F.max_by(F.struct("day", "median"), F.struct("toward", -F.col("day"))).alias("peak"), F.max(F.when(F.col("day") == days, F.col("median"))).alias("terminal_return"), F.max("n_paths").alias("n_paths")
    )
    since = px.join(reports, "market").where("date >= report_date").groupBy("market").agg(F.count("*").alias("prices_since"))
    out = peak.join(start, "market", "left").join(window, "market", "left").join(since, "market", "left")
    out = out.select(
        "market", "n_paths", F.col("onset").alias("onset_day"), F.coalesce("window_start", "onset").alias("window_start"), F.coalesce("window_end", "onset").alias("window_end"),
        F.col("peak.day").alias("peak_day"), F.col("peak.median").alias("peak_return"), "terminal_return", F.greatest(F.lit(0), F.coalesce("prices_since", F.lit(0)) - 1).alias("current_day"),
    )
    first, last = (F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col("onset_day")) for c in ("window_start", "window_end"))
    status = F.when(F.col("onset_day").isNull(), "unclear").when(F.col("current_day") < first, "before").when(F.col("current_day") <= last, "onset").when(F.col("current_day") <= F.col("peak_day"), "active").otherwise("late")
    return out.withColumn("status", status)
