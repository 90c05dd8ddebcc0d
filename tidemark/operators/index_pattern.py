"""Analogs of a doubly confirmed extreme: range index and net percentile extreme on the same side, for commercials and retail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import knn, outcomes
from tidemark.operators.observations import with_indices

PATTERN = ["commercial_index", "retail_index", "commercial_net_percentile", "retail_net_percentile"]
PAIRS = {"commercial": ("commercial_index", "commercial_net_percentile"), "retail": ("retail_index", "retail_net_percentile")}


def candidates(indexed: DataFrame, weeks: int = 8, min_history: int = 104, cutoff: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """The current rows with what they confirm, and the earlier rows in the same regime with their distances."""
    clean = knn.complete(indexed, [*PATTERN, f"return_{weeks}w"])
    placed = knn.scaled(clean, PATTERN)
    checks = {f"{g}_confirmed": expr.same_extreme(F.col(i), F.col(p), cutoff) for g, (i, p) in PAIRS.items()}
    current = placed.where("is_last").select("market", "date", "n_rows", *PATTERN, *(c.alias(n) for n, c in checks.items()))
    current = current.withColumn("enough", F.col("n_rows") >= min_history + 1)
    sides = current.where("enough AND commercial_confirmed AND retail_confirmed").select("market", *(expr.extreme_side(F.col(i), cutoff).alias(f"{g}_side") for g, (i, _) in PAIRS.items()))
    history = placed.where(~F.col("is_last")).join(sides, "market")
    alike = [F.coalesce(expr.extreme_side(F.col(c), cutoff) == F.col(f"{group}_side"), F.lit(False)) for group, columns in PAIRS.items() for c in columns]
    history = history.where(reduce(Column.__and__, alike))
    return current, history.withColumn("distance", knn.distance(PATTERN, "euclid"))


def matches(history: DataFrame, weeks: int = 8, n: int = 30, gap_weeks: int = 8) -> DataFrame:
    """The nearest four times ``n`` rows of the regime, thinned to independent ones, at most ``n``."""
    place = F.row_number().over(Window.partitionBy("market").orderBy("distance", "date"))
    near = history.withColumn("place", place).where(F.col("place") <= 4 * n)
    return knn.greedy(near, ["market"], [F.col("distance"), F.col("date")], ["date", "distance", f"return_{weeks}w"], 7 * gap_weeks, n)


def analyze(df: DataFrame, weeks: int = 8, n: int = 30, lookback: int = 156, min_history: int = 104, min_sample: int = 1, gap_weeks: int = 8, cutoff: float = 80.0) -> DataFrame:
    """One row per market: the current indices, why there is no result, or the outcome of the matches with its quality."""
    current, history = candidates(with_indices(df, lookback), weeks, min_history, cutoff)
    found = matches(history, weeks, n, gap_weeks)
    result = outcomes.index_pattern(found, ["market"], f"return_{weeks}w", [F.percentile("distance", 0.5).alias("median_distance")])
    quality = expr.index_quality(F.col("wilson_low"), F.col("n"), F.col("median_distance"), F.col("up") / F.col("n"), F.col("down") / F.col("n"))
    out = current.join(result.withColumn("quality", quality), "market", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = (
        F.when(~F.col("enough"), "too_few_rows")
        .when(~(F.col("commercial_confirmed") & F.col("retail_confirmed")), "not_confirmed")
        .when(F.col("n") == 0, "never_before")
        .when(F.col("n") < min_sample, "too_few_matches")
        .otherwise("")
    )
    zones = {f"{g}_zone": expr.zone(F.col(i), cutoff) for g, (i, _) in PAIRS.items()}
    return out.withColumns({"reason": reason, "available": reason == "", **zones})
