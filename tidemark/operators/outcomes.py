"""What happened after a set of events: six ways to summarise forward returns, which differ in ties, zeros and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr


def quantile(x: Column, p: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(x, p)


def counted(df: DataFrame, keys: list[str], ret: str, more: list[Column] | None = None) -> DataFrame:
    """Per key: cases, ups and downs, median, and quartiles of all, of the rising and of the falling returns."""
    r = F.col(ret)
    up, down = F.when(r > 0, r), F.when(r < 0, r)
    return df.where(r.isNotNull()).groupBy(*keys).agg(
        F.count(r).alias("n"), F.count(up).alias("up"), F.count(down).alias("down"), quantile(r, 0.5).alias("median"),
        *(quantile(x, p).alias(f"{name}{q}") for name, x in (("all_", r), ("up_", up), ("down_", down)) for q, p in ((25, 0.25), (75, 0.75))),
        F.min(r).alias("worst"), F.max(r).alias("best"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), *(more or []),
    )


def majority() -> Column:
    return F.when(F.col("up") > F.col("down"), "bullish").when(F.col("down") > F.col("up"), "bearish").otherwise("neutral")


def by_direction(direction: Column, q: int, tied: Column | None = None) -> Column:
    return F.when(direction == "bullish", F.col(f"up_{q}")).when(direction == "bearish", F.col(f"down_{q}")).otherwise(tied if tied is not None else F.lit(None).cast("double"))


def levels(df: DataFrame, keys: list[str], ret: str, more: list[Column] | None = None) -> DataFrame:
    """Majority direction; a tie is neutral with rate one half and no range; quartiles of the direction's returns."""
    c = counted(df, keys, ret, more).withColumn("direction", majority())
    hit = F.when(F.col("direction") == "neutral", 0.5).otherwise(F.greatest("up", "down") / F.col("n"))
    return c.withColumns({"hit_rate": hit, "range_low": by_direction(F.col("direction"), 25), "range_high": by_direction(F.col("direction"), 75)})


def cluster(df: DataFrame, keys: list[str], ret: str, more: list[Column] | None = None) -> DataFrame:
    """A direction needs 60 % of the cases; quartiles of all returns; Wilson's limits of the larger rate."""
    c = counted(df, keys, ret, more)
    bias = F.when(F.col("up") / F.col("n") >= 0.6, "bullish").when(F.col("down") / F.col("n") >= 0.6, "bearish").otherwise("neutral")
    hits = F.when(bias == "bullish", F.col("up")).when(bias == "bearish", F.col("down")).otherwise(F.greatest("up", "down"))
    return with_interval(c.withColumns({"direction": bias, "hits": hits, "q25": F.col("all_25"), "q75": F.col("all_75")}))


def index_pattern(df: DataFrame, keys: list[str], ret: str, more: list[Column] | None = None) -> DataFrame:
    """Majority direction; a tie is neutral and counts the rising cases; quartiles of all returns."""
    c = counted(df, keys, ret, more).withColumn("direction", majority())
    hits = F.when(F.col("direction") == "bearish", F.col("down")).otherwise(F.col("up"))
    return with_interval(c.withColumns({"hits": hits, "q25": F.col("all_25"), "q75": F.col("all_75")}))


def with_interval(df: DataFrame) -> DataFrame:
    hits, n = F.col("hits"), F.col("n")
    return df.withColumns({"hit_rate": hits / n, "wilson_low": expr.wilson(hits, n, False), "wilson_high": expr.wilson(hits, n, True)})


def same_week(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Unchanged cases don't count in the rate; a tie is neutral with rate one half (none without ups and downs) and quartiles of all."""
    c = counted(df, keys, ret).withColumn("direction", majority())
    moved = F.nullif(F.col("up") + F.col("down"), F.lit(0))
    hit = F.when(F.col("direction") == "neutral", F.when(moved.isNotNull(), 0.5)).otherwise(F.greatest("up", "down") / moved)
    return c.withColumns({"hit_rate": hit, "range_low": by_direction(F.col("direction"), 25, F.col("all_25")), "range_high": by_direction(F.col("direction"), 75, F.col("all_75"))})


def forecast(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Majority direction, the larger count's rate, quartiles of all returns."""
    c = counted(df, keys, ret).withColumn("direction", majority())
    return c.withColumns({"hit_rate": F.greatest("up", "down") / F.col("n"), "q25": F.col("all_25"), "q75": F.col("all_75")})


def dominant(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """The larger count's rate and the quartiles of the more frequent sign's returns (none in a tie)."""
    c = counted(df, keys, ret).withColumn("direction", majority())
    return c.withColumns({"hit_rate": F.greatest("up", "down") / F.col("n"), "range_low": by_direction(F.col("direction"), 25), "range_high": by_direction(F.col("direction"), 75)})


def statistics(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Cases, mean, median, share of rising cases, best, worst and sample deviation."""
    return counted(df, keys, ret).select(*keys, F.col("n"), "mean", "median", (F.col("up") / F.col("n")).alias("hit_rate"), "best", "worst", "std")
