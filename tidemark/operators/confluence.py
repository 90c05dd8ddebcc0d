"""Confluence: three independent views of a market, compared without weighting, and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr

MODULES = ("positioning", "macro", "seasonality")
#: The order of the states in a ranking.
ORDER = {"confirmed": 0, "partly_confirmed": 1, "conflicting": 2, "insufficient": 3}


def evidence(rows: DataFrame) -> DataFrame:
    """Normalised module rows: ``market, module, direction, n, up, down, median, range_low, range_high, available`` with rate and limits."""
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    out = rows.withColumns({"direction": F.lower(F.coalesce("direction", F.lit("n.a."))), "n": whole("n"), "up": whole("up"), "down": whole("down")})
    directed = F.col("direction").isin("bullish", "bearish")
    hits = F.when(F.col("direction") == "bullish", F.col("up")).when(F.col("direction") == "bearish", F.col("down")).otherwise(0)
    limit = lambda upper: F.when(directed, expr.wilson(hits, F.col("n"), upper))
    made = {"hit_rate": F.try_divide(hits, F.col("n")), "wilson_low": limit(False), "wilson_high": limit(True), "available": F.coalesce("available", F.lit(False)) & (F.col("n") > 0)}
    return out.withColumns(made)


def combine(rows: DataFrame) -> DataFrame:
    """One row per market from its evidence: state, direction, number of confirming modules and their weakest figures."""
    good = F.col("available") & F.col("direction").isin("bullish", "bearish")
    side = lambda d: F.count(F.when(good & (F.col("direction") == d), 1))
    counts = rows.groupBy("market").agg(side("bullish").alias("ups"), side("bearish").alias("downs"), F.count(F.when(F.col("available"), 1)).alias("n_available"))
    both = (F.col("ups") > 0) & (F.col("downs") > 0)
    most = F.greatest("ups", "downs")
    state = F.when(most == 0, "insufficient").when(both, "conflicting").when(most == 3, "confirmed").when(most == 2, "partly_confirmed").otherwise("insufficient")
    side_of = F.when(most == 0, "none").when(both & (most == 1), "conflict").when(F.col("ups") >= F.col("downs"), "bullish").otherwise("bearish")
    stated = counts.select("market", state.alias("status"), side_of.alias("direction"), most.alias("confirmations"), "n_available")
    confirming = rows.where(F.col("available")).join(stated.select("market", F.col("direction").alias("agreed")), "market").where(F.col("direction") == F.col("agreed"))
    weakest = confirming.groupBy("market").agg(F.min("wilson_low").alias("lower_limit"), F.min("n").alias("least_sample"), F.min(F.abs("median")).alias("least_move"))
    return stated.join(weakest, "market", "left").withColumn("least_sample", F.coalesce("least_sample", F.lit(0)))


def side_by_side(rows: DataFrame) -> DataFrame:
    """Each module's figures as columns of one row per market."""
    figures = ("direction", "n", "hit_rate", "wilson_low", "wilson_high", "median", "range_low", "range_high")
    pick = lambda m, c: F.max(F.when(F.col("module") == m, F.col(c))).alias(f"{m}_{c}")
    return rows.groupBy("market").agg(*(pick(m, c) for m in MODULES for c in figures))


def ranking() -> list[Column]:
    status = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), ORDER.items(), F.when(F.lit(False), 99)).otherwise(99)
    low, move = F.coalesce("lower_limit", F.lit(-1.0)), F.coalesce("least_move", F.lit(-1.0))
    return [status.asc(), F.col("confirmations").desc(), low.desc(), F.coalesce("least_sample", F.lit(0)).desc(), move.desc(), F.col("market").asc()]


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ranking())


def common_years(starts: list[Column], ends: list[Column]) -> Column:
    """Years that all periods share; NULL if they share none. Missing dates are left out."""
    first = F.greatest(*starts) if len(starts) > 1 else starts[0]
    last = F.least(*ends) if len(ends) > 1 else ends[0]
    days = F.datediff(last, first)
    return F.when(days > 0, days / 365.25)


def periods(markets: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Per market the first and last date of each module's table (of the whole table if it has no market), and the years that all share."""
    out = markets.select("market")
    for name, df in tables.items():
        by = ["market"] if "market" in df.columns else []
        spans = df.groupBy(*by).agg(F.min("date").alias(f"{name}_first"), F.max("date").alias(f"{name}_last"))
        out = out.join(spans, "market", "left") if by else out.join(F.broadcast(spans))  # without a key it is one row
    return out.withColumn("common_years", common_years([F.col(f"{n}_first") for n in tables], [F.col(f"{n}_last") for n in tables]))
