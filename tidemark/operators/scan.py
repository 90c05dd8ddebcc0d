"""The market scan: every analyzer over all markets at once, one wide row per market, and the rankings over it.

Markets that fail a minimum keep their row, with a reason, by left joins from the table of markets; so do markets for which an analyzer fails.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.isolation import Failures, tried
from tidemark.operators import clusters, confluence, flows, index_pattern, knn, outcomes, paths
from tidemark.operators.observations import HORIZONS, observations
from tidemark.session import materialized
from tidemark.sources.tables import market_quality

LEAST_ROWS = 60
#: Analyzers whose jobs are made and run at the same time.
AT_ONCE = 6


def titled(direction: Column) -> Column:
    return F.coalesce(direction, F.lit("n.a."))


def pure_net_columns(valid: DataFrame, prices: DataFrame, reports: DataFrame, weeks: int, n: int) -> DataFrame:
    """Outcome and timing of one horizon's pure-net analogs, prefixed by the horizon."""
    matches = materialized(knn.pure_net(valid, weeks, n))
    result = outcomes.levels(matches, ["market"], f"return_{weeks}w")
    timing = paths.cluster_timing(matches, prices, result.select("market", F.col("direction").alias("bias")), reports, weeks)
    figures = ("n", "up", "down", "direction", "hit_rate", "median", "range_low", "range_high")
    both = result.select("market", *figures).join(timing.select("market", "window_start", "window_end"), "market", "left")
    return both.select("market", *(F.col(c).alias(f"net{weeks}_{c}") for c in (*figures, "window_start", "window_end")))


def analog_columns(valid: DataFrame, prices: DataFrame, n: int = 30, threshold: float = 0.01) -> DataFrame:
    """Bias and hit rate of the analogs by nets, and whether those near by shares confirm them."""
    matches = materialized(knn.net_similar(valid, n))
    main = paths.timing(matches, prices, 8, threshold).select("market", "n", "up", "down", "bias")
    near = paths.timing(knn.share_context(matches, valid), prices, 8, threshold).select("market", F.col("n").alias("share_n"), F.col("bias").alias("share_bias"))
    hit = F.when(F.col("bias") == "bullish", F.col("up")).otherwise(F.col("down")) / F.col("n")
    confirmed = F.coalesce((F.col("share_n") >= 8) & (F.col("share_bias") == F.col("bias")) & (F.col("bias") != "neutral"), F.lit(False))
    return main.join(near, "market", "left").select("market", F.col("n").alias("cases"), "bias", hit.alias("hit_rate"), confirmed.alias("share_confirmed"))


def timing_bias(median: Column, bias: Column) -> Column:
    """The sign of the median return, or else the result's own bias."""
    return F.when(median > 0, "bullish").when(median < 0, "bearish").otherwise(bias)


def flow_columns(valid: DataFrame) -> DataFrame:
    each = materialized(flows.horizons(valid))
    split = flows.divergence(each).select("market", F.col("signal").alias("flow_signal"), F.col("strength").alias("flow_strength"), F.lit(True).alias("flow_available"))
    by_weeks = each.groupBy("market").agg(*(F.max(F.when(F.col("weeks") == k, F.col("signal"))).alias(f"flow_signal_{k}w") for k in flows.FLOW_HORIZONS))
    return split.join(by_weeks, "market", "full").join(flows.strongest(each), "market", "full")


def extreme_columns(valid: DataFrame) -> DataFrame:
    return flows.extremes(valid).select(
        "market", F.col("signal").alias("extreme_signal"), F.col("absolute_signal").alias("extreme_direction"), F.col("confirmed").alias("extreme_confirmed"), F.col("strength").alias("extreme_strength"),
        *(F.col(f"{c}_combined").alias(f"{c}_percentile") for c in knn.NETS), F.lit(True).alias("extreme_available"),
    )


def transition_columns(valid: DataFrame) -> DataFrame:
    return flows.transition(valid).select("market", *(F.col(c).alias(f"transition_{c}") for c in ("phase", "score", "direction", "convergence", "sustained", "price_confirmed")))


def index_columns(valid: DataFrame, prices: DataFrame, reports: DataFrame, n: int) -> DataFrame:
    """The index pattern's state, outcome and timing."""
    index = materialized(index_pattern.analyze(valid, n=n))
    rates = F.greatest("up", "down") / F.col("n")
    ranges = [outcomes.by_direction(outcomes.majority(), q) for q in (25, 75)]
    _, regime = index_pattern.candidates(index_pattern.with_indices(valid))
    timing = paths.cluster_timing(index_pattern.matches(regime, n=n), prices, index.where("available").select("market", timing_bias(F.col("median"), F.col("direction")).alias("bias")), reports)
    columns = index.select(
        "market", F.col("available").alias("index_available"), "commercial_index", "retail_index", "commercial_net_percentile", "retail_net_percentile",
        (F.col("commercial_confirmed") & F.col("retail_confirmed")).alias("index_confirmed"), F.col("reason").alias("index_reason"), F.col("n").alias("index_cases"),
        F.coalesce(F.when(F.col("available"), F.col("direction")), F.lit("neutral")).alias("index_bias"),
        *(F.when(F.col("available"), c).alias(f"index_{name}") for name, c in (("hit_rate", F.col("hit_rate")), ("lower_limit", F.col("wilson_low")), ("share", rates), ("median", F.col("median")), ("range_low", ranges[0]), ("range_high", ranges[1]), ("quality", F.col("quality")))),
    )
    return columns.join(timing.select("market", F.col("window_start").alias("index_window_start"), F.col("window_end").alias("index_window_end")), "market", "left")


CLUSTER_FIGURES = {"bias": "direction", "hit_rate": "hit_rate", "lower_limit": "wilson_low", "cases": "n", "up": "up", "down": "down", "median": "median", "q25": "q25", "q75": "q75", "range_low": "range_low", "range_high": "range_high", "quality": "quality", "silhouette": "silhouette"}


def cluster_columns(valid: DataFrame, prices: DataFrame, reports: DataFrame) -> DataFrame:
    """Outcome and timing of the current cluster; the fits run once."""
    result, events = clusters.analyze(materialized(clusters.fitted(valid)))
    good = result.where("available")
    timing = paths.cluster_timing(events, prices, good.select("market", timing_bias(F.col("median"), F.col("direction")).alias("bias")), reports)
    columns = good.select("market", F.lit(True).alias("cluster_available"), (F.greatest("up", "down") / F.col("n")).alias("cluster_share"), *(F.col(c).alias(f"cluster_{k}") for k, c in CLUSTER_FIGURES.items()))
    return columns.join(timing.select("market", *(F.col(c).alias(f"cluster_{c}") for c in ("onset_day", "window_start", "window_end", "peak_day", "status"))), "market", "left")


Analyzer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def analyzers(n: int = 30, threshold: float = 0.01, with_clusters: bool = True) -> dict[str, Analyzer]:
    """What the scan computes from valid rows, prices and the dates of the newest reports: columns by market, each analyzer apart from the others."""
    found: dict[str, Analyzer] = {
        "analogs": lambda valid, prices, reports: analog_columns(valid, prices, n, threshold),
        "flows": lambda valid, prices, reports: flow_columns(valid),
        "extremes": lambda valid, prices, reports: extreme_columns(valid),
        "transition": lambda valid, prices, reports: transition_columns(valid),
        "index": lambda valid, prices, reports: index_columns(valid, prices, reports, n),
    }
    found |= {f"net{h}": lambda valid, prices, reports, h=h: pure_net_columns(valid, prices, reports, h, n) for h in HORIZONS}
    return found | ({"clusters": cluster_columns} if with_clusters else {})


def side_by_side(parts: list[DataFrame], rows: DataFrame) -> DataFrame:
    out = rows.select("market").distinct()
    for part in parts:
        out = out.join(part, "market", "left")
    return out


def analyzed(valid: DataFrame, prices: DataFrame, reports: DataFrame, found: dict[str, Analyzer]) -> tuple[DataFrame, Failures]:
    """The columns of all analyzers by market. Each is a job of its own, some at a time, so that a failing one is known and the cluster isn't idle while plans are made."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        tries = [pool.submit(inheritable_thread_target(valid.sparkSession)(tried), name, partial(a, prices=prices, reports=reports), valid) for name, a in found.items()]
        results = [t.result() for t in tries]
    return side_by_side([part for part, _ in results], valid), [f for _, failed in results for f in failed]


def scan(positions: DataFrame, prices: DataFrame, markets: DataFrame, today: Column, n: int = 30, threshold: float = 0.01, with_clusters: bool = True, found: dict[str, Analyzer] | None = None) -> DataFrame:
    """One row per row of ``markets`` (market, category). ``error`` says why a market has no results, or which analyzers failed for it and why; an analyzer that fails for one market leaves all other
    results as they are."""
    positions, prices = materialized(positions), materialized(prices)
    quality = market_quality(positions, prices, markets, today)

    def usable_rows(rows: DataFrame) -> DataFrame:
        obs = observations(rows, prices, HORIZONS, scales=False)
        full = obs.na.drop(subset=knn.NETS + knn.SHARES).withColumn("n_valid", F.count("*").over(windows.whole()))
        return full.where(F.col("n_valid") >= LEAST_ROWS).join(quality.where("usable").select("market"), "market").drop("n_valid")

    valid, failures = tried("observations", usable_rows, positions)
    reports = valid.groupBy("market").agg(F.max("date").alias("report_date"))
    wide, more = analyzed(valid, prices, reports, found or analyzers(n, threshold, with_clusters))
    failed = positions.sparkSession.createDataFrame(failures + more, "market string, name string, reason string")
    failed = failed.groupBy("market").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "name", "reason"))), "; ").alias("failed"))
    out = markets.select("market", "category").join(quality, "market", "left").join(reports, "market", "left").join(wide, "market", "left").join(failed, "market", "left")
    unusable = F.concat_ws("; ", F.concat(F.lit("positions "), "positions_status"), F.concat(F.lit("prices "), "prices_status"))
    error = F.when(~F.col("usable"), unusable).when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("report_date").isNull(), "too_few_rows").otherwise("")
    flags = ["flow_available", "extreme_available", "index_available", *(["cluster_available"] if "cluster_available" in wide.columns else [])]
    return out.withColumns({"error": error, "bias": titled(F.col("bias")), **{f: F.coalesce(F.col(f), F.lit(False)) for f in flags}}).drop("failed")


def quality_filter(prefix: str, rate: str, min_rate: float = 0.7, min_cases: int = 25, min_move: float = 0.02) -> Column:
    cases, median = F.col(f"{prefix}_cases" if prefix in ("cluster", "index") else f"{prefix}_n"), F.col(f"{prefix}_median")
    return (F.col(rate) >= min_rate) & (cases >= min_cases) & (F.abs(median) >= min_move)


def top(rows: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    return rows.orderBy(*order, F.col("market").asc()).limit(k)


def top_markets(rows: DataFrame, k: int = 5) -> DataFrame:
    """Directional markets of 15 cases or more by rate, confirmation by shares, and cases."""
    good = rows.where(F.col("bias").isin("bullish", "bearish") & F.col("hit_rate").isNotNull() & (F.col("cases") >= 15))
    return top(good, [F.col("hit_rate").desc(), F.col("share_confirmed").desc(), F.col("cases").desc()], k)


def top_pure_net(rows: DataFrame, weeks: int, min_rate: float = 0.7, min_cases: int = 25, min_move: float = 0.02, k: int = 5) -> DataFrame:
    """Pure-net patterns of one horizon (4, 8 or 12) by historical edge."""
    if weeks not in HORIZONS:
        raise ValueError("weeks must be 4, 8 or 12")
    p = f"net{weeks}"
    directed = F.col(f"{p}_direction").isin("bullish", "bearish")
    edge = expr.log_edge(F.col(f"{p}_median"), F.col(f"{p}_hit_rate"), F.col(f"{p}_n"))
    return top(rows.where(directed & quality_filter(p, f"{p}_hit_rate", min_rate, min_cases, min_move)).withColumn("edge", edge), [F.col("edge").desc(), F.col(f"{p}_n").desc()], k)


def top_by_edge(rows: DataFrame, prefix: str, min_rate: float = 0.7, min_cases: int = 25, min_move: float = 0.02, k: int = 5) -> DataFrame:
    """Cluster or index patterns by historical edge."""
    edge = expr.log_edge(F.col(f"{prefix}_median"), F.col(f"{prefix}_share"), F.col(f"{prefix}_cases"))
    good = rows.where(F.col(f"{prefix}_available") & quality_filter(prefix, f"{prefix}_share", min_rate, min_cases, min_move))
    return top(good.withColumn("edge", edge), [F.col("edge").desc(), F.col(f"{prefix}_cases").desc()], k)


def top_extremes(rows: DataFrame, k: int = 5) -> DataFrame:
    return top(rows.where((F.col("error") == "") & F.col("extreme_available")), [F.col("extreme_strength").desc(), F.col("extreme_confirmed").desc()], k)


def top_flows(rows: DataFrame, k: int = 5) -> DataFrame:
    return top(rows.where((F.col("error") == "") & (F.col("flow_score") > 0)), [F.col("flow_score").desc(), F.col("flow_dominance").desc(), F.col("flow_weeks").desc()], k)


def top_transitions(rows: DataFrame, k: int = 5) -> DataFrame:
    """Turning markets by phase, score and number of confirmations."""
    confirmations = sum((F.coalesce(F.col(f"transition_{c}"), F.lit(False)).cast("int") for c in ("convergence", "sustained", "price_confirmed")), F.lit(0))
    good = rows.where((F.col("error") == "") & (F.col("transition_phase") >= 1)).withColumn("confirmations", confirmations)
    return top(good, [F.col("transition_phase").desc(), F.col("transition_score").desc(), F.col("confirmations").desc()], k)


def module_rows(scanned: DataFrame, macro: DataFrame, season: DataFrame, weeks: int) -> DataFrame:
    """Evidence of the three modules at one horizon from their results: scan rows, ``macro.regime`` and a seasonal forecast."""
    figures = ("direction", "n", "up", "down", "median", "range_low", "range_high")
    p = f"net{weeks}"
    net = scanned.select("market", F.lit("positioning").alias("module"), *(F.col(f"{p}_{c}").alias(c) for c in figures), (F.col(f"{p}_n") > 0).alias("available"))
    fundamental = macro.select("market", F.lit("macro").alias("module"), outcomes.majority().alias("direction"), *figures[1:], "available")
    seasonal = season.where(F.col("weeks") == weeks).select("market", F.lit("seasonality").alias("module"), "direction", "n", "up", "down", "median", F.col("q25").alias("range_low"), F.col("q75").alias("range_high"), F.lit(True).alias("available"))
    found = net.unionByName(fundamental).unionByName(seasonal)
    grid = scanned.select("market", F.explode(F.array(*map(F.lit, confluence.MODULES))).alias("module"))
    return confluence.evidence(grid.join(found, ["market", "module"], "left"))


def overview(scanned: DataFrame, macro: DataFrame, season: DataFrame, weeks: int = 8) -> DataFrame:
    """The ranked confluence of all markets at one horizon."""
    rows = module_rows(scanned, macro, season, weeks)
    return confluence.ranked(confluence.combine(rows).join(confluence.side_by_side(rows), "market").join(scanned.select("market", "category"), "market"))
