"""Position flows: price against long and short building, historical extremes, and trend transitions.

All results are one row per market (flows: per market and horizon); a market that fails a minimum gets ``available`` false and a reason
from the caller's left join with the markets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators.knn import NETS, SHARES, complete

FLOW_HORIZONS = (1, 2, 4, 8)


def classify(price: Column, long: Column, short: Column, long_z: Column, short_z: Column, min_move: float = 0.02, min_z: float = 1.0, min_dominance: float = 0.7) -> dict[str, Column]:
    """State, signal, score and strength of one horizon from the price change, both flows and their z-scores.

    A signal needs an unusual and dominant building of one side against the price, without an unusual one of the other side.
    """
    zero = F.lit(0.0)
    long_share = F.when(long > 0, expr.dominance(long, short)).otherwise(0.0)
    short_share = F.when(short > 0, expr.dominance(short, long)).otherwise(0.0)
    long_active = F.coalesce((long > 0) & (long_z >= min_z), F.lit(False))
    short_active = F.coalesce((short > 0) & (short_z >= min_z), F.lit(False))
    long_building, short_building = long_active & (long_share >= min_dominance), short_active & (short_share >= min_dominance)
    falling, rising = price <= -min_move, price >= min_move
    flow = (
        F.when((long > 0) & (short > 0), F.when(long > short, "long_building").otherwise("short_building"))
        .when(long > 0, "long_building")
        .when(short > 0, "short_building")
        .when((long < 0) & (short < 0), "position_reduction")
        .when(long < 0, "long_liquidation")
        .when(short < 0, "short_covering")
        .otherwise("none")
    )
    bullish, bearish = falling & long_building & ~short_active, rising & short_building & ~long_active
    both = (long > 0) & (short > 0)
    state = (
        F.when(bullish, "bullish_divergence")
        .when(bearish, "bearish_divergence")
        .when(falling & both, "bullish_accumulation_mixed")
        .when(rising & both, "bearish_distribution_mixed")
        .when(falling & (long > 0), "bullish_accumulation")
        .when(rising & (short > 0), "bearish_distribution")
        .when(falling & (short > 0), "bearish_trend_confirmation")
        .when(rising & (long > 0), "bullish_trend_confirmation")
        .when((long < 0) & (short < 0), "position_reduction")
        .otherwise("neutral")
    )
    points = lambda z, d: 2 + F.greatest(zero, z - min_z) + 4 * F.greatest(zero, d - min_dominance)
    score = F.when(bullish, points(long_z, long_share)).when(bearish, points(short_z, short_share)).otherwise(0.0)
    signal = F.when(bullish, "bullish").when(bearish, "bearish").otherwise("none")
    strength = (
        F.when(signal == "none", F.when(state.isin("neutral", "position_reduction"), "none").otherwise("hint")).when(score >= 4.0, "strong").when(score >= 2.8, "medium").otherwise("early")
    )
    return {
        "signal": signal, "state": state, "strength": strength, "score": score, "dominant_flow": flow, "dominance": F.greatest(long_share, short_share),
        "long_dominance": long_share, "short_dominance": short_share, "long_building": long_building, "short_building": short_building,
        "long_active": long_active, "short_active": short_active, "long_liquidation": long < 0, "short_covering": short < 0,
    }


def horizons(df: DataFrame, weeks: tuple[int, ...] = FLOW_HORIZONS, min_move: float = 0.02, min_z: float = 1.0, min_dominance: float = 0.7) -> DataFrame:
    """One classified row per market and horizon (rows, not calendar weeks) for the newest complete report.

    Markets need ``max(weeks) + 53`` complete rows.
    """
    clean = complete(df, ["close", "noncomm_long", "noncomm_short"]).where(F.col("n_rows") >= max(weeks) + 53)
    w = windows.series()
    moved = {f"price_{k}": windows.row_return(F.col("close"), w, k) for k in weeks}
    moved |= {f"{side}_{k}": windows.row_change(F.col(f"noncomm_{side}"), w, k) for side in ("long", "short") for k in weeks}
    steps = F.array(*(F.struct(F.lit(k).alias("weeks"), *(F.col(f"{x}_{k}").alias(x) for x in ("price", "long", "short"))) for k in weeks))
    long_form = clean.withColumns(moved).select("market", "date", "is_last", F.explode(steps).alias("s")).select("market", "date", "is_last", "s.*")
    last = lambda c: F.max(F.when(F.col("is_last"), F.col(c)))
    latest = long_form.groupBy("market", "weeks").agg(
        F.max("date").alias("date"), *(last(c).alias(f"{c}_change") for c in ("price", "long", "short")),
        windows.latest_z(F.col("long"), F.col("is_last")).alias("long_z"), windows.latest_z(F.col("short"), F.col("is_last")).alias("short_z"),
    )
    return latest.withColumns(classify(*(F.col(c) for c in ("price_change", "long_change", "short_change", "long_z", "short_z")), min_move, min_z, min_dominance))


def divergence(flows: DataFrame) -> DataFrame:
    """Horizons added up per market: the side with the larger score wins; its confirmed horizons and score give the strength."""
    side = lambda s: F.sum(F.when(F.col("signal") == s, F.col("score")).otherwise(0.0))
    number = lambda s: F.count(F.when(F.col("signal") == s, 1))
    both = flows.groupBy("market").agg(side("bullish").alias("up"), side("bearish").alias("down"), number("bullish").alias("ups"), number("bearish").alias("downs"))
    signal = F.when((F.col("up") > F.col("down")) & (F.col("ups") > 0), "bullish").when((F.col("down") > F.col("up")) & (F.col("downs") > 0), "bearish").otherwise("none")
    confirmed = F.when(signal == "bullish", F.col("ups")).when(signal == "bearish", F.col("downs")).otherwise(0)
    score = F.when(signal == "bullish", F.col("up")).when(signal == "bearish", F.col("down")).otherwise(0.0)
    strength = F.when((confirmed >= 3) & (score >= 8), "strong").when((confirmed >= 2) | (score >= 3.5), "medium").when(confirmed == 1, "early").otherwise("none")
    return both.select("market", signal.alias("signal"), confirmed.alias("confirmed"), score.alias("score"), strength.alias("strength"))


def strongest(flows: DataFrame) -> DataFrame:
    """Per market the horizon with the largest score; of equal ones the shortest."""
    best = F.max_by(F.struct("weeks", "score", "dominant_flow", "dominance"), F.struct(F.col("score"), -F.col("weeks")))
    return flows.groupBy("market").agg(best.alias("b")).select("market", *(F.col(f"b.{c}").alias(f"flow_{c}") for c in ("weeks", "score", "dominant_flow", "dominance")))


def mid_rank(x: str) -> Column:
    """An aggregate: the current row's percentile in the history, equal values half."""
    now, before = F.col(f"now_{x}"), F.when(~F.col("is_last"), F.col(x))
    return 100 * (F.count(F.when(before < now, 1)) + 0.5 * F.count(F.when(before == now, 1))) / F.count(before)


def extremes(df: DataFrame, cutoff: float = 90.0, min_history: int = 104) -> DataFrame:
    """Percentiles of the newest report's nets and shares in their own history, and whether commercials and large speculators are opposed extremes."""
    clean = complete(df, NETS + SHARES).where(F.col("n_rows") >= min_history + 1)
    w = windows.whole()
    clean = clean.withColumns({f"now_{c}": F.max(F.when(F.col("is_last"), F.col(c))).over(w) for c in NETS + SHARES})
    ranked = clean.groupBy("market").agg(
        F.max("date").alias("date"), (F.count("*") - 1).alias("history"), *(mid_rank(c).alias(f"{c}_pct") for c in NETS + SHARES), *(F.max(f"now_{c}").alias(c) for c in NETS + SHARES)
    )
    mean = lambda a, b: F.coalesce((a + b) / 2, a, b)
    ranked = ranked.withColumns({f"{n}_combined": mean(F.col(f"{n}_pct"), F.col(f"{n}_oi_pct")) for n in NETS})
    ranked = ranked.withColumns({f"{n}_state": expr.percentile_state(F.col(f"{n}_combined"), cutoff) for n in NETS})
    high, low = lambda c: F.col(c) >= cutoff, lambda c: F.col(c) <= 100 - cutoff
    absolute = F.when(high("commercial_net_pct") & low("noncommercial_net_pct"), "bullish").when(low("commercial_net_pct") & high("noncommercial_net_pct"), "bearish").otherwise("neutral")
    shares = F.when(high("commercial_net_oi_pct") & low("noncommercial_net_oi_pct"), "bullish").when(low("commercial_net_oi_pct") & high("noncommercial_net_oi_pct"), "bearish").otherwise("neutral")
    ranked = ranked.withColumns({"absolute_signal": absolute, "share_signal": shares})
    either = lambda s: (F.col("absolute_signal") == s) | (F.col("share_signal") == s)
    signal = F.when(either("bullish"), "bullish_reversal_zone").when(either("bearish"), "bearish_reversal_zone").otherwise("no_joint_extreme")
    side = F.when(either("bullish"), "bullish").when(either("bearish"), "bearish")
    confirmed = F.coalesce((F.col("absolute_signal") == side) & (F.col("share_signal") == side), F.lit(False))
    retail = F.when(low("nonreportable_net_combined"), "bullish").when(high("nonreportable_net_combined"), "bearish").otherwise("neutral")
    strength = F.greatest(*(F.abs(F.col(f"{n}_combined") - 50) * 2 for n in NETS))
    return ranked.withColumns({"signal": signal, "confirmed": confirmed, "retail_support": retail, "strength": strength})


def transition(df: DataFrame, flow_weeks: int = 4, cutoff: float = 90.0) -> DataFrame:
    """Phases of a turning market: extreme positions, flows that turn, flows that last, and the price that follows."""
    sides = ["noncomm_long", "noncomm_short"]
    used = ["market", "date", "close", "oi", *NETS, *SHARES, *sides, "comm_long", "comm_short", "nonrep_long", "nonrep_short"]
    clean = complete(df.select(*used), ["close", "oi", *NETS, *sides, "comm_long", "comm_short", "nonrep_long", "nonrep_short"]).where(F.col("n_rows") >= max(105, flow_weeks + 53)).drop("is_last", "n_rows")
    w = windows.series()
    moved = {f"d_{c}": windows.row_change(F.col(c), w, flow_weeks) for c in (*sides, "noncommercial_net")} | {"d_close": windows.row_return(F.col("close"), w, flow_weeks), "from_end": F.row_number().over(windows.whole().orderBy(F.col("date").desc()))}
    rows = windows.with_place(clean.withColumns(moved))
    last = lambda c: F.max(F.when(F.col("is_last"), F.col(c)))
    recent = F.col("from_end") <= 3
    flows_now = rows.groupBy("market").agg(
        *(last(f"d_{c}").alias(f"{c}_change") for c in sides), *(windows.latest_z(F.col(f"d_{c}"), F.col("is_last")).alias(f"{c}_z") for c in sides), last("d_close").alias("price_change"),
        F.count(F.when(recent & (F.col("d_noncommercial_net") > 0), 1)).alias("rises"), F.count(F.when(recent & (F.col("d_noncommercial_net") < 0), 1)).alias("falls"),
    )
    zones = extremes(clean, cutoff).select("market", "date", "signal", "confirmed", "retail_support")
    split = divergence(horizons(clean)).select("market", F.col("signal").alias("split_signal"), F.col("strength").alias("split_strength"))
    out = zones.join(flows_now, "market").join(split, "market", "left")
    flow_args = [F.col(c) for c in ("noncomm_long_change", "noncomm_short_change", "noncomm_long_z", "noncomm_short_z")]
    direction = F.when(F.col("signal") == "bullish_reversal_zone", "bullish").when(F.col("signal") == "bearish_reversal_zone", "bearish").otherwise("neutral")
    out = out.withColumns({"direction": direction, "flow_direction": expr.flow_direction(*flow_args), "flow": expr.flow_label(*flow_args)})
    known, toward = F.col("direction") != "neutral", F.col("direction") == "bullish"
    out = out.withColumns(
        {
            "convergence": known & (F.col("flow_direction") == F.col("direction")),
            "sustained": known & (F.when(toward, F.col("rises")).otherwise(F.col("falls")) >= 2),
            "price_confirmed": known & F.when(toward, F.col("price_change") > 0.01).otherwise(F.col("price_change") < -0.01),
            "split_aligned": known & F.coalesce(F.col("split_signal") == F.col("direction"), F.lit(False)),
            "retail_aligned": known & (F.col("retail_support") == F.col("direction")),
        }
    )
    unusual = F.greatest(F.abs("noncomm_long_z"), F.abs("noncomm_short_z"))
    points = lambda c, p: F.when(F.col(c), p).otherwise(0)
    score = (
        F.when(known, 35).otherwise(0) + points("confirmed", 5) + F.when(F.col("retail_support") == F.col("direction"), 10).otherwise(0)
        + F.when(F.col("convergence"), 20 + F.least(F.lit(10), F.floor(F.greatest(F.lit(0.0), unusual - 1) * 10))).otherwise(0)
        + points("sustained", 10) + F.when(F.col("split_aligned"), F.when(F.col("split_strength") == "early", 8).when(F.col("split_strength") == "medium", 12).otherwise(15)).otherwise(0)
        + points("price_confirmed", 10)
    )
    phase = F.when(~known, 0).when(~F.col("convergence"), 1).when(~F.col("sustained"), 2).when(~F.col("price_confirmed"), 3).otherwise(4)
    return out.withColumns({"score": F.least(F.lit(100), score), "phase": phase})
