"""Queries of the positioning engine: observations, windows, analogs and their outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators import knn, observations, outcomes, ranges
from tidemark.operators.asof import asof
from tidemark.plans.shape import shaped, sql, sql_counted, sql_levels, sql_nearest, sql_wilson
from tidemark.session import materialized
from tidemark.sources import proxies

NETS, SHARES = knn.NETS, knn.SHARES


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, aggregated once."""
    return materialized(proxies.prices(spark, sf_dir))


def observed(spark: SparkSession, sf_dir: str, scales: bool = False, prices: DataFrame | None = None) -> DataFrame:
    """Observations, made once: the source tables are read once, and analyzers that use them several times have a short plan."""
    return materialized(observations.observations(proxies.positions(spark, sf_dir), priced(spark, sf_dir) if prices is None else prices, scales=scales))


def asof_backward(spark, sf_dir):
    return shaped(observations.with_close(proxies.positions(spark, sf_dir), proxies.prices(spark, sf_dir)), "market:s date:t oi:l close")


#: Ranges of the queries for keys that are too large for one task.
RANGES = 24


def asof_ranges(spark, sf_dir):
    """The last close at or before each report, with keys in many ranges."""
    out = asof(proxies.positions(spark, sf_dir), proxies.prices(spark, sf_dir), ["market"], "date", "date", {"close": "close"}, ranges=RANGES)
    return shaped(out, "market:s date:t oi:l close")


def rolling_ranges(spark, sf_dir):
    """The rolling scales with keys in stretches."""
    w = ranges.window(["market"], "date")
    made = {f"{n}_z": windows.rolling_z(F.col(n), w) for n in NETS} | {f"{n}_pct": windows.rolling_rank(F.col(n), w) for n in NETS}
    return shaped(ranges.rolling(proxies.positions(spark, sf_dir), ["market"], "date", 156, made, RANGES, stretch=200), SCALES)


#: Prices in the frame of a wide rank, and how many of them there have to be.
WIDE, WIDE_LEAST = 1000, 250


def rolling_ranks_wide(spark, sf_dir):
    """The rank of every price among the last thousand of its market, in stretches."""
    return shaped(ranges.ranked(proxies.prices(spark, sf_dir), ["market"], "date", WIDE, {"close_pct": "close"}, WIDE_LEAST, RANGES, stretch=WIDE), "market:s date:t close close_pct")


def sql_wide() -> str:
    frame = f"OVER (PARTITION BY market ORDER BY date ROWS BETWEEN {WIDE - 1} PRECEDING AND CURRENT ROW)"
    return f"""v AS (SELECT market, date, close, list(close) {frame} AS held FROM prices),
result AS (SELECT market, date, close, CASE WHEN len(held) >= {WIDE_LEAST} THEN (len(list_filter(held, lambda h: h < close)) + (len(list_filter(held, lambda h: h = close)) + 1) / 2.0) / len(held) END AS close_pct FROM v)"""


def asof_forward_tolerance(spark, sf_dir):
    left = proxies.positions(spark, sf_dir).select("market", "date", F.date_add("date", 28).alias("target"))
    out = asof(left, proxies.prices(spark, sf_dir), ["market"], "target", "date", {"date": "price_date", "close": "close"}, "forward", 10)
    return shaped(out, "market:s date:t price_date:t close")


OBS = "market:s date:t oi:l close commercial_net_oi noncommercial_net_oi nonreportable_net_oi return_4w return_8w return_12w"


def observation_table(spark, sf_dir):
    return shaped(observed(spark, sf_dir), OBS)


SCALES = "market:s date:t " + " ".join(f"{n}_z {n}_pct" for n in NETS)


def rolling_scales(spark, sf_dir):
    return shaped(observations.with_scales(proxies.positions(spark, sf_dir)), SCALES)


INDICES = "market:s date:t commercial_index commercial_net_percentile retail_index retail_net_percentile"


def rolling_indices(spark, sf_dir):
    return shaped(observations.with_indices(proxies.positions(spark, sf_dir)), INDICES)


def latest_flow_z(spark, sf_dir):
    w = windows.series()
    rows = windows.with_place(proxies.positions(spark, sf_dir).withColumn("d", windows.row_change(F.col("noncomm_long"), w, 4)))
    return shaped(rows.groupBy("market").agg(windows.latest_z(F.col("d"), F.col("is_last")).alias("z")), "market:s z")


MATCH = "market:s rank:l date:t distance"
LEVELS = "market:s n:l up:l down:l direction:s hit_rate median range_low range_high"
R8 = "return_8w"


def matched(name: str, matches, features, required, metric="rms", n=30, gap=56, weights=None):
    """A pair of queries: the matches."""
    return {name: (lambda spark, sf_dir: shaped(matches(observed(spark, sf_dir)), MATCH), sql(sql_nearest(features, required, metric, n, gap, weights) + ", result AS (SELECT * FROM m)", MATCH))}


def summed(name: str, matches, features, required, n=30, gap=56):
    """A pair of queries: the outcome of the matches."""
    body = sql_nearest(features, required, "rms", n, gap) + f", e AS (SELECT m.*, o.{R8} FROM m JOIN obs o ON o.market = m.market AND o.date = m.date), result AS ({sql_levels('e', R8)})"
    return {name: (lambda spark, sf_dir: shaped(outcomes.levels(matches(observed(spark, sf_dir)), ["market"], R8), LEVELS), sql(body, LEVELS))}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the 20 most similar, independent positionings before the newest report whose 8-week outcome is known."""
    return shaped(outcomes.levels(knn.pure_net(observed(spark, sf_dir), 8, 20), ["market"], R8), LEVELS)


W55 = {f: 0.55 / 3 for f in NETS} | {f: 0.45 / 3 for f in SHARES}
CN = ["commercial_net", "nonreportable_net"]

SIMILAR = "market:s rank:l date:t distance similarity"


def similar_weeks(spark, sf_dir):
    return shaped(knn.net_similar(observed(spark, sf_dir)), SIMILAR)


def euclid_neighbours(spark, sf_dir):
    return shaped(knn.similar(observed(spark, sf_dir), NETS), MATCH)


CONTEXT = "market:s date:t distance oi_distance oi_similarity oi_rank:l"


def share_context(spark, sf_dir):
    obs = observed(spark, sf_dir).na.drop(subset=NETS + SHARES)
    return shaped(knn.share_context(knn.net_similar(obs), obs), CONTEXT)


STATS = "market:s n:l mean median hit_rate best worst std"
ZONES = "market:s index_zone:s percentile_zone:s index_side:s same:b state:s"


def index_zones(spark, sf_dir):
    rows = windows.with_place(observations.with_indices(proxies.positions(spark, sf_dir)).na.drop(subset=["commercial_index", "commercial_net_percentile"])).where("is_last")
    index, p = F.col("commercial_index"), F.col("commercial_net_percentile")
    made = {"index_zone": expr.zone(index, 80), "percentile_zone": expr.zone(p, 80), "index_side": expr.extreme_side(index, 80), "same": expr.same_extreme(index, p, 80), "state": expr.percentile_state(p, 90)}
    return shaped(rows.withColumns(made), ZONES)


def sql_zone(x: str, other: str = "'neutral'") -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n.a.' WHEN {x} >= 80 THEN 'high' WHEN {x} <= 20 THEN 'low' ELSE {other} END"


SCREEN = "market:s commercial_index retail_index strength"


def extreme_screen(spark, sf_dir, cutoff=60.0):
    rows = windows.with_place(observations.with_indices(proxies.positions(spark, sf_dir)).na.drop(subset=["commercial_index", "retail_index"])).where("is_last")
    return shaped(screen(rows, cutoff), SCREEN)


def screen(rows: DataFrame, cutoff: float) -> DataFrame:
    """Markets with an extreme index, those furthest from the middle first."""
    extreme = expr.extreme_side(F.col("commercial_index"), cutoff).isNotNull() | expr.extreme_side(F.col("retail_index"), cutoff).isNotNull()
    strength = F.greatest(F.abs(F.col("commercial_index") - 50), F.abs(F.col("retail_index") - 50))
    return rows.where(extreme).withColumn("strength", strength).orderBy(F.col("strength").desc(), "market")


FRESH = "market:s positions_first:t positions_last:t positions_age_days:l positions_status:s prices_first:t prices_last:t prices_age_days:l prices_status:s usable:b"


def data_status(spark, sf_dir):
    from tidemark.sources.tables import market_quality

    markets = proxies.table(spark, sf_dir, "region").select(F.col("r_name").alias("market"))
    return shaped(market_quality(proxies.positions(spark, sf_dir), proxies.prices(spark, sf_dir), markets, F.lit("2001-11-10").cast("date")), FRESH)


def sql_fresh(table: str, prefix: str, most: int) -> str:
    return f"""{prefix}_f AS (
  SELECT market, first, last, greatest(0, date_diff('day', last, DATE '2001-11-10')) AS age FROM (SELECT market, min(date) AS first, max(date) AS last FROM {table} GROUP BY 1)
),
{prefix}_q AS (
  SELECT r_name AS market, first AS {prefix}_first, last AS {prefix}_last, age AS {prefix}_age_days, CASE WHEN last IS NULL THEN 'missing' WHEN age <= {most} THEN 'current' ELSE 'stale' END AS {prefix}_status
  FROM region LEFT JOIN {prefix}_f ON r_name = market
)"""


FEATURES = "market:s date:t mode:s commercial noncommercial nonreportable"


def feature_sets(spark, sf_dir):
    """The columns that each feature set selects, one below the other."""
    obs = observed(spark, sf_dir, True)
    parts = [obs.select("market", "date", F.lit(mode).alias("mode"), *(F.col(c).alias(n) for c, n in zip(observations.feature_columns(mode), ("commercial", "noncommercial", "nonreportable"), strict=True))) for mode in ("absolute", "share", "z", "percentile")]
    return shaped(reduce(DataFrame.unionByName, parts), FEATURES)


def sql_feature_sets() -> str:
    columns = {"absolute": list(NETS), "share": SHARES, "z": [observations.sql_z(n) for n in NETS], "percentile": [observations.sql_rank(n) for n in NETS]}
    return "result AS (" + " UNION ALL ".join(f"SELECT market, date, '{mode}' AS mode, {c} AS commercial, {n} AS noncommercial, {r} AS nonreportable FROM obs" for mode, (c, n, r) in columns.items()) + ")"


def entries() -> dict[str, tuple]:
    last = lambda need: f"x AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last FROM i WHERE {need})"
    index = f"i AS (SELECT market, date, {observations.sql_index('commercial_net')} AS ci, 100 * {observations.sql_rank('commercial_net')} AS cp, {observations.sql_index('nonreportable_net')} AS ri, 100 * {observations.sql_rank('nonreportable_net')} AS rp FROM positions)"
    out = {
        "asof_backward": (asof_backward, sql("result AS (SELECT * FROM closed)", "market:s date:t oi:l close")),
        "asof_ranges": (asof_ranges, sql("result AS (SELECT * FROM closed)", "market:s date:t oi:l close")),
        "asof_forward_tolerance": (
            asof_forward_tolerance,
            sql("f AS (SELECT p.market, p.date, p.date + 28 AS t, px.pd, px.pc FROM positions p ASOF LEFT JOIN px ON p.market = px.pm AND p.date + 28 <= px.pd), result AS (SELECT market, date, CASE WHEN pd - t <= 10 THEN pd END AS price_date, CASE WHEN pd - t <= 10 THEN pc END AS close FROM f)", "market:s date:t price_date:t close"),
        ),
        "observations": (observation_table, sql("result AS (SELECT * FROM obs)", OBS)),
        "rolling_scales": (rolling_scales, sql("result AS (SELECT market, date, " + ", ".join(f"{observations.sql_z(n)} AS {n}_z, {observations.sql_rank(n)} AS {n}_pct" for n in NETS) + " FROM positions)", SCALES, "tables")),
        "rolling_ranges": (rolling_ranges, sql("result AS (SELECT market, date, " + ", ".join(f"{observations.sql_z(n)} AS {n}_z, {observations.sql_rank(n)} AS {n}_pct" for n in NETS) + " FROM positions)", SCALES, "tables")),
        "rolling_ranks_wide": (rolling_ranks_wide, sql(sql_wide(), "market:s date:t close close_pct", "tables")),
        "rolling_indices": (rolling_indices, sql(index + ", result AS (SELECT market, date, ci AS commercial_index, cp AS commercial_net_percentile, ri AS retail_index, rp AS retail_net_percentile FROM i)", INDICES, "tables")),
        "latest_flow_z": (
            latest_flow_z,
            sql(
                """d AS (SELECT market, noncomm_long - lag(noncomm_long, 4) OVER (PARTITION BY market ORDER BY date) AS d, date = max(date) OVER (PARTITION BY market) AS l FROM positions),
a AS (SELECT market, avg(d) FILTER (NOT l) AS m, stddev_pop(d) FILTER (NOT l) AS s, count(d) FILTER (NOT l) AS n, max(d) FILTER (l) AS x FROM d GROUP BY 1),
result AS (SELECT market, CASE WHEN n >= 52 AND x IS NOT NULL THEN CASE WHEN s = 0 THEN 0.0 ELSE (x - m) / s END END AS z FROM a)""",
                "market:s z", "tables",
            ),
        ),
        "flagship": (flagship, sql(sql_nearest(NETS, [R8], "rms", 20, 56) + f", e AS (SELECT m.*, o.{R8} FROM m JOIN obs o ON o.market = m.market AND o.date = m.date), result AS ({sql_levels('e', R8)})", LEVELS)),
        "similar_weeks": (similar_weeks, sql(sql_nearest(NETS, [], "rms", 30, 56) + ", result AS (SELECT *, 100 * exp(-distance / greatest(quantile_cont(distance, 0.5) OVER (PARTITION BY market), 1e-9)) AS similarity FROM m)", SIMILAR)),
        "euclid_neighbours": (euclid_neighbours, sql(sql_nearest(NETS, [], "euclid", 30, 0) + ", result AS (SELECT * FROM m)", MATCH)),
        "share_context": (
            share_context,
            sql(
                sql_nearest(NETS, SHARES, "rms", 30, 56) + "," + sql_nearest(SHARES, NETS, "rms", 1, 0, name="v")
                + ", j AS (SELECT m.market, m.date, m.distance, v_d.distance AS oi_distance FROM m JOIN v_d ON m.market = v_d.market AND m.date = v_d.date WHERE v_d.distance <= 1), result AS (SELECT *, 100 * exp(-oi_distance) AS oi_similarity, row_number() OVER (PARTITION BY market ORDER BY oi_distance, date) AS oi_rank FROM j)",
                CONTEXT,
            ),
        ),
        "outcome_statistics": (
            lambda spark, sf_dir: shaped(outcomes.statistics(observed(spark, sf_dir), ["market"], R8), STATS),
            sql(f"c AS ({sql_counted('obs', R8)}), result AS (SELECT *, up / n AS hit_rate FROM c)", STATS),
        ),
        "outcome_dominant_range": (
            lambda spark, sf_dir: shaped(outcomes.dominant(observed(spark, sf_dir), ["market"], R8), LEVELS),
            sql(f"c AS ({sql_levels('obs', R8)}), result AS (SELECT * EXCLUDE (hit_rate), greatest(up, down) / n AS hit_rate FROM c)", LEVELS),
        ),
        "outcome_index_pattern": (
            lambda spark, sf_dir: shaped(outcomes.index_pattern(observed(spark, sf_dir), ["market"], R8), "market:s n:l hits:l direction:s hit_rate wilson_low wilson_high q25 q75 best worst"),
            sql(
                f"c AS ({sql_counted('obs', R8)}), h AS (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN down > up THEN down ELSE up END AS hits FROM c), "
                f"result AS (SELECT *, hits / n AS hit_rate, {sql_wilson('hits', 'n', False)} AS wilson_low, {sql_wilson('hits', 'n', True)} AS wilson_high, all_25 AS q25, all_75 AS q75 FROM h)",
                "market:s n:l hits:l direction:s hit_rate wilson_low wilson_high q25 q75 best worst",
            ),
        ),
        "outcome_cluster": (
            lambda spark, sf_dir: shaped(outcomes.cluster(observed(spark, sf_dir), ["market"], R8), "market:s n:l hits:l direction:s hit_rate wilson_low wilson_high q25 q75"),
            sql(
                f"c AS ({sql_counted('obs', R8)}), h AS (SELECT *, CASE WHEN up / n >= 0.6 THEN 'bullish' WHEN down / n >= 0.6 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN up / n >= 0.6 THEN up WHEN down / n >= 0.6 THEN down ELSE greatest(up, down) END AS hits FROM c), "
                f"result AS (SELECT *, hits / n AS hit_rate, {sql_wilson('hits', 'n', False)} AS wilson_low, {sql_wilson('hits', 'n', True)} AS wilson_high, all_25 AS q25, all_75 AS q75 FROM h)",
                "market:s n:l hits:l direction:s hit_rate wilson_low wilson_high q25 q75",
            ),
        ),
        "index_zones": (
            index_zones,
            sql(
                f"{index}, {last('ci IS NOT NULL AND cp IS NOT NULL')}, result AS (SELECT market, {sql_zone('ci')} AS index_zone, {sql_zone('cp')} AS percentile_zone, CASE WHEN ci >= 80 THEN 'high' WHEN ci <= 20 THEN 'low' END AS index_side, (ci >= 80 AND cp >= 80) OR (ci <= 20 AND cp <= 20) AS same, "
                "CASE WHEN cp >= 90 THEN 'extreme_high' WHEN cp <= 10 THEN 'extreme_low' WHEN cp >= 80 THEN 'high' WHEN cp <= 20 THEN 'low' ELSE 'normal' END AS state FROM x WHERE is_last)",
                ZONES, "tables",
            ),
        ),
        "extreme_screen": (
            extreme_screen,
            sql(f"{index}, {last('ci IS NOT NULL AND ri IS NOT NULL')}, result AS (SELECT market, ci AS commercial_index, ri AS retail_index, greatest(abs(ci - 50), abs(ri - 50)) AS strength FROM x WHERE is_last AND (ci >= 60 OR ci <= 40 OR ri >= 60 OR ri <= 40))", SCREEN, "tables"),
        ),
        "data_status": (data_status, sql(sql_fresh("positions", "positions", 14) + "," + sql_fresh("prices", "prices", 7) + ", result AS (SELECT *, positions_status = 'current' AND prices_status = 'current' AS usable FROM positions_q JOIN prices_q USING (market))", FRESH, "tables")),
        "scenario_filter": (
            lambda spark, sf_dir: shaped(observations.scenario(observed(spark, sf_dir), {"commercial_net_oi": (-0.1, 0.1), "return_8w": (0.0, 1.0)}), OBS),
            sql("result AS (SELECT * FROM obs WHERE commercial_net_oi BETWEEN -0.1 AND 0.1 AND return_8w BETWEEN 0 AND 1)", OBS),
        ),
    }
    out |= {"feature_sets": (feature_sets, sql(sql_feature_sets(), FEATURES))}
    out |= matched("group_net_matches", lambda o: knn.group_net(o, "commercials"), ["commercial_net"], ["commercial_net_oi", R8])
    out |= matched("pure_net_matches", knn.pure_net, NETS, [R8])
    out |= matched("hybrid_similar", lambda o: knn.hybrid_similar(o), NETS + SHARES, [], "weighted", 30, 56, W55)
    out |= summed("group_net_commercials", lambda o: knn.group_net(o, "commercials"), ["commercial_net"], ["commercial_net_oi", R8])
    out |= summed("group_net_retail_share", lambda o: knn.group_net(o, "retail", with_share=True), ["nonreportable_net", "nonreportable_net_oi"], [R8])
    out |= summed("overlap_net", lambda o: knn.overlap(o), CN, ["commercial_net_oi", "nonreportable_net_oi", R8])
    return out
