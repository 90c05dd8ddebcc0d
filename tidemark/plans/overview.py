"""Queries of clusters, zones, the market scan, its rankings, and confluence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clusters, confluence, flows, index_pattern, knn, outcomes, scan
from tidemark.plans import cluster_sql, display, regimes, scan_sql, signals
from tidemark.plans.positioning import NETS, R8, SHARES, observed, priced
from tidemark.plans.shape import shaped, sql, sql_greedy, sql_levels, sql_nearest, sql_wilson
from tidemark.session import materialized
from tidemark.sources import proxies

CLUSTER = "market:s n:l up:l down:l direction:s hit_rate wilson_low wilson_high median q25 q75 best worst k:l silhouette quality available:b"
ZONES = "market:s place:l lower upper center n:l up:l down:l direction:s hit_rate median range_low range_high is_current:b"


def cluster_query(spark, sf_dir):
    result, _ = clusters.analyze(clusters.fitted(observed(spark, sf_dir)))
    return shaped(result, CLUSTER)


def zones_query(spark, sf_dir):
    return shaped(clusters.zone_table(clusters.zoned(observed(spark, sf_dir), "commercial_net")), ZONES)


def fixed_zones(spark, sf_dir):
    """The zone table for zones of equal size, which SQL can form too."""
    clean = knn.complete(observed(spark, sf_dir), ["commercial_net", R8])
    rows = clean.select("market", "date", "is_last", F.col("commercial_net").alias("net"), F.col(R8).alias("ret"), F.ntile(8).over(Window.partitionBy("market").orderBy("commercial_net", "date")).alias("zone"))
    return shaped(clusters.zone_table(rows), ZONES)


SQL_ZONES = f"""za AS (SELECT market, date, commercial_net AS net, {R8} AS ret, date = max(date) OVER (PARTITION BY market) AS is_last, ntile(8) OVER (PARTITION BY market ORDER BY commercial_net, date) AS zone FROM obs WHERE commercial_net IS NOT NULL AND {R8} IS NOT NULL),
zb AS (SELECT market || '|' || zone AS mz, market, zone, date, net, ret FROM za WHERE NOT is_last),
zc AS (SELECT market, zone, min(net) AS lower, max(net) AS upper, quantile_cont(net, 0.5) AS center FROM zb GROUP BY 1, 2),
{sql_greedy('zb', 'date DESC', 56, None, 'ze', 'mz', 'ret')},
zf AS ({sql_levels('ze', 'ret', 'mz')}),
zg AS (SELECT market, zone AS cz FROM za WHERE is_last),
result AS (SELECT zc.*, zf.* EXCLUDE (mz), zc.zone = zg.cz AS is_current, row_number() OVER (PARTITION BY zc.market ORDER BY center) AS place FROM zc JOIN zf ON zf.mz = zc.market || '|' || zc.zone JOIN zg ON zg.market = zc.market)"""

EVIDENCE = "market:s module:s direction:s n:l up:l down:l hit_rate wilson_low wilson_high median available:b"
CONFLUENCE = "market:s status:s direction:s confirmations:l n_available:l lower_limit least_sample:l least_move"


def evidence_rows(spark, sf_dir):
    """Three analog searches stand in for the three modules, so that SQL can follow: all nets, commercials alone, retail alone."""
    obs = observed(spark, sf_dir)
    searches = {"positioning": knn.pure_net(obs), "macro": knn.group_net(obs, "commercials"), "seasonality": knn.group_net(obs, "retail")}
    parts = [outcomes.levels(m, ["market"], R8).withColumns({"module": F.lit(k), "available": F.lit(True)}) for k, m in searches.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return confluence.evidence(rows)


def sql_evidence() -> str:
    parts = {"positioning": (NETS, [R8]), "macro": (["commercial_net"], ["commercial_net_oi", R8]), "seasonality": (["nonreportable_net"], ["nonreportable_net_oi", R8])}
    out = []
    for i, (module, (features, need)) in enumerate(parts.items()):
        out.append(sql_nearest(features, need, "rms", 30, 56, name=f"m{i}") + f", e{i} AS (SELECT m.*, o.{R8} FROM m{i} m JOIN obs o ON o.market = m.market AND o.date = m.date), l{i} AS (SELECT *, '{module}' AS module FROM ({sql_levels(f'e{i}', R8)}))")
    return ",".join(out) + f""", la AS (SELECT * EXCLUDE (hit_rate), n > 0 AS available FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)), {sql_judged()}"""


def sql_judged() -> str:
    """``evid``: module rows with rates and limits, from ``la``."""
    hits = "CASE direction WHEN 'bullish' THEN up WHEN 'bearish' THEN down ELSE 0 END"
    limit = lambda upper: f"CASE WHEN direction IN ('bullish', 'bearish') THEN {sql_wilson('hits', 'n', upper)} END"
    return f"""lb AS (SELECT *, {hits} AS hits FROM la),
evid AS (SELECT *, hits / nullif(n, 0) AS hit_rate, {limit(False)} AS wilson_low, {limit(True)} AS wilson_high FROM lb)"""


SQL_COMBINE = """ca AS (SELECT market, count(*) FILTER (available AND direction = 'bullish') AS ups, count(*) FILTER (available AND direction = 'bearish') AS downs, count(*) FILTER (available) AS n_available FROM evid GROUP BY 1),
cb AS (SELECT *, greatest(ups, downs) AS confirmations, CASE WHEN ups = 0 AND downs = 0 THEN 'none' WHEN ups > 0 AND downs > 0 AND ups = 1 AND downs = 1 THEN 'conflict' WHEN ups >= downs THEN 'bullish' ELSE 'bearish' END AS direction,
  CASE WHEN ups = 0 AND downs = 0 THEN 'insufficient' WHEN ups > 0 AND downs > 0 THEN 'conflicting' WHEN ups = 3 OR downs = 3 THEN 'confirmed' WHEN ups = 2 OR downs = 2 THEN 'partly_confirmed' ELSE 'insufficient' END AS status FROM ca),
result AS (SELECT cb.*, (SELECT min(wilson_low) FROM evid e WHERE e.market = cb.market AND e.available AND e.direction = cb.direction) AS lower_limit,
  coalesce((SELECT min(n) FROM evid e WHERE e.market = cb.market AND e.available AND e.direction = cb.direction), 0) AS least_sample, (SELECT min(abs(median)) FROM evid e WHERE e.market = cb.market AND e.available AND e.direction = cb.direction) AS least_move FROM cb)"""


def markets(spark, sf_dir):
    return proxies.table(spark, sf_dir, "region").select(F.col("r_name").alias("market"), F.lit("region").alias("category"))


def scanned(spark, sf_dir, with_clusters=True):
    """The scan on the day of the newest price."""
    prices = priced(spark, sf_dir)
    return scan.scan(proxies.positions(spark, sf_dir), prices, markets(spark, sf_dir), F.lit(prices.agg(F.max("date")).first()[0]), with_clusters=with_clusters)


TOP_FLOW = "market:s flow_weeks:l flow_score flow_dominance flow_dominant_flow:s"


def top_flows_query(spark, sf_dir):
    """Flow ranking alone, with limits that let weak signals count."""
    best = flows.strongest(flows.horizons(observed(spark, sf_dir), flows.FLOW_HORIZONS, 0.0, -1.0, 0.5)).withColumn("error", F.lit(""))
    return shaped(scan.top_flows(best), TOP_FLOW)


SQL_TOP_FLOW = "ta AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, weeks) AS k FROM fl), tb AS (SELECT market, weeks AS flow_weeks, score AS flow_score, dominance AS flow_dominance, dominant_flow AS flow_dominant_flow FROM ta WHERE k = 1 AND score > 0), result AS (SELECT * FROM tb ORDER BY flow_score DESC, flow_dominance DESC, flow_weeks DESC, market LIMIT 5)"
TOP_NET = "market:s net8_n:l net8_direction:s net8_hit_rate net8_median edge"


def top_net_query(spark, sf_dir):
    rows = outcomes.levels(knn.pure_net(observed(spark, sf_dir)), ["market"], R8)
    named = rows.select("market", *(F.col(c).alias(f"net8_{c}") for c in ("n", "direction", "hit_rate", "median")))
    return shaped(scan.top_pure_net(named, 8, 0.5, 10, 0.0, 3), TOP_NET)


TOP_EXTREME = "market:s extreme_strength extreme_confirmed:b"


def top_extremes_query(spark, sf_dir):
    rows = flows.extremes(observed(spark, sf_dir)).select("market", F.col("strength").alias("extreme_strength"), F.col("confirmed").alias("extreme_confirmed"), F.lit("").alias("error"), F.lit(True).alias("extreme_available"))
    return shaped(scan.top_extremes(rows, 3), TOP_EXTREME)


#: So few analogs that more markets have a direction.
FEW = 15
TOP_MARKET = "market:s bias:s hit_rate share_confirmed:b cases:l"


def top_markets_query(spark, sf_dir):
    prices = priced(spark, sf_dir)
    valid = observed(spark, sf_dir, prices=prices).na.drop(subset=NETS + SHARES)
    return shaped(scan.top_markets(scan.analog_columns(valid, prices, FEW)), TOP_MARKET)


def sql_top_markets() -> str:
    main, near = scan_sql.sql_base(FEW)
    valid = f"valid AS (SELECT * FROM obs WHERE {' AND '.join(f'{c} IS NOT NULL' for c in NETS + SHARES)})"
    return f"{valid}, {main}, {near}, {scan_sql.SQL_BASE}, result AS (SELECT * FROM base WHERE bias IN ('bullish', 'bearish') AND cases >= 15 ORDER BY hit_rate DESC, share_confirmed DESC, cases DESC, market LIMIT 5)"


#: A percentile that lets so many markets turn that their order shows.
LOOSE = 20.0
TOP_TURN = "market:s transition_phase:l transition_score confirmations:l"


def top_transitions_query(spark, sf_dir):
    rows = flows.transition(observed(spark, sf_dir), 4, LOOSE)
    named = rows.select("market", F.lit("").alias("error"), *(F.col(c).alias(f"transition_{c}") for c in ("phase", "score", "convergence", "sustained", "price_confirmed")))
    return shaped(scan.top_transitions(named), TOP_TURN)


SQL_TOP_TURN = "result AS (SELECT market, phase AS transition_phase, score AS transition_score, CAST(convergence AS INT) + CAST(sustained AS INT) + CAST(price_confirmed AS INT) AS confirmations FROM ti WHERE phase >= 1 ORDER BY phase DESC, score DESC, confirmations DESC, market LIMIT 5)"
TOP_EDGE = "market:s {0}_cases:l {0}_share {0}_median edge"


def top_index_query(spark, sf_dir):
    rows = index_pattern.analyze(observed(spark, sf_dir), cutoff=signals.WIDE)
    named = rows.select("market", F.col("available").alias("index_available"), F.col("n").alias("index_cases"), (F.greatest("up", "down") / F.col("n")).alias("index_share"), F.col("median").alias("index_median"))
    return shaped(scan.top_by_edge(named, "index", 0.5, 1, 0.0, 3), TOP_EDGE.format("index"))


def sql_top_edge(prefix: str, source: str, where: str) -> str:
    return f"te AS (SELECT market, n AS {prefix}_cases, greatest(up, down) / n AS {prefix}_share, median AS {prefix}_median FROM {source} WHERE {where}), result AS (SELECT *, abs({prefix}_median) * {prefix}_share * ln(1 + {prefix}_cases) AS edge FROM te WHERE {prefix}_share >= 0.5 AND {prefix}_cases >= 1 ORDER BY edge DESC, {prefix}_cases DESC, market LIMIT 3)"


FIXED = 4


def fixed_clusters(spark, sf_dir):
    """The outcome of the current cluster, for clusters of equal size by the commercials' net position."""
    clean = knn.complete(observed(spark, sf_dir), ["commercial_net", R8]).withColumn("cluster", F.ntile(FIXED).over(Window.partitionBy("market").orderBy("commercial_net", "date")))
    now = F.max(F.when(F.col("is_last"), F.col("cluster"))).over(Window.partitionBy("market"))
    clean = materialized(clean.withColumns({"same": F.col("cluster") == now, "k": F.lit(FIXED)}).where(~F.col("is_last")))
    fit = clean.join(clusters.silhouettes(clean, ["commercial_net"]), "market")
    return clusters.analyze(fit.select("market", "date", R8, "cluster", "same", "k", "silhouette"))[0]


SQL_CLUSTERS = f"""qa AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last, ntile({FIXED}) OVER (PARTITION BY market ORDER BY commercial_net, date) AS cluster FROM obs WHERE commercial_net IS NOT NULL AND {R8} IS NOT NULL),
qb AS (SELECT *, max(cluster) FILTER (is_last) OVER (PARTITION BY market) AS current FROM qa),
qc AS (SELECT market, date, {R8} AS ret FROM qb WHERE cluster = current AND NOT is_last),
ql AS (SELECT market, {FIXED} AS k, date, [CAST(commercial_net AS DOUBLE)] AS f, cluster AS label FROM qb WHERE NOT is_last),
{cluster_sql.silhouettes('ql', 'qs')},
{cluster_sql.outcome()}"""


def top_clusters_query(spark, sf_dir):
    rows = fixed_clusters(spark, sf_dir)
    named = rows.select("market", F.col("available").alias("cluster_available"), F.col("n").alias("cluster_cases"), (F.greatest("up", "down") / F.col("n")).alias("cluster_share"), F.col("median").alias("cluster_median"))
    return shaped(scan.top_by_edge(named, "cluster", 0.5, 1, 0.0, 3), TOP_EDGE.format("cluster"))


RANKED = "market:s place:l status:s confirmations:l lower_limit"


def ranked_query(spark, sf_dir):
    """The order of the overview, as each market's place."""
    rows = confluence.combine(evidence_rows(spark, sf_dir))
    return shaped(rows.withColumn("place", F.row_number().over(Window.orderBy(*confluence.ranking()))), RANKED)  # one row a market


SQL_RANKED = "result AS (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'partly_confirmed' THEN 1 WHEN 'conflicting' THEN 2 WHEN 'insufficient' THEN 3 ELSE 99 END, confirmations DESC, coalesce(lower_limit, -1) DESC, coalesce(least_sample, 0) DESC, coalesce(least_move, -1) DESC, market) AS place FROM combined)"
SCAN = (
    "market:s category:s error:s usable:b cases bias:s hit_rate share_confirmed:b flow_available:b flow_signal:s flow_strength:s flow_weeks flow_score flow_dominance extreme_available:b extreme_signal:s extreme_strength transition_phase transition_score "
    "index_available:b index_reason:s index_cases index_bias:s cluster_available:b cluster_bias:s cluster_cases cluster_median cluster_quality cluster_silhouette cluster_window_start cluster_window_end "
    + " ".join(f"net{h}_n net{h}_direction:s net{h}_hit_rate net{h}_median net{h}_range_low net{h}_range_high net{h}_window_start net{h}_window_end" for h in (4, 8, 12))
)
OVERVIEW = "market:s category:s status:s direction:s confirmations:l n_available:l lower_limit least_sample:l least_move positioning_direction:s macro_direction:s seasonality_direction:s"


#: The scan without clusters.
SCAN_CORE = " ".join(w for w in SCAN.split() if not w.startswith("cluster_"))
SQL_SIDES = ", ".join(f"(SELECT direction FROM evid e WHERE e.market = cb.market AND e.module = '{m}') AS {m}_direction" for m in confluence.MODULES)


def overview_query(spark, sf_dir):
    from tidemark.operators import macro, seasonality

    prices = priced(spark, sf_dir)
    fundamental = macro.regime(proxies.macro(spark, sf_dir), regimes.specs(spark), regimes.weights(spark, True), prices)
    _, _, ahead = seasonality.calibrate(prices, 15)
    return shaped(scan.overview(materialized(scanned(spark, sf_dir, False)), fundamental, materialized(ahead)), OVERVIEW)


VIEW = "market:s period:s price:s longs:s shorts:s flow:s dominance:s reading:s"


def sql_labels(code: str, labels: dict[str, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {code} END"


def sql_signed(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '+' END || format('{{:,}}', CAST(abs({x}) AS BIGINT))"


SQL_VIEW = f"""result AS (SELECT market, weeks || ' Woche(n)' AS period, printf('%+.1f%%', price_change * 100) AS price, {sql_signed('long_change')} AS longs, {sql_signed('short_change')} AS shorts,
  {sql_labels('dominant_flow', display.FLOWS)} AS flow, printf('%.1f%%', dominance * 100) AS dominance, {sql_labels('state', display.STATES)} AS reading FROM fl)"""
SHOWN_ZONES = ["market", "current", "zone", "center", "visits", "up", "down", "direction", "hit_rate", "move"]
SHOWN_CONFLUENCE = ["market", "category", "status", "direction", "confirmed", "positioning", "macro", "seasonality", "lower_limit", "least_sample"]
strings = lambda names: " ".join(f"{n}:s" for n in names)


def zone_view_query(spark, sf_dir):
    clean = knn.complete(observed(spark, sf_dir), ["commercial_net", R8])
    rows = clean.select("market", "date", "is_last", F.col("commercial_net").alias("net"), F.col(R8).alias("ret"), F.ntile(8).over(Window.partitionBy("market").orderBy("commercial_net", "date")).alias("zone"))
    return shaped(display.zone_view(clusters.zone_table(rows)).toDF(*SHOWN_ZONES), strings(SHOWN_ZONES))


def sql_percent(x: str, sign: str = "") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{display.MISSING}' ELSE printf('%{sign}.1f%%', {x} * 100) END"


SQL_ZONE_VIEW = SQL_ZONES.replace("result AS", "zones AS") + f""", result AS (SELECT market, CASE WHEN is_current THEN '●' ELSE '' END AS current, {sql_signed('round_even(lower, 0)')} || ' bis ' || {sql_signed('round_even(upper, 0)')} AS zone, {sql_signed('round(center)')} AS center, n AS visits, up, down, direction, {sql_percent('hit_rate')} AS hit_rate,
  CASE WHEN range_low IS NULL OR range_high IS NULL THEN '{display.MISSING}' ELSE {sql_percent('range_low', '+')} || ' bis ' || {sql_percent('range_high', '+')} END AS move FROM zones)"""


def confluence_view_query(spark, sf_dir):
    rows = evidence_rows(spark, sf_dir)
    whole = confluence.combine(rows).join(confluence.side_by_side(rows), "market").withColumn("category", F.lit("region"))
    return shaped(display.confluence_view(confluence.ranked(whole)).toDF(*SHOWN_CONFLUENCE), strings(SHOWN_CONFLUENCE))


def sql_confluence_view() -> str:
    cell = f"""SELECT market, module, CASE WHEN direction IN ('bullish', 'bearish') AND n > 0 THEN {sql_labels('direction', display.DIRECTIONS)} || ' · ' || {sql_percent('hit_rate')} || ' · n=' || n || ' · KI≥' || {sql_percent('wilson_low')} || ' · Median ' || {sql_percent('median', '+')} ELSE {sql_labels('direction', display.DIRECTIONS)} END AS cell FROM evid"""
    cells = ", ".join(f"(SELECT cell FROM cells WHERE cells.market = c.market AND module = '{m}') AS {m}" for m in confluence.MODULES)
    return sql_evidence() + "," + SQL_COMBINE.replace("result AS", "combined AS") + f""", cells AS ({cell}),
result AS (SELECT market, 'region' AS category, {sql_labels('status', display.STATUS)} AS status, {sql_labels('direction', display.DIRECTIONS)} AS direction, confirmations || '/3' AS confirmed, {cells}, {sql_percent('lower_limit')} AS lower_limit, least_sample FROM combined c)"""


PERIODS = "market:s positions_first:t positions_last:t prices_first:t prices_last:t macro_first:t macro_last:t common_years"


def periods_query(spark, sf_dir):
    """What the overview says of its modules' periods."""
    tables = {"positions": proxies.positions(spark, sf_dir), "prices": proxies.prices(spark, sf_dir), "macro": proxies.macro(spark, sf_dir)}
    return shaped(confluence.periods(markets(spark, sf_dir), tables), PERIODS)


SQL_PERIODS = """pm AS (SELECT r_name AS market FROM region), spans AS (
  SELECT pm.market, (SELECT min(date) FROM positions p WHERE p.market = pm.market) AS positions_first, (SELECT max(date) FROM positions p WHERE p.market = pm.market) AS positions_last,
    (SELECT min(date) FROM prices p WHERE p.market = pm.market) AS prices_first, (SELECT max(date) FROM prices p WHERE p.market = pm.market) AS prices_last, (SELECT min(date) FROM macro) AS macro_first, (SELECT max(date) FROM macro) AS macro_last FROM pm),
result AS (SELECT *, CASE WHEN least(positions_last, prices_last, macro_last) > greatest(positions_first, prices_first, macro_first) THEN date_diff('day', greatest(positions_first, prices_first, macro_first), least(positions_last, prices_last, macro_last)) / 365.25 END AS common_years FROM spans)"""
PARTS = "confirmed:l conflicting:l insufficient:l"


def entries() -> dict[str, tuple]:
    return {
        "reference_zones_fixed": (fixed_zones, sql(SQL_ZONES, ZONES)),
        "evidence": (lambda spark, sf_dir: shaped(evidence_rows(spark, sf_dir), EVIDENCE), sql(sql_evidence() + ", result AS (SELECT * FROM evid)", EVIDENCE)),
        "confluence": (lambda spark, sf_dir: shaped(confluence.combine(evidence_rows(spark, sf_dir)), CONFLUENCE), sql(sql_evidence() + "," + SQL_COMBINE, CONFLUENCE)),
        "top_flows": (top_flows_query, sql(signals.sql_flows(0.0, -1.0, 0.5) + "," + SQL_TOP_FLOW, TOP_FLOW)),
        "top_pure_net": (
            top_net_query,
            sql(
                sql_nearest(NETS, [R8], "rms", 30, 56) + f", e AS (SELECT m.*, o.{R8} FROM m JOIN obs o ON o.market = m.market AND o.date = m.date), lv AS ({sql_levels('e', R8)}), "
                "lw AS (SELECT market, n AS net8_n, direction AS net8_direction, hit_rate AS net8_hit_rate, median AS net8_median, abs(median) * hit_rate * ln(1 + n) AS edge FROM lv WHERE direction <> 'neutral' AND hit_rate >= 0.5 AND n >= 10), result AS (SELECT * FROM lw ORDER BY edge DESC, net8_n DESC, market LIMIT 3)",
                TOP_NET,
            ),
        ),
        "top_extremes": (top_extremes_query, sql(signals.sql_extremes(90) + ", result AS (SELECT market, strength AS extreme_strength, confirmed AS extreme_confirmed FROM xx ORDER BY strength DESC, confirmed DESC, market LIMIT 3)", TOP_EXTREME)),
        "flow_matrix_view": (lambda spark, sf_dir: shaped(display.flow_view(flows.horizons(observed(spark, sf_dir))), VIEW), sql(signals.sql_flows(0.02, 1.0, 0.7) + "," + SQL_VIEW, VIEW)),
        "overview_parts": (
            lambda spark, sf_dir: shaped(display.overview_parts(confluence.combine(evidence_rows(spark, sf_dir))), PARTS),
            sql(sql_evidence() + "," + SQL_COMBINE.replace("result AS", "combined AS") + ", result AS (SELECT count(*) FILTER (status IN ('confirmed', 'partly_confirmed')) AS confirmed, count(*) FILTER (status = 'conflicting') AS conflicting, count(*) FILTER (status = 'insufficient') AS insufficient FROM combined)", PARTS),
        ),
        "common_periods": (periods_query, sql(SQL_PERIODS, PERIODS, "tables")),
        "top_markets": (top_markets_query, sql(sql_top_markets(), TOP_MARKET)),
        "top_transitions": (top_transitions_query, sql(signals.sql_transition(LOOSE) + "," + SQL_TOP_TURN, TOP_TURN)),
        "top_index": (top_index_query, sql(signals.sql_index_pattern(signals.WIDE).replace("result AS", "indexed AS") + "," + sql_top_edge("index", "indexed", "reason = ''"), TOP_EDGE.format("index"))),
        "market_clusters_fixed": (lambda spark, sf_dir: shaped(fixed_clusters(spark, sf_dir), CLUSTER), sql(SQL_CLUSTERS + ", result AS (SELECT * FROM clus)", CLUSTER)),
        "top_clusters": (top_clusters_query, sql(SQL_CLUSTERS + "," + sql_top_edge("cluster", "clus", "available"), TOP_EDGE.format("cluster"))),
        "confluence_ranked": (ranked_query, sql(sql_evidence() + "," + SQL_COMBINE.replace("result AS", "combined AS") + "," + SQL_RANKED, RANKED)),
        "zone_table_view": (zone_view_query, sql(SQL_ZONE_VIEW, strings(SHOWN_ZONES))),
        "confluence_view": (confluence_view_query, sql(sql_confluence_view(), strings(SHOWN_CONFLUENCE))),
        "market_scan_core": (lambda spark, sf_dir: shaped(scanned(spark, sf_dir, False), SCAN_CORE), sql(scan_sql.sql_scan() + ", result AS (SELECT * FROM scan)", SCAN_CORE, "none")),
        "market_clusters": (cluster_query, sql(cluster_sql.fitted() + "," + cluster_sql.outcome() + ", result AS (SELECT * FROM clus)", CLUSTER)),
        "reference_zones": (zones_query, sql(cluster_sql.zoned("commercial_net") + "," + SQL_ZONES[SQL_ZONES.index("zb AS") :], ZONES)),
        "market_scan": (lambda spark, sf_dir: shaped(scanned(spark, sf_dir), SCAN), sql(scan_sql.sql_scan(True) + ", result AS (SELECT * FROM scan)", SCAN, "none")),
        "market_overview": (
            overview_query,
            sql(scan_sql.sql_overview() + "," + sql_judged() + "," + SQL_COMBINE.replace("SELECT cb.*,", f"SELECT cb.*, 'region' AS category, {SQL_SIDES},"), OVERVIEW, "none"),
        ),
    }
