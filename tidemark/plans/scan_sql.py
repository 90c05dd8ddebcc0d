"""The market scan and the overview in SQL: the pieces of the single analyzers, each over the scan's valid rows, joined by market."""

from __future__ import annotations

from tidemark.operators import observations, scan
from tidemark.plans import cluster_sql, regimes, signals
from tidemark.plans.positioning import NETS, SHARES, sql_fresh
from tidemark.plans.shape import sql_greedy, sql_levels, sql_nearest
from tidemark.sources import proxies

LEAST_ROWS = 60
#: The day of the scan: that of the newest price.
TODAY = "(SELECT max(date) FROM prices)"


def part(name: str, body: str, shown: str) -> str:
    """A common table expression that computes ``body`` over the valid rows; its own names stay inside."""
    return f"{name} AS (WITH RECURSIVE obs AS (SELECT * FROM valid), {body} SELECT {shown})"


def moves(days: int) -> str:
    return signals.SQL_MOVES.replace("ev.p0 + 40", f"ev.p0 + {days}").replace("day = 40", f"day = {days}").replace("n = 41", f"n = {days + 1}")


def windowed(days: int, biases: str) -> str:
    """Onset windows of the matches ``m``, for the markets and biases of a query."""
    text = signals.SQL_CLUSTER_TIMING
    start = text.index("ca AS")
    return f"rd AS (SELECT b.market, r.report_date, CASE b.bias WHEN 'bullish' THEN 1.0 ELSE -1.0 END AS sgn FROM ({biases}) b JOIN (SELECT market, max(date) AS report_date FROM obs GROUP BY 1) r USING (market) WHERE b.bias IN ('bullish', 'bearish')),\n" + text[start:].replace("day = 40", f"day = {days}")


def net_part(weeks: int) -> str:
    ret = f"return_{weeks}w"
    body = ",\n".join([sql_nearest(NETS, [ret], "rms", 30, 56), f"e0 AS (SELECT m.*, o.{ret} FROM m JOIN obs o ON o.market = m.market AND o.date = m.date), lv AS ({sql_levels('e0', ret)})", moves(5 * weeks), windowed(5 * weeks, "SELECT market, direction AS bias FROM lv")])
    figures = ", ".join(f"lv.{c} AS net{weeks}_{c}" for c in ("n", "up", "down", "direction", "hit_rate", "median", "range_low", "range_high"))
    return part(f"p_net{weeks}", body, f"lv.market, {figures}, window_start AS net{weeks}_window_start, window_end AS net{weeks}_window_end FROM lv LEFT JOIN result USING (market)")


def sql_base(n: int = 30) -> tuple[str, str]:
    """Outcome of the analogs by nets, and of those that are near by shares."""
    near = sql_nearest(NETS, [], "rms", n, 56)
    body = ",\n".join([near, moves(40), signals.SQL_TIMING])
    shares = ",\n".join([sql_nearest(NETS, [], "rms", n, 56, name="m0"), sql_nearest(SHARES, [], "rms", 1, 0, name="v"), "m AS (SELECT m0.* FROM m0 JOIN v_d ON m0.market = v_d.market AND m0.date = v_d.date WHERE v_d.distance <= 1)", moves(40), signals.SQL_TIMING])
    return part("p_main", body, "market, n AS cases, up, down, bias FROM result"), part("p_near", shares, "market, n AS share_n, bias AS share_bias FROM result")


SQL_BASE = """base AS (SELECT market, cases, bias, CASE bias WHEN 'bullish' THEN up ELSE down END / cases AS hit_rate, coalesce(share_n >= 8 AND share_bias = bias AND bias <> 'neutral', false) AS share_confirmed FROM p_main LEFT JOIN p_near USING (market))"""


def cluster_part() -> str:
    """The current cluster's outcome and the timing of its events."""
    biases = "SELECT market, CASE WHEN median > 0 THEN 'bullish' WHEN median < 0 THEN 'bearish' ELSE direction END AS bias FROM clus WHERE available"
    body = ",\n".join([cluster_sql.fitted(), cluster_sql.outcome(), "m AS (SELECT market, date FROM qe)", moves(40), windowed(40, biases)])
    figures = ", ".join(f"clus.{c} AS cluster_{name}" for name, c in scan.CLUSTER_FIGURES.items())
    return part("p_clus", body, f"clus.market, {figures}, window_start AS cluster_window_start, window_end AS cluster_window_end FROM clus LEFT JOIN result USING (market) WHERE available")


def sql_scan(with_clusters: bool = False) -> str:
    """Everything up to ``scan``."""
    fresh = ",\n".join(sql_fresh(t, t, days).replace("DATE '2001-11-10'", TODAY) for t, days in (("positions", 14), ("prices", 7)))
    need = " AND ".join(f"{c} IS NOT NULL" for c in NETS + SHARES)
    main, near = sql_base()
    parts = [
        proxies.SQL, observations.SQL, fresh,
        "quality AS (SELECT *, positions_status = 'current' AND prices_status = 'current' AS usable FROM positions_q JOIN prices_q USING (market))",
        f"valid AS (SELECT * EXCLUDE (n_valid) FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n_valid FROM obs WHERE {need}) WHERE n_valid >= {LEAST_ROWS} AND market IN (SELECT market FROM quality WHERE usable))",
        main, near, SQL_BASE,
        part("p_flow", signals.sql_flows(0.02, 1.0, 0.7) + "," + signals.SQL_SPLIT + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, weeks) AS k FROM fl) WHERE k = 1)", "split.market, split.signal AS flow_signal, split.strength AS flow_strength, best.weeks AS flow_weeks, best.score AS flow_score, best.dominance AS flow_dominance FROM split JOIN best USING (market)"),
        part("p_zone", signals.sql_extremes(90), "market, signal AS extreme_signal, strength AS extreme_strength FROM xx"),
        part("p_turn", signals.sql_transition(90), "market, phase AS transition_phase, score AS transition_score FROM ti"),
        part("p_index", signals.sql_index_pattern(80), "market, reason = '' AS index_available, reason AS index_reason, n AS index_cases, CASE WHEN reason = '' THEN coalesce(direction, 'neutral') ELSE 'neutral' END AS index_bias FROM result"),
        *(net_part(h) for h in (4, 8, 12)),
        *([cluster_part()] if with_clusters else []),
        f"""scan AS (SELECT r_name AS market, 'region' AS category, CASE WHEN NOT usable THEN 'positions ' || positions_status || '; prices ' || prices_status WHEN rows.market IS NULL THEN 'too_few_rows' ELSE '' END AS error, usable,
  base.* EXCLUDE (market, bias), coalesce(base.bias, 'n.a.') AS bias, p_flow.market IS NOT NULL AS flow_available, p_flow.* EXCLUDE (market), p_zone.market IS NOT NULL AS extreme_available, p_zone.* EXCLUDE (market), p_turn.* EXCLUDE (market),
  coalesce(index_available, false) AS index_available, index_reason, index_cases, index_bias, {', '.join(f'p_net{h}.* EXCLUDE (market)' for h in (4, 8, 12))}{', p_clus.market IS NOT NULL AS cluster_available, p_clus.* EXCLUDE (market)' if with_clusters else ''}
  FROM region LEFT JOIN quality ON quality.market = r_name LEFT JOIN (SELECT DISTINCT market FROM valid) rows ON rows.market = r_name LEFT JOIN base ON base.market = r_name
  {' '.join(f'LEFT JOIN {p} ON {p}.market = r_name' for p in ('p_flow', 'p_zone', 'p_turn', 'p_index', 'p_net4', 'p_net8', 'p_net12', *(['p_clus'] if with_clusters else [])))})""",
    ]
    return ",\n".join(parts)


def sql_overview() -> str:
    """The overview: positioning from the scan, the macro regime, and the season's forecast of all prices, combined and ranked."""
    macro = f"p_macro AS (WITH RECURSIVE {regimes.sql_analogs()}, {regimes.SQL_REGIME}, mm AS (SELECT result.*, od.up, od.down FROM result LEFT JOIN od USING (market)) SELECT market, n, up, down, median FROM mm)"
    season = f"p_season AS (WITH RECURSIVE {regimes.SQL_AHEAD} SELECT market, n, up, down, direction, median FROM ahead WHERE weeks = 8)"
    sides = "CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END"
    return sql_scan() + f""",
{macro},
{season},
mods AS (SELECT market, 'positioning' AS module, net8_direction AS direction, net8_n AS n, net8_up AS up, net8_down AS down, net8_median AS median, net8_n > 0 AS available FROM scan
  UNION ALL SELECT market, 'macro', {sides}, n, up, down, median, n > 0 FROM p_macro UNION ALL SELECT market, 'seasonality', direction, n, up, down, median, true FROM p_season),
la AS (SELECT g.market, g.module, coalesce(direction, 'n.a.') AS direction, coalesce(n, 0) AS n, coalesce(up, 0) AS up, coalesce(down, 0) AS down, median, coalesce(available, false) AND coalesce(n, 0) > 0 AS available
  FROM (SELECT market, unnest(['positioning', 'macro', 'seasonality']) AS module FROM scan) g LEFT JOIN mods USING (market, module))"""
