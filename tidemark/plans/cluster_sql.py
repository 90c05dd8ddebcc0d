"""Clusters in SQL: Lloyd's iteration from given starts as a recursive query, silhouettes by a self-join, and what follows from them."""

from __future__ import annotations

from tidemark.operators import clusters
from tidemark.plans.shape import sql_counted, sql_greedy, sql_wilson


def k_means(rows: str, runs: str, name: str, width: int) -> str:
    """``<name>_c(market, k, centers)`` and ``<name>_l(market, k, date, f, label)``, labels from 1.

    ``rows`` has ``market, date`` and ``f``, a list of ``width`` numbers; ``runs`` has ``market, k``. A working row is a run (market, k, restart) with
    its centres: rows go to the nearest, centres to the rounded mean of theirs, until they stay.
    """
    means = ", ".join(f"round(avg(f[{i}]), {clusters.PLACES})" for i in range(1, width + 1))
    return f"""{name}_o AS (SELECT x.*, r, row_number() OVER (PARTITION BY market, r ORDER BY md5(strftime(date, '%Y-%m-%d') || '|' || r)) AS place FROM {rows} x, range({clusters.RESTARTS}) t(r)),
{name}_i(market, k, r, it, centers, moving) AS (
  SELECT u.market, u.k, r, 0, list(f ORDER BY place), true FROM {runs} u JOIN {name}_o o ON o.market = u.market AND place <= u.k GROUP BY 1, 2, 3
  UNION ALL
  SELECT market, k, r, it + 1, fresh, fresh <> centers AND it < {clusters.ROUNDS} FROM (
    SELECT market, k, r, it, any_value(centers) AS centers, list_transform(range(1, k + 1), lambda c: coalesce(map_from_entries(list((label, f)))[c], any_value(centers)[c])) AS fresh FROM (
      SELECT market, k, r, it, label, any_value(centers) AS centers, [{means}] AS f FROM (
        SELECT market, k, r, it, centers, f, list_position(away, list_min(away)) AS label FROM (
          SELECT i.*, x.f, list_transform(i.centers, lambda c: list_distance(c, x.f)) AS away FROM {name}_i i JOIN {rows} x ON x.market = i.market WHERE i.moving
        )) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)
),
{name}_f AS (SELECT market, k, r, arg_max(centers, it) AS centers FROM {name}_i GROUP BY 1, 2, 3),
{name}_a AS (SELECT i.market, i.k, i.r, x.date, x.f, list_transform(i.centers, lambda c: list_distance(c, x.f)) AS away FROM {name}_f i JOIN {rows} x ON x.market = i.market),
{name}_b AS (SELECT market, k, arg_min(r, (cost, r)) AS r FROM (SELECT market, k, r, round(sum(pow(list_min(away), 2)), 6) AS cost FROM {name}_a GROUP BY 1, 2, 3) GROUP BY 1, 2),
{name}_c AS (SELECT f.market, f.k, f.centers FROM {name}_f f JOIN {name}_b b USING (market, k, r)),
{name}_l AS (SELECT a.market, a.k, a.date, a.f, list_position(away, list_min(away)) AS label FROM {name}_a a JOIN {name}_b b USING (market, k, r))"""


def silhouettes(labels: str, name: str) -> str:
    """``<name>(market, k, silhouette)`` of the clusters in ``labels`` (market, k, date, f, label), where there are two or more."""
    return f"""{name}_p AS (SELECT a.market, a.k, a.date, a.label, b.label AS other, sum(list_distance(a.f, b.f)) AS total, count(*) AS n FROM {labels} a JOIN {labels} b ON b.market = a.market AND b.k = a.k GROUP BY 1, 2, 3, 4, 5),
{name}_q AS (SELECT market, k, date, max(n) FILTER (other = label) AS own, max(total / greatest(n - 1, 1)) FILTER (other = label) AS inside, min(total / n) FILTER (other <> label) AS outside FROM {name}_p GROUP BY 1, 2, 3),
{name} AS (SELECT market, k, round(avg(CASE WHEN own > 1 THEN (outside - inside) / greatest(inside, outside, 1e-300) ELSE 0 END), {clusters.FIGURES}) AS silhouette FROM {name}_q GROUP BY 1, 2 HAVING count(outside) > 0)"""


def outcome(weeks: int = 8) -> str:
    """``clus``: the outcome of the current cluster from ``qc`` (market, date, ret: its earlier rows) and ``qs`` (market, k, silhouette)."""
    return f"""{sql_greedy('qc', 'date DESC', 7 * weeks, None, 'qe', 'market', 'ret')},
qf AS ({sql_counted('qe', 'ret')}),
qg AS (SELECT *, CASE WHEN up / n >= 0.6 THEN 'bullish' WHEN down / n >= 0.6 THEN 'bearish' ELSE 'neutral' END AS direction, CASE WHEN up / n >= 0.6 THEN up WHEN down / n >= 0.6 THEN down ELSE greatest(up, down) END AS hits FROM qf),
qh AS (SELECT *, hits / n AS hit_rate, {sql_wilson('hits', 'n', False)} AS wilson_low, {sql_wilson('hits', 'n', True)} AS wilson_high FROM qg JOIN qs USING (market)),
clus AS (SELECT *, all_25 AS q25, all_75 AS q75, n >= 12 AS available, CASE WHEN up > down THEN up_25 WHEN down > up THEN down_25 END AS range_low, CASE WHEN up > down THEN up_75 WHEN down > up THEN down_75 END AS range_high,
  CASE direction WHEN 'neutral' THEN 0.0 ELSE 100 * (0.65 * wilson_low + 0.20 * least(1.0, ln(1 + n) / ln(51)) + 0.15 * least(1.0, greatest(0.0, (silhouette + 0.1) / 0.6))) END AS quality FROM qh)"""


def fitted(source: str = "obs", weeks: int = 8) -> str:
    """``qc`` and ``qs`` by k-means over scaled features, with the number of clusters of the best silhouette."""
    ret = f"return_{weeks}w"
    need = " AND ".join(f"{c} IS NOT NULL" for c in [*clusters.FEATURES, ret])
    scaled = ", ".join(f"({c} - avg({c}) FILTER (NOT is_last) OVER m) / coalesce(nullif(stddev_pop({c}) FILTER (NOT is_last) OVER m, 0), 1)" for c in clusters.FEATURES)
    return f"""ka AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last, count(*) OVER (PARTITION BY market) AS n_rows FROM {source} WHERE {need}),
kb AS (SELECT market, date, is_last, {ret} AS ret, [{scaled}] AS f FROM ka WHERE n_rows >= 80 WINDOW m AS (PARTITION BY market)),
kh AS (SELECT market, date, ret, f FROM kb WHERE NOT is_last),
kr AS (SELECT market, unnest(range(3, least(8, greatest(3, n // 20)) + 1)) AS k FROM (SELECT market, count(*) AS n FROM kh GROUP BY 1)),
{k_means('kh', 'kr', 'km', len(clusters.FEATURES))},
{silhouettes('km_l', 'ks')},
qs AS (SELECT market, arg_min(k, (-silhouette, k)) AS k, max(silhouette) AS silhouette FROM ks GROUP BY 1),
kn AS (SELECT n.market, c.k, list_transform(c.centers, lambda c: list_distance(c, n.f)) AS away FROM kb n JOIN qs s ON s.market = n.market JOIN km_c c ON c.market = s.market AND c.k = s.k WHERE n.is_last),
qc AS (SELECT h.market, h.date, h.ret FROM kh h JOIN kn ON kn.market = h.market JOIN km_l l ON l.market = h.market AND l.k = kn.k AND l.date = h.date WHERE l.label = list_position(away, list_min(away)))"""


def zoned(net: str, weeks: int = 8, n_zones: int = 8) -> str:
    """``za`` (market, date, net, ret, is_last, zone) by one-dimensional k-means over the earlier rows."""
    ret = f"return_{weeks}w"
    return f"""zo AS (SELECT market, date, {net} AS net, {ret} AS ret, date = max(date) OVER (PARTITION BY market) AS is_last, count(*) OVER (PARTITION BY market) AS n_rows FROM obs WHERE {net} IS NOT NULL AND {ret} IS NOT NULL),
zp AS (SELECT market, date, [CAST(net AS DOUBLE)] AS f FROM zo WHERE NOT is_last AND n_rows >= {max(30, 4 * n_zones)}),
zr AS (SELECT market, least({n_zones}, greatest(3, count(*) // 20)) AS k FROM zp GROUP BY 1),
{k_means('zp', 'zr', 'zm', 1)},
zs AS (SELECT market, list_sort(centers) AS centers FROM zm_c),
zt AS (SELECT o.*, list_transform(s.centers, lambda c: list_distance(c, [CAST(o.net AS DOUBLE)])) AS away FROM zo o JOIN zs s ON s.market = o.market),
za AS (SELECT market, date, net, ret, is_last, list_position(away, list_min(away)) - 1 AS zone FROM zt)"""
