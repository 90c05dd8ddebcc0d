"""Result columns with fixed types on both sides of a comparison, and pieces of SQL that several checks share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import observations
from tidemark.sources import proxies

DIGITS = 6


def parts(spec: str) -> list[tuple[str, str]]:
    """``name:kind`` words; d double (rounded), l long, s string, t date, b boolean."""
    return [tuple(w.split(":")) if ":" in w else (w, "d") for w in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    casts = {
        "d": lambda c: F.round(c.cast("double"), DIGITS) + F.lit(0.0),
        "l": lambda c: c.cast("long"),
        "s": lambda c: c.cast("string"),
        "t": lambda c: c.cast("date"),
        "b": lambda c: c.cast("boolean"),
    }
    return df.select(*(casts[k](F.col(n)).alias(n) for n, k in parts(spec)))


def quoted(name: str) -> str:
    return f'"{name}"'


def sql(body: str, spec: str, base: str = "obs") -> str:
    """A whole statement: common table expressions up to ``base``, then ``body`` (more of them, and at last ``result``)."""
    casts = {"d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "l": "CAST({0} AS BIGINT)", "s": "CAST({0} AS VARCHAR)", "t": "CAST({0} AS DATE)", "b": "CAST({0} AS BOOLEAN)"}
    shown = ", ".join(f"{casts[k].format(quoted(n))} AS {quoted(n)}" for n, k in parts(spec))
    head = {"none": "", "tables": proxies.SQL + ",", "obs": proxies.SQL + "," + observations.SQL + ","}[base]
    return f"WITH RECURSIVE {head}\n{body}\nSELECT {shown} FROM result"


def sql_nearest(features: list[str], required: list[str], metric: str, n: int, gap_days: int, weights: dict[str, float] | None = None, source: str = "obs", name: str = "m") -> str:
    """``<name>(market, rank, date, distance)``: nearest rows with a minimum gap, by a recursive fold over the ranked rows."""
    need = " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys([*features, *required]))
    stats = ", ".join(f"coalesce(nullif(stddev_pop({f}) FILTER (NOT is_last), 0), 1) AS sd_{f}, max({f}) FILTER (is_last) AS now_{f}" for f in features)
    term = lambda f: f"pow((c.{f} - s.now_{f}) / s.sd_{f}, 2) * {weights[f] if weights else 1.0}"
    total = " + ".join(map(term, features))
    if metric == "rms":
        total = f"({total}) / {len(features)}"
    return f"""
{name}_c AS (SELECT *, date = max(date) OVER (PARTITION BY market) AS is_last, count(*) OVER (PARTITION BY market) AS n_rows FROM {source} WHERE {need}),
{name}_s AS (SELECT market, {stats} FROM {name}_c WHERE n_rows >= 3 GROUP BY market),
{name}_d AS (SELECT c.market, c.date, round(sqrt({total}), 9) AS distance FROM {name}_c c JOIN {name}_s s ON c.market = s.market WHERE NOT is_last),
{sql_greedy(f"{name}_d", "distance, date", gap_days, n, name)}"""


def sql_greedy(source: str, order: str, gap_days: int, limit: int | None, name: str, key: str = "market", more: str = "distance") -> str:
    full = f"len(g.taken) >= {limit} OR " if limit is not None else ""
    extra = f", k.{more}" if more else ""
    return f"""{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM {source}),
{name}_g({key}, i, taken) AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT), CAST([] AS DATE[]) FROM {name}_k
  UNION ALL
  SELECT g.{key}, k.i, CASE WHEN {full}len(list_filter(g.taken, lambda t: abs(date_diff('day', t, k.date)) < {gap_days})) > 0 THEN g.taken ELSE list_append(g.taken, k.date) END
  FROM {name}_g g JOIN {name}_k k ON k.{key} = g.{key} AND k.i = g.i + 1
),
{name}_t AS (SELECT {key}, arg_max(taken, i) AS taken FROM {name}_g GROUP BY {key}),
{name}_u AS (SELECT {key}, unnest(taken) AS date, generate_subscripts(taken, 1) AS rank FROM {name}_t),
{name} AS (SELECT u.{key}, u.rank, u.date{extra} FROM {name}_u u JOIN {name}_k k ON k.{key} = u.{key} AND k.date = u.date)"""


def sql_levels(source: str, ret: str, keys: str = "market") -> str:
    """The summary of ``outcomes.levels`` as a query."""
    return f"""SELECT {keys}, n, up, down, direction, median,
  CASE direction WHEN 'neutral' THEN 0.5 ELSE greatest(up, down) / n END AS hit_rate,
  CASE direction WHEN 'bullish' THEN up_25 WHEN 'bearish' THEN down_25 END AS range_low,
  CASE direction WHEN 'bullish' THEN up_75 WHEN 'bearish' THEN down_75 END AS range_high
FROM (SELECT *, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS direction FROM ({sql_counted(source, ret, keys)}))"""


def sql_counted(source: str, ret: str, keys: str = "market", more: str = "") -> str:
    q = lambda p, cond, name: f"quantile_cont({ret}, {p}) FILTER ({cond}) AS {name}"
    quartiles = ", ".join(q(p, cond, f"{name}_{n}") for name, cond in (("all", "true"), ("up", f"{ret} > 0"), ("down", f"{ret} < 0")) for n, p in ((25, 0.25), (75, 0.75)))
    return f"""SELECT {keys}, count({ret}) AS n, count(*) FILTER ({ret} > 0) AS up, count(*) FILTER ({ret} < 0) AS down, quantile_cont({ret}, 0.5) AS median,
  {quartiles}, min({ret}) AS worst, max({ret}) AS best, avg({ret}) AS mean, stddev_samp({ret}) AS std{more} FROM {source} WHERE {ret} IS NOT NULL GROUP BY {keys}"""


def sql_wilson(hits: str, n: str, upper: bool) -> str:
    sign, bound = ("+", "least(1.0, ") if upper else ("-", "greatest(0.0, ")
    return f"CASE WHEN {n} > 0 AND {hits} >= 0 AND {hits} <= {n} THEN {bound}({hits} / {n} + 1.9208 / {n} {sign} 1.96 * sqrt(({hits} / {n} * (1 - {hits} / {n}) + 0.9604 / {n}) / {n})) / (1 + 3.8416 / {n})) END"
