"""The observations that all analyzers start from: reports with shares of open interest, prices and forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr, windows
from tidemark.operators.asof import asof
from tidemark.sources.tables import NETS

HORIZONS = (4, 8, 12)


def with_close(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Each report with the last close at or before its date (NULL before the first price)."""
    return asof(positions, prices.select("market", "date", "close"), ["market"], "date", "date", {"close": "close"})


def with_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{n}_oi": expr.share(F.col(n), F.col("oi")) for n in NETS})


def with_scales(df: DataFrame, rows: int = 156, least: int = 52) -> DataFrame:
    """Rolling z-score and percentile of each net position."""
    w = windows.series()
    return df.withColumns({f"{n}_z": windows.rolling_z(F.col(n), w, rows, least) for n in NETS} | {f"{n}_pct": windows.rolling_rank(F.col(n), w, rows, least) for n in NETS})


def with_returns(df: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The return from the report's close to the first close at or after each horizon (NULL beyond the last price)."""
    out = df
    for weeks in horizons:
        target, later = f"target_{weeks}w", f"close_{weeks}w"
        out = asof(out.withColumn(target, F.date_add("date", 7 * weeks)), prices.select("market", "date", "close"), ["market"], target, "date", {"close": later}, "forward")
        out = out.withColumn(f"return_{weeks}w", expr.change(F.col(later), F.col("close"))).drop(target, later)
    return out


def observations(positions: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, scales: bool = True) -> DataFrame:
    """Positions with close, shares, (with ``scales``) rolling z-scores and percentiles, and forward returns."""
    out = with_shares(with_close(positions, prices))
    return with_returns(with_scales(out) if scales else out, prices, horizons)


def with_indices(df: DataFrame, rows: int = 156, least: int = 52) -> DataFrame:
    """Range index and percentile, both from 0 to 100, of the commercial and the retail net position."""
    w = windows.series()
    made = {}
    for name, net in (("commercial", "commercial_net"), ("retail", "nonreportable_net")):
        made[f"{name}_index"] = windows.range_index(F.col(net), w, rows, least)
        made[f"{name}_net_percentile"] = 100 * windows.rolling_rank(F.col(net), w, rows, least)
    return df.withColumns(made)


def feature_columns(mode: str) -> list[str]:
    """The columns of a feature set: ``absolute``, ``share``, ``z`` or ``percentile``."""
    suffix = {"absolute": "", "share": "_oi", "z": "_z", "percentile": "_pct"}[mode]
    return [f"{n}{suffix}" for n in NETS]


def scenario(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows within all bounds, which are included."""
    for column, (low, high) in bounds.items():
        df = df.where(F.col(column).between(low, high))
    return df


#: Observations as common table expressions, after ``proxies.SQL``.
SQL = """
px AS (SELECT market AS pm, date AS pd, close AS pc FROM prices),
closed AS (SELECT p.*, px.pc AS close FROM positions p ASOF LEFT JOIN px ON p.market = px.pm AND p.date >= px.pd),
shared AS (SELECT *, commercial_net / nullif(oi, 0) AS commercial_net_oi, noncommercial_net / nullif(oi, 0) AS noncommercial_net_oi, nonreportable_net / nullif(oi, 0) AS nonreportable_net_oi FROM closed),
r4 AS (SELECT s.*, px.pc / nullif(s.close, 0) - 1 AS return_4w FROM shared s ASOF LEFT JOIN px ON s.market = px.pm AND s.date + 28 <= px.pd),
r8 AS (SELECT s.*, px.pc / nullif(s.close, 0) - 1 AS return_8w FROM r4 s ASOF LEFT JOIN px ON s.market = px.pm AND s.date + 56 <= px.pd),
obs AS (SELECT s.*, px.pc / nullif(s.close, 0) - 1 AS return_12w FROM r8 s ASOF LEFT JOIN px ON s.market = px.pm AND s.date + 84 <= px.pd)"""


def sql_z(x: str) -> str:
    frame = "OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= 52 THEN ({x} - avg({x}) {frame}) / nullif(stddev_pop({x}) {frame}, 0) END"


def sql_rank(x: str) -> str:
    frame = "OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)"
    values = f"list({x}) {frame}"
    return f"CASE WHEN count({x}) {frame} >= 52 THEN (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0) / len({values}) END"


def sql_index(x: str) -> str:
    frame = "OVER (PARTITION BY market ORDER BY date ROWS BETWEEN 155 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= 52 THEN 100 * ({x} - min({x}) {frame}) / nullif(max({x}) {frame} - min({x}) {frame}, 0) END"
