"""Market states by k-means, and reference zones of one net position.

The fits run per market in ``applyInPandas`` on numpy arrays: a market has a few thousand rows at most, and markets are dealt over
the cluster. Starts are fixed by digests of dates, so a fit can be followed in SQL. Everything after the fit is set-based.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import expr, windows
from tidemark.operators import outcomes
from tidemark.operators.knn import NETS, SHARES, complete, greedy

FEATURES = NETS + SHARES
#: Restarts and most rounds of a fit, decimal places of centres, and of silhouettes.
RESTARTS, ROUNDS, PLACES, FIGURES = 20, 300, 10, 9


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2), 0))


def starts(dates: pd.Series, restarts: int = RESTARTS) -> np.ndarray:
    """For each restart the rows in the order of a digest of their date and the restart: starts that are random, but the same everywhere."""
    days = [f"{d:%Y-%m-%d}" for d in pd.to_datetime(dates)]
    return np.array([sorted(range(len(days)), key=lambda i: hashlib.md5(f"{days[i]}|{r}".encode()).hexdigest()) for r in range(restarts)])


def k_means(x: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of Lloyd's iterations from the first ``k`` rows of each order; of equal ones the first.

    Centres are rounded, so that the iteration ends when they stay; a cluster without rows keeps its centre.
    """
    best = (np.inf, None, None)
    for first in order[:, :k]:
        centers = x[first]
        for _ in range(ROUNDS):
            labels = distances(x, centers).argmin(axis=1)
            fresh = np.array([x[labels == c].mean(axis=0).round(PLACES) if (labels == c).any() else centers[c] for c in range(k)])
            if (fresh == centers).all():
                break
            centers = fresh
        away = distances(x, centers)
        cost = round(float((away.min(axis=1) ** 2).sum()), 6)
        if cost < best[0]:
            best = (cost, away.argmin(axis=1), centers)
    return best[1], best[2]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; a point alone in its cluster counts 0."""
    names, own = np.unique(labels, return_inverse=True)
    sizes = np.bincount(own)
    sums = np.zeros((len(x), len(names)))
    for at in range(0, len(x), 512):  # a block of rows at a time
        d = distances(x[at : at + 512], x)
        for c in range(len(names)):
            sums[at : at + 512, c] = d[:, own == c].sum(axis=1)
    rows = np.arange(len(x))
    inside = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    outside = means.min(axis=1)
    return round(float(np.where(sizes[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0).mean()), FIGURES)


def silhouettes(rows: DataFrame, features: list[str]) -> DataFrame:
    """``market, silhouette`` of the clusters in column ``cluster``, by the distances of ``features``; NULL with a single cluster."""

    def figure(part: pd.DataFrame) -> pd.DataFrame:
        several = part["cluster"].nunique() > 1
        return pd.DataFrame({"market": [part["market"].iloc[0]], "silhouette": [silhouette(part[features].to_numpy(float), part["cluster"].to_numpy()) if several else None]})

    return rows.select("market", "cluster", *features).groupBy("market").applyInPandas(figure, "market string, silhouette double")


def fitted(df: DataFrame, weeks: int = 8, min_k: int = 3, max_k: int = 8, least_rows: int = 80) -> DataFrame:
    """History rows of each market with ``same``: whether they are in the current row's cluster, the number of clusters and the silhouette.

    The number is the one with the best silhouette, the smallest of equal ones. Rows with infinite values are left out, and a market whose current row
    has one has no clusters; the others are fitted all the same.
    """
    ret = f"return_{weeks}w"
    clean = complete(df, [*FEATURES, ret]).where(F.col("n_rows") >= least_rows).select("market", "date", "is_last", ret, *FEATURES)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[np.isfinite(rows[FEATURES].to_numpy(float)).all(axis=1)].sort_values("date")
        x = rows[FEATURES].to_numpy(float)
        history = ~rows["is_last"].to_numpy(bool)
        if history.all() or not history.any():  # no finite current row, or nothing to compare it with: the market has no clusters
            return pd.DataFrame(columns=["market", "date", ret, "cluster", "same", "k", "silhouette"])
        spread = x[history].std(axis=0)
        z = (x - x[history].mean(axis=0)) / np.where(spread == 0, 1, spread)
        past, now = z[history], z[~history][:1]
        best = (-np.inf, 0, None, None)
        order = starts(rows.loc[history, "date"])
        for k in range(min_k, min(max_k, max(min_k, len(past) // 20)) + 1):
            if len(past) <= k:
                continue
            labels, centers = k_means(past, k, order)
            if len(np.unique(labels)) > 1 and (s := silhouette(past, labels)) > best[0]:
                best = (s, k, labels, centers)
        out = rows.loc[history, ["market", "date", ret]].copy()
        current = -1 if best[2] is None else int(distances(now, best[3]).argmin())
        out["cluster"] = best[2] if best[2] is not None else -2
        out["same"] = out["cluster"] == current
        out["k"], out["silhouette"] = best[1], best[0] if best[2] is not None else None
        return out[["market", "date", ret, "cluster", "same", "k", "silhouette"]]

    schema = T.StructType(
        [T.StructField("market", T.StringType()), T.StructField("date", T.DateType()), T.StructField(ret, T.DoubleType()), T.StructField("cluster", T.IntegerType())]
        + [T.StructField("same", T.BooleanType()), T.StructField("k", T.IntegerType()), T.StructField("silhouette", T.DoubleType())]
    )
    return clean.groupBy("market").applyInPandas(fit, schema)


def episodes(rows: DataFrame, payload: list[str], gap_weeks: int = 8, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Independent events, of each episode the newest."""
    return greedy(rows, list(keys), [-F.unix_date("date")], ["date", *payload], 7 * gap_weeks)


def analyze(fit: DataFrame, weeks: int = 8, gap_weeks: int = 8, min_sample: int = 12) -> tuple[DataFrame, DataFrame]:
    """Per market the outcome of the current cluster's independent events with its quality, and those events."""
    ret = f"return_{weeks}w"
    events = episodes(fit.where("same"), [ret, "k", "silhouette"], gap_weeks)
    c = outcomes.cluster(events, ["market"], ret, [F.first("k").alias("k"), F.first("silhouette").alias("silhouette")])
    quality = expr.cluster_quality(F.col("direction"), F.col("wilson_low"), F.col("n"), F.col("silhouette"))
    r = outcomes.by_direction(outcomes.majority(), 25), outcomes.by_direction(outcomes.majority(), 75)
    return c.withColumns({"quality": quality, "available": F.col("n") >= min_sample, "range_low": r[0], "range_high": r[1]}), events


def zoned(df: DataFrame, net: str, weeks: int = 8, n_zones: int = 8) -> DataFrame:
    """Rows of each market with the zone of their net position by one-dimensional k-means; the newest row is assigned, not fitted."""
    ret = f"return_{weeks}w"
    clean = complete(df, [net, ret]).where(F.col("n_rows") >= max(30, 4 * n_zones)).select("market", "date", "is_last", F.col(net).alias("net"), F.col(ret).alias("ret"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x = rows[["net"]].to_numpy(float)
        history = ~rows["is_last"].to_numpy(bool)
        k = min(n_zones, max(3, int(history.sum()) // 20))
        _, centers = k_means(x[history], k, starts(rows.loc[history, "date"]))
        rows["zone"] = distances(x, np.sort(centers, axis=0)).argmin(axis=1)
        return rows

    return clean.groupBy("market").applyInPandas(fit, "market string, date date, is_last boolean, net double, ret double, zone int")


def zone_table(rows: DataFrame, gap_weeks: int = 8) -> DataFrame:
    """Per zone its bounds over all earlier rows, the outcome of its independent visits, and whether the newest row is in it."""
    history = rows.where(~F.col("is_last"))
    bounds = history.groupBy("market", "zone").agg(F.min("net").alias("lower"), F.max("net").alias("upper"), F.percentile("net", 0.5).alias("center"))
    visits = episodes(history, ["ret"], gap_weeks, ("market", "zone"))
    now = rows.where("is_last").select("market", F.col("zone").alias("current_zone"))
    out = bounds.join(outcomes.levels(visits, ["market", "zone"], "ret"), ["market", "zone"]).join(now, "market")
    place = F.row_number().over(windows.whole().orderBy("center"))
    return out.withColumns({"is_current": F.col("zone") == F.col("current_zone"), "place": place})
