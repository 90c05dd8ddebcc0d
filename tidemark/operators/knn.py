"""Historical analogs: standardized distances to the current row, and greedy selection with a minimum gap in time.

Everything is grouped by market. A market's history is a few thousand rows at most (one a week), so its rows fit one array; markets
are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr, windows

NETS = ["commercial_net", "noncommercial_net", "nonreportable_net"]
SHARES = [f"{n}_oi" for n in NETS]
GROUPS = {"commercials": "commercial_net", "retail": "nonreportable_net"}


def complete(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("market",), order: str = "date") -> DataFrame:
    """Rows with all ``columns``; the newest of them is the current one. Which columns are asked for decides how old it is."""
    return windows.with_place(df.na.drop(subset=[*columns, order]), *keys, order=order).withColumn("n_rows", F.count("*").over(windows.whole(*keys)))


def scaled(df: DataFrame, features: list[str], keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Columns ``z_<feature>``: distance from the current row in population deviations of the history (1 if it doesn't vary)."""
    w = windows.whole(*keys)
    made = {}
    for f in features:
        spread = F.stddev_pop(F.when(~F.col("is_last"), F.col(f))).over(w)
        now = F.max(F.when(F.col("is_last"), F.col(f))).over(w)
        made[f"z_{f}"] = (F.col(f) - now) / F.when(spread == 0, 1.0).otherwise(spread)
    return df.withColumns(made)


def distance(features: list[str], metric: str = "rms", weights: dict[str, float] | None = None) -> Column:
    """``rms``: root of the mean square; ``euclid``: of the sum; ``weighted``: of the weighted sum. Rounded to 9 places, so that ties are ties."""
    square = lambda f: F.col(f"z_{f}") * F.col(f"z_{f}") * (weights[f] if weights else 1.0)
    total = square(features[0])
    for f in features[1:]:
        total = total + square(f)
    return F.round(F.sqrt(total / len(features) if metric == "rms" else total), 9)


def greedy(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], gap_days: int, limit: int | None = None) -> DataFrame:
    """Rows taken in ``order`` if they are at least ``gap_days`` from every row taken before, up to ``limit``; with their ``rank``.

    What is taken depends on what was taken before. With a limit it's a fold over each key's sorted array, which compares with so many rows at most; without
    one, rows are streamed (``spaced``). ``payload`` holds ``date``.
    """
    if limit is None:
        return spaced(df, keys, order, payload, gap_days)
    item = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), *payload)
    items = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.expr("filter(items, x -> false)")
    close = lambda taken, x: F.exists(taken, lambda u: F.abs(F.datediff(u["date"], x["date"])) < gap_days)
    taken = F.aggregate("items", none, lambda acc, x: F.when((F.size(acc) >= limit) | close(acc, x), acc).otherwise(F.array_append(acc, x)))
    return items.select(*keys, F.posexplode(taken).alias("rank", "item")).select(*keys, (F.col("rank") + 1).alias("rank"), *(F.col(f"item.{c}").alias(c) for c in payload))


def spaced(df: DataFrame, keys: list[str], order: list[Column], payload: list[str], gap_days: int) -> DataFrame:
    """``greedy`` without a limit, in time and memory of the rows taken: a day belongs to a bucket as wide as the gap, of which at most one row is taken,
    so a row is compared with what its own bucket and the two beside it have. Rows stream through in order; no key's rows are gathered.
    """
    places = [f"o{i}" for i in range(len(order))]
    rows = df.select(*keys, *payload, *(o.alias(p) for o, p in zip(order, places, strict=True)), F.unix_date("date").alias("o_day"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *places, *payload)
    width = max(1, gap_days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, taken, number = None, {}, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            days = batch.column(batch.num_columns - 1).to_pylist()
            kept, ranks = [], []
            for i, (*own, day) in enumerate(zip(*columns, days, strict=True)):
                if key != own:
                    key, taken, number = own, {}, 0
                bucket = day // width
                if all(abs(taken.get(b, day + width) - day) >= gap_days for b in (bucket - 1, bucket, bucket + 1)):
                    taken[bucket] = day
                    number += 1
                    kept.append(i)
                    ranks.append(number)
            found = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(found.column(i) for i in range(len(keys))), pa.array(ranks, pa.int32()), *(found.column(len(keys) + i) for i in range(len(payload)))], names=[*keys, "rank", *payload])

    schema = df.select(*keys, F.lit(1).alias("rank"), *payload).schema
    return dealt.mapInArrow(run, schema)


def nearest(
    df: DataFrame,
    features: list[str],
    n: int = 30,
    gap_weeks: int | None = 8,
    metric: str = "rms",
    weights: dict[str, float] | None = None,
    required: list[str] | None = None,
    payload: list[str] | None = None,
) -> DataFrame:
    """The ``n`` most similar earlier rows of each market's current row: ``market, rank, date, distance`` and ``payload``.

    ``required`` adds columns that must be there: with a forward return among them, the current row is the newest whose outcome is
    known. Markets of fewer than three rows have no result. Without a gap, ``gap_weeks`` is None.
    """
    clean = complete(df, [*features, *(required or [])]).where("n_rows >= 3")
    ranked = scaled(clean, features).where(~F.col("is_last")).withColumn("distance", distance(features, metric, weights))
    columns = ["date", "distance", *(payload or [])]
    if gap_weeks is None:
        place = F.row_number().over(Window.partitionBy("market").orderBy("distance", "date"))
        return ranked.withColumn("rank", place).where(F.col("rank") <= n).select("market", "rank", *columns)
    return greedy(ranked, ["market"], [F.col("distance"), F.col("date")], columns, 7 * gap_weeks, n)


def with_similarity(matches: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Matches with a similarity from 0 to 100, on the scale of their median distance."""
    return matches.withColumn("similarity", expr.similarity(F.col("distance"), F.percentile("distance", 0.5).over(windows.whole(*keys))))


def net_similar(df: DataFrame, n: int = 30, gap_weeks: int = 8, payload: list[str] | None = None) -> DataFrame:
    """Analogs of the newest row by all three net positions."""
    return with_similarity(nearest(df, NETS, n, gap_weeks, payload=payload))


def similar(df: DataFrame, features: list[str], n: int = 30) -> DataFrame:
    """The nearest rows to the newest by Euclidean distance, without a gap."""
    return nearest(df, features, n, None, "euclid")


def hybrid_similar(df: DataFrame, n: int = 30, gap_weeks: int = 8, net_weight: float = 0.55) -> DataFrame:
    """Analogs of the newest row by net positions and their shares of open interest, which divide ``net_weight`` and the rest."""
    w = min(1.0, max(0.0, net_weight))
    weights = {f: w / 3 for f in NETS} | {f: (1 - w) / 3 for f in SHARES}
    return with_similarity(nearest(df, NETS + SHARES, n, gap_weeks, "weighted", weights))


def group_net(df: DataFrame, group: str, weeks: int = 8, n: int = 30, gap_weeks: int = 8, with_share: bool = False) -> DataFrame:
    """Analogs by one group's net position; its share of open interest has to be there even where it isn't compared."""
    net = GROUPS[group]
    features = [net, f"{net}_oi"] if with_share else [net]
    return nearest(df, features, n, gap_weeks, required=[f"{net}_oi", f"return_{weeks}w"], payload=[f"return_{weeks}w"])


def overlap(df: DataFrame, weeks: int = 8, n: int = 30, gap_weeks: int = 8, with_share: bool = False) -> DataFrame:
    """Analogs by the net positions of commercials and retail together."""
    nets = list(GROUPS.values())
    features = nets + [f"{c}_oi" for c in nets] if with_share else nets
    return nearest(df, features, n, gap_weeks, required=[*(f"{c}_oi" for c in nets), f"return_{weeks}w"], payload=[f"return_{weeks}w"])


def pure_net(df: DataFrame, weeks: int = 8, n: int = 30, gap_weeks: int = 8) -> DataFrame:
    """Analogs by the three net positions alone, of the newest row whose outcome is known."""
    return nearest(df, NETS, n, gap_weeks, required=[f"return_{weeks}w"], payload=[f"return_{weeks}w"])


def share_context(matches: DataFrame, df: DataFrame, most: float = 1.0) -> DataFrame:
    """Matches whose shares of open interest are within ``most`` deviations (root mean square) of the newest row's."""
    placed = scaled(complete(df, SHARES), SHARES).where(~F.col("is_last"))
    near = placed.select("market", "date", distance(SHARES).alias("oi_distance"))
    found = matches.join(near, ["market", "date"]).where(F.col("oi_distance") <= most)
    place = F.row_number().over(Window.partitionBy("market").orderBy("oi_distance", "date"))
    return found.withColumns({"oi_similarity": 100 * F.exp(-F.col("oi_distance")), "oi_rank": place})
