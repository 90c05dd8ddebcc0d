"""Work over one very large key: rows in ranges of (key, order), and what a range needs from its neighbours.

A window by key sorts each key in one task. That is right for markets, whose histories are bounded, and not for a key of billions of rows. Here rows
are dealt by ranges of key and order, so a key fills as many tasks as it needs; each range is summed up in one row a key, and what a range takes over from
earlier ones (a count, a last value) comes from those few rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialized

#: Rows of a key that lie together in ``overlapping``.
STRETCH = 100_000


def dealt(df: DataFrame, keys: list[str], order: list[Column], ranges: int) -> DataFrame:
    """``df`` with ``part``, ascending in ``keys`` and ``order``; written, so that it's the same for all that follows."""
    return materialized(df.repartitionByRange(ranges, *keys, *order).withColumn("part", F.spark_partition_id()))


def with_earlier(df: DataFrame, summed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with what ``summed`` (keys, part, columns) has for its key and part; NULL where nothing is taken over.

    ``summed`` has a row only where a part goes on with a key of earlier parts. That is true of one key a part at most, so it has no more rows than there are parts, and is broadcast.
    """
    named = summed.select(*(F.col(c).alias(f"of_{c}") for c in [*keys, "part"]), *columns)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*keys, "part"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(F.broadcast(named), on, "left").drop(*(f"of_{c}" for c in [*keys, "part"]))


def earlier(summed: DataFrame, keys: list[str], made: dict[str, Column], where: Column) -> DataFrame:
    """Aggregates over the earlier parts of each key: ``made`` maps names to aggregates that a window can compute; rows for which ``where`` holds."""
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return summed.withColumns({name: c.over(before) for name, c in made.items()}).where(where).select(*keys, "part", *made)


def numbered(df: DataFrame, keys: list[str], order: list[Column], ranges: int, name: str = "pos") -> DataFrame:
    """``df`` with each row's place in its key, from 1."""
    rows = dealt(df, keys, order, ranges)
    counts = rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    taken_over = earlier(counts, keys, {"n_before": F.sum("n")}, F.col("n_before") > 0)
    place = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    return with_earlier(rows.withColumn("place", place), taken_over, keys, ["n_before"]).withColumn(name, F.col("place") + F.coalesce("n_before", F.lit(0))).drop("part", "place", "n_before")


def filled(df: DataFrame, keys: list[str], order: list[Column], column: str, ranges: int) -> DataFrame:
    """``df`` with the last value of ``column`` up to each row in place of its own."""
    rows = dealt(df, keys, order, ranges)
    within = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = materialized(rows.withColumn(column, F.last(column, ignorenulls=True).over(within)))
    # of each part and key the value of its last row; there is one, as the values are filled
    last = rows.groupBy(*keys, "part").agg(F.max_by(column, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("value"))
    taken_over = earlier(last, keys, {"value_before": F.last("value", ignorenulls=True)}, F.col("value_before").isNotNull())
    return with_earlier(rows, taken_over, keys, ["value_before"]).withColumn(column, F.coalesce(column, "value_before")).drop("part", "value_before")


def overlapping(df: DataFrame, keys: list[str], order: str, rows: int, ranges: int, stretch: int | None = None) -> DataFrame:
    """``df`` in stretches of ``stretch`` rows (column ``stretch``), each with the ``rows - 1`` rows before it (``is_edge``).

    A frame of ``rows`` rows up to the current one is whole within a window by keys and stretch, for all rows but edges, which are then left out.
    """
    stretch = stretch or STRETCH
    if rows > stretch:
        raise ValueError("a frame is longer than a stretch")
    placed = numbered(df, keys, [F.col(order)], ranges).withColumn("own", F.floor((F.col("pos") - 1) / stretch))
    also = F.when((F.col("pos") - 1) % stretch > stretch - rows, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    return placed.withColumn("stretch", F.explode(also)).withColumn("is_edge", F.col("stretch") != F.col("own")).drop("own", "pos")


def rolling(df: DataFrame, keys: list[str], order: str, rows: int, made: dict[str, Column], ranges: int, stretch: int | None = None) -> DataFrame:
    """``df`` with window expressions over frames of at most ``rows`` rows. ``made`` has expressions over ``window(keys, order)``."""
    spread = overlapping(df, keys, order, rows, ranges, stretch).withColumns(made)
    return spread.where(~F.col("is_edge")).drop("stretch", "is_edge")


def window(keys: list[str], order: str):
    """The window that expressions of ``rolling`` are over."""
    return Window.partitionBy(*keys, "stretch").orderBy(order)


def sliding_ranks(values: list[float | None], rows: int, least: int) -> list[float | None]:
    """For each place the average rank, as a share, of the last known value among those of the last ``rows`` places; None with fewer than ``least`` of them.

    The frame's values are kept in order, so a place costs a few binary searches and not a pass over its frame.
    """
    held: list[float] = []
    last, out = None, []
    for i, value in enumerate(values):
        gone = values[i - rows] if i >= rows else None
        if gone is not None:
            del held[bisect_left(held, gone)]
        if value is not None:
            insort(held, value)
            last = value
        if len(held) < max(least, 1):
            out.append(None)
        else:
            below = bisect_left(held, last)
            out.append((below + (bisect_right(held, last) - below + 1) / 2) / len(held))
    return out


def ranked(df: DataFrame, keys: list[str], order: str, rows: int, columns: dict[str, str], least: int, ranges: int, stretch: int | None = None) -> DataFrame:
    """``df`` with rolling average ranks: ``columns`` maps new names to columns. The same as ``windows.rolling_rank``, for wide frames and keys of any size.

    A task holds one stretch and its edge at a time. Nulls aren't in frames; a row with a null has the rank of the last known value.
    """
    spread = overlapping(df, keys, order, rows, ranges, stretch)
    kept = df.columns
    schema = T.StructType([*df.schema, *(T.StructField(name, T.DoubleType()) for name in columns)])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending")], null_placement="at_start"))
        found = [pa.array(sliding_ranks(table.column(c).cast(pa.float64()).to_pylist(), rows, least), pa.float64()) for c in columns.values()]
        out = pa.Table.from_arrays([*(table.column(c) for c in kept), *found], names=[*kept, *columns])
        return out.filter(pc.invert(table.column("is_edge")))

    return spread.groupBy(*keys, "stretch").applyInArrow(run, schema)
