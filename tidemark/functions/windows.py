"""Window expressions over one market's rows by date. Frames count rows; minimums count rows with a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("market",))).orderBy(order)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("market",)))


def rolling_z(x: Column, w: WindowSpec, rows: int = 156, least: int = 52) -> Column:
    """Distance from the mean of the last rows in population deviations; NULL with too few values or no spread."""
    frame = w.rowsBetween(1 - rows, 0)
    z = F.try_divide(x - F.avg(x).over(frame), F.nullif(F.stddev_pop(x).over(frame), F.lit(0.0)))
    return F.when(F.count(x).over(frame) >= least, z)


def rolling_rank(x: Column, w: WindowSpec, rows: int = 156, least: int = 52) -> Column:
    """Average rank, as a share, of the frame's last value among its values; from 0 (not included) to 1."""
    frame = w.rowsBetween(1 - rows, 0)
    values = F.collect_list(x).over(frame)
    last = F.element_at(values, -1)
    below, equal = F.size(F.filter(values, lambda v: v < last)), F.size(F.filter(values, lambda v: v == last))
    return F.when(F.size(values) >= least, (below + (equal + 1) / 2) / F.size(values))


def range_index(x: Column, w: WindowSpec, rows: int = 156, least: int = 52) -> Column:
    """Place between the frame's least and greatest value, from 0 to 100; NULL if they are the same."""
    frame = w.rowsBetween(1 - rows, 0)
    low, high = F.min(x).over(frame), F.max(x).over(frame)
    return F.when(F.count(x).over(frame) >= least, 100 * F.try_divide(x - low, F.nullif(high - low, F.lit(0.0))))


def row_change(x: Column, w: WindowSpec, rows: int) -> Column:
    return x - F.lag(x, rows).over(w)


def row_return(x: Column, w: WindowSpec, rows: int) -> Column:
    return F.try_divide(x, F.lag(x, rows).over(w)) - 1


def latest_z(x: Column, is_last: Column, least: int = 52) -> Column:
    """An aggregate: the last row's value in population deviations of the rows before; 0 if those don't vary.

    NULL with less than ``least`` values before, or if the last row has none.
    """
    before = F.when(~is_last, x)
    spread = F.stddev_pop(before)
    z = (F.max(F.when(is_last, x)) - F.avg(before)) / spread
    return F.when((F.count(before) >= least) & (F.count(F.when(is_last, x)) == 1), F.when(spread == 0, 0.0).otherwise(z))


def with_place(df: DataFrame, *keys: str, order: str = "date") -> DataFrame:
    """``df`` with ``is_last``, true on the newest row of each key."""
    return df.withColumn("is_last", F.col(order) == F.max(order).over(whole(*keys)))


def interpolated(value: Column, place: Column, w: WindowSpec) -> Column:
    """Straight lines between known values along ``place``; the nearest known value beyond the first and last.

    ``w`` orders by ``place``. The frame to the end is computed anew for each row, so keep partitions short (a year's weeks).
    """
    known = F.when(value.isNotNull(), F.struct(place.alias("p"), value.alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    blend = before["v"] + (after["v"] - before["v"]) * F.try_divide((place - before["p"]).cast("double"), (after["p"] - before["p"]).cast("double"))
    return F.coalesce(value, F.when(before.isNull(), after["v"]).when(after.isNull(), before["v"]).otherwise(blend))
