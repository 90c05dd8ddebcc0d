"""As-of joins by union and fill: one sort per key, linear in the rows of both sides, no join by range.

For keys too large for one task, ``ranges`` deals both sides by ranges of key and time and takes the last match over from earlier ranges.

Both sides go into one window per key. Going forward in time, the last row of the right side seen so far is the match (backward join);
going back in time, it is the match of a forward join. Rows of the right side sort first among equal times, so exact matches
count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges as spread


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: dict[str, str], direction: str = "backward", tolerance_days: int | None = None, ranges: int | None = None) -> DataFrame:
    """``left`` with columns of the nearest row of ``right`` at or before (``backward``) or at or after (``forward``) ``left_on``.

    ``values`` maps columns of ``right`` to their names in the result; they are NULL without a match within ``tolerance_days``.
    Rows with a null in ``left_on`` match nothing; rows of ``right`` with a null in ``right_on`` are no match. With ``ranges``, a key isn't sorted in one task but in as many
    of so many ranges as it fills; times have to be dates or timestamps.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward or forward")
    match = F.struct(F.col(right_on).alias("asof_on"), *(F.col(c).alias(n) for c, n in values.items()))
    found = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("asof_time"), F.lit(0).alias("asof_side"), match.alias("asof_match"))
    asked = left.select("*", F.col(left_on).alias("asof_time"), F.lit(1).alias("asof_side"))
    both = asked.unionByName(found, allowMissingColumns=True)
    time = F.col("asof_time").asc_nulls_first() if direction == "backward" else F.col("asof_time").desc_nulls_first()
    if ranges is not None:
        # microseconds, negative going back in time, order like the window below and can be compared
        micros = F.unix_micros(F.col("asof_time").cast("timestamp"))
        both = both.withColumn("asof_order", micros if direction == "backward" else -micros)
        filled = spread.filled(both, by, [F.col("asof_order"), F.col("asof_side")], "asof_match", ranges).where("asof_side = 1")
    else:
        w = Window.partitionBy(*by).orderBy(time, "asof_side").rowsBetween(Window.unboundedPreceding, 0)
        filled = both.withColumn("asof_match", F.last("asof_match", ignorenulls=True).over(w)).where("asof_side = 1")
    keep = F.col("asof_time").isNotNull() & F.col("asof_match").isNotNull()
    if tolerance_days is not None:
        keep &= F.abs(F.datediff(F.col("asof_match.asof_on"), F.col("asof_time"))) <= tolerance_days
    return filled.select(*left.columns, *(F.when(keep, F.col("asof_match")[n]).alias(n) for n in values.values()))
