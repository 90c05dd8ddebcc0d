"""A failure of one market ends Spark's job for all; here it becomes that market's error."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialized


#: A line that names an error, as Python and the JVM write it.
NAMED = re.compile(r"(?::\s*|Caused by:\s*)?((?:\[[A-Z_.]+\]|[\w.$]*(?:Error|Exception)\b).*)")


def reason_of(failure: Exception) -> str:
    """The last line that names an error in a failure's text (its root cause), or the first line."""
    lines = [x.strip() for x in str(failure).splitlines() if x.strip()] or [type(failure).__name__]
    named = [m[1] for x in lines if (m := NAMED.match(x))]
    return (named[-1] if named else lines[0])[:300]


Failures = list[tuple[str, str, str]]


def tried(name: str, make: Callable[[DataFrame], DataFrame], rows: DataFrame, key: str = "market") -> tuple[DataFrame, Failures]:
    """``make(rows)``, materialized, without the markets (or other keys) that it fails for, and those as (market, name, reason).

    One market's failure ends Spark's job for all. Then halves of the markets, by a hash of their names, are tried until each that fails is alone; the
    others' results don't change. A market costs as many attempts as there are halvings, and only when something fails. If the session is gone, the failure is raised.
    """
    results, failures = [], []

    def attempt(bits: int, bucket: int) -> None:
        # written before it is tried, as a filter beside what fails may be evaluated after it
        part = materialized(rows.where(F.pmod(F.xxhash64(key), F.lit(1 << bits)) == bucket)) if bits else rows
        try:
            results.append(materialized(make(part)))
        except Exception as failure:
            if rows.sparkSession.sparkContext._jsc.sc().isStopped():
                raise
            among = [r[0] for r in part.select(key).distinct().limit(2).collect()]
            if not among:
                raise
            if len(among) == 1 or bits == 60:
                failures.extend((m, name, reason_of(failure)) for m in among)
            else:
                attempt(bits + 1, bucket)
                attempt(bits + 1, bucket + (1 << bits))

    attempt(0, 0)
    # without any market the analyzer still gives its columns
    return (reduce(DataFrame.unionByName, results) if results else make(rows.limit(0))), failures
