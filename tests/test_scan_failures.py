"""A market that an analyzer fails for keeps its row, with the reason, and changes nothing for the others."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark import isolation
from tidemark.operators import scan

MARKETS = ["A", "C", "D"]
TODAY = dt.date(2003, 12, 30)


def rows():
    first = dt.date(2000, 1, 4)
    positions, prices = [], []
    for m, market in enumerate(MARKETS):
        for i in range(208):
            long = int(10_000 + 3000 * math.sin(i / (5 + m)) + 900 * math.sin(i * 1.7))
            short = int(9000 + 2000 * math.cos(i / (7 + m)))
            small = int(1000 + 300 * math.sin(i / 11))
            positions.append((market, first + dt.timedelta(7 * i), 40_000, short, long, long, short, small, 900, -(long - short) + 0.5, float(long - short), float(small - 900)))
        for i in range(208 * 7 + 7):
            prices.append((market, first + dt.timedelta(i), 100 + 10 * math.sin(i / (60 + m)) + i / 200))
    return positions, prices


POSITIONS = "market string, date date, oi long, comm_long long, comm_short long, noncomm_long long, noncomm_short long, nonrep_long long, nonrep_short long, commercial_net double, noncommercial_net double, nonreportable_net double"


@pytest.fixture(scope="module")
def tables(spark):
    positions, prices = rows()
    markets = spark.createDataFrame([(m, "x") for m in MARKETS], "market string, category string")
    return spark.createDataFrame(positions, POSITIONS), spark.createDataFrame(prices, "market string, date date, close double"), markets


def run(tables, found=None, positions=None):
    out = scan.scan(positions if positions is not None else tables[0], tables[1], tables[2], F.lit(TODAY), found=found)
    return {r.market: r.asDict() for r in out.collect()}


@pytest.fixture(scope="module")
def sound(tables):
    return run(tables)


def failing_in_spark(analyzer):
    """The analyzer, with a failure of Spark's own for market C."""
    broken = lambda c: F.when(F.col("market") == "C", F.raise_error(F.lit("planted failure"))).otherwise(F.col(c))
    return lambda valid, prices, reports: analyzer(valid.withColumns({c: broken(c) for c in valid.columns if c != "market"}), prices, reports)


def failing_in_python(analyzer):
    def check(batch):
        if (batch["market"] == "C").any():
            raise ValueError("planted failure")
        return batch

    return lambda valid, prices, reports: analyzer(valid.groupBy("market").applyInPandas(check, valid.schema), prices, reports)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize(("broken", "names"), [(failing_in_spark, list(scan.analyzers())), (failing_in_python, ["analogs", "flows", "clusters"])])
def test_every_analyzer_fails_alone(tables, sound, broken, names):
    assert all(r["error"] == "" for r in sound.values())
    usual = {name: a for name, a in scan.analyzers().items() if name in names or name in ("extremes", "index", "net8", "analogs")}
    kept = {name: a for name, a in usual.items() if name not in names}
    usual = {name: a for name, a in usual.items() if name in names}
    got = run(tables, kept | {name: broken(a) for name, a in usual.items()})
    assert set(got) == set(MARKETS)
    for market in MARKETS:
        if market == "C":
            reasons = dict(x.split(": ", 1) for x in got["C"]["error"].split("; "))
            assert set(reasons) == set(usual) and {n: r for n, r in reasons.items() if not any(x in r for x in ("planted failure", "MULTIPLE_FAILURES"))} == {}  # Spark may give several stages' failures together
            assert got["C"]["cases"] is None and not got["C"]["flow_available"] and not got["C"]["cluster_available"]
            assert (got["C"]["net8_n"] is None) == ("net8" in usual)
        else:
            assert [k for k in got[market] if not same(got[market][k], sound[market][k])] == []


def test_one_analyzer_fails_for_one_market(tables, sound):
    usual = scan.analyzers()
    got = run(tables, usual | {"extremes": failing_in_spark(usual["extremes"])})
    assert got["C"]["error"].startswith("extremes: ") and not got["C"]["extreme_available"]
    assert got["C"]["net8_n"] == sound["C"]["net8_n"] and got["C"]["transition_phase"] == sound["C"]["transition_phase"]
    assert all(got[m]["error"] == "" and same(got[m]["extreme_strength"], sound[m]["extreme_strength"]) for m in MARKETS if m != "C")


def test_numbers_that_overflow(tables, sound):
    """Real data can do it: changes of positions near the ends of a long overflow, and with them the flows of all markets."""
    huge = F.when(F.col("market") == "D", F.when(F.month("date") % 2 == 0, F.lit(9_000_000_000_000_000_000)).otherwise(F.lit(-9_000_000_000_000_000_000))).otherwise(F.col("noncomm_long"))
    got = run(tables, positions=tables[0].withColumn("noncomm_long", huge))
    assert "flows: " in got["D"]["error"] and "overflow" in got["D"]["error"].lower()
    assert got["D"]["cluster_available"] == sound["D"]["cluster_available"] and got["D"]["net4_n"] == sound["D"]["net4_n"]
    assert all(got[m]["error"] == "" and same(got[m]["flow_score"], sound[m]["flow_score"]) for m in MARKETS if m != "D")


def test_reason_names_the_error():
    assert isolation.reason_of(ValueError("x\n  File y\nValueError: bad input\n")) == "ValueError: bad input"
    assert isolation.reason_of(RuntimeError("plain")) == "plain"
    java = "An error occurred while calling o1.checkpoint.\n: org.apache.spark.SparkException: Job aborted\n\tat org.apache.X\nCaused by: org.apache.spark.SparkRuntimeException: [USER_RAISED_EXCEPTION] planted\n\tat org.apache.Y\n\t... 1 more\n"
    assert isolation.reason_of(RuntimeError(java)) == "org.apache.spark.SparkRuntimeException: [USER_RAISED_EXCEPTION] planted"
