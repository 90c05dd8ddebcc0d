"""One key with very many rows: as-of joins and rolling frames in ranges, and selections with a gap in linear time, equal to the plain ways."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import clusters, knn, ranges
from tidemark.operators.asof import asof


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    day = lambda: None if rng.random() < 0.02 else rng.randrange(3000)
    left = [(rng.choice(["big"] * 9 + ["small", None]), day(), i) for i in range(3000)]
    right = [(k, d, float(i)) for i, (k, d) in enumerate({(rng.choice(["big"] * 9 + ["small", None]), rng.randrange(0, 3000, 7)) for _ in range(900)})]
    dated = lambda df: df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d"))).drop("d")
    return dated(spark.createDataFrame(left, "market string, d int, id long")), dated(spark.createDataFrame(right, "market string, d int, close double"))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_in_ranges(sides, direction, tolerance):
    left, right = sides
    plain, spread = (sorted(map(tuple, asof(left, right, ["market"], "date", "date", {"close": "close", "date": "found"}, direction, tolerance, ranges=n).collect()), key=repr) for n in (None, 13))
    assert plain == spread and any(r[-1] is not None for r in plain)


def test_a_large_key_fills_many_tasks(spark):
    """Two million rows of one key in thirty-two ranges: no range has more than a few times its share."""
    n = 1_000_000
    left = spark.range(n).select(F.lit("big").alias("market"), F.timestamp_seconds(F.col("id") * 10 + 5).alias("t"), "id")
    right = spark.range(n).select(F.lit("big").alias("market"), F.timestamp_seconds(F.col("id") * 10).alias("t"), F.col("id").alias("value"))
    found = asof(left, right, ["market"], "t", "t", {"value": "value"}, ranges=32)
    assert found.where("value = id").count() == n
    parts = ranges.dealt(left, ["market"], [F.col("t")], 32).groupBy("part").count().collect()
    assert len(parts) > 20 and max(r["count"] for r in parts) < 4 * n / 32


def test_numbers(sides):
    left, _ = sides
    got = ranges.numbered(left, ["market"], [F.col("date"), F.col("id")], 7)
    plain = left.withColumn("pos", F.row_number().over(windows.series("market", order="date").orderBy("date", "id")))
    assert sorted(map(tuple, got.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_rolling_frames_in_ranges(spark):
    rng = random.Random(4)
    rows = [(m, i, None if rng.random() < 0.05 else rng.gauss(0, 1)) for m, size in (("big", 900), ("small", 40), ("one", 1)) for i in range(size)]
    df = spark.createDataFrame(rows, "market string, date int, x double").repartition(5)
    made = lambda w: {"z": windows.rolling_z(F.col("x"), w, 30, 10), "rank": windows.rolling_rank(F.col("x"), w, 30, 10), "index": windows.range_index(F.col("x"), w, 30, 10), "n": F.count("x").over(w.rowsBetween(-29, 0))}
    plain = df.withColumns(made(windows.series()))
    spread = ranges.rolling(df, ["market"], "date", 30, made(ranges.window(["market"], "date")), 6, stretch=64)
    near = lambda df: sorted((r.market, r.date, r.n, *(None if v is None else round(v, 9) for v in (r.x, r.z, r["rank"], r["index"]))) for r in df.collect())
    assert near(plain) == near(spread)
    with pytest.raises(ValueError, match="longer"):
        ranges.rolling(df, ["market"], "date", 65, {}, 6, stretch=64)


def test_ranks_in_ranges(spark):
    """Ranks from frames in order equal those from an array for each row, with nulls, ties and keys that are null."""
    rng = random.Random(5)
    rows = [(m, i, None if rng.random() < 0.1 else rng.randrange(12)) for m, size in (("big", 700), (None, 90), ("none", 0), ("one", 1)) for i in range(size)] + [("void", i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "market string, date int, x int").repartition(5)
    for frame, least in ((30, 10), (7, 7)):
        plain = df.withColumn("rank", windows.rolling_rank(F.col("x"), windows.series(), frame, least))
        spread = ranges.ranked(df, ["market"], "date", frame, {"rank": "x"}, least, 6, stretch=64)
        assert spread.columns == plain.columns
        assert sorted(map(repr, map(tuple, spread.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert ranges.ranked(df.limit(0), ["market"], "date", 30, {"rank": "x"}, 10, 6).count() == 0


def test_wide_ranks_of_a_large_key_in_seconds(spark):
    """Three hundred thousand rows with frames of twenty thousand: 6 billion values, if each row had an array of its own."""
    n, frame = 300_000, 20_000
    df = spark.range(n).select(F.lit("big").alias("market"), F.col("id").alias("date"), (F.col("id") * 7919 % n).alias("x"))
    began = time.time()
    got = ranges.ranked(df, ["market"], "date", frame, {"rank": "x"}, 1, 16).where("date % 50000 = 49999").collect()
    assert time.time() - began < 60
    for r in got:
        values = [i * 7919 % n for i in range(r.date - frame + 1, r.date + 1)]
        assert r["rank"] == (sum(v < r.x for v in values) + 1) / frame
    assert len(got) == 6


def plain_greedy(rows, gap):
    taken = []
    for r in rows:
        if all(abs((r[0] - t[0]).days) >= gap for t in taken):
            taken.append(r)
    return taken


def test_selection_without_limit(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(400), rng.randrange(50)) for _ in range(600)]
    df = spark.createDataFrame(rows, "market string, d int, score int").withColumn("date", F.date_add(F.lit("1969-06-01").cast("date"), F.col("d"))).drop("d").repartition(4)
    for gap in (0, 1, 9, 56):
        got = knn.greedy(df, ["market"], [F.col("score"), -F.unix_date("date")], ["date", "score"], gap).collect()
        for market in "ab":
            own = sorted((r for r in df.collect() if r.market == market), key=lambda r: (r.score, -r.date.toordinal()))
            wanted = [(i, d, s) for i, (d, s) in enumerate(plain_greedy([(r.date, r.score) for r in own], gap), 1)]
            assert sorted((r["rank"], r.date, r.score) for r in got if r.market == market) == wanted


def test_hundred_thousand_events_in_seconds(spark):
    events = spark.range(100_000).select(F.lit("big").alias("market"), F.date_add(F.lit("1800-01-01").cast("date"), (F.col("id") * 7919 % 100_000).cast("int")).alias("date"), F.col("id").alias("x"))
    clusters.episodes(events.limit(10), ["x"], 1).count()
    began = time.time()
    assert clusters.episodes(events, ["x"], 1).count() == -(-100_000 // 7)
    assert time.time() - began < 20
