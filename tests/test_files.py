"""Registry files, and the cache when sources and writes fail."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import files
from tidemark.sources import catalogue, proxies, registry, tables

ASSET = {"category": "Metals", "exchange": "X", "cftc_report": "legacy", "cftc_market_name": "GOLD", "cftc_code": "088691", "price_symbol": "GC=F"}
YAML = """
categories:
  Grains:
    icon: g
    order: 2
assets:
  Wheat:
    category: Grains
    exchange: Y
    cftc_report: legacy
    cftc_market_name: WHEAT
    cftc_code: "001602"
    price_symbol: ZW=F
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"categories": {"Metals": {"icon": "m", "order": 1}}, "assets": {"Gold": ASSET, "Silver": ASSET | {"cftc_code": "084691"}}}))
    (tmp_path / "b.yaml").write_text(YAML)
    return tmp_path


def test_nested_files(spark, folder):
    markets, categories, errors = registry.read_registry(spark, str(folder))
    assert sorted((r.market, r.category, r.report_code) for r in markets.collect()) == [("Gold", "Metals", "088691"), ("Silver", "Metals", "084691"), ("Wheat", "Grains", "001602")]
    assert [(r.category, r.place, r.markets) for r in catalogue.grouped(markets, categories).collect()] == [("Metals", 1, ["Gold", "Silver"]), ("Grains", 2, ["Wheat"])]
    assert errors.count() == 0
    assert set(markets.columns) == {c.split()[0] for c in catalogue.MARKET.split(", ")}


def test_bad_files_and_entries(spark, folder):
    (folder / "c.json").write_text("{[ not: closed")
    (folder / "d.json").write_text(json.dumps({"assets": {"Tin": {"category": "Metals"}, "Moon": ASSET | {"category": "Nowhere"}, "Lead": ASSET | {"colour": "grey"}, "Zinc": None}}))
    (folder / "e.json").write_text("")
    (folder / "f.json").write_text(json.dumps({"assets": {"Gold": ASSET | {"exchange": "later"}}}))
    markets, _, errors = registry.read_registry(spark, str(folder))
    assert {r.market: r.exchange for r in markets.collect()} == {"Gold": "later", "Silver": "X", "Wheat": "Y"}
    got = {(r.kind, r.name): r.error for r in errors.collect()}
    assert set(got) == {("file", None), ("asset", "Tin"), ("asset", "Moon"), ("asset", "Lead"), ("asset", "Zinc")}
    assert got["asset", "Moon"] == "unknown category Nowhere" and got["asset", "Lead"] == "unknown colour" and "missing exchange" in got["asset", "Tin"]


def test_written_and_read_again(spark, folder, tmp_path):
    markets, categories, _ = registry.read_registry(spark, str(folder))
    registry.write_registry(markets, categories, str(tmp_path / "again"))
    again, categories_again, errors = registry.read_registry(spark, str(tmp_path / "again"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(markets) == rows(again) and rows(categories) == rows(categories_again) and errors.count() == 0


def test_two_keys_fail_for_two_reasons(spark):
    keys = spark.createDataFrame([(k,) for k in ("A", "B", "C", "D")], "market string")

    def load(rows):
        close = F.when(F.col("market") == "B", F.raise_error(F.lit("timeout"))).when(F.col("market") == "D", F.raise_error(F.lit("unknown market"))).otherwise(F.lit(2.0))
        return rows.select("market", F.lit("2024-01-12").cast("date").alias("date"), close.alias("close"))

    loaded, failures = tables.load_each(keys, load)
    reasons = {r.market: r.reason for r in failures.collect()}
    assert set(reasons) == {"B", "D"} and "timeout" in reasons["B"] and "unknown market" in reasons["D"]
    cached = spark.createDataFrame([("A", "2024-01-10", 1.0), ("B", "2023-01-10", 1.0), ("C", "2023-01-10", 1.0)], "market string, date string, close double").withColumn("date", F.col("date").cast("date"))
    got = {r.market: r.origin for r in tables.served(cached, loaded, "market", F.lit("2024-01-13").cast("date"), 7, failures).collect()}
    assert got["A"] == "cache" and got["C"] == "loaded" and got["B"].startswith("stale_cache: ") and "timeout" in got["B"] and "D" not in got
    assert [r.market for r in tables.unserved(cached, loaded, "market", failures).collect()] == ["D"]


def test_a_failed_write_leaves_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    old = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "market string, close double")
    tables.write_cache(old, path)
    broken = F.when(F.col("market") == "B", F.raise_error(F.lit("lost"))).otherwise(F.col("market"))
    new = spark.createDataFrame([("A", 7.0), ("B", 8.0)], "market string, close double").repartition(2, "market").withColumn("market", broken)
    with pytest.raises(Exception, match="lost"):
        tables.write_cache(new, path)
    assert sorted((r.market, r.close) for r in tables.read_cache(spark, path).collect()) == [("A", 1.0), ("B", 2.0)]


def test_cached_prices_makes_its_prices_once(spark, monkeypatch):
    """Prices are small, what they come from is not: neither writes nor attempts to load make them again."""
    seen, made = spark.sparkContext.accumulator(0), proxies.prices

    @F.udf("double")
    def counted(close):
        seen.add(1)
        return close

    monkeypatch.setattr(proxies, "prices", lambda *args: made(*args).withColumn("close", counted("close")))
    assert len(files.cached_prices(spark, "/root/testdata/sf0.001").collect()) == 5
    rows = made(spark, "/root/testdata/sf0.001").count()
    assert rows <= seen.value <= 2 * rows
