"""Queries of what is read from files: registries of markets, and the cache with its fallback. The files are written from the test tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shape import shaped, sql
from tidemark.session import materialized, use_checkpoints
from tidemark.sources import catalogue, proxies, registry, tables


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def registry_files(spark, sf_dir):
    """Nations as markets and regions as categories, in files of the registry's form."""
    nation, region = proxies.table(spark, sf_dir, "nation"), proxies.table(spark, sf_dir, "region")
    categories = region.select(F.col("r_name").alias("category"), (F.col("r_regionkey") + 1).cast("int").alias("place"), F.substring("r_name", 1, 1).alias("icon"))
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    code = F.lpad(F.col("n_nationkey").cast("string"), 6, "0")
    markets = named.select(F.col("n_name").alias("market"), F.col("r_name").alias("category"), F.lit("X").alias("exchange"), F.lit("legacy").alias("report"), F.upper("n_name").alias("report_name"), code.alias("report_code"), F.concat("n_name", F.lit("=F")).alias("price_symbol"))
    path = folder(spark, "registry")
    registry.write_registry(markets, categories, path)
    return registry.read_registry(spark, path)


MARKETS = "market:s category:s exchange:s report:s report_name:s report_code:s price_symbol:s place:l icon:s"


def registry_markets(spark, sf_dir):
    markets, categories, _ = registry_files(spark, sf_dir)
    return shaped(markets.join(categories, "category"), MARKETS)


SQL_MARKETS = "result AS (SELECT n_name AS market, r_name AS category, 'X' AS exchange, 'legacy' AS report, upper(n_name) AS report_name, lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS report_code, n_name || '=F' AS price_symbol, r_regionkey + 1 AS place, substring(r_name, 1, 1) AS icon FROM nation JOIN region ON n_regionkey = r_regionkey)"
GROUPED = "category:s place:l markets:s"


def registry_grouped(spark, sf_dir):
    markets, categories, _ = registry_files(spark, sf_dir)
    return shaped(catalogue.grouped(markets, categories).withColumn("markets", F.array_join("markets", ", ")), GROUPED)


SQL_GROUPED = "result AS (SELECT r_name AS category, r_regionkey + 1 AS place, string_agg(n_name, ', ' ORDER BY n_name) AS markets FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2)"
ORIGINS = "market:s n:l first:t last:t total origin:s"
#: Days that the cache lags behind, by the first letter of a market's name; loading fails for names up to LAST.
LAGS, LAST = {"A": 90, "E": 2}, "AMZ"


def cached_prices(spark, sf_dir):
    """Prices from a cache that lags behind, from a source that fails for some markets, and what is served."""
    prices = materialized(tables.normalize_prices(proxies.prices(spark, sf_dir), F.col("market")))  # every write, load and attempt below reads them
    newest = F.lit(prices.agg(F.max("date")).first()[0])
    lag = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LAGS.items() for x in kv)), F.substring("market", 1, 1)), F.lit(30))
    path = folder(spark, "cache")
    tables.write_cache(prices.where(F.col("date") <= F.date_sub(newest, 400)), path)
    tables.write_cache(prices.where(F.col("date") <= F.date_sub(newest, lag)), path)  # replaces each market's older rows
    cached = tables.read_cache(spark, path).select(*prices.columns)
    close = F.when(F.col("market") <= LAST, F.raise_error(F.lit("no source"))).otherwise(F.col("close"))
    loaded, failures = tables.load_each(prices.select("market").distinct(), lambda keys: prices.join(keys, "market").withColumn("close", close))
    rows = tables.served(cached, loaded, "market", newest, tables.MAX_AGE["prices"], failures)
    origin = F.regexp_replace("origin", r"^(stale_cache: ).*(no source).*$", "$1$2")
    return shaped(rows.groupBy("market", origin.alias("origin")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.sum("close"), 2).alias("total")), ORIGINS)


SQL_ORIGINS = f"""ca AS (SELECT *, max(date) OVER () AS newest, CASE substring(market, 1, 1) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LAGS.items())} ELSE 30 END AS lag FROM prices),
cb AS (SELECT market, any_value(newest) AS newest, max(date) FILTER (date <= newest - lag) AS cached FROM ca GROUP BY 1),
cc AS (SELECT market, CASE WHEN date_diff('day', cached, newest) <= {tables.MAX_AGE['prices']} THEN 'cache' WHEN market > '{LAST}' THEN 'loaded' ELSE 'stale_cache: no source' END AS origin FROM cb),
result AS (SELECT market, origin, count(*) AS n, min(date) AS first, max(date) AS last, round(sum(close), 2) AS total FROM ca JOIN cc USING (market) WHERE origin = 'loaded' OR date <= newest - lag GROUP BY 1, 2)"""


def entries() -> dict[str, tuple]:
    return {
        "registry_markets": (registry_markets, sql(SQL_MARKETS, MARKETS, "tables")),
        "registry_grouped": (registry_grouped, sql(SQL_GROUPED, GROUPED, "tables")),
        "cached_prices": (cached_prices, sql(SQL_ORIGINS, ORIGINS, "tables")),
    }
