"""The engine's tables from the star-schema test tables: regions as markets.

positions: Tuesdays of shipping weeks, return flags as trader groups, line status as side, quantities as contracts; prices: mean order
price a day in whole cents; macro: mean order price a month, a series for every order priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import with_nets

GROUPS = {"A": "comm", "N": "noncomm", "R": "nonrep"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Customers' or suppliers' keys with their region's name as ``market``."""
    source, prefix = ("customer", "c") if key == "c_custkey" else ("supplier", "s")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias(f"{prefix}_nationkey"), F.col("r_name").alias("market"))
    return table(spark, sf_dir, source).select(key, f"{prefix}_nationkey").join(named, f"{prefix}_nationkey").select(key, "market")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity")
    week = F.date_add(F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date"), 1)
    at = lines.join(regions(spark, sf_dir, "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("date", week)
    amount = lambda flag, status: F.coalesce(F.sum(F.when((F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status), F.col("l_quantity"))), F.lit(0.0))
    sides = [amount(f, s).alias(f"{g}_{side}") for f, g in GROUPS.items() for s, side in (("O", "long"), ("F", "short"))]
    return with_nets(at.groupBy("market", "date").agg(F.sum("l_quantity").alias("oi"), *sides))


def cents(price: Column) -> Column:
    return F.sum(F.round(price * 100).cast("long")) / F.count("*") / 100


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    at = orders.join(regions(spark, sf_dir, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return at.groupBy("market", "date").agg(cents(F.col("o_totalprice")).alias("close"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_totalprice", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.substring("o_orderpriority", 1, 1).alias("series_key"))
    return orders.groupBy("series_key", "date").agg(cents(F.col("o_totalprice")).alias("value"))


#: The same tables as common table expressions in SQL.
SQL = """
s_region AS (SELECT s_suppkey, r_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c_region AS (SELECT c_custkey, r_name AS market FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sides AS (
  SELECT market, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) + 1 AS date, sum(l_quantity) AS oi,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'O'), 0.0) AS comm_long, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F'), 0.0) AS comm_short,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'O'), 0.0) AS noncomm_long, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N' AND l_linestatus = 'F'), 0.0) AS noncomm_short,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'O'), 0.0) AS nonrep_long, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'F'), 0.0) AS nonrep_short
  FROM lineitem JOIN s_region ON l_suppkey = s_suppkey GROUP BY 1, 2
),
positions AS (SELECT *, comm_long - comm_short AS commercial_net, noncomm_long - noncomm_short AS noncommercial_net, nonrep_long - nonrep_short AS nonreportable_net FROM sides),
prices AS (
  SELECT market, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close
  FROM orders JOIN c_region ON o_custkey = c_custkey GROUP BY 1, 2
),
macro AS (
  SELECT substring(o_orderpriority, 1, 1) AS series_key, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value
  FROM orders GROUP BY 1, 2
)"""
