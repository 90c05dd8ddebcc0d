"""Registries of markets as nested files: categories with their order, and assets with the category, exchange and names that providers know them by.

A file holds ``{"categories": {name: {"icon", "order"}}, "assets": {name: {...}}}`` as JSON, or as YAML where that package is there. Spark reads whole files,
wherever they are, and tasks take them apart, one row an entry; any number of files makes one registry.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import last_per_key

#: Fields of an asset in a file, and the columns that they become.
ASSET = {"category": "category", "exchange": "exchange", "cftc_report": "report", "cftc_market_name": "report_name", "cftc_code": "report_code", "price_symbol": "price_symbol"}
CATEGORY = {"icon": "icon", "order": "place"}
ENTRIES = "path string, kind string, name string, " + ", ".join(f"{c} string" for c in [*ASSET.values(), "icon"]) + ", place int, error string"


def parsed(text: str) -> dict:
    """JSON, or else YAML."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def entries_of(path: str, text: str) -> Iterator[dict]:
    """A row for each category and asset; fields that are missing or unknown make the row an error, and so does a file that can't be read."""
    try:
        whole = parsed(text) or {}
        groups = [("category", CATEGORY, whole.get("categories") or {}), ("asset", ASSET, whole.get("assets") or {})]
    except Exception as failure:  # of whatever kind: the file has an error, the others are read
        yield {"path": path, "kind": "file", "error": f"{type(failure).__name__}: {failure}".splitlines()[0]}
        return
    for kind, fields, group in groups:
        for name, given in group.items():
            given = given if isinstance(given, dict) else {}
            wrong = [f"missing {f}" for f in fields if f not in given] + [f"unknown {f}" for f in given if f not in fields]
            values = {c: given.get(f) for f, c in fields.items()}
            yield {"path": path, "kind": kind, "name": str(name), **{c: v if c == "place" or v is None else str(v) for c, v in values.items()}, "error": "; ".join(wrong) or None}


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the files under ``path``, errors among them."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    names = StructType.fromDDL(ENTRIES).names

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [e for p, text in zip(frame["path"], frame["value"]) for e in entries_of(p, text)]
            out = pd.DataFrame(found, columns=names).astype(object)
            yield out.where(out.notna(), None).astype({"place": "Int32"})

    return files.mapInPandas(rows, ENTRIES)


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Markets (``market, category, exchange, report, report_name, report_code, price_symbol``), categories (``category, place, icon``) and errors (``path, kind, name, error``).

    Of entries with one name in several files the one of the last path counts. Markets whose category no file has are errors, too.
    """
    entries = read_entries(spark, path)
    sound = last_per_key(entries.where("error IS NULL"), ["kind", "name"], F.col("path"))
    categories = sound.where("kind = 'category'").select(F.col("name").alias("category"), "place", "icon")
    markets = sound.where("kind = 'asset'").select(F.col("name").alias("market"), *ASSET.values(), "path")
    lost = markets.join(categories, "category", "left_anti").select("path", F.lit("asset").alias("kind"), F.col("market").alias("name"), F.concat(F.lit("unknown category "), "category").alias("error"))
    errors = entries.where("error IS NOT NULL").select("path", "kind", "name", "error").unionByName(lost)
    return markets.join(categories.select("category"), "category").select("market", *ASSET.values()), categories, errors


def write_registry(markets: DataFrame, categories: DataFrame, path: str) -> None:
    """JSON files, one a category with its assets, from the tables of ``read_registry``."""
    item = lambda fields: F.struct(*(F.col(c).alias(f) for f, c in fields.items()))
    entry = F.map_from_entries(F.array(F.struct("category", item(CATEGORY))))
    assets = markets.groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("market", item(ASSET))))).alias("assets"))
    nested = categories.join(assets, "category", "left").select(F.to_json(F.struct(entry.alias("categories"), "assets"), {"ignoreNullFields": "false"}).alias("value"), "category")
    nested.repartitionByRange(max(1, categories.count()), "category").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
