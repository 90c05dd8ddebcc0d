"""Results as people read them: signed percentages, ranges and German labels. A thin view; nothing is computed from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of codes.
DIRECTIONS = {"bullish": "Bullish", "bearish": "Bearish", "neutral": "Neutral", "conflict": "Konflikt", "none": "–", "n.a.": "Nicht verfügbar"}
STATUS = {"confirmed": "Vollständig bestätigt", "partly_confirmed": "Teilweise bestätigt", "conflicting": "Widersprüchlich", "insufficient": "Daten unzureichend"}
ZONES = {"high": "Extrem hoch", "low": "Extrem niedrig", "neutral": "Neutral", "n.a.": "Nicht verfügbar"}
STATES = {
    "bullish_divergence": "Bullische aktive Divergenz",
    "bearish_divergence": "Bearische aktive Divergenz",
    "bullish_accumulation_mixed": "Bullische Akkumulation + Short-Aufbau",
    "bearish_distribution_mixed": "Bearischer Gegenfluss + Long-Aufbau",
    "bullish_accumulation": "Bullische Akkumulation",
    "bearish_distribution": "Bearischer Gegenfluss",
    "bearish_trend_confirmation": "Bearische Trendbestätigung",
    "bullish_trend_confirmation": "Bullische Trendbestätigung",
    "position_reduction": "Positionsabbau",
    "neutral": "Kein eindeutiges Signal",
}
FLOWS = {
    "long_building": "Long-Aufbau dominiert",
    "short_building": "Short-Aufbau dominiert",
    "long_liquidation": "Long-Liquidation",
    "short_covering": "Short-Covering",
    "position_reduction": "Beidseitiger Positionsabbau",
    "none": "Kein dominanter Flow",
}
GRADES = {"high": "hoch", "medium_high": "mittel bis hoch", "medium": "mittel", "low_medium": "niedrig bis mittel", "low": "niedrig"}
INPUTS = {
    "us_macro": "US-Konjunktur", "us_basics": "wenige US-Reihen", "own_economy": "eigene Volkswirtschaft", "us_side": "US-Seite", "positions": "Positionsdaten", "rates": "Leitzinsen", "real_rates": "Realzins", "curve": "Zinskurve",
    "liquidity": "Geldmenge", "stress": "Stressindex", "inflation": "Teuerung", "growth": "Wirtschaftsleistung", "labour": "Beschäftigung", "dollar": "Dollarkurs", "physical_demand": "Nachfrage nach Barren und Schmuck", "on_chain": "Blockchain-Daten",
    "inventories": "Bestände", "production": "Förderung", "refineries": "Raffinerieauslastung", "opec": "OPEC-Quoten", "counter_currency": "Gegenwährung", "crop_reports": "amtliche Agrarberichte", "weather": "Wetterdaten", "yields": "Ernteerträge",
    "producers": "Erzeugerländer", "herds": "Viehzahlen", "feed": "Futterpreise",
}
MISSING = "–"


def label(code: Column, labels: dict[str, str]) -> Column:
    """The code's label, or the code itself."""
    pairs = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, code), code)


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), MISSING).otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def signed_percent(x: Column) -> Column:
    return F.when(x.isNull(), MISSING).otherwise(F.format_string("%+.1f%%", x * 100))


def move_range(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), MISSING).otherwise(F.concat(signed_percent(low), F.lit(" bis "), signed_percent(high)))


def signed_number(x: Column) -> Column:
    return F.when(x.isNull(), MISSING).otherwise(F.format_string("%+,.0f", x))


def day(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "dd.MM.yyyy"), F.lit(MISSING))


def module_cell(module: str) -> Column:
    """A module's figures in one cell; only its direction if it has none."""
    c = lambda name: F.col(f"{module}_{name}")
    name = label(F.coalesce(c("direction"), F.lit("n.a.")), DIRECTIONS)
    figures = F.concat(name, F.lit(" · "), percent(c("hit_rate")), F.lit(" · n="), c("n").cast("string"), F.lit(" · KI≥"), percent(c("wilson_low")), F.lit(" · Median "), signed_percent(c("median")))
    return F.when(c("direction").isin("bullish", "bearish") & (c("n") > 0), figures).otherwise(name)


def confluence_view(rows: DataFrame) -> DataFrame:
    """The ranked overview, in its order."""
    return rows.select(
        F.col("market").alias("Asset"), F.col("category").alias("Kategorie"), label(F.col("status"), STATUS).alias("Status"), label(F.col("direction"), DIRECTIONS).alias("Richtung"),
        F.concat(F.col("confirmations").cast("string"), F.lit("/3")).alias("Bestätigung"), module_cell("positioning").alias("COT"), module_cell("macro").alias("Fundamental"), module_cell("seasonality").alias("Seasonality"),
        percent(F.col("lower_limit")).alias("Robuste Untergrenze"), F.col("least_sample").alias("Schwächste Stichprobe"),
    )


def zone_view(zones: DataFrame) -> DataFrame:
    return zones.orderBy("market", "place").select(
        "market", F.when(F.col("is_current"), "●").otherwise("").alias("Aktuell"), F.concat(signed_number(F.col("lower")), F.lit(" bis "), signed_number(F.col("upper"))).alias("Netto-Zone"), signed_number(F.col("center")).alias("Zentrum"),
        F.col("n").alias("Besuche"), F.col("up").alias("Gestiegen"), F.col("down").alias("Gefallen"), F.col("direction").alias("Richtung"), percent(F.col("hit_rate")).alias("Trefferquote"), move_range(F.col("range_low"), F.col("range_high")).alias("Bewegungsbereich"),
    )


def flow_view(flows: DataFrame) -> DataFrame:
    """The flow matrix: one row per market and horizon."""
    return flows.select(
        "market", F.concat(F.col("weeks").cast("string"), F.lit(" Woche(n)")).alias("period"), signed_percent(F.col("price_change")).alias("price"), signed_number(F.col("long_change")).alias("longs"), signed_number(F.col("short_change")).alias("shorts"),
        label(F.col("dominant_flow"), FLOWS).alias("flow"), percent(F.col("dominance")).alias("dominance"), label(F.col("state"), STATES).alias("reading"),
    )


def overview_parts(rows: DataFrame) -> DataFrame:
    """How many markets are confirmed, conflicting and insufficient."""
    return rows.agg(*(F.count_if(F.col("status").isin(*s)).alias(n) for n, s in {"confirmed": ("confirmed", "partly_confirmed"), "conflicting": ("conflicting",), "insufficient": ("insufficient",)}.items()))


def coverage_view(rows: DataFrame) -> DataFrame:
    """The coverage of each market in words."""
    named = lambda c: F.when(F.size(c) == 0, MISSING).otherwise(F.array_join(F.transform(c, lambda x: label(x, INPUTS)), ", "))
    return rows.select("market", "category", F.coalesce("country", F.lit(MISSING)).alias("country"), label(F.col("grade"), GRADES).alias("grade"), named(F.col("covered")).alias("covered"), named(F.col("missing")).alias("missing"))


def passes_quality(rate: Column, cases: Column, median: Column, min_rate: float = 0.7, min_cases: int = 25, min_move: float = 0.02) -> Column:
    return F.coalesce((rate >= min_rate) & (cases >= min_cases) & (F.abs(median) >= min_move), F.lit(False))
