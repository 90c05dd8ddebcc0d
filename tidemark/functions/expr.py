"""Column expressions: shares, zones, scores, intervals. Missing values are NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: z of a 95 % interval.
Z95 = 1.96


def number(c: Column) -> Column:
    """A double; text that isn't a number, NaN and infinities become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def day(c: Column) -> Column:
    """A date without time or zone; what can't be read becomes NULL."""
    return F.to_date(F.try_to_timestamp(c.cast("string")))


def share(part: Column, whole: Column) -> Column:
    """``part`` of ``whole``; NULL where the whole is 0."""
    return F.try_divide(part, F.nullif(whole, F.lit(0)))


def change(now: Column, then: Column) -> Column:
    """Relative change; NULL where there was nothing before."""
    return F.try_divide(now, then) - 1


def zone(value: Column, cutoff: float) -> Column:
    """``high``, ``low``, ``neutral`` or ``n.a.`` on a scale from 0 to 100."""
    return F.when(value.isNull(), "n.a.").when(value >= cutoff, "high").when(value <= 100 - cutoff, "low").otherwise("neutral")


def extreme_side(value: Column, cutoff: float) -> Column:
    """``high`` or ``low``; NULL if the value isn't extreme."""
    return F.when(value >= cutoff, "high").when(value <= 100 - cutoff, "low")


def same_extreme(index: Column, percentile: Column, cutoff: float) -> Column:
    return F.coalesce(extreme_side(index, cutoff) == extreme_side(percentile, cutoff), F.lit(False))


def percentile_state(p: Column, cutoff: float) -> Column:
    """State of a percentile; the extreme states come before the merely high and low ones."""
    return (
        F.when(p.isNull(), "unknown").when(p >= cutoff, "extreme_high").when(p <= 100 - cutoff, "extreme_low").when(p >= 80, "high").when(p <= 20, "low").otherwise("normal")
    )


def dominance(active: Column, other: Column) -> Column:
    """The active change's share of both changes' sizes; 0 if nothing changed."""
    return F.coalesce(F.try_divide(F.abs(active), F.abs(active) + F.abs(other)), F.lit(0.0))


def flow_direction(long_change: Column, short_change: Column, long_z: Column, short_z: Column) -> Column:
    """Where the large speculators' flows point; if both sides grow or both shrink, the more unusual one decides."""
    long_leads = F.coalesce(F.abs(long_z), F.lit(0.0)) >= F.coalesce(F.abs(short_z), F.lit(0.0))
    short_leads = F.coalesce(F.abs(short_z), F.lit(0.0)) >= F.coalesce(F.abs(long_z), F.lit(0.0))
    return (
        F.when((long_change > 0) & (short_change <= 0), "bullish")
        .when((long_change <= 0) & (short_change > 0), "bearish")
        .when((long_change > 0) & (short_change > 0), F.when(long_leads, "bullish").otherwise("bearish"))
        .when((long_change < 0) & (short_change < 0), F.when(short_leads, "bullish").otherwise("bearish"))
        .otherwise("neutral")
    )


def flow_label(long_change: Column, short_change: Column, long_z: Column, short_z: Column) -> Column:
    """What the flows are, with ``strong_`` before it if one of them is unusual."""
    strong = F.greatest(F.coalesce(F.abs(long_z), F.lit(0.0)), F.coalesce(F.abs(short_z), F.lit(0.0))) >= 1.5
    toward = flow_direction(long_change, short_change, long_z, short_z)
    both = F.when((long_change > 0) & (short_change > 0), "_both_growing").when((long_change < 0) & (short_change < 0), "_both_shrinking").otherwise("")
    return F.when(toward == "neutral", "unclear").otherwise(F.concat(F.when(strong, "strong_").otherwise(""), toward, F.lit("_flow"), both))


def score_label(score: Column) -> Column:
    return (
        F.when(score >= 50, "strongly_bullish").when(score >= 20, "slightly_bullish").when(score <= -50, "strongly_bearish").when(score <= -20, "slightly_bearish").otherwise("mixed")
    )


def regime_label(value: Column) -> Column:
    return F.when(value.isNull(), "n.a.").when(value >= 0.5, "positive").when(value <= -0.5, "negative").otherwise("neutral")


def squash(raw: Column) -> Column:
    """A weighted mean of z-scores on a scale from -100 to 100."""
    return F.tanh(raw / 1.25) * 100


def effect(contribution: Column) -> Column:
    return F.when(contribution > 0.10, "supportive").when(contribution < -0.10, "burdening").otherwise("neutral")


def similarity(distance: Column, scale: Column) -> Column:
    """100 at distance 0, less the further away on the scale of typical distances."""
    return 100 * F.exp(-distance / F.greatest(scale, F.lit(1e-9)))


def log_edge(median: Column, hit_rate: Column, cases: Column) -> Column:
    return F.abs(median) * hit_rate * F.log1p(cases)


def wilson(successes: Column, total: Column, upper: bool, z: float = Z95) -> Column:
    """A limit of Wilson's interval of a rate; NULL without cases or with more successes than cases."""
    n = total.cast("double")
    p = successes / n
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    edge = (p + z * z / (2 * n) + (spread if upper else -spread)) / (1 + z * z / n)
    bounded = F.least(F.lit(1.0), edge) if upper else F.greatest(F.lit(0.0), edge)
    return F.when((total > 0) & (successes >= 0) & (successes <= total), bounded)


def cluster_quality(bias: Column, low: Column, n: Column, silhouette: Column) -> Column:
    depth = F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(50.0)))
    apart = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (silhouette + 0.1) / 0.6))
    return F.when(bias == "neutral", 0.0).otherwise(100 * (0.65 * low + 0.20 * depth + 0.15 * apart))


def index_quality(low: Column, n: Column, median_distance: Column, up_rate: Column, down_rate: Column) -> Column:
    depth = F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(50.0)))
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - median_distance / 3.5))
    return 100 * (0.55 * low + 0.25 * depth + 0.20 * near) * F.abs(up_rate - down_rate)


def cache_key(name: Column) -> Column:
    """A file name: lower case, one underscore for every run of other characters."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def availability(observed: Column, frequency: Column, lag_days: Column) -> Column:
    """The day from which an observation counts as known: its period's end plus the release lag."""
    quarter_end = F.last_day(F.add_months(F.trunc(observed, "quarter"), 2))
    end = F.when(frequency == "monthly", F.last_day(observed)).when(frequency == "quarterly", quarter_end).otherwise(observed)
    return F.date_add(end, lag_days.cast("int"))


def iso_year(d: Column) -> Column:
    """The year of the ISO week, the one that its Thursday is in."""
    return F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3))


def curve_week(d: Column) -> Column:
    """The ISO week, with week 53 in week 52."""
    return F.least(F.weekofyear(d), F.lit(52))
