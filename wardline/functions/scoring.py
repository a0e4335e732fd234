"""From raw anomaly score to risk score, band, action and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Thresholds on the 0-100 risk score and on the raw score.
BAND_FLOORS = [(80, "critical"), (60, "high"), (40, "elevated")]
ACTION_CEILINGS = [(-0.3, "Quarantine"), (-0.1, "Investigate")]
ACTIONS = ["Quarantine", "Investigate", "Monitor"]


def has_score(raw: Column) -> Column:
    return raw.isNotNull() & ~F.isnan(raw.cast("double"))


def risk_score(raw: Column) -> Column:
    """Clamp to +-0.5 and map to 0..100, lower raw scores being riskier; half-even rounding.

    Without a score (null or NaN) there is no risk score.
    """
    clamped = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), raw.cast("double")))
    return F.when(has_score(raw), F.rint((F.lit(0.5) - clamped) * 100).cast("int"))


def risk_band(score: Column) -> Column:
    chain = F
    for floor, name in BAND_FLOORS:
        chain = chain.when(score >= floor, name)
    return chain.when(score.isNotNull(), "low")


def recommended_action(raw: Column) -> Column:
    chain = F
    for ceiling, name in ACTION_CEILINGS:
        chain = chain.when(raw < ceiling, name)
    return chain.when(has_score(raw), "Monitor")


def display_user(name: Column) -> Column:
    """"jane.doe" to "Jane Doe"; ids and undotted names stay as they are."""
    dotted = name.contains(".") & ~name.startswith("USR")
    return F.when(dotted, F.initcap(F.replace(name, F.lit("."), F.lit(" ")))).otherwise(name)


def display_asset(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def display_type(name: Column) -> Column:
    """"BULK_EXPORT" to "Bulk Export"."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def display_feature(name: Column) -> Column:
    """Underscores to blanks, a blank before each capital, trimmed."""
    spaced = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([A-Z])", " $1")
    return F.trim(spaced)


def display_time(text: Column) -> Column:
    """"2024-01-05 14:30:09" to "05 Jan 2024 at 14:30"; unreadable text is returned unchanged."""
    parsed = F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(parsed, "dd MMM yyyy 'at' HH:mm"), text)


def truth_tag(is_anomaly: Column) -> Column:
    """Tag of a predicted anomaly by its ground truth."""
    return F.when(is_anomaly, "TP").otherwise("FP")


def bar_widths(values: Column) -> Column:
    """|v| as a percentage of the largest |v| of the same alert; all zero when that is zero."""
    sizes = F.transform(values, F.abs)
    top = F.array_max(sizes)
    return F.transform(sizes, lambda v: F.when(top > 0, v / top * 100).otherwise(0.0))
