"""Normalisation of raw text columns and small parsers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column, default: str = "") -> Column:
    """Null to ``default``, then trim and lower-case: how every category is compared."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(default))))


def truthy(c: Column) -> Column:
    """1 for true or "True" in any case, 0 for everything else including null."""
    return F.when(F.lower(c.cast("string")) == "true", 1).otherwise(0)


def pipe_list(c: Column) -> Column:
    """"a| b||c" to ["a", "b", "c"]: trimmed, blanks dropped, null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[|]"), strip)
    return F.filter(parts, lambda x: x != "")


def in_list(items: Column, value: Column) -> Column:
    """Null-safe membership of a trimmed value in a clean list."""
    return F.coalesce(F.array_contains(items, strip(F.coalesce(value, F.lit("")))), F.lit(False))


def time_class(ts: Column) -> Column:
    """Weekend first; otherwise by hour: 6-7 early, 8-17 business, 18-21 after hours, else night."""
    hour = F.hour(ts)
    return (
        F.when(ts.isNull(), F.lit(None))
        .when(F.weekday(ts) >= 5, "weekend")
        .when(hour.between(6, 7), "early_morning")
        .when(hour.between(8, 17), "business_hours")
        .when(hour.between(18, 21), "after_hours")
        .otherwise("night")
    )


def hours_range(c: Column) -> tuple[Column, Column]:
    """"8-18" to its two hours; malformed text gives nulls."""
    part = lambda i: F.get(F.split(c, "-"), i).try_cast("int")
    return part(0), part(1)


def time_cell(ts: Column, seconds: int) -> Column:
    """Number of the ``seconds`` long interval that a time falls into."""
    micros, width = F.unix_micros(ts.cast("timestamp")), F.lit(seconds * 1_000_000)
    return F.call_function("div", micros - F.pmod(micros, width), width)


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over name=value pairs in name order; nulls are marked, so they differ from ''."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\\N")))
        for c in sorted(columns)
    ]
    return F.sha2(F.concat_ws("|", *pairs), 256)
