"""Rounding and number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(c: Column | str, digits: int) -> Column:
    """Half-even rounding by scaling, as numeric arrays are rounded; stays in generated code."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / scale


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals of the rounded value."""
    return F.call_function("format_number", round_to(c, digits), F.lit("0." + "0" * digits))
