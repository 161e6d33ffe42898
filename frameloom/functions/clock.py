"""Monotonic nanoseconds, durations and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def since(later: Column, earlier: Column) -> Column:
    """Null if time went backwards."""
    return F.when(later >= earlier, later - earlier)


def since_or_zero(later: Column, earlier: Column) -> Column:
    return F.greatest(later - earlier, F.lit(0).cast("long"))


def seconds(ns: Column) -> Column:
    return ns.cast("double") / 1e9


def pretty(ns: Column) -> Column:
    """Seconds and milliseconds to three places, microseconds to one, else whole nanoseconds."""
    return (
        F.when(ns >= 1_000_000_000, F.format_string("%.3fs", ns / 1e9))
        .when(ns >= 1_000_000, F.format_string("%.3fms", ns / 1e6))
        .when(ns >= 1_000, F.format_string("%.1fμs", ns / 1e3))
        .otherwise(F.format_string("%dns", ns))
    )


def display(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))
