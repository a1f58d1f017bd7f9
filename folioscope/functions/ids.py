"""Identifiers and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base36(number: Column) -> Column:
    """A non-negative number in base 36, lower case."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def device_id(millis: Column, noise: Column) -> Column:
    """STR-19: ``device_<time>_<noise>``, both in base 36; ``noise`` is any non-negative number,
    such as ``abs(xxhash64(...))`` for ids that must be the same again."""
    return F.concat(F.lit("device_"), base36(millis), F.lit("_"), base36(noise))


def clock(at: Column) -> Column:
    """DTE-02: hours and minutes."""
    return F.date_format(at, "HH:mm")
