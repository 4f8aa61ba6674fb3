"""Null, NaN and array rules of the source pipeline's SQL dialect, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_greatest(*cols: Column) -> Column:
    """Greatest value, null if any is null (Spark's skips nulls)."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*cols))


def over(a: Column, b) -> Column:
    """a > b where NaN compares as false."""
    b = b if isinstance(b, Column) else F.lit(b)
    return (a > b) & ~F.isnan(a) & ~F.isnan(b.cast("double"))


def count_or_null(array: Column) -> Column:
    """Size of an array, null for an empty one: an aggregate over nothing is null there."""
    return F.nullif(F.size(array), F.lit(0))


def sequence0(low: Column, high: Column) -> Column:
    """low..high, empty if high < low, null if either is null."""
    empty = F.array().cast("array<bigint>")
    return F.when(low.isNull() | high.isNull(), F.lit(None)).when(high < low, empty).otherwise(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def drop_last_parts(label: Column, parts: int = 2, sep: str = "-") -> Column:
    """``City-Region-CC`` without its last parts, so that hyphens in the city stay."""
    pieces = F.split(label, sep)
    return F.when(F.size(pieces) > parts, F.array_join(F.slice(pieces, 1, F.size(pieces) - parts), sep)).otherwise(label)


def strip_suffix(label: Column, suffix: Column) -> Column:
    """The label without exactly this suffix."""
    return F.when(F.endswith(label, suffix), F.substring(label, F.lit(1), F.length(label) - F.length(suffix))).otherwise(label)
