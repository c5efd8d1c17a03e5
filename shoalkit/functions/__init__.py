"""Column helpers with the missing-value and rounding rules of the metrics."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_missing(column: Column) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.bool_or(column.isNull()), F.lit(None)).otherwise(F.sum(column))


def text_or_na(column: Column) -> Column:
    """Text form in which a missing value reads ``NA``."""
    return F.coalesce(column.cast("string"), F.lit("NA"))


def group_or_null(column: Column, pattern: str, group: int) -> Column:
    """Regex group, NULL where the pattern does not match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def thousands(column: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(column, 0)


def plain_number(column: Column) -> Column:
    """Number as text, at most six decimals, without trailing zeros."""
    return F.regexp_replace(column.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")


def whole_number(column: Column) -> Column:
    """Number as text after rounding half to even."""
    return F.bround(column, 0).cast("long").cast("string")


def slug(column: Column) -> Column:
    """Lower case, spaces to underscores."""
    return F.regexp_replace(F.lower(column), " ", "_")


def bubble_radius(value: Column, largest: Column) -> Column:
    """10 to 60 in proportion to the largest value; 5 for zero."""
    return F.when(value == 0, F.lit(5.0)).otherwise(10 + F.try_divide(value.cast("double"), largest.cast("double")) * 50)


def rescaled(value: Column, low: Column, high: Column, start=4.0, stop=14.0, constant=8.0) -> Column:
    """Linear map of [low, high] to [start, stop]; a constant if there is one value only."""
    share = F.try_divide(value - low, high - low)
    return F.when(low == high, F.lit(constant)).otherwise(start + (stop - start) * share)


def mean_se(value: Column, single=None):
    """``n``, ``mean`` and ``se`` aggregates; ``se`` is ``single`` for one value or none."""
    n = F.count(value)
    return (
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(single)).alias("se"),
    )
