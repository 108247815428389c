"""Column functions: lenient parsing, symbol keys, missing values, averaged percent ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def lenient_double(c: Column | str) -> Column:
    """A number, or NULL where the text is none."""
    c = F.col(c) if isinstance(c, str) else c
    return finite(c.try_cast("double"))


def lenient_date(c: Column | str) -> Column:
    """The day of a date or time in text, or NULL where the text is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.try_to_timestamp(F.trim(c.cast("string"))))


def symbol(c: Column | str) -> Column:
    """Trimmed, upper case, without an .AX suffix."""
    return F.regexp_replace(F.upper(F.trim(c)), r"\.AX$", "")


def symbol_key(c: Column | str) -> Column:
    """The key that symbols of different sources share: letters and digits before the first underscore."""
    return F.regexp_replace(F.split_part(F.upper(F.trim(c)), F.lit("_"), F.lit(1)), "[^A-Z0-9]", "")


def truthy(c: Column | str) -> Column:
    """1, true, yes or y in any case; NULL is false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c between the bounds; NULL stays NULL."""
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(c.isNotNull(), bounded)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL for a zero divisor or a result that is not finite."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def average_percent_rank(c: Column | str, by: str | list[str], ascending: bool = True) -> Column:
    """Average rank over the number of values; NULL for NULL. One sort: ties share rank() and the running count."""
    c = F.col(c) if isinstance(c, str) else c
    group = Window.partitionBy(by)
    order = group.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(c.isNotNull(), (F.rank().over(order) + F.count(c).over(upto)) / 2 / F.count(c).over(group))


def mean_of_present(columns: list[Column]) -> Column:
    """The mean of the values that are there; NULL if none is."""
    zero = F.lit(0.0)
    total = sum((F.coalesce(c, zero) for c in columns), zero)
    return F.try_divide(total, sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0)))


def dot(features: Column | str, weights: Column | str) -> Column:
    """Sum of products of two arrays of numbers."""
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
