"""Column expressions shared by the operators. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIVE, NEUTRAL, POSITIVE = "Negative", "Neutral", "Positive"


def classify_rating(rating: Column) -> Column:
    """Label of one review: 1-2 negative, 3 neutral, 4-5 positive, NULL stays NULL."""
    return (
        F.when(rating <= 2, NEGATIVE).when(rating == 3, NEUTRAL).when(rating >= 4, POSITIVE)
    )


def classify_average(average: Column) -> Column:
    """Label of an average rating: that of the average rounded to a whole rating."""
    return (
        F.when(average < 2.5, NEGATIVE).when(average < 3.5, NEUTRAL).when(average >= 3.5, POSITIVE)
    )


def in_year(date: Column, year: int) -> Column:
    """``year(date) = year`` as a half-open range, which reaches the Parquet scan."""
    return (date >= F.lit(dt.date(year, 1, 1))) & (date < F.lit(dt.date(year + 1, 1, 1)))


def days_since(date: Column, as_of: dt.date | str | None = None) -> Column:
    """Days from ``date`` to ``as_of`` (today when not given)."""
    return F.datediff(F.current_date() if as_of is None else F.lit(as_of).cast("date"), date)


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent to two decimals; NULL when the previous value is zero."""
    return F.round(F.try_divide(current - previous, previous) * 100, 2)


def gender_group(gender: Column) -> Column:
    """Male and Female as they are, everything else including NULL as Others."""
    return F.when(gender.isin("Male", "Female"), gender).otherwise("Others")


def short_title(title: Column, width: int = 35) -> Column:
    """Title cut to ``width`` characters plus an ellipsis when it is longer."""
    return F.when(
        F.length(title) > width, F.concat(F.substring(title, 1, width), F.lit("…"))
    ).otherwise(title)
