from quillmart.functions.expressions import (
    classify_average,
    classify_rating,
    days_since,
    gender_group,
    in_year,
    percent_change,
    short_title,
)

__all__ = [
    "classify_average",
    "classify_rating",
    "days_since",
    "gender_group",
    "in_year",
    "percent_change",
    "short_title",
]
