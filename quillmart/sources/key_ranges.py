"""Conditions that split a database table into parts of about equal numbers of rows.

Even ranges between the smallest and the largest key give a task as many rows as its range happens to hold.
Quantiles of the keys give ranges of equal numbers of rows. A key that holds several of the parts by itself
cannot be split by a range; its rows are dealt by the remainder of a second column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_quantiles(keys: DataFrame, column: str, parts: int, accuracy: int = 10_000) -> list[int]:
    """The ``parts - 1`` keys that cut ``keys`` into parts of equal numbers of rows; repeated for a heavy key.

    ``keys`` may be the key column alone, read in even ranges, or a sample of it. Spark sketches the quantiles
    on the map side; a part is off by 1 / ``accuracy`` of all rows at most.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx(F.col(column), shares, accuracy)).first()[0]
    return [int(q) for q in found or []]


def quantile_predicates(column: str, quantiles: Sequence[int], deal_by: str | None = None) -> list[str]:
    """Conditions of which every row meets exactly one.

    ``quantiles`` are whole numbers in any order. A key that occurs in them ``n`` times holds about ``n - 1``
    parts and gets a condition of its own; with ``deal_by``, a whole number column, as many as ``n - 1``.
    Rows without a key are with the smallest, rows without a ``deal_by`` with remainder 0.
    """
    for name in (column, deal_by or "x"):
        if not name.replace("_", "").replace(".", "").isalnum():
            raise ValueError(f"{name!r} is no plain column name")
    times = Counter(int(q) for q in quantiles)
    out, low = [], None  # low: smallest key of the range, None before the first

    def between(high: int | None) -> str:
        if low is None:
            return "1 = 1" if high is None else f"({column} < {high} OR {column} IS NULL)"
        return f"{column} >= {low}" if high is None else f"({column} >= {low} AND {column} < {high})"

    for key in sorted(times):
        n = times[key] - 1
        # A range that nothing can be in, below the smallest key or behind a heavy neighbour, is left out.
        if low is None or low < key:
            out.append(between(key))
        low = key
        if n and deal_by is not None and n > 1:
            out += [
                f"({column} = {key} AND " + (f"(MOD(ABS({deal_by}), {n}) = 0 OR {deal_by} IS NULL))" if i == 0 else f"MOD(ABS({deal_by}), {n}) = {i})")
                for i in range(n)
            ]
            low = key + 1
        elif n:
            out.append(f"{column} = {key}")
            low = key + 1
    return [*out, between(None)]
