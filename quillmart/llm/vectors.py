"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import quoted


def usable(vector: Column) -> Column:
    """Not NULL, not zero, and without NULL or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of lists as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def one_per_id(rows: DataFrame, id_col: str, vec_col: str, *others: str) -> DataFrame:
    """Usable vectors as ``id``, ``vec``; of rows that share an id the smallest vector. Rows without an id go."""
    kept = rows.filter(usable(quoted(vec_col)) & quoted(id_col).isNotNull())
    found = F.min(F.struct(quoted(vec_col).cast("array<double>").alias("vec"), *(quoted(c) for c in others)))
    return kept.groupBy(quoted(id_col).alias("id")).agg(found.alias("row")).select("id", "row.*")


def common_length(rows: DataFrame) -> int | None:
    """The length most vectors ``vec`` have; the smaller of two. None for an empty table."""
    n = F.size("vec").alias("n")
    first = rows.groupBy(n).count().orderBy(F.desc("count"), "n").first()
    return first and first["n"]
