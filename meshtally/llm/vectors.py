"""Vectors as whole numbers, and their packed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_numbers(df: DataFrame, scale: int, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``vector``: floor(scale * x) per component, x as double.

    Rows whose embedding is NULL or holds NULL or non-finite components are left out.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col("embedding").isNotNull() & ~bad).select(
        *keep, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("vector"))


def padded(vector: str, size: int) -> Column:
    """The vector with zeros up to ``size`` components."""
    return F.concat(F.col(vector), F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size(vector)))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` whole numbers, no NULLs among them, as rows."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
