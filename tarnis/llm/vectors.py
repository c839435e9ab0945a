"""Embedding rows as integer vectors, and the cells in which a query set meets all rows in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Squared lengths stay below this, so that any inner product of two vectors fits a long.
LONGEST = 4.0e18


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vec_col: str, longest: float = LONGEST) -> DataFrame:
    """vec_id and v, the components as floor(scale * x) with x as double.

    Rows whose vector is null, holds a null or a component that isn't finite, or whose squared length after scaling reaches
    `longest` are left out; so are all other columns.
    """
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    floors = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    small = F.forall(v, lambda x: F.abs(x * F.lit(float(scale))) < F.lit(2.0**31 - 1))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    rows = rows.where(v.isNotNull()).where(whole).where(small).select("vec_id", floors.alias("v"))
    return rows.where(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x) < F.lit(float(longest))).select("vec_id", v.cast("array<int>").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), dims)


def dealt(rows: DataFrame, slot: Column, groups: int, others: int, own: str, other: str) -> DataFrame:
    """Each row in its group, once for each of the other side's groups it has to meet."""
    return rows.withColumn(own, F.pmod(slot, F.lit(groups)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def best(found: DataFrame, by: str, item: str, score: str, k: int) -> DataFrame:
    """The k rows of each `by` with the highest score, equal scores by ascending item (nulls last), with their rank."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
