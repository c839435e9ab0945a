from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Floating point columns cut to a number of decimals, as the SQL side does. Adding 0.0 turns
    a negative zero into zero."""
    names = [c for c, kind in df.dtypes if kind == "double" and (only is None or c in only)]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})
