"""Union, slice replacement, long/wide."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col, strict_mean


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side are NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def replace_slice(base: DataFrame, patch: DataFrame, predicate: Column) -> DataFrame:
    """Drop the rows of `base` that match, or for which the predicate is unknown, and add `patch`.

    No sort: row order belongs to the sink.
    """
    return bind_rows(base.where(~predicate), patch)


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per id and column; NULL cells are kept."""
    return df.unpivot([col(c) for c in ids], [col(c) for c in cols], name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    columns: Sequence[str] | Mapping[str, str],
    agg: Callable[[Column], Column] = strict_mean,
) -> DataFrame:
    """One column per parameter, duplicates reduced by `agg` (default: mean, NULL if any is NULL).

    `columns` lists the parameters, or maps parameter -> output column. Each column is one
    conditional aggregate: a single shuffle on the ids with map-side combine, and no extra job to
    find the distinct parameters.
    """
    mapping = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    if agg is strict_mean:
        # the mean of the rows of one parameter; NULL as soon as one of them is NULL
        cells = []
        for parameter, out in mapping.items():
            mine = col(names) == parameter
            x = F.when(mine, col(values))
            whole = F.count(x) == F.count(F.when(mine, F.lit(1)))
            cells.append(F.when(whole, F.avg(x)).alias(out))
        keyed = df.groupBy(*[col(c) for c in ids])
        return keyed.agg(*cells)
    wide = df.groupBy(*[col(c) for c in ids]).pivot(names, list(mapping)).agg(agg(col(values)))
    return wide.withColumnsRenamed(dict(mapping))
