"""Series operators: moving average, autocorrelation, change periods, whitening."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnis.functions.columns import col
from tarnis.operators.order import over_neighbours, with_row_index, with_running_total

MAX_LAG = 36


def centered_mean(
    df: DataFrame,
    value: str,
    order: Sequence[str] | str,
    k: int = 3,
    by: Sequence[str] = (),
    out: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Equal-weight moving average over k rows, centred; NULL at the ends and next to a NULL."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    order = [order] if isinstance(order, str) else list(order)
    h, x = k // 2, col(value)

    def mean(w):
        frame = w.rowsBetween(-h, h)
        return F.when(F.count(x).over(frame) == k, F.avg(x).over(frame))

    return over_neighbours(df, {out or f"{value}_mean{k}": mean}, order, by, h, h, bounded)


# --- autocorrelation ---------------------------------------------------------------------------
#
# A run of consecutive values is summarised by its length, mean, lagged products about that mean,
# and its first and last `max_lag` values. Two runs that follow each other combine exactly from
# these alone, so tasks summarise what they hold and only summaries are shuffled.


def _run(values: np.ndarray, max_lag: int) -> dict:
    y = values - values.mean()
    products = np.array([np.dot(y[: len(y) - k], y[k:]) if k < len(y) else 0.0 for k in range(max_lag + 1)])
    return {
        "n": len(values),
        "mean": float(values.mean()),
        "products": products,
        "head": values[:max_lag],
        "tail": values[max(0, len(values) - max_lag) :],
    }


def _products_about(run: dict, centre: float, max_lag: int) -> np.ndarray:
    """Lagged products of a run about another centre: edges tell which values lack a partner."""
    d = run["mean"] - centre
    lags = np.arange(max_lag + 1)
    pairs = np.maximum(run["n"] - lags, 0)
    head = np.concatenate([[0.0], np.cumsum(run["head"] - run["mean"])])
    tail = np.concatenate([[0.0], np.cumsum((run["tail"] - run["mean"])[::-1])])
    # deviations sum to 0, so the sum without the last k values is minus the sum of those values
    dropped = np.minimum(lags, len(head) - 1)
    moved = run["products"] - d * (head[dropped] + tail[dropped]) + pairs * d * d
    return np.where(pairs > 0, moved, 0.0)


def _join_runs(a: dict, b: dict, max_lag: int) -> dict:
    n = a["n"] + b["n"]
    mean = a["mean"] + (b["mean"] - a["mean"]) * b["n"] / n
    products = _products_about(a, mean, max_lag) + _products_about(b, mean, max_lag)
    left, right = a["tail"] - mean, b["head"] - mean
    both = np.concatenate([left, right])
    for k in range(1, max_lag + 1):
        first = max(0, len(left) - k)
        last = min(len(left), len(both) - k)
        if last > first:
            products[k] += np.dot(both[first:last], both[first + k : last + k])
    return {
        "n": n,
        "mean": mean,
        "products": products,
        "head": np.concatenate([a["head"], b["head"]])[:max_lag],
        "tail": np.concatenate([a["tail"], b["tail"]])[-max_lag:],
    }


def _partial(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0..L], by the Durbin-Levinson recursion."""
    out = np.full(len(r), np.nan)
    phi = np.zeros(0)
    v = 1.0
    for k in range(1, len(r)):
        a = (r[k] - np.dot(phi, r[k - 1 : 0 : -1][: len(phi)])) / v if v > 1e-12 else np.nan
        if not np.isfinite(a):
            break
        phi = np.concatenate([phi - a * phi[::-1], [a]])
        v *= 1 - a * a
        out[k] = a
    return out


def correlogram(
    df: DataFrame,
    value: str,
    order: Sequence[str] | str,
    max_lag: int = MAX_LAG,
    by: Sequence[str] = (),
) -> DataFrame:
    """(lag, acf, pacf) per series, in row order; rows without a value are left out.

    One range shuffle sorts the rows; a series of any length is summarised in pieces. A constant
    series, and lags beyond its length, give NULL.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(by)
    rows = df.select(*[col(c) for c in keys], *[col(c).alias(f"_o{i}") for i, c in enumerate(order)], col(value).cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sort = [*keys, *[f"_o{i}" for i in range(len(order))]]
    # the value comes last, so rows that share a time can still be split over partitions
    sort = [col(c) for c in [*sort, "_x"]]
    ordered = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = ordered.select(*keys, "_x", F.spark_partition_id().alias("_part"))

    fields = [ordered.schema[c] for c in keys]
    partial_schema = T.StructType(
        [
            *fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_n", T.LongType()),
            T.StructField("_mean", T.DoubleType()),
            *[T.StructField(f, T.ArrayType(T.DoubleType())) for f in ("_products", "_head", "_tail")],
        ]
    )

    def emit(key, part, run):
        record = dict(zip(keys, key))
        record.update(_part=part, _n=run["n"], _mean=run["mean"], _products=run["products"].tolist())
        record.update(_head=run["head"].tolist(), _tail=run["tail"].tolist())
        return record

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, run, part = None, None, 0
        for pdf in batches:
            done = []
            if pdf.empty:
                continue
            part = int(pdf["_part"].iloc[0])
            if keys:
                k = pdf[keys]
                changed = (k != k.shift()) & ~(k.isna() & k.shift().isna())
                starts = np.flatnonzero(changed.any(axis=1).to_numpy())
                starts = starts if len(starts) and starts[0] == 0 else np.r_[0, starts]
            else:
                starts = np.array([0])
            x = pdf["_x"].to_numpy()
            for s, e in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(None if pd.isna(v) else v for v in (pdf[c].iloc[s] for c in keys))
                piece = _run(x[s:e], max_lag)
                if run is not None and key == current:
                    run = _join_runs(run, piece, max_lag)
                else:
                    if run is not None:
                        done.append(emit(current, part, run))
                    current, run = key, piece
            if done:
                yield pd.DataFrame(done)
        if run is not None:
            yield pd.DataFrame([emit(current, part, run)])

    pieces = ordered.mapInPandas(summarise, partial_schema)

    result_schema = T.StructType(
        [
            *fields,
            T.StructField("lag", T.IntegerType()),
            T.StructField("acf", T.DoubleType()),
            T.StructField("pacf", T.DoubleType()),
        ]
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        run = None
        columns = ("_n", "_mean", "_products", "_head", "_tail")
        for n, mean, *arrays in pdf.sort_values("_part", kind="stable")[list(columns)].itertuples(index=False):
            products, head, tail = (np.asarray(a, dtype=float) for a in arrays)
            piece = {"n": n, "mean": mean, "products": products, "head": head, "tail": tail}
            run = piece if run is None else _join_runs(run, piece, max_lag)
        c = run["products"]
        varies = c[0] > 1e-24 * max(1.0, run["mean"] ** 2) * run["n"]
        r = np.full(max_lag + 1, np.nan)
        if varies:
            known = np.arange(max_lag + 1) < run["n"]
            r[known] = c[known] / c[0]
        p = _partial(r[: min(max_lag + 1, run["n"])]) if varies else r
        p = np.concatenate([p, np.full(max_lag + 1 - len(p), np.nan)])
        out = {k: [pdf[k].iloc[0]] * (max_lag + 1) for k in keys}
        none = lambda a: [None if np.isnan(v) else float(v) for v in a]
        return pd.DataFrame({**out, "lag": range(max_lag + 1), "acf": none(r), "pacf": none(p)})

    # summaries of one series: one per task that held a part of it
    if not keys:
        pieces = pieces.withColumn("_series", F.lit(0))
    return pieces.groupBy(*(keys or ["_series"])).applyInPandas(finish, result_schema)


def acf(df, value, order, max_lag: int = MAX_LAG, by: Sequence[str] = ()) -> DataFrame:
    """Autocorrelation about the overall mean, denominator at lag 0: (lag, acf)."""
    return correlogram(df, value, order, max_lag, by).drop("pacf")


def pacf(df, value, order, max_lag: int = MAX_LAG, by: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelation, lags 1..max_lag: (lag, pacf)."""
    return correlogram(df, value, order, max_lag, by).drop("acf").where("lag > 0")


# --- change periods ----------------------------------------------------------------------------


def significant_change(df: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Null_test: the interval includes 0; sig: 1 = change, 2 = no change."""
    includes_zero = (col(lower) <= 0) & (col(upper) >= 0)
    return df.withColumn("Null_test", includes_zero).withColumn(
        "sig", F.when(includes_zero, 2).when(~includes_zero, 1)
    )


def change_periods(
    df: DataFrame,
    order: str,
    flag: str,
    by: Sequence[str] = (),
    bounded: bool = False,
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Runs of consecutive rows with a true flag: (start, end, n).

    A run starts where the flag turns true; a running count of starts numbers the runs. Runs are
    reduced map-side, so one run that spans most of the series is not gathered in one task.
    """
    keys, seq = list(by), [order, *tie_breakers]
    on = F.coalesce(col(flag), F.lit(False))
    previous = {"_prev": lambda w: F.lag(F.col("_on")).over(w)}
    rows = df.select(*[col(c) for c in keys], *[col(c) for c in seq], on.alias("_on"))
    index = None
    if not bounded:
        index = "_row"
        rows = with_row_index(rows, [*keys, *seq], index)
    marked = over_neighbours(rows, previous, seq, keys, before=1, bounded=bounded, index=index)
    starts = (F.col("_on") & ~F.coalesce(F.col("_prev"), F.lit(False))).cast("long")
    if bounded:
        w = Window.partitionBy(*keys).orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0)
        numbered = marked.withColumn("_run", F.sum(starts).over(w))
    else:
        numbered = with_running_total(marked, starts, index, keys, "_run")
    return (
        numbered.where("_on")
        .groupBy(*keys, "_run")
        .agg(F.min(col(order)).alias("start"), F.max(col(order)).alias("end"), F.count(F.lit(1)).alias("n"))
        .drop("_run")
    )


# --- autoregressive whitening ------------------------------------------------------------------


def innovations(phi: Sequence[float]) -> tuple[list[np.ndarray], np.ndarray]:
    """For a stationary AR(p): prediction weights from k earlier values, k = 0..p, and the ratio of
    each prediction variance to the final one. Row k of a series uses entry min(k, p)."""
    phi = np.asarray(phi, dtype=float)
    weights = [phi]
    a = phi
    ratios = [1.0]
    for _ in range(len(phi)):  # run the Durbin-Levinson recursion backwards
        last = a[-1]
        if abs(last) >= 1:
            raise ValueError(f"AR coefficients {list(phi)} are not stationary")
        ratios.append(ratios[-1] / (1 - last * last))
        a = (a[:-1] + last * a[:-1][::-1]) / (1 - last * last)
        weights.append(a)
    return weights[::-1], np.array(ratios[::-1])


def ar_residuals(
    df: DataFrame,
    resid: str,
    order: Sequence[str] | str,
    by: Sequence[str],
    phi: Sequence[float],
    out: str = "normalized",
    bounded: bool = False,
) -> DataFrame:
    """Residuals freed of AR(p) correlation within each group, in row order. The first p rows of a
    group are predicted from what precedes them and scaled to the common variance."""
    order = [order] if isinstance(order, str) else list(order)
    p = len(phi)
    weights, ratios = innovations(phi)
    lags = {f"_r{j}": (lambda w, j=j: F.lag(col(resid), j).over(w)) for j in range(1, p + 1)}
    place = {f"_has{j}": (lambda w, j=j: F.lag(F.lit(1), j).over(w)) for j in range(1, p + 1)}
    wide = over_neighbours(df, {**lags, **place}, order, by, before=p, bounded=bounded)
    value = None
    for k in range(p, -1, -1):  # k earlier rows exist
        expr = col(resid)
        for j in range(1, k + 1):
            expr = expr - float(weights[k][j - 1]) * F.col(f"_r{j}")
        expr = expr / float(np.sqrt(ratios[k]))
        has_k = F.col(f"_has{k}").isNotNull() if k else F.lit(True)
        value = F.when(has_k, expr) if value is None else value.when(has_k, expr)
    return wide.withColumn(out, value).drop(*lags, *place)
