"""Grouped and global summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col, label_if, nan_to_null, strict_mean
from tarnis.operators.frame import one_row
from tarnis.operators.quantiles import group_quantiles


def _attach(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two summaries of the same groups; a single-row summary is read as a scalar."""
    if by:
        keyed = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
        same = [col(c).eqNullSafe(F.col(f"`_by_{c}`")) for c in by]
        return left.join(keyed, same, "left").drop(*[f"_by_{c}" for c in by])
    s = one_row(right)
    return left.select("*", *[s[c].alias(c) for c in right.columns])


def summary6(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "select") -> DataFrame:
    """mean, median, sd, min, max and the number of rows (rows without a value count too). NaN is no value."""
    x = nan_to_null(value)
    basic = df.groupBy(*by).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.count(F.lit(1)).alias("count"),
    )
    median = group_quantiles(df, value, [0.5], by, ["median"], method)
    return _attach(basic, median, by).select(*by, "mean", "median", "sd", "min", "max", "count")


def annual_summary(df: DataFrame, value: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, max and min per year in one aggregate; rows without a value (NULL or NaN) are left out first."""
    x = nan_to_null(value)
    present = df.where(x.isNotNull())
    return present.groupBy(*by, F.year(col(date)).alias("year")).agg(
        F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min")
    )


def annual_index(df: DataFrame, date: str, cols: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Annual strict means: {output: input}; a year with a missing value gives NULL."""
    year = F.year(col(date)).alias("Year")
    return df.groupBy(*by, year).agg(*[strict_mean(c).alias(out) for out, c in cols.items()])


def annual_extreme(
    df: DataFrame,
    value: str,
    date: str,
    how: str = "max",
    by: Sequence[str] = (),
    method: str = "select",
) -> DataFrame:
    """Annual max or mean with the median sampling time (microsecond precision)."""
    reduce_by = {"max": F.max, "mean": F.avg, "min": F.min}[how]
    micros = F.unix_micros(col(date).cast("timestamp"))
    rows = df.select(
        *[col(c) for c in by], F.year(col(date)).alias("year"), col(value).alias("_x"), micros.alias("_t")
    )
    keys = [*by, "year"]
    stat = rows.groupBy(*keys).agg(reduce_by("_x").alias(how))
    middle = group_quantiles(rows, "_t", [0.5], keys, ["_m"], method)
    out = _attach(stat, middle, keys)
    return out.select(*keys, how, F.timestamp_micros(F.col("_m").cast("long")).alias("median_date"))


# Proper decades, and the looser cuts of the published figure, where the 1990s mean
# has no lower bound and the 2020s stop before 2022.
DECADES = [(f"{y}s", f"{y}-01-01", f"{y + 10}-01-01") for y in range(1980, 2030, 10)]
FIGURE_DECADES = [
    ("1980s", None, "1990-01-01"),
    ("1990s", None, "2000-01-01"),
    ("2000s", "1999-12-31", "2010-01-01"),
    ("2010s", "2009-12-31", "2020-01-01"),
    ("2020s", "2019-12-31", "2022-01-01"),
]


def decadal_mean(annual: DataFrame, value: str, date: str, breaks=DECADES, by: Sequence[str] = (), open_start: bool = False) -> DataFrame:
    """Mean of the annual statistic per decade; a year counts in every span that covers its date.

    The few spans are an array literal, so the annual rows are read once and nothing is joined.
    """
    d = col(date)
    labels = []
    for label, start, end in breaks:
        inside = d < F.lit(end).cast("timestamp")
        if start is not None:
            lower = F.lit(start).cast("timestamp")
            inside = inside & ((d > lower) if open_start else (d >= lower))
        labels.append(F.when(inside, F.lit(label)))
    tagged = annual.withColumn("decade", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    return tagged.groupBy(*by, "decade").agg(F.avg(col(value)).alias("mean"), F.count(F.lit(1)).alias("years"))


def temporal_ranges(df: DataFrame, value: str, year: str | Column = "year", by: Sequence[str] = ()) -> DataFrame:
    """Between-year and within-year ranges; the second level sees one row per year. NaN is missing."""
    x = nan_to_null(value)
    y = (col(year) if isinstance(year, str) else year).alias("_year")
    yearly = df.groupBy(*by, y).agg(
        F.avg(x).alias("mean_year"), (F.max(x) - F.min(x)).alias("seasonal_range")
    )
    top, low = F.max("mean_year"), F.min("mean_year")
    return yearly.groupBy(*by).agg(
        (top - low).alias("between_year_range"),
        F.try_divide(top, low).alias("extreme_range"),
        F.avg("mean_year").alias("avg_year"),
        F.try_divide(top, F.avg("mean_year")).alias("extreme_factor"),
        F.avg("seasonal_range").alias("avg_within_year_range"),
        F.max("seasonal_range").alias("max_within_year_range"),
    )


def summary_quartiles(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "select") -> DataFrame:
    """min, q1, median, mean, q3, max and the number of missing values, NaN among them."""
    x = nan_to_null(value)
    basic = df.groupBy(*by).agg(
        F.min(x).alias("min"),
        F.avg(x).alias("mean"),
        F.max(x).alias("max"),
        F.count_if(x.isNull()).alias("nulls"),
    )
    q = group_quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"], method)
    return _attach(basic, q, by).select(*by, "min", "q1", "median", "mean", "q3", "max", "nulls")


def corr_matrix(df: DataFrame, cols: Sequence[str], use: str = "pairwise", by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair (x before y), long form, one aggregate.

    `use='pairwise'` takes the rows where both values are present, 'complete' those with all. NaN is not present.
    """
    if use == "complete":
        df = df.na.drop(subset=list(cols))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    made = []
    for i, (a, b) in enumerate(pairs):
        both = nan_to_null(a).isNotNull() & nan_to_null(b).isNotNull()
        xa, xb = F.when(both, col(a).cast("double")), F.when(both, col(b).cast("double"))
        # no variation in a column: no correlation
        varies = (F.min(xa) < F.max(xa)) & (F.min(xb) < F.max(xb))
        spread = F.stddev_pop(xa) * F.stddev_pop(xb)
        made.append(F.when(varies, F.try_divide(F.covar_pop(xa, xb), spread)).alias(f"_r{i}"))
    one = df.groupBy(*by).agg(*made)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"_r{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(*by, F.explode(cells).alias("c")).select(*by, "c.x", "c.y", "c.corr")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30, width: float | None = None) -> DataFrame:
    """Counts per variable and bin: (variable, bin, left, right, n); empty bins are not listed.

    Bins are (left, right], their edges lie at odd multiples of half the width, and the width is
    range / (bins - 1) per variable unless given.
    """
    values = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), col(c).cast("double").alias("x")) for c in cols])
    )
    stats = df.agg(
        *[F.min(nan_to_null(col(c).cast("double"))).alias(f"_lo{i}") for i, c in enumerate(cols)],
        *[F.max(nan_to_null(col(c).cast("double"))).alias(f"_hi{i}") for i, c in enumerate(cols)],
    )
    s = one_row(stats)
    by_name = lambda prefix: F.create_map(
        *[e for i, c in enumerate(cols) for e in (F.lit(c), s[f"{prefix}{i}"])]
    )
    rows = (
        df.select(values.alias("v"))
        .select("v.*")
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
        .withColumn("lo", by_name("_lo")[F.col("variable")])
        .withColumn("hi", by_name("_hi")[F.col("variable")])
    )
    w = F.lit(float(width)) if width else (F.col("hi") - F.col("lo")) / (bins - 1)
    rows = rows.withColumn("w", F.when(w > 0, w).otherwise(F.lit(0.1)))
    rows = rows.withColumn("origin", (F.floor(F.col("lo") / F.col("w") - 0.5) + 0.5) * F.col("w"))
    position = F.ceil((F.col("x") - F.col("origin")) / F.col("w")) - 1
    rows = rows.withColumn("bin", F.greatest(position, F.lit(0)))
    counted = rows.groupBy("variable", "origin", "w", "bin").agg(F.count(F.lit(1)).alias("n"))
    left = F.col("origin") + F.col("bin") * F.col("w")
    return counted.select(
        "variable", F.col("bin").cast("int").alias("bin"), left.alias("left"), (left + F.col("w")).alias("right"), "n"
    )


def threshold_group(df: DataFrame, value: str, threshold: float, out: str = "group") -> DataFrame:
    """'Above/Equal' or 'Below' a threshold; a missing value has no group."""
    return df.withColumn(out, label_if(col(value) >= threshold, "Above/Equal", "Below"))


def density(df: DataFrame, value: str, by: Sequence[str], n: int = 512, method: str = "select") -> DataFrame:
    """Gaussian kernel density per group on n points over the range of all groups.

    Bandwidth: 0.9 * min(sd, IQR/1.34) * count^(-1/5). Each value is split between its two nearest
    grid points in proportion to distance, so one grouped count leaves at most n weights per group, whatever the number of
    rows; the kernel sums run inside an array of those.
    """
    x = col(value).cast("double")
    rows = df.select(*[col(c) for c in by], x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = one_row(rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    lo, step = ends["lo"], (ends["hi"] - ends["lo"]) / (n - 1)

    stats = rows.groupBy(*by).agg(F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    q = group_quantiles(rows, "x", [0.25, 0.75], by, ["q1", "q3"], method)
    spread = _attach(stats, q, by)
    robust = (F.col("q3") - F.col("q1")) / 1.34
    narrow = F.when(robust > 0, F.least("sd", robust)).otherwise(F.col("sd"))
    spread = spread.withColumn("bw", 0.9 * narrow * F.pow(F.col("n"), F.lit(-0.2)))

    at = (F.col("x") - lo) / step
    cell = F.least(F.floor(at), F.lit(n - 2))
    part = at - cell
    split = F.explode(
        F.array(
            F.struct(cell.alias("cell"), (1 - part).alias("w")),
            F.struct((cell + 1).alias("cell"), part.alias("w")),
        )
    )
    weights = (
        rows.select(*by, split.alias("s")).groupBy(*by, F.col("s.cell").alias("cell")).agg(F.sum("s.w").alias("w"))
    )
    # at most n weights lie in a group's array, and every grid point sums over it there
    arrays = weights.groupBy(*by).agg(F.collect_list(F.struct(F.col("cell").cast("double").alias("cell"), "w")).alias("weights"))
    joined = arrays.join(spread.select(*by, "bw", "n"), list(by)).withColumn("scale", step / F.col("bw"))

    def kernels(i):
        def add(total, s):
            z = (i - s["cell"]) * F.col("scale")
            return total + s["w"] * F.exp(-0.5 * z * z)

        return F.aggregate("weights", F.lit(0.0), add) / (F.col("n") * F.col("bw") * 2.5066282746310002)

    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), kernels)
    out = joined.select(*by, "bw", F.posexplode(points).alias("point", "density"))
    return out.select(*by, "point", (lo + F.col("point") * step).alias("x"), "density", "bw")


def monthly(df: DataFrame, value: str, date: str, how=F.avg, by: Sequence[str] = (), out: str = "value") -> DataFrame:
    """Monthly statistic of a dated column, keyed by the first day of the month."""
    month = F.trunc(col(date).cast("date"), "month").alias("month")
    return df.groupBy(*by, month).agg(how(col(value)).alias(out))

