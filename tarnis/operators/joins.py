"""Joins on dates, years and phases; grids; masks. No join here pairs all rows with all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.functions.columns import col
from tarnis.operators.filters import complete_cases
from tarnis.operators.frame import one_row
from tarnis.session import settle


def merge_outer(a: DataFrame, b: DataFrame, on: Sequence[str], null_keys: str = "drop") -> DataFrame:
    """Full outer join, one copy of the key. NULL keys are dropped, or matched with each other."""
    on = list(on)
    if null_keys == "drop":
        return complete_cases(a, on).join(complete_cases(b, on), on, "full_outer")
    left, right = a.alias("l"), b.alias("r")
    matched = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in on]
    keys = [F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in on]
    rest = [F.col(f"l.`{c}`") for c in a.columns if c not in on]
    rest += [F.col(f"r.`{c}`") for c in b.columns if c not in on]
    return left.join(right, matched, "full_outer").select(*keys, *rest)


def merge_inner(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes=("_x", "_y")) -> DataFrame:
    """Inner equi-join; columns that clash get a suffix on each side."""
    on = list(on)
    clash = (set(a.columns) & set(b.columns)) - set(on)
    a = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    b = b.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return a.join(b, on)


def merge_left(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left")


def label_phases(
    df: DataFrame,
    phases: DataFrame,
    key: str,
    closed: str = "left",
    out: str = "phase",
) -> DataFrame:
    """Attach the phase that covers each year. Intervals are [start, end), or [start, end] with
    closed='both'. Years outside all phases get NULL; overlapping phases give one row each.

    Each interval is spread over the whole years it covers, so the range condition becomes an
    equality and the join a hash join. The phase side is left to the optimiser to broadcast by size.
    """
    last = F.col("end") if closed == "both" else F.col("end") - 1
    yearly = phases.select(
        F.col("phase").alias(out),
        F.explode(F.sequence(F.col("start"), last)).alias("_phase_year"),
    )
    return df.join(yearly, col(key) == F.col("_phase_year"), "left").drop("_phase_year")


def label_date_phases(
    df: DataFrame,
    phases: DataFrame,
    key: str,
    out: str = "phase",
) -> DataFrame:
    """As `label_phases`, for intervals of dates (start and end are dates, end exclusive): equality
    on the calendar year, then the exact bounds."""
    yearly = phases.select(
        F.col("phase").alias(out),
        F.col("start").alias("_start"),
        F.col("end").alias("_end"),
        F.explode(F.sequence(F.year("start"), F.year(F.date_sub("end", 1)))).alias("_phase_year"),
    )
    d = col(key)
    covered = (F.year(d) == F.col("_phase_year")) & (d >= F.col("_start")) & (d < F.col("_end"))
    return df.join(yearly, covered, "left").drop("_start", "_end", "_phase_year")


def bind_by_index(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Put two tables side by side by an explicit row number; the shorter one is padded with NULL.

    Rows of a DataFrame have no position: make the number first with `with_row_index`.
    """
    return a.join(b, key, "full_outer")


def expand_months(df: DataFrame, date: str, cols: Sequence[str], out: str = "date") -> DataFrame:
    """Monthly rows to daily rows, the values repeated on each day of the month that starts at
    `date` (the span runs to the day before the same day of the next month)."""
    start = col(date).cast("date")
    days = F.sequence(start, F.date_sub(F.add_months(start, 1), 1))
    others = [col(c) for c in cols]
    return df.select(F.explode(days).alias(out), *others)


def join_monthly(daily: DataFrame, monthly: DataFrame, date: str, month: str, how: str = "inner", by: Sequence[str] = ()) -> DataFrame:
    """Bring monthly values to daily rows without expanding them: equality on the month start.

    The monthly table (12 rows a year and series) is stored first, so that its size is known and it
    is broadcast if small; otherwise every reading would be shuffled by month.
    """
    keyed = settle(monthly.withColumnRenamed(month, "_month"), "monthly")
    on = F.trunc(col(date), "month") == F.col("_month")
    if not by:
        return daily.join(keyed, on, how).drop("_month")
    tagged = daily.withColumn("_month", F.trunc(col(date), "month"))
    return tagged.join(keyed, [*by, "_month"], how).drop("_month")


def grid(
    df: DataFrame,
    axes: Mapping[str, int],
    hold: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Equally spaced prediction grid between the observed extremes of each axis (or given bounds),
    other covariates held at an aggregate of the data.

    One aggregate gives the bounds (one row, or one per `by` group); each axis is then exploded
    from it, so the product of the axes is built from one row and joins nothing.
    """
    bounds = dict(bounds or {})
    pieces = []
    for a in axes:
        lo, hi = bounds.get(a, (None, None))
        pieces.append((F.min(col(a)) if lo is None else F.min(F.lit(lo))).cast("double").alias(f"_lo_{a}"))
        pieces.append((F.max(col(a)) if hi is None else F.max(F.lit(hi))).cast("double").alias(f"_hi_{a}"))
    held = {k: v for k, v in (hold or {}).items()}
    pieces += [v.alias(k) for k, v in held.items()]
    out = df.groupBy(*by).agg(*pieces)
    keys = list(by)
    for a, n in axes.items():
        out = out.withColumn(f"_i_{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        step = (F.col(f"_hi_{a}") - F.col(f"_lo_{a}")) / max(n - 1, 1)
        # the last point is the bound itself, free of rounding
        point = F.when(F.col(f"_i_{a}") == n - 1, F.col(f"_hi_{a}")).otherwise(
            F.col(f"_lo_{a}") + F.col(f"_i_{a}") * step
        )
        out = out.withColumn(a, point)
    cells = [F.col(f"_i_{a}") for a in axes]
    grid_id = cells[0]
    for a, c in list(zip(axes, cells))[1:]:
        grid_id = grid_id * axes[a] + c
    return out.select(*keys, grid_id.cast("long").alias("grid_id"), *axes, *held)


def mask_far(
    lattice: DataFrame,
    obs: DataFrame,
    dims: tuple[str, str],
    dist: float = 0.1,
    shape: tuple[int, int] = (200, 200),
    out: str = "too_far",
) -> DataFrame:
    """Flag points of a regular two-way grid that lie further than `dist` from every observation,
    both axes scaled to the unit interval by the range of the grid.

    On each grid row an observation reaches one run of neighbouring columns. A run is written as
    +1 at its first column and -1 after its last, the marks are added up (map-side first, at most
    one per grid cell and task) and a running sum along the row tells which cells are covered. No
    point meets an observation in a join, however many observations fall into one place.
    """
    (x, y), (nx, ny) = dims, shape
    ends = one_row(
        lattice.agg(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        )
    )
    unit = lambda c, lo, hi: (c - ends[lo]) / (ends[hi] - ends[lo])
    points = (
        obs.select(unit(col(x).cast("double"), "x0", "x1").alias("u"), unit(col(y).cast("double"), "y0", "y1").alias("v"))
        .na.drop()
        .distinct()
    )
    sx, sy = 1.0 / (nx - 1), 1.0 / (ny - 1)
    row_lo = F.greatest(F.ceil((F.col("v") - dist) / sy) - 1, F.lit(0))
    row_hi = F.least(F.floor((F.col("v") + dist) / sy) + 1, F.lit(ny - 1))
    rows = points.where(row_lo <= row_hi).withColumn("j", F.explode(F.sequence(row_lo, row_hi)))
    dv = F.col("v") - F.col("j") * sy
    reach = F.sqrt(F.greatest(dist * dist - dv * dv, F.lit(0.0)))
    rows = rows.withColumn("dv", dv).withColumn("reach", reach)

    def within(i):
        du = F.col("u") - i * sx
        return F.sqrt(du * du + F.col("dv") * F.col("dv")) <= dist

    # first and last column by arithmetic, then corrected by the distance test itself
    first, last = F.ceil((F.col("u") - F.col("reach")) / sx), F.floor((F.col("u") + F.col("reach")) / sx)
    rows = rows.withColumn("a", F.when(within(first - 1), first - 1).when(within(first), first).otherwise(first + 1))
    rows = rows.withColumn("b", F.when(within(last + 1), last + 1).when(within(last), last).otherwise(last - 1))
    rows = (
        rows.withColumn("a", F.greatest("a", F.lit(0)))
        .withColumn("b", F.least("b", F.lit(nx - 1)))
        .where(F.col("a") <= F.col("b"))
    )
    marks = (
        rows.select(
            "j",
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("i"), F.lit(1).alias("mark")),
                    F.struct((F.col("b") + 1).alias("i"), F.lit(-1).alias("mark")),
                )
            ).alias("m"),
        )
        .groupBy("j", "m.i")
        .agg(F.sum("m.mark").alias("mark"))
    )
    # per grid row: marks in column order become the list of covered runs (at most nx of them)
    runs = marks.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "mark"))).alias("marks"))
    covered = F.aggregate(
        F.filter("marks", lambda m: m["i"] <= F.col("_i")),
        F.lit(0).cast("long"),
        lambda total, m: total + m["mark"],
    )
    cell = lambda c, lo, hi, s: F.round(unit(col(c).cast("double"), lo, hi) / s).cast("long")
    placed = lattice.withColumn("_i", cell(x, "x0", "x1", sx)).withColumn("j", cell(y, "y0", "y1", sy))
    joined = placed.join(runs, "j", "left")
    return joined.withColumn(out, F.coalesce(covered == 0, F.lit(True))).drop("_i", "j", "marks")
