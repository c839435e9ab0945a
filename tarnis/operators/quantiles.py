"""Exact quantiles (linear interpolation) of groups of any size.

`percentile` keeps every distinct value of a group in one task. Here a double becomes a whole number of the same order (its
sign, exponent and fraction), and the number with a wanted rank is found digit by digit: one pass counts the leading 22 bits of
all values of a group, which tells the leading digit of each wanted value and its rank among those that share it; the
next pass counts the following 21 bits of just those, and so on. Three passes find any value of any distribution, no
pass has more than 2^22 digits to add up in one place, and rows are never shuffled by group (counts combine map-side).
The rows are stored once, as group and number only; every pass reads that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnis.functions.columns import col
from tarnis.session import settle

DIGITS = (22, 21, 21)
#: Fraction bits of a double, and the powers of two at which its exponents begin and end.
FRACTION, LEAST, MOST = 52, -1022, 1023


def order_key(x: Column) -> Column:
    """A long in the order of the double x: equal for equal values (zeros of both signs too), larger for larger ones."""
    a = F.abs(x)
    e = F.floor(F.log2(a))
    # the logarithm may be rounded over a power of two
    e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
    e = F.least(e, F.lit(MOST))
    step = F.lit(1 << FRACTION)
    normal = (e - LEAST) * step + ((a / F.pow(F.lit(2.0), e)) * F.lit(2.0**FRACTION)).cast("long")
    small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    key = F.when(a == float("inf"), F.lit((MOST - LEAST + 2) << FRACTION)).when(a < F.lit(2.0**LEAST), small).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def order_value(key: Column) -> Column:
    """The double of an order key."""
    a = F.abs(key)
    e = F.greatest(F.shiftright(a, FRACTION), F.lit(1))
    fraction = (a - (e - 1) * F.lit(1 << FRACTION)).cast("double")
    # in two steps, since the power of a very small number is none itself
    half = F.floor((e + LEAST - 1 - FRACTION) / 2)
    x = fraction * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e + LEAST - 1 - FRACTION - half)
    x = F.when(a >= F.lit((MOST - LEAST + 2) << FRACTION), F.lit(float("inf"))).otherwise(x)
    return F.when(key < 0, -x).otherwise(x)


def order_statistics(rows: DataFrame, value, wanted: Column, by: Sequence[str] = (), weight=None) -> DataFrame:
    """(by..., t, x): for each group the values of the wanted ranks.

    `wanted` is an expression over n, the number of values of a group (and over its keys), that gives an array of structs (t, k): a tag and a rank from
    0. NULL and NaN values are left out. `weight` is a whole number of times that a row counts.
    """
    keys = list(by)
    made = [col(c).alias(f"_g{i}") for i, c in enumerate(keys)]
    groups = [f"_g{i}" for i in range(len(keys))]
    counted = F.lit(1) if weight is None else col(weight)
    x = col(value).cast("double")
    rows = rows.select(*made, x.alias("_x"), counted.cast("long").alias("_c")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = settle(rows.select(*groups, order_key(F.col("_x")).alias("_k"), "_c"), "values")

    active = None
    for p, bits in enumerate(DIGITS):
        shift = sum(DIGITS[p + 1 :])
        digit = F.shiftright("_k", shift).alias("_d")
        if active is None:
            known, ids = rows.withColumn("_p", F.lit(0).cast("long")), [*groups, "_p"]
        else:
            same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.shiftright("l._k", shift + bits) == F.col("r._p")]
            known = rows.alias("l").join(active.select(*ids).alias("r"), same).select("l.*", "r._p")
        counts = known.groupBy(*ids, digit).agg(F.sum("_c").alias("_c"))
        here = Window.partitionBy(*ids)
        upto = F.sum("_c").over(here.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumns({"_upto": upto, "n": F.sum("_c").over(here)})
        if active is None:
            counts = counts.withColumnsRenamed(dict(zip(groups, keys))).withColumn("_w", wanted).withColumnsRenamed(dict(zip(keys, groups)))
        else:
            same = [F.col(f"l.{i}").eqNullSafe(F.col(f"r.{i}")) for i in ids]
            counts = counts.alias("l").join(active.alias("r"), same).select("l.*", "r._w")
        start = F.col("_upto") - F.col("_c")
        held = F.filter("_w", lambda w: (w["k"] >= start) & (w["k"] < F.col("_upto")))
        held = F.transform(held, lambda w: F.struct(w["t"].alias("t"), (w["k"] - start).alias("k")))
        active = counts.select(*groups, F.col("_d").alias("_p"), held.alias("_w")).where(F.size("_w") > 0)
        active, ids = settle(active, "digits"), [*groups, "_p"]
    found = active.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], order_value(F.col("_p")).alias("x"), F.explode("_w").alias("w"))
    return found.select(*[col(k) for k in keys], F.col("w.t").alias("t"), "x")


def ranked_pair(i, place: Column) -> Column:
    """The two neighbours of a place between ranks, tagged with the number i of the point, the side, how far between them the place lies, and n."""
    tag = lambda side: F.struct(
        (F.lit(i) if isinstance(i, int) else i).cast("int").alias("i"), F.lit(side).alias("side"), (place - F.floor(place)).alias("part"), F.col("n").alias("n")
    )
    return F.array(*[F.struct(tag(side).alias("t"), f(place).cast("long").alias("k")) for side, f in enumerate((F.floor, F.ceil))])


def evenly_ranked(count: Column) -> Column:
    """Wanted ranks of `count` points evenly spaced in rank."""
    place = lambda i: ((F.col("n") - 1) * i).cast("double") / F.greatest(count - 1, F.lit(1))
    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: ranked_pair(i, place(i))))


def quantiles(
    df: DataFrame, value, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None, weight=None
) -> DataFrame:
    """One row per group with one column per probability; NULL and NaN values are left out. Without groups, no values give
    a row of NULLs."""
    names = list(names or [f"q{p:g}" for p in probs])
    keys = list(by)
    wanted = F.concat(*[ranked_pair(i, (F.col("n") - 1) * F.lit(float(p))) for i, p in enumerate(probs)])
    found = order_statistics(df, value, wanted, by, weight)
    ends = [F.max(F.when((F.col("t.i") == i) & (F.col("t.side") == s), F.col("x"))).alias(f"_x{2 * i + s}") for i in range(len(probs)) for s in (0, 1)]
    parts = [F.max(F.when(F.col("t.i") == i, F.col("t.part"))).alias(f"_h{i}") for i in range(len(probs))]
    wide = found.groupBy(*[col(k) for k in keys]).agg(*ends, *parts)
    out = [col(k) for k in keys]
    for i, name in enumerate(names):
        below, above, h = F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), F.col(f"_h{i}")
        out.append(F.when(below == above, below).otherwise((1 - h) * below + h * above).alias(name))
    return wide.select(*out)


def group_quantiles(df, value, probs, by=(), names=None, method: str = "select", weight=None) -> DataFrame:
    """Quantiles by the method that suits the data.

    'select'  exact, for groups of any size (above)
    'memory'  exact, Spark's own `percentile`; for groups known to be small
    'approx'  `approx_percentile`, one pass, relative rank error 1/10000
    """
    if method == "select":
        return quantiles(df, value, probs, by, names, weight)
    names = list(names or [f"q{p:g}" for p in probs])
    x = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    probs = [float(p) for p in probs]
    made = F.percentile(x, probs) if method == "memory" else F.percentile_approx(x, probs, 10000)
    grouped = df.groupBy(*[col(c) for c in by]).agg(made.alias("_q"))
    return grouped.select(*[col(c) for c in by], *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
