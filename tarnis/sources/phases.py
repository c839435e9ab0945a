"""Literal interval tables: (phase, start year, end year), end exclusive."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Published phase years of the southern oscillation index.
SOI_PHASES = [
    ("Warm", 1990, 1995), ("Cold", 1995, 1997), ("Warm", 1997, 1998), ("Cold", 1998, 2002),
    ("Warm", 2002, 2007), ("Cold", 2007, 2014), ("Warm", 2014, 2016), ("Cold", 2016, 2018),
    ("Warm", 2018, 2020), ("Cold", 2020, 2022),
]

# Phase years of the Pacific decadal oscillation.
PDO_PHASES = [
    ("Cold", 1990, 1992), ("Warm", 1992, 1994), ("Cold", 1994, 1995), ("Warm", 1995, 1998),
    ("Cold", 1998, 2003), ("Warm", 2003, 2004), ("Cold", 2004, 2014), ("Warm", 2014, 2016),
    ("Cold", 2016, 2022),
]

# Years in which both indices were in the same phase.
IN_PHASE = [
    ("Warm", 1986, 1988), ("Cold", 1988, 1990), ("Warm", 1992, 1993), ("Warm", 1997, 1998),
    ("Cold", 1998, 2001), ("Warm", 2003, 2004), ("Cold", 2007, 2014), ("Warm", 2014, 2016),
    ("Cold", 2016, 2019), ("Cold", 2020, 2022),
]

# The period of significant increase.
SIGNIFICANT_INCREASE = [("Significant increase", 1992, 1997)]


def phase_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """(phase, start, end); start and end are years, or dates."""
    rows = list(rows)
    for phase, start, end in rows:
        if end <= start:
            raise ValueError(f"phase {phase!r}: end {end} is not after start {start}")
    # literals in the plan: the optimiser knows the size and broadcasts the table
    literals = [
        F.struct(F.lit(p).alias("phase"), F.lit(a).alias("start"), F.lit(b).alias("end"))
        for p, a, b in rows
    ]
    return spark.range(1).select(F.inline(F.array(*literals)))
