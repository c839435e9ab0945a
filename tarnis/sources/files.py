"""Readers and writers for the file layouts of monitoring archives. No schema inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnis.functions.columns import MONTHS, col


def read_table(
    spark: SparkSession,
    path,
    schema: T.StructType | str,
    null_value: str = "NA",
    fmt: str = "csv",
) -> DataFrame:
    """Delimited file with a header line, or a columnar table. `null_value` reads as NULL."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    return spark.read.schema(schema).csv(
        path, header=True, nullValue=null_value, mode="PERMISSIVE", enforceSchema=False
    )


def read_month_matrix(spark: SparkSession, path, sentinels: Sequence[float] = ()) -> DataFrame:
    """Whitespace-separated text: a year and twelve monthly values per line, title line skipped.

    Values listed in `sentinels` (missing-month marks such as 99.99) become NULL.
    """
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(cells.alias("cells"))
    value = lambda i: F.get("cells", F.lit(i)).try_cast("double")
    months = [
        (F.when(~value(i).isin(*sentinels), value(i)) if sentinels else value(i)).alias(m)
        for i, m in enumerate(MONTHS, start=1)
    ]
    year = F.get("cells", F.lit(0)).try_cast("int")
    return lines.select(year.alias("Year"), *months).where(F.col("Year").isNotNull())


def read_block(
    spark: SparkSession,
    path,
    columns: Sequence[str],
    header_row: int = 8,
    last_row: int = 67,
    sep: str = ",",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Rectangular block of a sheet export: rows after `header_row` to `last_row`, as text columns.

    A workbook sheet is one small file, so a file is read as one record and its lines are numbered;
    many files are spread over the tasks. The first lines of a sheet are notes, so the names of the
    block's columns are given, or taken with `block_header`. Cells are text; type them afterwards.
    """
    numbered = _numbered_lines(spark, path)
    rows = numbered.where((F.col("line") > header_row) & (F.col("line") <= last_row))
    # from_csv honours quoted separators
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = rows.select(
        "file", "line", F.from_csv("text", schema, {"sep": sep, "mode": "PERMISSIVE"}).alias("r")
    )
    keep = [c for c in columns if c not in drop]
    return parsed.select("file", "line", *[F.col("r").getField(c).alias(c) for c in keep])


def block_header(spark: SparkSession, path, header_row: int = 8, sep: str = ",") -> list[str]:
    """Column names in the header line; unnamed columns are called `...3`, `...4` by position."""
    line = _numbered_lines(spark, path).where(F.col("line") == header_row).select("text").first()
    if line is None:
        raise ValueError(f"{path} has no line {header_row}")
    names = [c.strip().strip('"') for c in line[0].split(sep)]
    return [c or f"...{i}" for i, c in enumerate(names, start=1)]


def _numbered_lines(spark: SparkSession, path) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.split("value", r"\r?\n")).alias("pos", "text"),
    ).select("file", (F.col("pos") + 1).alias("line"), "text")


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "error",
) -> None:
    """Write with header and no row names. Partitioned output is first rebalanced by partition
    value: few files per folder, and adaptive execution splits a site or year that is large."""
    out = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        out.csv(path, header=True, nullValue="NA")
    else:
        out.format(fmt).save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], fmt="parquet") -> None:
    """Replace only the partitions that occur in `df` (a re-keyed year, for example)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .format(fmt)
        .save(path)
    )


def parse_problems(df: DataFrame, casts: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Text cells that do not read as their target type: (column, value, n).

    `casts` maps a text column to a type name; one scan covers all columns.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    col(c).cast("string").alias("value"),
                    col(c).try_cast(t).isNull().alias("failed"),
                )
                for c, t in casts.items()
            ]
        )
    )
    return (
        df.select(cells.alias("cell"))
        .select("cell.*")
        .where(F.col("failed") & F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
