"""Row order at scale: row numbers, neighbours and running totals without a one-task window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnis.functions.columns import col
from tarnis.session import cut_lineage

BLOCK_ROWS = 1 << 17
SPAN = 1 << 12  # blocks whose totals are added up together
_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low 33 bits


def sort_by_date(df: DataFrame, *cols) -> DataFrame:
    """Total order, for a sink. Elsewhere order belongs in the operator that needs it."""
    return df.orderBy(*[col(c) for c in cols])


def with_row_index(df: DataFrame, order: Sequence, name: str = "row_id") -> DataFrame:
    """0-based number of each row in the given order.

    Range partitions are sorted and saved to the checkpoint folder, so partitions and order stay
    fixed if an executor is lost; one count per partition then gives each partition its offset.
    List enough columns to make the order unique: rows that tie are numbered in any order (by a
    hash of the row, so a value that many rows share can still be split over partitions).
    """
    keys = [*[col(c) for c in order], F.xxhash64(*[col(c) for c in df.columns])]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    position = F.monotonically_increasing_id()
    saved = cut_lineage(
        ordered.withColumns(
            {
                "_part": F.shiftright(position, _POSITION_BITS),
                "_pos": position.bitwiseAND((1 << _POSITION_BITS) - 1),
            }
        )
    )
    # one row per partition on either side of the broadcast
    counts = sorted(saved.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    numbered = saved.join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_start") + F.col("_pos")).drop("_part", "_pos", "_start")


def over_neighbours(
    df: DataFrame,
    columns: Mapping[str, Callable[[Window], Column]],
    order: Sequence,
    by: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    bounded: bool = False,
    block_rows: int = BLOCK_ROWS,
    index: str | None = None,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    With `bounded=True` (series known to be short, such as one row per month) this is a plain
    window per series. Otherwise rows are numbered and cut into blocks of equal size; the rows at a
    block's edge are copied to its neighbour, so each block has all the rows its windows reach and
    a series that holds most of the table is spread over many tasks. `index` names a row number the
    frame already has.
    """
    if bounded:
        w = Window.partitionBy(*[col(c) for c in by]).orderBy(*[col(c) for c in order])
        return df.withColumns({name: make(w) for name, make in columns.items()})
    if max(before, after) > block_rows:
        raise ValueError("a window may not reach further than one block")
    row = index or "_row"
    numbered = df if index else with_row_index(df, [*by, *order], row)
    home = F.floor(F.col(row) / block_rows)
    place = F.pmod(F.col(row), F.lit(block_rows))
    targets = F.array(
        home,
        F.when(place >= block_rows - before, home + 1) if before else F.lit(None).cast("long"),
        F.when(place < after, home - 1) if after else F.lit(None).cast("long"),
    )
    copies = numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.filter(targets, lambda t: t.isNotNull()))
    )
    w = Window.partitionBy(*[col(c) for c in by], "_block").orderBy(row)
    out = copies.withColumns({name: make(w) for name, make in columns.items()})
    out = out.where(F.col("_block") == F.col("_home")).drop("_home", "_block")
    return out if index else out.drop(row)


def with_running_total(
    df: DataFrame,
    value: Column,
    index: str,
    by: Sequence[str] = (),
    name: str = "total",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum along each series in the order of a row number, in levels: rows within blocks, blocks within groups of
    blocks, groups within the series. A window holds at most `block_rows` rows on the first level and SPAN blocks on the second, and the last
    has one row for each block_rows * SPAN rows."""
    blocked = df.withColumns({"_block": F.floor(F.col(index) / block_rows), "_value": value})
    keys = [*by, "_block"]
    blocks = blocked.groupBy(*keys).agg(F.sum("_value").alias("_sum")).withColumn("_span", F.floor(F.col("_block") / SPAN))
    spans = blocks.groupBy(*by, "_span").agg(F.sum("_sum").alias("_total"))
    before = lambda x, w, at: F.coalesce(F.sum(x).over(w.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a constant, so that a table of one series has a partition as well
    spans = spans.withColumn("_all", F.lit(0)).withColumn("_start", before("_total", Window.partitionBy(*by, "_all"), "_span"))
    blocks = blocks.withColumn("_before", before("_sum", Window.partitionBy(*by, "_span"), "_block"))
    blocks = _matched(blocks, spans.select(*by, "_span", "_start"), [*by, "_span"])
    blocks = blocks.select(*by, "_block", (F.col("_start") + F.col("_before")).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    summed = _matched(blocked, blocks, keys).withColumn(name, F.col("_before") + F.sum("_value").over(inside))
    return summed.drop("_block", "_value", "_before")


def _matched(df: DataFrame, table: DataFrame, keys: Sequence) -> DataFrame:
    """The columns of a table with one row per key beside the rows of that key; a null key matches itself."""
    table = table.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = [col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(table, same).drop(*[f"_k{i}" for i in range(len(keys))])
