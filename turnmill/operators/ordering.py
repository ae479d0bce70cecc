"""Row positions and neighbour lookups that stay balanced when one group is very large.

A plain window over a group sends the whole group to one task. Here a group is cut into
chunks of consecutive positions, so that a group with a third of all rows spreads over
many tasks, and only one summary row per chunk is combined per group. Group keys are not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import written

# A chunk with its copied edges stays below the 4096 rows that a window keeps in memory.
CHUNK_ROWS = 2048


def chunk_of(position: str, rows: int) -> Column:
    return F.floor(F.col(position) / F.lit(rows)).cast("bigint")


def spread_chunks(
    df: DataFrame, position: str, ahead: bool, behind: bool = False, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Give each row its chunk, and copy edge rows into the chunk that needs them as neighbour.

    ``position`` counts 0, 1, 2 … without gaps inside its group. One row in ``rows`` is copied.
    """
    home = F.col("_home")
    wanted = [home]
    if ahead:
        wanted.append(F.when(F.col(position) % rows == 0, home - 1))
    if behind:
        wanted.append(F.when(F.col(position) % rows == rows - 1, home + 1))
    return df.withColumn("_home", chunk_of(position, rows)).withColumn(
        "_chunk", F.explode(F.array_compact(F.array(*wanted)))
    )


def drop_edge_copies(df: DataFrame) -> DataFrame:
    return df.filter("_chunk = _home").drop("_home")


def chunk_window(key: str, position: str) -> Window:
    return Window.partitionBy(key, "_chunk").orderBy(position)


def with_neighbours(
    df: DataFrame,
    key: str,
    position: str,
    ahead: dict[str, str] | None = None,
    behind: dict[str, str] | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add columns of the next (``ahead``) and previous (``behind``) row: {new name: source}."""
    w = chunk_window(key, position)
    spread = spread_chunks(df, position, bool(ahead), bool(behind), rows)
    added = {n: F.lead(c).over(w) for n, c in (ahead or {}).items()}
    added |= {n: F.lag(c).over(w) for n, c in (behind or {}).items()}
    return drop_edge_copies(spread.withColumns(added)).drop("_chunk")


def add_earlier_chunks(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Add to each row the totals of all earlier chunks of its group.

    The totals are one row per chunk, and are joined on (group, chunk), so no join key is hot.
    """
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in sums.items()])
    starts = totals.select(
        key,
        "_chunk",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
    )
    return df.join(starts, [key, "_chunk"], "left")


def dense_index(
    df: DataFrame, key: str, order: str, name: str = "index", span: int = 65536
) -> DataFrame:
    """Number the rows of each group 1, 2, 3 … by a unique integer ``order`` column.

    ``span`` is the width of a chunk in units of ``order``.
    """
    chunked = df.withColumn("_chunk", chunk_of(order, span))
    numbered = add_earlier_chunks(
        chunked.withColumn("_row", F.row_number().over(chunk_window(key, order))),
        key,
        {"_before": F.count(F.lit(1))},
    )
    return numbered.withColumn(name, (F.col("_row") + F.col("_before")).cast("bigint")).drop(
        "_chunk", "_row", "_before"
    )


def prefix_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over all rows that sort before by the unique ``order``.

    Two levels: ranges of the order, one per task, sum up their own rows; the totals of the ranges, one
    number per task, are summed on the driver. df is evaluated once, into a written table.
    """
    held = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts, total = [], 0
    for part, n in sorted(held.groupBy("_part").agg(F.sum(value)).collect()):
        starts.append((part, total))
        total += n or 0
    base = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    summed = held.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    return summed.join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def group_offsets(
    df: DataFrame, key: str, name: str = "_offset", span: int = 65536
) -> DataFrame:
    """Rows in all groups that sort before, one line per (group, chunk of ``span`` rows).

    The lines per chunk let a caller join on (group, chunk) instead of on a group that may be hot.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    started = prefix_sums(counts, key, "_rows", name)
    last = F.floor((F.col("_rows") - 1) / span)
    return started.select(
        key, name, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk")
    )
