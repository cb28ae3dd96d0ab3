"""Dense global row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written

_SHIFT = 33  # monotonically_increasing_id keeps the row's place in its partition below this bit


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all of ``columns``, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the order of the columns ``order``, over the whole table.

    The rows are range-partitioned and sorted, written once (so a place in a partition is a fixed
    fact), and each partition's base is the sum of the counts before it. Only one row per partition
    meets in a single window. Pass narrow rows: every column is shuffled once. Rows that agree on
    all of ``order`` get neighbouring numbers in an order fixed by that one write. Columns of ``df`` may have
    any names but ``name``.
    """
    place, task, base = (free_name(df.columns, n) for n in ("_place", "_part", "_base"))
    placed = written(
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(place, _SHIFT)
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy(part.alias(task)).count()
        .select(task, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    )
    return (
        placed.withColumn(task, part)
        .join(F.broadcast(bases), task)  # one row for each partition of the range shuffle
        .withColumn(name, F.col(base) + F.col(place).bitwiseAND((1 << _SHIFT) - 1))
        .drop(task, base, place)
    )
