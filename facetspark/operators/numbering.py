"""Consecutive numbers in an order, without one task for all rows or for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def numbered(rows: DataFrame, by: list[str], name: str, group: list[str] = []) -> DataFrame:
    """``rows`` with a column ``name``: the place from 0 of each row by ``by`` (a total order), within its ``group``.

    Rows are dealt into ranges of (group, by) and sorted there, so that a group of any size
    is spread over tasks.  A row's number is its place in its range, less the place where
    its group begins there, plus what the group has in the ranges before.  Only a row a
    range and group is joined back.  Nulls come first.
    """
    order = [*group, *by]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spot, part = f"{name}__spot", f"{name}__range"
    dealt = materialize(dealt.withColumn(spot, F.monotonically_increasing_id()).withColumn(part, F.shiftright(spot, 33)), "numbered")
    begins = dealt.groupBy(*group, part).agg(F.min(spot).alias("first__"), F.count("*").alias("n__"))
    if group:
        before = F.sum("n__").over(Window.partitionBy(*group).orderBy(part)) - F.col("n__")
        begins = begins.select(*[F.col(g).alias(f"{g}__of") for g in group], F.col(part).alias("range__"), (before - F.col("first__")).alias("move__"))
        same = [F.col(g).eqNullSafe(F.col(f"{g}__of")) for g in group]
    else:
        at, moves = 0, []
        for r in begins.orderBy(part).collect():  # a row a range
            moves.append((r[part], at - r["first__"]))
            at += r["n__"]
        begins = F.broadcast(rows.sparkSession.createDataFrame(moves, "range__ long, move__ long"))
        same = []
    out = dealt.join(begins, [F.col(part) == F.col("range__"), *same]).withColumn(name, F.col(spot) + F.col("move__"))
    return out.select(*rows.columns, name)
