"""Ranks and running sums over a whole table, without sending it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.shared import freeze, partitions


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df sorted over range partitions and written, with _part and _row (from 0 in each part)."""
    spread = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    numbered = spread.withColumn("_id", F.monotonically_increasing_id())
    return freeze(numbered.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), name)


def before_parts(df: DataFrame, amount: Column) -> DataFrame:
    """For each _part the sum of amount over the parts before it: as many rows as there are partitions."""
    sums = sorted((r._part, r.n or 0) for r in df.groupBy("_part").agg(F.sum(amount).alias("n")).collect())
    rows, total = [], 0
    for part, n in sums:
        rows.append((part, total))
        total += n
    return df.sparkSession.createDataFrame(rows, "_part int, _before long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rank (from 1) in the given order, which must be total for the rank to be settled."""
    rows = in_order(df, order, name)
    offsets = before_parts(rows, F.lit(1))
    return rows.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
