"""Positions in a global order, the least rows of groups, and their texts joined in order, without a task that gets all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisight.session import cut_lineage

#: Rows whose texts joined() puts together at once.
JOINED_ROWS = 8192


def numbered(rows: DataFrame, *order: str | Column, out: str = "position") -> DataFrame:
    """rows, checkpointed, with out: their places from 1 in the order. Rows that tie are in any order.

    Ranges of the order are sorted apart; of each, the driver gets its number of rows, and a row's place is that in its range behind the sums
    of the ranges before.
    """
    at = "_place"
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    start = F.array(*[F.lit(n) for n in before or [0]])[part.cast("int")]
    return ranged.withColumn(out, (start + place + 1).cast("long")).drop(at)


def least_of(rows: DataFrame, keys: list[str], order: list[str], k: int, out: str) -> DataFrame:
    """keys and out: each group's k least rows, as an array of structs of the order's columns. Tasks keep k rows of a group before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = rows.select(*keys, *order).withColumn("_nth", nth).where(F.col("_nth") <= k)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias(out))


def joined(rows: DataFrame, keys: list[str], order: list[str], text: str, beside: DataFrame, out: str) -> DataFrame:
    """beside (keys, and other columns; a row for each group of rows) with out: text (a column of the order, never null) of all of a group's rows
    in the order, blanks between.

    Blocks of places are joined apart. What stands beside goes with the blocks into the last sum, so no join moves a whole text.
    """
    placed = numbered(rows.select(*keys, *order), *keys, *order, out="_nth")
    block = F.floor(F.col("_nth") / JOINED_ROWS).alias("_block")
    parts = placed.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct("_nth", text))).alias("_of"))
    parts = parts.select(*keys, F.struct("_block", F.concat_ws(" ", F.col("_of")[text]).alias("_text")).alias("_part"))
    others = [F.max(c).alias(c) for c in beside.columns if c not in keys]  # nulls but for one row
    whole = parts.unionByName(beside, allowMissingColumns=True).groupBy(*keys).agg(*others, F.array_sort(F.collect_list("_part")).alias("_of"))
    return whole.select(*beside.columns, F.concat_ws(" ", "_of._text").alias(out))
