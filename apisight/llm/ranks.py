"""Exclusive running sums of any length without one task per key.

A plain window over a hot key sorts all its rows in one task. Here a row's block (a monotone function of the order) splits each key; sums by
block are few and are accumulated first, then each block is summed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the bits of a block's number: a key's block sums (2 ** 20 small rows at most) are sorted as a whole.
BLOCK_ROWS, LEAST_BITS, MOST_BITS = 10_000, 10, 20


def block_bits(rows: int) -> int:
    """Bits of the blocks' numbers for a table of so many rows."""
    return min(MOST_BITS, max(LEAST_BITS, (rows // BLOCK_ROWS).bit_length()))


def seeded(seed: int | str, *cols: Column) -> Column:
    """60 pseudo-random bits of the seed and the columns, as long: the seeded shuffle's order (SQL: the first 15 hex digits of an md5)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def block_of(value: Column, bits: int) -> Column:
    """Block of a seeded() value; the higher bits, so blocks are in its order."""
    return F.shiftright(value, 60 - bits).cast("int")


def running(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str, total: str | None = None, nullable: bool = True) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys that come before in (block, order); and total: the sum over all of them.

    rows is evaluated twice, so it should be a table or cheap to make. Null keys form a key of their own; where there are none (nullable is
    False), the rows stay where the sums by block have put them.
    """
    rows = rows.withColumn("_block", block).withColumn("_value", value)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(whole).alias("_total"))
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    cond = F.col("_block") == F.col("_b")
    for k in keys:
        cond = cond & (F.col(k).eqNullSafe(F.col(f"_k_{k}")) if nullable else F.col(k) == F.col(f"_k_{k}"))
    joined = rows.join(sums, cond, "left").withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
    if total:
        joined = joined.withColumn(total, F.col("_total").cast("long"))
    return joined.drop("_block", "_value", "_local", "_before", "_total", "_b", *[f"_k_{k}" for k in keys])
