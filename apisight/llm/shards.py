"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import block_bits, block_of, running, seeded
from .shared import materialise


def stratified_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """Deals rows to shards 0 to n_shards - 1 so that each has the mixture of sources of the whole table.

    Rows of a source are ranked in a seeded shuffle (r of n); the fractional ranks (2r - 1) / 2n of all sources are sorted together and the
    order is cut into n_shards runs. Law `rows`: counts differ by one at most, and a source's count in a shard by two from its share.

    Returns doc_id, source, size (UTF-8 bytes of the text, 0 for null, plus 8), text_crc32 (of the UTF-8 bytes; null: of none), law, shard,
    slot (gapless from 0 in each shard), grown_shard (null: the law is not `key`). Null sources form one source. Rows repeated under one
    doc_id get slots of their own; identical rows may be taken for each other. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), seeded(seed, F.col("doc_id")).alias("h"))
    rows = materialise(rows, "shard_rows")
    bits = block_bits(rows.count())
    order = ["h", "doc_id", "text_crc32", "size"]
    ranked = running(rows, ["source"], block_of(F.col("h"), bits), order, F.lit(1).cast("long"), "r", "n")
    ranked = materialise(ranked.withColumn("frac", (2 * F.col("r") + 1) / (2 * F.col("n"))), "shard_ranks")
    # the block is computed from the integers; it is monotone in frac, whose order is that of the exact quotient
    block = F.expr(f"cast(((2 * r + 1) * {1 << bits}) div (2 * n) as int)")
    placed = running(ranked, [], block, ["frac", "source", *order], F.lit(1).cast("long"), "g", "rows")
    shard = F.expr(f"cast((g * {n_shards}) div rows as int)")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.expr(f"g - (shard * rows + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
