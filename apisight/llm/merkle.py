"""Merkle manifests of datasets: trees of FAN children a node, kept as blocks in a van Emde Boas layout.

A tree is cut into aligned subtrees (blocks) of at most LEVELS levels of edges, so of FAN ** LEVELS leaves. A task makes a block's nodes and
stores them as one value, laid out by recursive halving of its height: the top half of the levels, then each tree below it in order. A node's
address follows from the height, its depth and its place alone. The roots of a round's blocks are the leaves of the next round's. Siblings
are read from the blocks by the same addresses, from the top round down, so that no task needs more than one block and the path above it.

Digests are hashed as lowercase hexadecimal text and stored as 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Levels of edges in a block.
LEVELS = 3
#: Rows of a range when rows are put in order; ranges whose counts are broadcast.
RANGE_ROWS, BROADCAST_RANGES = 100_000, 200_000

_PATH = "path array<struct<l: binary, r: binary>>"


def _size(height: int) -> int:
    """Nodes of a whole tree of so many levels of nodes."""
    return (FAN**height - 1) // (FAN - 1)


def address(height: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the nodes at a depth (0: the root) stand in the layout of a whole tree of `height` levels of nodes."""
    place = np.asarray(place, np.int64)
    at = np.zeros(len(place), np.int64)
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        height, depth = height - top, depth - top
        tree = place >> (FAN_BITS * depth)
        at += _size(top) + tree * _size(height)
        place = place - (tree << (FAN_BITS * depth))
    return at


def _sha(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def build_block(leaves: list[bytes], levels: int) -> np.ndarray:
    """The block's nodes, 32 bytes each, in the layout of levels + 1 levels of nodes; places without a node are zero."""
    store = np.zeros((_size(levels + 1), 32), np.uint8)
    now = b"".join(leaves)
    for depth in range(levels, -1, -1):
        n = len(now) // 32
        store[address(levels + 1, depth, np.arange(n))] = np.frombuffer(now, np.uint8).reshape(n, 32)
        if depth:
            text, step = now.hex(), 64 * FAN
            now = b"".join(_sha(text[i : i + step]) for i in range(0, len(text), step))
    return store


def siblings(store: np.ndarray, levels: int, counts: list[int], place: int) -> list[tuple[bytes, bytes]]:
    """Of a leaf of a block: the digests to its left and right in its run, level by level, without the block's root."""
    out = []
    for depth in range(levels, 0, -1):
        first = place & ~(FAN - 1)
        run = store[address(levels + 1, depth, np.arange(first, min(first + FAN, counts[depth])))].tobytes()
        out.append((run[: 32 * (place - first)], run[32 * (place - first + 1) :]))
        place >>= FAN_BITS
    return out


def _counts(n: int, levels: int) -> list[int]:
    """Nodes at each depth over n leaves."""
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


def _height(n: int) -> int:
    """Levels of edges over n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def fold(start: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        start = _sha(left.hex() + start.hex() + right.hex())
    return start


def proof_digest(path: list[tuple[bytes, bytes]]) -> bytes:
    return _sha("".join(left.hex() + right.hex() for left, right in path))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 (32 bytes) of a row's values: `-` for null, else the UTF-8 bytes' number, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows, in the shared folder, with idx (place from 0 among the rows of equal keys, nulls being equal) and n (how many those are).

    Ranges of (keys, order) are sorted apart; counts by range are summed up. Rows that tie are split by their place in the table, so that
    neither a key nor a tie makes a range larger.
    """
    rows = materialise(rows.withColumn("_u", F.monotonically_increasing_id()), "unordered")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = rows.repartitionByRange(ranges, *keys, *order, "_u").sortWithinPartitions(*keys, *order, "_u").drop("_u")
    ranged = materialise(ranged.withColumn("_g", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_g", 33)), "ordered")
    names = [f"_k{i}" for i in range(len(keys))]
    sums = ranged.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names, strict=True)], F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_c"), F.min("_g").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    sums = materialise(sums.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(*names))), "range_counts")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, names, strict=True)], F.col("_range") == F.col("_r"))
    joined = ranged.join(F.broadcast(sums) if sums.count() <= BROADCAST_RANGES else sums, same)
    return joined.withColumn("idx", F.col("_before") + F.col("_g") - F.col("_first")).drop("_g", "_range", "_r", "_c", "_first", "_before", *names)


def _blocks(level: DataFrame, levels: int) -> DataFrame:
    """tree, block, n, count, levels, store, root of every block of a round; level: tree, idx, n, digest."""
    span = FAN**levels

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        own = levels if n > span else _height(n)
        store = build_block(table.column("digest").to_pylist(), own)
        root = store[address(own + 1, 0, np.zeros(1))[0]].tobytes()
        row = {"tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py(), "n": n, "count": len(table), "levels": own, "store": zstandard.compress(store.tobytes(), 1), "root": root}
        return pa.Table.from_pylist([row], pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("count", pa.int64()), ("levels", pa.int32()), ("store", pa.binary()), ("root", pa.binary())]))

    rows = level.select("tree", "idx", "n", "digest", F.expr(f"idx div {span}").alias("block"))
    return rows.groupBy("tree", "block").applyInArrow(work, "tree long, block long, n long, count long, levels int, store binary, root binary")


def _forest(level: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over a level, lowest first, and (tree, root) of every tree."""
    rounds, roots, span = [], None, FAN**levels
    while True:
        made = materialise(_blocks(level, levels), f"{name}_blocks")
        rounds.append(made)
        done = made.where(F.col("n") <= span).select("tree", "root")
        roots = done if roots is None else roots.union(done)
        level = made.where(F.col("n") > span).select("tree", F.col("block").alias("idx"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"))
        if not level.limit(1).count():
            return rounds, roots


def _unpacked(levels: int, count: int, packed: bytes) -> tuple[np.ndarray, list[int]]:
    return np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(-1, 32), _counts(count, levels)


def _leaf_paths(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, idx, path of each leaf of blocks that have the path of their root."""
    kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                store, counts = _unpacked(row["levels"], row["count"], row["store"])
                outer = [(p["l"], p["r"]) for p in row["path"]]
                first = row["block"] * FAN**levels
                found = [{"tree": row["tree"], "idx": first + i, "path": [{"l": a, "r": b} for a, b in [*siblings(store, row["levels"], counts, i), *outer]]} for i in range(row["count"])]
                yield pa.RecordBatch.from_pylist(found, pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("path", kind)]))

    return blocks.select("tree", "block", "count", "levels", "store", "path").mapInArrow(work, f"tree long, idx long, {_PATH}")


def _down(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The blocks of the lowest round with path, the siblings from their roots on up to the top of all; above: tree, path of the trees' roots.

    A tree ends in the round in which it is one block; below that round, its blocks' roots are the leaves of the blocks above.
    """
    span, paths = FAN**levels, None
    for at in range(len(rounds) - 1, -1, -1):
        blocks = rounds[at].where(F.col("n") <= span).join(above.withColumnRenamed("tree", "_t"), F.col("tree") == F.col("_t")).drop("_t")
        if paths is not None:
            more = rounds[at].where(F.col("n") > span).join(paths.toDF("_t", "_i", "path"), (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_i"))).drop("_t", "_i")
            blocks = blocks.union(more)
        if at:
            paths = materialise(_leaf_paths(blocks, levels), "paths")
    return blocks


@dataclass
class Manifest:
    """leaves: the rows with tree (place of their group), idx and n; rounds: blocks of the groups' trees; top: blocks of the tree over the
    groups' roots; roots: tree, subroot; root: that of all, None without rows."""

    leaves: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    root: bytes | None
    levels: int


def build_manifest(rows: DataFrame, group: str, order: list[str], levels: int = LEVELS) -> Manifest:
    """rows: with leaf (32 bytes), and any other columns, but tree, idx, n and those that begin with `_`.

    The leaves of one group (null is a group) are in the order of `order`, then of their digests; groups in their own, null first and strings
    by their bytes. Every FAN consecutive nodes become the digest of their joined hexadecimal texts until one is left.
    """
    placed = in_order(rows, [group], [*order, "leaf"])
    groups = materialise(placed.where("idx = 0").select(F.col(group).alias("_group"), F.col("n").alias("_size")), "groups")
    ranked = in_order(groups, [], ["_group"]).select("_group", F.col("idx").alias("tree"), F.col("n").alias("trees"))
    ranked = materialise(ranked, "trees")
    small = F.broadcast(ranked) if ranked.count() <= BROADCAST_RANGES else ranked
    leaves = materialise(placed.join(small.drop("trees"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group"), "leaves")
    rounds, roots = _forest(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), levels, "group")
    roots = materialise(roots, "subroots").withColumnRenamed("root", "subroot")
    over = roots.join(ranked.select(F.col("tree").alias("_t"), "trees"), F.col("tree") == F.col("_t")).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), F.col("subroot").alias("digest"))
    top, root = _forest(over, levels, "top")
    found = root.first()
    return Manifest(leaves, rounds, top, roots, found and bytes(found["root"]), levels)


def audit(manifest: Manifest, presented: str | None = None) -> DataFrame:
    """The manifest's rows with subroot, root, proof_sha256 (of the siblings from the leaf up to the root), folded_root (from the leaf in the
    column `presented`, or from the row's own where that is null or unnamed, and the siblings) and verified (whether it is the root).

    Digests are lowercase hexadecimal texts; leaf is turned into one too. Blocks and their rows meet by (tree, block): a task holds one block.
    """
    levels, spark = manifest.levels, manifest.leaves.sparkSession
    span, root = FAN**levels, manifest.root or b""
    none = spark.createDataFrame([(0, [])], f"tree long, {_PATH}")
    over = _down(manifest.top, none, levels)
    # the leaves of the tree over the groups are the groups
    top_paths = materialise(_leaf_paths(over, levels), "group_paths")
    blocks = _down(manifest.rounds, top_paths.select("idx", "path").toDF("tree", "path"), levels)
    blocks = blocks.join(manifest.roots.toDF("_t", "subroot"), F.col("tree") == F.col("_t")).drop("_t", "root")
    columns = [c for c in manifest.leaves.columns if c not in ("tree", "idx", "n")]
    rows = manifest.leaves.withColumn("block", F.expr(f"idx div {span}"))
    kinds = dict(manifest.leaves.dtypes)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        store, counts = _unpacked(block["levels"], block["count"], block["store"])
        outer = [(p["l"], p["r"]) for p in block["path"]]
        leaf = left.column("leaf").to_pylist()
        start = left.column(presented).to_pylist() if presented else [None] * len(leaf)
        proofs, folded = [], []
        for place, own, other in zip(left.column("idx").to_pylist(), leaf, start, strict=True):
            path = [*siblings(store, block["levels"], counts, place - block["block"] * span), *outer]
            proofs.append(proof_digest(path).hex())
            folded.append(fold(own if other is None else other, path).hex())
        out = {c: left.column(c) for c in columns if c not in ("leaf", presented)}
        out |= {"leaf": pa.array([x.hex() for x in leaf]), "subroot": pa.array([block["subroot"].hex()] * len(leaf)), "root": pa.array([root.hex()] * len(leaf))}
        return pa.table(out | {"proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root.hex() for x in folded])})

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns if c not in ("leaf", presented)] + ["leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"])
    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(work, schema)


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot (of its lang), root, and an audit against rows of which a third are tampered with.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Where 3 divides the CRC-32 of the doc_id's decimal text, the row that is
    presented has A-Z in its text lower-cased. Rows repeated under one doc_id are leaves of their own, in the order of their digests; a null
    doc_id comes first and is not tampered with, null texts stay. An empty table gives no rows. Other columns are ignored.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.col("text")
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(*rest, lowered))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_digest(*rest, text).alias("leaf"), tampered.alias("presented"))
    return audit(build_manifest(rows, "lang", ["doc_id"], levels), "presented").drop("lang")
