"""Training-order materialisation: fixed-stride binary shards in a keyed pseudo-random order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import id_type
from .packing import encoded
from .ranks import seeded
from .shared import materialise

#: Tokens of a sequence, and sequences of a shard.
LENGTH, SHARD_ROWS = 2048, 8192
#: Ends each document; fills the last sequence of each block of documents.
END_ID, PAD_ID = 50256, 50256
ROUNDS = 6
#: Bytes of text of a block on average, and the most blocks there are (a count for each is broadcast, some 16 bytes).
BLOCK_BYTES, MOST_BLOCKS = 16 << 20, 1 << 20
#: Sequences that are compressed together on their way to one shard.
TOGETHER = 64


def _round(x: np.ndarray, key: int) -> np.ndarray:
    h = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1. A balanced Feistel network permutes the next even power of two; values of n or more are put in again
    (cycle-walking) until they fall below n, after four times on average at most."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [zlib.crc32(f"{key}:{r}".encode()) * 0x100000001 for r in range(ROUNDS)]
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, seed: int = 3, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """block, at (from 0 in it), n (ids that are no filling), doc_ids (of the documents in it, in order), ids (little-endian, of id_type(path)).

    Documents are dealt to blocks by a seeded hash of doc_id and text; the number of blocks follows from the bytes of text. In a block they are
    ordered by that hash, doc_id and ids, each with end_id, and the row of ids is cut into sequences of length ids; each block is one task,
    which reads its documents one by one. So the same table gives the same sequences, however it is split and wherever it is read; rows that
    are equal in doc_id and text lie in one block. Null texts are end_id alone.
    """
    width = id_type(path)
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = min(MOST_BLOCKS, max(1, text_bytes // BLOCK_BYTES)).bit_length() - 1
    h = seeded(seed, F.col("doc_id"), F.xxhash64("text"))
    keyed = docs.select(F.struct(F.shiftright(h, 60 - bits).cast("int").alias("block"), h.alias("h"), F.col("doc_id").cast("long").alias("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("source"), "text")
    rows = encoded(keyed, path, end_id).select("doc_id.*", "ids").repartitionById(1 << bits, F.col("block")).sortWithinPartitions("block", "h", "doc_id", "ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        block, at, left = None, 0, 0  # left: ids that wait for the rest of their sequence
        rest: list[np.ndarray] = []
        known: list = []  # (doc_id, ids of it that wait)

        def cut(last: bool) -> pa.RecordBatch:
            """The whole sequences of what waits; the last one of a block is filled up."""
            nonlocal at, left, rest, known
            ids = np.concatenate(rest)
            ends = np.cumsum([c for _, c in known])
            count = -(-len(ids) // length) if last else len(ids) // length
            starts = np.arange(count) * length
            n = np.minimum(length, len(ids) - starts)
            own = np.concatenate((ids[: count * length], np.full(max(0, count * length - len(ids)), pad_id, width)))
            lists = [[known[j][0] for j in range(i, k + 1)] for i, k in zip(np.searchsorted(ends, starts, "right"), np.searchsorted(ends, starts + n - 1, "right"), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([block] * count, pa.int32()), pa.array(range(at, at + count), pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array([own[i * length : (i + 1) * length].tobytes() for i in range(count)], pa.binary())],
                ["block", "at", "n", "doc_ids", "ids"],
            )
            at, rest, left = at + count, [ids[count * length :]], max(0, len(ids) - count * length)
            first = int(np.searchsorted(ends, count * length, "right"))
            known = [(known[first][0], int(ends[first]) - count * length), *known[first + 1 :]] if left else []
            return out

        for batch in batches:
            blocks = batch.column("block").to_pylist()
            for i, (b, doc) in enumerate(zip(blocks, batch.column("doc_id").to_pylist(), strict=True)):
                if b != block:
                    if left:
                        yield cut(True)
                    block, at, left, rest, known = b, 0, 0, [], []
                own = np.frombuffer(unpack(batch.column("ids")[i].as_py()), width)
                rest.append(own)
                known.append((doc, len(own)))
                left += len(own)
                if left >= 64 * length:
                    yield cut(False)
        if left:
            yield cut(True)

    return rows.mapInArrow(work, "block int, at long, n long, doc_ids array<long>, ids binary")


def write_training_order(docs: DataFrame, path: str, out: str, key: int = 1, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes all documents as fixed-stride shards in training order; returns the index: slot, shard, place, n, doc_ids, ids_crc32 (of the record).

    Sequences (see sequences()) are numbered without gaps by block; feistel() gives each number a global slot. Shard s holds the slots from
    s * shard_rows on, in order, in out/shard=s/: one file of records of `length` little-endian ids (16 bits each, or 32 if the vocabulary
    needs them) and a line end, so slot t starts at (t % shard_rows) * (record + 1): read_shards() and any seek reach it, and a run resumes at
    a slot. The shards are the partitions by ranges of slots, one in each task. Spark's own writer makes the files, so a lost executor's
    task is done again and a shard is there whole or not at all. The same table and key give the same shards, however the table is split.
    `out` must be new.

    The ids are made once; they are shuffled to their blocks, written to the shared folder as sequences, and shuffled compressed to the shards.
    Repeated rows are written each; null and empty texts are the end id alone; documents with null doc_id are written, and null in doc_ids.
    Empty tables write nothing.
    """
    record = length * id_type(path).itemsize
    made = materialise(sequences(docs, path, length), "sequences")
    counts = made.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # MOST_BLOCKS rows at most
    counts = counts.select(F.col("block").alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    total = made.count()
    shards = max(1, -(-total // shard_rows))
    rows = made.join(F.broadcast(counts), F.col("block") == F.col("b")).select((F.col("base") + F.col("at")).alias("number"), "n", "doc_ids", "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            slots = feistel(batch.column("number").to_numpy(), total, key)
            order, ids = np.argsort(slots), batch.column("ids")
            shard = slots[order] // shard_rows
            found: list[tuple] = []
            for a in np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(order) else ():
                own = order[a : a + np.searchsorted(shard[a:], shard[a], "right")]
                for some in (own[i : i + TOGETHER] for i in range(0, len(own), TOGETHER)):
                    found.append((int(shard[a]), slots[some].tolist(), compress(b"".join(ids[int(i)].as_py() for i in some))))
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.binary())], ["shard", "slots", "ids"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, slots, ids in zip(batch.column("shard").to_pylist(), batch.column("slots").to_pylist(), batch.column("ids"), strict=True):
                raw = expand(ids.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(slots), pa.int64()), pa.array(slots, pa.int64()), pa.array([raw[i * record : (i + 1) * record] for i in range(len(slots))], pa.binary())], ["shard", "slot", "record"])

    placed = rows.select("number", "ids").mapInArrow(place, "shard int, slots array<long>, ids binary").repartitionById(shards, F.col("shard"))
    records = placed.mapInArrow(plain, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
    records.select(F.col("record").cast("string").alias("record"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(out)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = feistel(batch.column("number").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // shard_rows), pa.array(slots % shard_rows), batch.column("n"), batch.column("doc_ids"), batch.column("ids_crc32")], ["slot", "shard", "place", "n", "doc_ids", "ids_crc32"])

    return rows.select("number", "n", "doc_ids", F.crc32("ids").alias("ids_crc32")).mapInArrow(index, "slot long, shard long, place long, n long, doc_ids array<long>, ids_crc32 long")


def read_shards(spark: SparkSession, out: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, start: int = 0, id_bytes: int = 2) -> DataFrame:
    """slot, ids (binary) of a written order, from slot `start` on; shards before it are not read. id_bytes: of the vocabulary's id_type()."""
    stride = id_bytes * length + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if raw.size % stride:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                skip = max(0, start - shard * shard_rows)
                for a in range(skip, raw.size // stride, 512):
                    to = min(a + 512, raw.size // stride)
                    yield pa.RecordBatch.from_arrays([pa.array(range(shard * shard_rows + a, shard * shard_rows + to), pa.int64()), pa.array([raw.slice(i * stride, stride - 1).to_pybytes() for i in range(a, to)], pa.binary())], ["slot", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    if "shard" not in files.columns:  # nothing was written
        return spark.createDataFrame([], "slot long, ids binary")
    files = files.select(F.col("shard").cast("long").alias("shard"), "content").where(F.col("shard") >= start // shard_rows)
    return files.mapInArrow(work, "slot long, ids binary")
