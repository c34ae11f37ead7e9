"""Mixture-controlled packing into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode, id_type
from .ranks import block_bits, block_of, running, seeded
from .shared import materialise

#: Tokens of a window.
WINDOW = 2048
#: Tokens of a packet: the most that a queue holds back of its due.
PACKET = 512
#: Parts of a token in which the quanta of targets are counted.
UNIT = 1 << 16
#: Sources whose quanta are broadcast (some tens of bytes each); those of more are joined.
BROADCAST_SOURCES = 100_000
#: Ends each document.
END_ID = 1


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id (of any type), source, n (tokens with end_id), ids (compressed, of id_type(path)). Null texts are empty."""
    width = id_type(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, ids = [], []
                for text in part.column("text"):
                    own = np.array([*encode(path, text.as_py()), end_id], width)
                    n.append(len(own))
                    ids.append(pack(own.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(work, f"doc_id {kind}, source string, n long, ids binary")


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """encoded() with key (unique), written to the shared folder."""
    return materialise(encoded(docs, path, end_id).withColumn("key", F.monotonically_increasing_id()), "ids", "none")


def share(u: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(u * part / whole), exact for values below 2 ** 50; 0 where whole is 0."""
    some = np.maximum(whole, 1)
    guess = np.floor(u.astype(np.longdouble) * part / some).astype(np.int64)  # off by one at most
    return guess + (u * part - guess * some) // some  # the products wrap, their difference is small


def rounds(end: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """The round in which a packet goes whose queue has then given `end` tokens, its quantum being den / num: the first whose credit suffices."""
    done = share(end, num, den)
    exact = end * num == done * den  # both wrap alike
    return done + ~exact


def turns(n: np.ndarray, begin: np.ndarray, num: np.ndarray, den: np.ndarray, base: np.ndarray, packet: int) -> tuple[np.ndarray, ...]:
    """Of documents of n tokens that follow `begin` tokens of their queues: which document, the round, its first token and its tokens in that round.

    A document is sent in packets of `packet` tokens; those of one round are one turn.
    """
    count = -(-n // packet)
    which = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum((nth + 1) * packet, n[which])
    at = base[which] + rounds(begin[which] + end, num[which], den[which])
    first = np.concatenate((np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (which[1:] != which[:-1])))
    last = np.concatenate((first[1:], np.ones(min(1, len(at)), bool)))
    start = (nth * packet)[first]
    return which[first], at[first], start, end[last] - start


def quanta(sums: DataFrame, targets: dict[str | None, float], window: int) -> DataFrame:
    """sums: source, tokens. For every source q_source, num, den (its quantum is den / num tokens a round) and base, the rounds before its first.

    A round has a window's tokens: a source's quantum is its share of them. Sources that targets leaves out begin when the others have run
    dry, by the shares of their own tokens.
    """
    if any(x <= 0 for x in targets.values()):
        raise ValueError("a target is a share over 0")
    spark = sums.sparkSession
    mine = spark.createDataFrame([(s, max(1, round(Fraction(x) * window * UNIT))) for s, x in targets.items()], "t_source string, t_units long")
    sums = materialise(sums.join(F.broadcast(mine), F.col("source").eqNullSafe(F.col("t_source")), "left"), "sources")
    known = sums.where("t_units is not null")
    if sums.limit(1).count() and (lacking := mine.join(known.select("source"), F.col("t_source").eqNullSafe(F.col("source")), "left_anti").collect()):
        raise ValueError(f"targets for sources that the table lacks: {[r.t_source for r in lacking]}")
    base = known.agg(F.max(F.expr(f"cast(tokens as decimal(20,0)) * {UNIT} div t_units + 1"))).first()[0] or 0
    rest = sums.where("t_units is null").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    own = F.col("t_units").isNotNull()
    return sums.select(
        F.col("source").alias("q_source"),
        F.when(own, UNIT).otherwise(rest).cast("long").alias("num"),
        F.when(own, F.col("t_units")).otherwise(F.col("tokens") * window).cast("long").alias("den"),
        F.when(own, 0).otherwise(base).cast("long").alias("base"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, targets: dict[str | None, float] | None = None, seed: int = 11, end_id: int = END_ID, packet: int = PACKET) -> DataFrame:
    """Packs all documents into windows of `window` tokens by deficit round-robin over a queue for each source.

    A queue holds its source's documents in seeded order, in packets of `packet` tokens (a document's last one may be shorter). In each round it
    is credited its quantum, its target share of a window, and sends packets while the credit lasts; what is left, its deficit, it carries to
    the next round. So after any round a queue has given its due but for less than a packet, whatever windows and tasks the round falls in. In
    closed form: a packet up to whose end the queue gives c tokens goes in round ceil(c / quantum). Rounds follow each other, queues in a
    round by a hash; windows cut that one sequence of tokens, so all are full but the last. Packets of a document in one round stay together.

    targets: share of a source, over 0; the others begin when those named have run dry. By default, and among those others, a source's share
    is that of all their tokens, so that they end together. A target for a source that the table lacks is an error.

    Returns one row for each piece: doc_id, start (tokens of the document before it), length, ids_crc32 (of its little-endian unsigned
    32-bit ids), doc_tokens (with end_id), sequence_id, offset (gapless from 0), source, key (unique for each input row). Null and empty
    texts are packed as end_id alone; a null source is a source of its own; rows repeated under one doc_id are packed each. Other columns are
    ignored. An empty table gives no rows.

    Texts are encoded once; the ids are written to the shared folder and shuffled once, to meet their places. Places come from sums by blocks of
    each queue and of all turns (ranks.py), so that neither a source nor the whole sequence is a task.
    """
    ids = tokenise(docs, path, end_id)
    rows_in, width = ids.count(), id_type(path)
    sources = materialise(quanta(ids.groupBy("source").agg(F.sum("n").alias("tokens")), targets or {}, window), "quanta")
    number = sources.count()
    order = seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "key")))
    slim = ids.select("key", "source", "n", order.alias("h"))
    placed = running(slim, ["source"], block_of(F.col("h"), block_bits(rows_in)), ["h", "key"], F.col("n"), "begin").select("key", "source", "n", "begin")
    placed = placed.join(F.broadcast(sources) if number <= BROADCAST_SOURCES else sources, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    turn = "key long, source string, round long, at long, start long, length long"

    def take_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, begin, num, den, base = (batch.column(x).to_numpy() for x in ("n", "begin", "num", "den", "base"))
            doc, at, start, length = turns(n, begin, num, den, base, packet)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("source").take(take), *[pa.array(x) for x in (at, begin[doc] + start, start, length)]], ["key", "source", "round", "at", "start", "length"])

    taken = materialise(placed.mapInArrow(take_turns, turn), "turns")
    last, many = taken.agg(F.coalesce(F.max("round"), F.lit(0)), F.count(F.lit(1))).first()
    # blocks of consecutive rounds, of some BLOCK_ROWS turns; a round has no more turns than a window tokens, or packets that were waiting
    block = F.floor(F.col("round").cast("double") * (1 << block_bits(many)) / (last + 1)).cast("int")
    spread = taken.withColumn("q", seeded(seed, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    spread = running(spread, [], block, ["round", "q", "source", "at"], F.col("length"), "g")
    of = spread.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(F.struct("start", "length", "g"))).alias("turns"))
    rows = ids.join(of, F.col("key") == F.col("k")).select("key", "doc_id", "source", "n", "ids", "turns")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                mine = part.column("turns")
                doc = np.repeat(np.arange(len(part)), np.diff(mine.offsets.to_numpy()))
                start, length, g = (mine.flatten().field(x).to_numpy() for x in ("start", "length", "g"))
                # a window's end cuts a turn
                first, final = g // window, (g + length - 1) // window
                count = final - first + 1
                which = np.repeat(np.arange(len(g)), count)
                w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]
                low, high = np.maximum(g[which], w * window), np.minimum((g + length)[which], (w + 1) * window)
                doc, first, length, place = doc[which], start[which] + low - g[which], high - low, low - w * window
                # what follows on in one window is one piece
                new = np.concatenate((np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (w[1:] != w[:-1]) | (place[1:] != (place + length)[:-1])))
                head = np.flatnonzero(new)
                length = np.add.reduceat(length, head) if len(head) else length
                doc, first, w, place = doc[head], first[head], w[head], place[head]
                n = part.column("n").to_numpy()
                crc, had, raw = np.zeros(len(doc), np.int64), -1, memoryview(b"")
                blobs = part.column("ids")
                for i, (d, s, m) in enumerate(zip(doc.tolist(), first.tolist(), length.tolist(), strict=True)):
                    if d != had:
                        had, raw = d, memoryview(np.frombuffer(unpack(blobs[d].as_py()), width).astype("<u4").tobytes())
                    crc[i] = zlib.crc32(raw[4 * s : 4 * (s + m)])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), pa.array(first), pa.array(length), pa.array(crc), pa.array(n[doc]), pa.array(w), pa.array(place), part.column("source").take(take), part.column("key").take(take)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "key"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, key long")
