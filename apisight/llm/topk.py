"""Exact top-k search by integer inner product, with the kth score found from histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Rows of a block of candidates and of queries: what one step of a task scores.
CANDIDATES, QUERIES = 4096, 1024
#: Bits of a score that each round settles.
BITS = 9
#: Blocks of candidates and of queries (so many of each) that meet in one task.
GROUP = 4
#: Largest score that is told from others; doubles hold integers exactly below EXACT.
MOST, EXACT = (1 << 63) - 1, 1 << 53

_BLOCK = "part long, dim int, most double, rows binary, ids binary, vectors binary"


def _exact(a: np.ndarray, b: np.ndarray, dim: int, most_a: float, most_b: float) -> np.ndarray:
    """Integer inner products: in doubles where they are exact, else in Python's integers, kept within 64 bits."""
    if most_a * most_b * dim < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def _blocks(vectors: DataFrame, scale: int, size: int) -> DataFrame:
    """vec_id, embedding (array) and is_query as blocks of up to size vectors of one dimension. Row numbers are unique and odd for queries.

    Vectors whose products may need more than a double have blocks of their own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row, made = TaskContext.get().partitionId(), 0, 0
        had: dict[tuple[int, bool], list] = {}

        def flush(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal made
            rows, ids, x = (np.concatenate(c) for c in zip(*had.pop(kind), strict=True))
            made += 1
            values = [(task << 24) + made, kind[0], float(np.abs(x).max(initial=0)), rows.tobytes(), ids.tobytes(), x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "dim", "most", "rows", "ids", "vectors"])

        for batch in batches:
            at = 2 * (np.arange(row, row + batch.num_rows) + (task << 38)) + batch.column("is_query").to_numpy(zero_copy_only=False).astype(np.int64)
            row += batch.num_rows
            lists, ids = batch.column("embedding"), batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            dims = np.diff(offsets)
            for dim in np.unique(dims[dims > 0]):
                same = np.flatnonzero(dims == dim)
                # a double's floor is a whole number that a double holds; what scaling takes out of their range is brought back to its end
                with np.errstate(over="ignore"):
                    all_x = np.floor(scale * flat[offsets[same][:, None] + np.arange(dim)])
                all_x = np.clip(all_x, -np.finfo(np.float64).max, np.finfo(np.float64).max)
                large = np.abs(all_x).max(axis=1) >= np.sqrt(EXACT / dim)
                for wide in (False, True):
                    own, x = same[large == wide], all_x[large == wide]
                    kind, a = (int(dim), wide), 0
                    while a < len(own):  # a block takes no more than it has room for: _query_blocks() counts on it
                        b = a + size - sum(len(y[0]) for y in had.get(kind, []))
                        had.setdefault(kind, []).append((at[own[a:b]], ids[own[a:b]].astype(np.int64), x[a:b]))
                        if b <= len(own):
                            yield flush(kind)
                        a = b
        for kind in list(had):
            yield flush(kind)

    return vectors.mapInArrow(work, _BLOCK)


def _score(pair: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores (queries by candidates; a query's own row has the least 64-bit integer), query row numbers, query and candidate ids."""
    q_rows, c_rows = np.frombuffer(pair["q_rows"], np.int64), np.frombuffer(pair["rows"], np.int64)
    q, c = np.frombuffer(pair["q_vectors"]).reshape(len(q_rows), -1), np.frombuffer(pair["vectors"]).reshape(len(c_rows), -1)
    scores = _exact(q, c, pair["dim"], pair["q_most"], pair["most"])
    own = np.isin(c_rows, q_rows)
    if own.any():
        place = {r: i for i, r in enumerate(q_rows.tolist())}
        for j in np.flatnonzero(own):
            scores[place[int(c_rows[j])], j] = -MOST - 1
    return scores, q_rows, np.frombuffer(pair["q_ids"], np.int64), np.frombuffer(pair["ids"], np.int64)


def _state(pair: dict, n: int) -> tuple[np.ndarray, int]:
    """For each query of the block: the low end of the stretch that holds its kth score, and the bits of all stretches' width."""
    low = np.full(n, -MOST - 1, np.int64)
    for s in pair["state"] or []:
        low[s["at"]] = s["low"]
    return low, pair["bits"]


def _above(scores: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How far scores lie over low, as unsigned 64-bit integers; under it they wrap to large values."""
    return scores.view(np.uint64) - low.view(np.uint64)[:, None]


def _histograms(pairs: DataFrame, k: int) -> DataFrame:
    """part, at (a query), bin, n: how many of the block's scores lie in each bin of the query's stretch; scores under the block's own kth best
    are left out, for the kth best of all is not below that of a part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                scores, rows, _, _ = _score(pair)
                low, bits = _state(pair, len(rows))
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else scores.min(axis=1)
                over = _above(scores, low)
                inside = np.ones(over.shape, bool) if bits == 64 else (over >> np.uint64(bits)) == 0
                i, j = np.nonzero(inside & (scores >= low[:, None]) & (scores >= least[:, None]) & (scores > -MOST - 1))
                cell, n = np.unique((i << BITS) + (over[i, j] >> np.uint64(max(0, bits - BITS))).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), pair["q_part"])), pa.array((cell >> BITS).astype(np.int32)), pa.array((cell & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["part", "at", "bin", "n"])

    return pairs.mapInArrow(work, "part long, at int, bin int, n long")


def _winners(pairs: DataFrame, k: int) -> DataFrame:
    """Rows over each query's kth score, and of those equal to it the k least ids in each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                scores, rows, q_ids, ids = _score(pair)
                cut, _ = _state(pair, len(rows))
                i, j = np.nonzero((scores >= cut[:, None]) & (scores > -MOST - 1))
                score = scores[i, j]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                i, j, score = i[keep], j[keep], score[keep]
                yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(work, "row long, query_id long, vec_id long, score long")


def _query_blocks(blocks: DataFrame) -> DataFrame:
    """Of the candidates' blocks, the rows that are queries (the lowest bit of a row number), as blocks of up to QUERIES rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                rows = np.frombuffer(b["rows"], np.int64)
                asked = np.flatnonzero(rows & 1)
                ids, x = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["vectors"], np.int64).reshape(len(rows), -1)
                for n, a in enumerate(range(0, len(asked), QUERIES)):
                    own = asked[a : a + QUERIES]
                    out.append(b | {"part": b["part"] * (CANDIDATES // QUERIES + 1) + n, "rows": rows[own].tobytes(), "ids": ids[own].tobytes(), "vectors": x[own].tobytes()})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return blocks.mapInArrow(work, _BLOCK)


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The k candidates with the highest inner product for each row of vectors where `queries` holds; all of them, if there are fewer.

    Components become floor(scale * x) in doubles; scores are integers and exact, whatever the components. A score that no signed 64-bit
    integer holds is given as the nearest one that is held, -(2 ** 63 - 1) or 2 ** 63 - 1. Candidates are all rows of the same dimension but
    the query's own row. Ties go to the smaller vec_id. Vectors that are null, empty, or hold a null or non-finite component take no part;
    neither do rows with a null vec_id. Rows repeated under one vec_id are candidates, and queries, each.

    Queries meet all rows in blocks, GROUP blocks of either kind in a task, so tasks grow with the data. Each round scores everything and adds
    up histograms of every query's current stretch of scores; the bin that holds its kth score is the next stretch, until it is one score
    wide. Then everything is scored once more, and what lies over the kth score, with the least ids equal to it, is ranked. No task holds more
    than two blocks, their scores, and a query's few winners at once.

    Returns query_id, rank (from 1), vec_id, score.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    vectors = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    all_rows = materialise(_blocks(vectors, scale, CANDIDATES), "candidates")
    asked = materialise(_query_blocks(all_rows), "queries")
    spark = all_rows.sparkSession
    counts = {r.dim: r for r in all_rows.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"), F.max("most").alias("most")).collect()}
    asked_counts = {r.dim: r.blocks for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks")).collect()}
    if not asked_counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # scores of a dimension lie in [-2 ** (bits - 1), 2 ** (bits - 1)); a lane is a group of query blocks and a group of candidate blocks
    widths = [(d, min(63, (int(counts[d].most) ** 2 * d).bit_length()) + 1, -(-counts[d].blocks // GROUP), -(-n // GROUP)) for d, n in asked_counts.items()]
    plan = spark.createDataFrame(widths, "p_dim int, width int, c_groups int, q_groups int")
    group = lambda part, groups: F.pmod(F.xxhash64(part), F.col(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.col(groups) - 1))
    planned = lambda blocks: blocks.join(F.broadcast(plan), F.col("dim") == F.col("p_dim")).drop("p_dim")
    lanes = planned(all_rows).withColumn("c_lane", group("part", "c_groups")).withColumn("q_lane", every("q_groups")).drop("part", "width", "c_groups", "q_groups")
    q = planned(asked).select(group("part", "q_groups").alias("q_lane2"), every("c_groups").alias("c_lane2"), F.col("part").alias("q_part"), F.col("dim").alias("q_dim"), F.col("most").alias("q_most"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    state = planned(asked.select("part", "dim", (F.octet_length("rows") / 8).cast("int").alias("size")))
    least = F.when(F.col("width") == 64, F.lit(-MOST - 1)).otherwise(F.expr("-shiftleft(1L, width - 1)"))
    state = state.select("part", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"), least.cast("long").alias("least"), F.lit(0).cast("long").alias("over"), F.col("width").alias("bits"), F.lit(k).cast("long").alias("missing"))

    def pairs(now: DataFrame) -> DataFrame:
        # the sum modulo 2 ** 64, without an overflow
        low = F.when(F.col("least") == F.lit(-MOST - 1), F.col("least").bitwiseXOR(F.col("over"))).otherwise(F.expr("if(over < 0, 0, over) + least"))
        packed = now.groupBy(F.col("part").alias("s_part"), "bits").agg(F.collect_list(F.struct("at", low.alias("low"))).alias("state"))
        ready = q.join(packed, F.col("q_part") == F.col("s_part")).drop("s_part")
        meet = (F.col("dim") == F.col("q_dim")) & (F.col("q_lane") == F.col("q_lane2")) & (F.col("c_lane") == F.col("c_lane2"))
        return lanes.join(ready, meet).drop("q_dim", "q_lane", "c_lane", "q_lane2", "c_lane2")

    for _ in range(-(-max(width for _, width, _, _ in widths) // BITS)):
        bins = _histograms(pairs(state), k).groupBy(F.col("part").alias("p"), F.col("at").alias("a"), "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("p", "a").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("above", F.coalesce(above, F.lit(0)))
        joined = state.join(bins, (F.col("part") == F.col("p")) & (F.col("at") == F.col("a"))).where("above < missing and above + n >= missing")
        shift = f"greatest(bits - {BITS}, 0)"
        found = joined.select("part", "at", "least", F.expr(f"over | shiftleft(cast(bin as long), {shift})").alias("over"), F.expr(shift).alias("bits"), (F.col("missing") - F.col("above")).alias("missing"))
        # a query with fewer than k candidates has no kth score and takes all
        none = state.join(found.select(F.col("part").alias("p"), F.col("at").alias("a")), (F.col("part") == F.col("p")) & (F.col("at") == F.col("a")), "left_anti")
        state = materialise(found.union(none.select("part", "at", "least", F.lit(0).cast("long").alias("over"), F.lit(0).alias("bits"), "missing")), "kth")
    best = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    return _winners(pairs(state), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
