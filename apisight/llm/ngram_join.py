"""N-gram Jaccard join by rare-first prefixes, exact, with groups of copies held together.

Steps, all exact:

1. Every text becomes its set of distinct k-word shingle hashes (64 bits). Hashes are dealt to ranges (groups of sorted blobs, not rows); a
   range finds those that two documents or more have. A shingle of one document alone can be in no intersection. Ranges grow in number with
   the bytes of text; many are dealt in steps, so that the blobs grow with the hashes and not with ranges times tasks. A hash that OFTEN of
   the documents at hand have is counted before it is dealt: its range gets the count, and its documents in blobs that are read one by one
   after all counts, so no task holds the documents of a frequent shingle.
2. A document can only link if its repeated shingles make up the threshold of its set: any union is at least the set. The rest go.
3. Documents with equal size and equal repeated shingles have the same links to all others. They form one class; its least id stands for it.
   Shingles are counted again over classes, and step 2 is repeated.
4. Each class's set is sorted rarest first (those of one class alone, then by count, then hash). Two sets that link share a shingle in their
   prefixes of n - ceil(t n) + 1. Prefix shingles are join keys (buckets), with length and positional filters and a suffix bound from the
   repeated shingles that are left.
5. In every bucket all members meet its pivot, the member with the fewest unique shingles; these pairs are verified once. Of the other pairs
   only those in different components matter. They meet in blocks of members of like lengths, where a bound from what either shares with the
   pivot is added to the filters; what is left is verified once.
6. Components of the links by large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import free_names, materialise
from .words import chunks, mix, shingles

#: Bytes of text for each hash range and each group of documents (some million shingles): a range's blobs are what one task holds at once.
BYTES_PER_RANGE = 8 << 20
LEAST_BITS = 4
#: Bits of a range's number that one step deals.
STEP_BITS = 10
#: Documents and hashes that are dealt at once.
FLUSH_DOCS, FLUSH_HASHES = 60_000, 3_000_000
#: Of the documents dealt at once, those that make their common hash a frequent one.
OFTEN = 256
#: Members of a bucket that are compared at once in the last step.
BLOCK = 256

#: kind is 0, or 1 for entries of frequent hashes on their way to a range, where kind 0 then has records with their counts.
_BLOB = "part int, kind int, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed value."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (np.dtype(a.dtype).num, len(a))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.int64, np.uint64, np.uint32, np.uint16, np.int32)}


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 * (1 + 2 * n), []
    for kind, length in head.reshape(-1, 2):
        out.append(np.frombuffer(raw, _TYPES[int(kind)], int(length), at))
        at += _TYPES[int(kind)].itemsize * int(length)
    return out


Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blob(ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, h: np.ndarray, times: np.ndarray) -> bytes:
    """Entries as a value: documents with the sizes of their sets; for each hash its document's place among them and, if known, its count."""
    used, first, local = np.unique(ids[owner], return_index=True, return_inverse=True)
    place = local.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    parts = [(h >> np.uint64(32)).astype(np.uint16), (h >> np.uint64(48)).astype(np.uint16)]  # apart, for the highest bits are alike in a range
    return _pack(used, sizes[owner[first]], place, h.astype(np.uint32), *parts, np.minimum(times, 0xFFFFFFFF).astype(np.uint32))


def _entries(blobs: list[bytes]) -> Entries:
    """ids, sizes, owner (place in ids), hashes and counts of several blobs together. On the way to a range a count of 0 is an entry's, for it
    is not known yet, and any other is that of a record, which tells how many entries of its hash are in blobs of kind 1."""
    out: list[list] = [[], [], [], [], []]
    base = 0
    for blob in blobs:
        ids, sizes, place, low, middle, high, times = _unpack(blob)
        h = low.astype(np.uint64) | (middle.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(48))
        for had, new in zip(out, (ids, sizes, place.astype(np.int64) + base, h, times), strict=True):
            had.append(new)
        base += len(ids)
    return tuple(np.concatenate(x) for x in out)


def _deal(entries: Entries, where: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Entries by `where`, the number of the range or group that each goes to."""
    ids, sizes, owner, h, times = entries
    order = np.argsort(where, kind="stable")  # documents stay in order, so that their places compress
    where = where[order]
    bounds = np.append(np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else [], len(where)).astype(np.int64)
    blobs = [_blob(ids, sizes, owner[o], h[o], times[o]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for o in (order[a:b],)]
    return pa.RecordBatch.from_arrays([pa.array(where[bounds[:-1]], pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _range(entries: Entries, bits: int) -> np.ndarray:
    return (entries[3] >> np.uint64(64 - bits)).astype(np.int64)


def _group(entries: Entries, bits: int) -> np.ndarray:
    """The group of each entry's document."""
    return ((entries[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)[entries[2]]


def _deal_ranges(entries: Entries, kind: int, bits: int, often: int) -> Iterator[pa.RecordBatch]:
    """Entries and records by range; entries of kind 0 whose hash `often` of them have become kind 1 and leave a record of their number."""
    ids, sizes, owner, h, times = entries
    where = _range(entries, bits)
    if kind == 0:
        low = (h & np.uint64((1 << 20) - 1)).astype(np.int64)
        some = np.flatnonzero((times == 0) & (np.bincount(low, times == 0, 1 << 20) >= often)[low])
        _, first, back, count = np.unique(h[some], return_index=True, return_inverse=True, return_counts=True)
        moved, records = some[(count >= often)[back]], some[first[count >= often]]
        if len(moved):
            yield _deal((ids, sizes, owner[moved], h[moved], times[moved]), where[moved], 1)
            rest = np.ones(len(h), bool)
            rest[moved] = False
            stay = np.concatenate((np.flatnonzero(rest), records))
            owner, h, where, times = owner[stay], h[stay], where[stay], np.concatenate((times[rest], count[count >= often]))
    yield _deal((ids, sizes, owner, h, times), where, kind)


def _deal_groups(entries: Entries, kind: int, bits: int, often: int) -> Iterator[pa.RecordBatch]:
    yield _deal(entries, _group(entries, bits), kind)


def _finer(blobs: DataFrame, deal: Callable[[Entries, int, int, int], Iterator[pa.RecordBatch]], bits: int) -> DataFrame:
    """Blobs of the first STEP_BITS bits dealt on, STEP_BITS at a time, up to `bits` bits. No step gathers a range: any task may have a part of it."""

    def step(now: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            had: tuple[list[bytes], list[bytes]] = ([], [])
            size = [0, 0]
            for batch in batches:
                for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                    had[kind].append(blob.as_py())
                    size[kind] += len(had[kind][-1])
                    if size[kind] > 8 * FLUSH_HASHES:
                        yield from deal(_entries(had[kind]), kind, now, OFTEN)
                        had[kind].clear()
                        size[kind] = 0
            for kind in (0, 1):
                if had[kind]:
                    yield from deal(_entries(had[kind]), kind, now, OFTEN)

        return work

    for done in range(2 * STEP_BITS, bits + STEP_BITS, STEP_BITS):
        salted = blobs.repartition("part", F.pmod(F.xxhash64("blob"), F.lit(1 << STEP_BITS))).sortWithinPartitions("part")
        blobs = salted.mapInArrow(step(min(done, bits)), _BLOB)
    return blobs


def _shingle_blobs(docs: DataFrame, k: int, bits: int) -> DataFrame:
    first = min(bits, STEP_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: list = []

        def flush():
            ids, sizes = np.concatenate([x[0] for x in had]), np.concatenate([x[1] for x in had])
            at = np.cumsum([0] + [len(x[0]) for x in had[:-1]])
            owner, h = np.concatenate([x[2] + a for x, a in zip(had, at, strict=True)]), np.concatenate([x[3] for x in had])
            had.clear()
            yield from _deal_ranges((ids, sizes, owner, h, np.zeros(len(h), np.uint32)), 0, first, OFTEN)

        rows = hashes = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(batch.column("text")):
                own, h = shingles(chunk, k)
                sizes = np.bincount(own, minlength=chunk.n).astype(np.int64)
                if had and (rows + chunk.n > FLUSH_DOCS or hashes > FLUSH_HASHES):
                    yield from flush()
                    rows = hashes = 0
                had.append((ids[chunk.first : chunk.first + chunk.n], sizes, own, h))
                rows, hashes = rows + chunk.n, hashes + len(h)
        if had:
            yield from flush()

    blobs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(work, _BLOB)
    return _finer(blobs, _deal_ranges, bits)


def _set_blobs(sets: DataFrame, bits: int) -> DataFrame:
    """As _shingle_blobs, from (doc_id, n, hashes)."""
    first = min(bits, STEP_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                h = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
                owner = np.repeat(np.arange(len(h)), [len(x) for x in h])
                # mixed, so that they spread over the ranges anew; mix() keeps different hashes different
                entries = part.column("doc_id").to_numpy(), part.column("n").to_numpy(), owner, mix(np.concatenate(h)), np.zeros(len(owner), np.uint32)
                yield from _deal_ranges(entries, 0, first, OFTEN)

    return _finer(sets.select("doc_id", "n", "hashes").mapInArrow(work, _BLOB), _deal_ranges, bits)


def _counted(entries: Entries) -> tuple[Entries, np.ndarray, np.ndarray]:
    """The entries of a range's kind 0 that have company, with their counts and in order of documents; and all hashes, sorted, with their counts."""
    ids, sizes, owner, h, times = entries
    record, own = times > 0, np.flatnonzero(times == 0)
    own = own[np.lexsort((ids[owner[own]], h[own]))]
    new = np.ones(len(own), bool)  # rows repeated under one id count once
    new[1:] = (h[own[1:]] != h[own[:-1]]) | (ids[owner[own[1:]]] != ids[owner[own[:-1]]])
    own = own[new]
    mine, count = np.unique(h[own], return_counts=True)
    told, back = np.unique(h[record], return_inverse=True)
    every = np.union1d(mine, told) if len(told) else mine
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, mine)] += count
    total[np.searchsorted(every, told)] += np.bincount(back, times[record], len(told)).astype(np.int64)
    count = total[np.searchsorted(every, h[own])]
    own, count = own[count > 1], count[count > 1]
    by_doc = np.argsort(ids[owner[own]], kind="stable")
    return (ids, sizes, owner[own[by_doc]], h[own[by_doc]], count[by_doc]), every, total


def _repeated(blobs: DataFrame, bits: int) -> DataFrame:
    """Of each range, the hashes that several documents have, with their counts, as blobs by group of documents.

    A task holds the blobs of kind 0 of one range; those of kind 1 come after them and are held one at a time. (Rows repeated under one id are
    counted each where their hash is frequent; a count too high only lets more through to the later steps.)
    """
    first = min(bits, STEP_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, had, known = None, [], None

        def count():
            nonlocal known
            entries, *known = _counted(_entries(had))
            had.clear()
            return _deal(entries, _group(entries, first))

        for batch in batches:
            for now, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if had and (now != part or kind == 1):
                    yield count()
                part = now
                if kind == 0:
                    had.append(blob.as_py())
                else:
                    ids, sizes, owner, h, _ = _entries([blob.as_py()])
                    entries = ids, sizes, owner, h, known[1][np.searchsorted(known[0], h)]
                    yield _deal(entries, _group(entries, first))
        if had:
            yield count()

    return _finer(blobs.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(work, _BLOB), _deal_groups, bits)


def _eligible(blobs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, c, digest, hashes, counts of the documents whose c repeated shingles are at least the threshold of their n; sorted by (count, hash)."""

    def work(table: pa.Table) -> pa.Table:
        ids, sizes, owner, h, times = _entries(table.column("blob").to_pylist())
        ids, sizes = ids[owner], sizes[owner]
        order = np.lexsort((h, ids))
        order = order[np.concatenate(([True], (ids[order[1:]] != ids[order[:-1]]) | (h[order[1:]] != h[order[:-1]])))]
        ids, sizes, h, times = ids[order], sizes[order], h[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        length = np.diff(np.append(first, len(ids)))
        out: dict[str, list] = {x: [] for x in ("doc_id", "n", "c", "digest", "hashes", "counts")}
        for a, c in zip(first, length, strict=True):
            n = int(sizes[a])
            if 100 * c >= percent * n:
                mine, count = h[a : a + c], times[a : a + c]
                out["digest"].append(hashlib.blake2b(mine.tobytes(), digest_size=16).digest())
                rare = np.lexsort((mine, count))
                for k, v in (("doc_id", int(ids[a])), ("n", n), ("c", int(c)), ("hashes", mine[rare].tobytes()), ("counts", count[rare].tobytes())):
                    out[k].append(v)
        types = {"doc_id": pa.int64(), "n": pa.int64(), "c": pa.int64(), "digest": pa.binary(), "hashes": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    return blobs.groupBy("part").applyInArrow(work, "doc_id long, n long, c long, digest binary, hashes binary, counts binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """h, doc_id, n, c, pos (from 0 in the rare-first order, unique shingles counted) of each prefix shingle that other sets have too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, n, c, hashes in zip(*[batch.column(x).to_pylist() for x in ("doc_id", "n", "c", "hashes")], strict=True):
                unique = n - c
                take = n - -(-percent * n // 100) + 1 - unique
                if take > 0:
                    h = np.frombuffer(hashes, np.uint64)[:take]
                    cols[0].append(h.view(np.int64))
                    for j, v in ((1, doc), (2, n), (3, c)):
                        cols[j].append(np.full(len(h), v, np.int64))
                    cols[4].append(unique + np.arange(len(h), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in cols], ["h", "doc_id", "n", "c", "pos"])

    return sets.select("doc_id", "n", "c", "hashes").mapInArrow(work, "h long, doc_id long, n long, c long, pos long")


def _may_link(percent: int, a: str, b: str):
    """Length, positional and suffix filter: what the intersection needs, and what it can have at most.

    Before their common prefix shingle the sets share nothing that the smaller position doesn't bound; after it, no more than the repeated
    shingles that are left in either.
    """
    need = F.expr(f"{percent} * (n_{a} + n_{b})")  # inter * (100 + percent) must reach this
    after = F.least(F.col(f"n_{a}") - F.col(f"pos_{a}"), F.col(f"n_{b}") - F.col(f"pos_{b}"))
    before = F.least(F.col(f"pos_{a}") - (F.col(f"n_{a}") - F.col(f"c_{a}")), F.col(f"pos_{b}") - (F.col(f"n_{b}") - F.col(f"c_{b}")))
    return ((after + before) * (100 + percent) >= need) & (F.least("c_" + a, "c_" + b) * (100 + percent) >= need)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) with shared, the size of their sets' intersection, and whether they link."""
    own = sets.select("doc_id", "n", "hashes")
    joined = pairs.join(own.toDF("a", "n_a", "h_a"), "a").join(own.toDF("b", "n_b", "h_b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(k) for k in ("n_a", "n_b", "h_a", "h_b")]
            inter = np.array([len(np.intersect1d(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), True)) for p, q in zip(x[2], x[3], strict=True)], np.int64)
            linked = inter * (100 + percent) >= percent * (x[0].to_numpy() + x[1].to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter), pa.array(linked)], ["a", "b", "shared", "linked"])

    return joined.select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(work, "a long, b long, shared long, linked boolean")


def _rest(cells: DataFrame, percent: int) -> DataFrame:
    """cells: (h, len, x, y, side, main, doc_id, n, c, pos, comp, shared): a block of a bucket's members outside the pivot's component (side 0) and a
    block of any members but the pivot (side 1). Returns the pairs of different components that the filters let through.

    shared is a member's intersection with the bucket's pivot. What two members share lies in the pivot, where it is at most the smaller of
    the two values, or outside of it, where it is at most what either has there.
    """

    def work(table: pa.Table) -> pa.Table:
        n, c, pos, comp, doc, shared = (table.column(k).to_numpy() for k in ("n", "c", "pos", "comp", "doc_id", "shared"))
        side, main = table.column("side").to_numpy(), table.column("main").to_numpy(zero_copy_only=False)
        right = np.flatnonzero(side == 1)
        a, b = [], []
        for i in np.flatnonzero(side == 0):
            other = right[(comp[right] != comp[i]) & (main[right] | (doc[right] > doc[i]))]
            # a linked pair passes this in the bucket of its first common shingle, and there it meets
            most = np.minimum(np.minimum(n[i] - pos[i], n[other] - pos[other]), np.minimum(c[i], c[other]))
            known = (shared[other] >= 0) & (shared[i] >= 0)
            by_pivot = np.minimum(shared[i], shared[other]) + np.minimum(c[i] - shared[i], c[other] - shared[other])
            most = np.where(known, np.minimum(most, by_pivot), most)
            other = other[most * (100 + percent) >= percent * (n[i] + n[other])]
            a.append(np.minimum(doc[i], doc[other]))
            b.append(np.maximum(doc[i], doc[other]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("h", "len", "x", "y").applyInArrow(work, "a long, b long")


def _bucket_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that suffice for their components."""
    entries = materialise(_prefixes(sets, percent), "prefixes")
    pivots = entries.groupBy("h").agg(F.min_by(F.struct("doc_id", "n", "c", "pos"), F.struct(F.col("n") - F.col("c"), "doc_id")).alias("p"), F.count(F.lit(1)).alias("members"))
    pivots = pivots.where("members > 1").select(F.col("h").alias("h_p"), *[F.col(f"p.{x}").alias(f"{x}_p") for x in ("doc_id", "n", "c", "pos")])
    met = entries.toDF("h", *[f"{x}_m" for x in ("doc_id", "n", "c", "pos")]).join(pivots, F.col("h") == F.col("h_p")).where("doc_id_m <> doc_id_p")
    low, high = F.least("doc_id_m", "doc_id_p"), F.greatest("doc_id_m", "doc_id_p")
    met = materialise(met.withColumn("may", _may_link(percent, "m", "p")).withColumns({"a": low, "b": high}), "pivot_pairs")
    verified = materialise(_verified(met.where("may").select("a", "b").distinct(), sets, percent), "pivot_verified")
    links = verified.where("linked").select("a", "b")
    comps = materialise(components(links), "pivot_components").withColumnRenamed("component", "comp")
    # all but the pivots themselves: members that are not in the pivot's component have not met the others
    pivot_comp = comps.toDF("node_p", "comp_p")
    rows = met.join(comps, F.col("doc_id_m") == F.col("node"), "left").join(pivot_comp, F.col("doc_id_p") == F.col("node_p"), "left")
    rows = rows.withColumn("comp", F.coalesce("comp", "doc_id_m")).withColumn("main", F.col("comp") == F.coalesce("comp_p", "doc_id_p"))
    had = verified.select(F.col("a").alias("a_v"), F.col("b").alias("b_v"), "shared")
    rows = rows.join(had, (F.col("a") == F.col("a_v")) & (F.col("b") == F.col("b_v")), "left").withColumn("shared", F.coalesce("shared", F.lit(-1)))
    rows = materialise(rows.select("h", *[F.col(f"{x}_m").alias(x) for x in ("doc_id", "n", "c", "pos")], "comp", "main", "shared"), "bucket_members")
    # linked sets have lengths of one class or of neighbouring ones
    rows = rows.withColumn("len", F.floor(F.log("n") / math.log(100 / min(percent, 99) * 1.000001)))
    lefts = rows.where("not main")
    rights = rows.withColumn("len", F.explode(F.array(*[F.col("len") + i for i in (-1, 0, 1)])))
    blocks = lambda side, name: side.groupBy(F.col("h").alias("h_o"), F.col("len").alias("len_o")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    cells = materialise(blocks(lefts, "xs").join(blocks(rights, "ys"), ["h_o", "len_o"]), "cells")
    open_ = lambda side: side.join(cells, (F.col("h") == F.col("h_o")) & (F.col("len") == F.col("len_o"))).drop("h_o", "len_o")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = ("main", "doc_id", "n", "c", "pos", "comp", "shared")
    left = open_(lefts).select("h", "len", own("xs").alias("x"), every("ys").alias("y"), F.lit(0).alias("side"), *member)
    right = open_(rights).select("h", "len", every("xs").alias("x"), own("ys").alias("y"), F.lit(1).alias("side"), *member)
    met_now = materialise(_rest(left.union(right), percent).distinct(), "rest_pairs")
    return links.union(_verified(met_now, sets, percent).where("linked").select("a", "b"))


def set_sizes(docs: DataFrame, k: int) -> DataFrame:
    """docs with n_shingles of its text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.bincount(shingles(c, k)[0], minlength=c.n) for c in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())], ["doc_id", "n_shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_shingles long")


def linked_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, component_id of every document that is linked with another: 100 * intersection >= percent * union of the shingle sets.

    component_id is the least doc_id reachable by links. Documents without a row have no link.
    """
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer: components are named by the least one")
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, (text_bytes // BYTES_PER_RANGE).bit_length())
    found = materialise(_eligible(_repeated(_shingle_blobs(docs, k, bits), bits), percent).drop("counts"), "sets")
    classes = materialise(found.groupBy("n", "c", "digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "class_heads")
    members = found.select("doc_id", "n", "c", "digest").join(classes.withColumnRenamed("doc_id", "class_id"), ["n", "c", "digest"])
    members = materialise(members.select("doc_id", "class_id", "copies", (100 * F.col("c") >= percent * (2 * F.col("n") - F.col("c"))).alias("inner")), "classes")
    heads = found.join(members.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    sets = materialise(_eligible(_repeated(_set_blobs(heads, bits), bits), percent).select("doc_id", "n", "c", "hashes"), "class_sets")
    comps = materialise(components(_bucket_links(sets, percent)), "components")
    # the members of a class are linked with each other, or through what their class is linked with, or not at all
    out = members.join(comps, F.col("class_id") == F.col("node"), "left").where("component is not null or (inner and copies > 1)")
    return out.select("doc_id", F.coalesce("component", "class_id").alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set of k-word shingles), component_id (least doc_id reachable by links, itself included).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A text of under k words has its whole sequence as its only
    shingle; null and blank texts have none and link with nothing. Rows repeated under one doc_id are one document (its text should be the
    same) and get the same values. A null doc_id links with nothing; its component is null. Other columns are ignored.
    """
    groups = linked_groups(docs, k, percent).withColumnRenamed("doc_id", "_id")
    sizes = set_sizes(docs, k)
    return sizes.join(groups, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """docs without all but the document with the least doc_id of each component; the columns, of whatever names, stay as they are."""
    (gone_id,) = free_names(docs.columns, "_id")
    gone = linked_groups(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
