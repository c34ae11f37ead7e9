"""Phrase collocations by Rabin-Karp fingerprints of n-grams.

1. Words and pairs. Prefix sums of a polynomial over the words' codes give every n-gram's 64-bit fingerprint by one difference; the group's
   (language's) seed and n are mixed in. Tasks count their fingerprints and a shuffle adds up, with each count, a checksum over all occurrences
   (of a second, independent hash) and an occurrence pointer: the least document hash. A count is never too low: n-grams that share a
   fingerprint only add to each other's.
2. Triples, counted alike, at the places where both pairs are frequent; n-grams of four and five words where all of their triples are.
3. Text of the frequent ones alone: each is read where its pointer says. The least document hashes are those of few documents.
4. Collisions. A fingerprint whose checksum is not that of its text times its count, or that has several texts, stands for several phrases. The
   occurrences of such ones are read again and counted by text.
5. Scores, containment and ranks are joins over the frequent phrases.

Which fingerprints are frequent is told to tasks by a bitmap of at most 2 ** MOST_BITS bits: what passes it by chance costs work and nothing
else. N-grams don't cross pieces, so a long text is taken in stretches, the last words of one being carried to the next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise
from .words import Chunk, _power, mix

MOST_WORDS = 5
#: Bytes of text that are worked on at once.
STRETCH = 1 << 20
#: Counts that a task keeps before they go to the shuffle: fingerprints, phrases.
FLUSH_COUNTS, FLUSH_PHRASES = 600_000, 150_000
#: Rows of a batch that a task hands on.
BATCH = 50_000
#: Bits of a bitmap for each frequent fingerprint and for each one with its pointer, and at least and at most for all of them (64 MiB).
BITS_EACH, BITS_PLACED, LEAST_BITS, MOST_BITS = 32, 512, 16, 29
#: Checksums are modulo a power of two whose square is a long.
CHECK = (1 << 31) - 1
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64
#: Language of a null.
NO_LANG = "und"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\n\x0b\x0c\r")] = True
_BREAK = _SEPARATOR.copy()
_BREAK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Stretch:
    """Words of some texts, or of a part of one: code (in `dictionary`), piece (equal for words of one piece), lang (in `langs`), place (a hash of the text).

    The first `carried` words are those of the stretch before and count only as the beginnings of n-grams.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, langs: list[str], place: np.ndarray, bits: int = 64, carried: int = 0):
        data = _LOWER[data]
        inside = ~_BREAK[data]
        starts, ends = Chunk(data, offsets, 0).spans(~inside)
        owner = np.searchsorted(offsets, starts, "right") - 1
        separators = np.concatenate((np.zeros(1, np.int32), np.cumsum(_SEPARATOR[data], dtype=np.int32)))
        self.starts, self.ends, self.carried, self.langs = starts, ends, carried, langs
        self.piece = separators[starts] + owner
        self.lang, self.place, self.bits = lang[owner], place[owner], bits
        flat = np.concatenate((np.zeros(1, np.int32), np.cumsum(ends - starts, dtype=np.int32)))
        spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(flat), pa.py_buffer(data[inside])]).dictionary_encode()
        self.code, self.dictionary = spelled.indices.to_numpy(zero_copy_only=False), spelled.dictionary
        self._sums = None

    def _fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums of the polynomial, the base's inverse powers and each word's seed."""
        if self._sums is None:
            at = np.frombuffer(self.dictionary.buffers()[1], np.int32)[self.dictionary.offset : self.dictionary.offset + len(self.dictionary) + 1].astype(np.int64)
            body = self.dictionary.buffers()[2]
            body = np.frombuffer(body, np.uint8)[: at[-1]] if body is not None else np.zeros(0, np.uint8)
            codes = Chunk(body, np.array([0, len(body)]), 0).hashes(at[:-1], at[1:])
            n = len(self.code)
            total = lambda c: np.concatenate((np.zeros(1, np.uint64), np.cumsum(c[self.code] * _power("base", n), dtype=np.uint64)))
            sums, self._second = total(codes), total(mix(codes ^ np.uint64(0x5851F42D4C957F2D)))
            seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
            self._sums = sums, _power("inverse", n), seeds[self.lang] if n else np.zeros(0, np.uint64)
        return self._sums

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the n-gram at each place but the last n - 1, and whether it is one: in one piece, and its last word not carried."""
        count = max(0, len(self.code) - n + 1)
        if not count:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        sums, inverse, seed = self._fingerprints()
        h = mix((sums[n : n + count] - sums[:count]) * inverse[:count] + seed[:count] * np.uint64(2 * n + 1))
        valid = self.piece[:count] == self.piece[n - 1 :]
        valid[: max(0, self.carried - n + 1)] = False
        return h >> np.uint64(64 - self.bits) << np.uint64(64 - self.bits) if self.bits < 64 else h, valid

    def checks(self, n: int) -> np.ndarray:
        """A second hash of each n-gram, of 31 bits."""
        count = max(0, len(self.code) - n + 1)
        _, inverse, seed = self._fingerprints()
        return (mix((self._second[n : n + count] - self._second[:count]) * inverse[:count] + seed[:count]) & np.uint64(CHECK)).astype(np.int64)


def _long(data: np.ndarray, size: int, lang: np.ndarray, langs: list[str], place: np.ndarray, bits: int) -> Iterator[Stretch]:
    """The words of one text by `size` bytes. A word is not cut, however long it is; the last words of a piece that goes on are carried."""
    at, carried, prefix = 0, 0, np.zeros(0, np.uint8)
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and not _BREAK[data[stop]]:
            ends = np.flatnonzero(_BREAK[data[stop : stop + size]])
            stop = min(len(data), stop + (int(ends[0]) if len(ends) else size))
        block = np.concatenate((prefix, data[at:stop]))
        found = Stretch(block, np.array([0, len(block)]), lang, langs, place, bits, carried)
        yield found
        last = np.arange(len(found.code))[1 - MOST_WORDS :]
        last = last[found.piece[last] == found.piece[-1]] if len(last) else last
        if len(last) and _SEPARATOR[block[found.ends[-1] :]].any():
            last = last[:0]
        space = np.frombuffer(b" ", np.uint8)
        carried, prefix = len(last), np.concatenate([np.zeros(0, np.uint8), *[x for i in last for x in (block[found.starts[i] : found.ends[i]], space)]])
        at = stop


def stretches(batch: pa.RecordBatch, size: int, bits: int = 64) -> Iterator[Stretch]:
    """The words of lang, text; texts are taken together up to `size` bytes, and longer ones cut at the end of a word."""
    langs = pc.fill_null(batch.column("lang"), NO_LANG).dictionary_encode()
    names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    column = batch.column("text").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        begin, end = int(offsets[at]), int(offsets[to])
        place = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[at:to], offsets[at + 1 : to + 1], strict=True)], np.int64)
        if end - begin <= size:
            yield Stretch(data[begin:end], offsets[at : to + 1] - begin, lang[at:to], names, place, bits)
        else:
            yield from _long(data[begin:end], size, lang[at:to], names, place, bits)
        at = to


class Bitmap:
    """Whether a fingerprint may be among those that were put in."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - self.bits)
        return (np.frombuffer(self.data, np.uint8)[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(spark: SparkSession, keys: DataFrame, each: int) -> Bitmap:
    """Of the column h. Tasks pack blocks of 8192 bits; their bytes, 64 MiB at most, go to the driver and to all tasks."""
    bits = min(MOST_BITS, max(LEAST_BITS, (each * keys.count()).bit_length()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for slots in batch.column("slots"):
                block = np.zeros(8192, bool)
                block[slots.values.to_numpy()] = True
                made.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, pa.binary())], ["block", "packed"])

    slot = F.shiftrightunsigned("h", 64 - bits)
    blocks = keys.select(F.shiftright(slot, 13).alias("block"), slot.bitwiseAND(8191).cast("int").alias("s")).groupBy("block").agg(F.collect_set("s").alias("slots"))
    out = bytearray(1 << (bits - 3))
    for row in blocks.mapInArrow(pack, "block long, packed binary").toLocalIterator():
        out[row["block"] << 10 : (row["block"] + 1) << 10] = row["packed"]
    return Bitmap(bits, bytes(out))


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _summed(parts: list[Sums]) -> Sums:
    """Fingerprints, sorted, with their counts, checksums and least places."""
    h, times, check, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")  # sorted parts are merged
    h = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    if not len(first):
        return h, times, check, place
    return h[first], np.add.reduceat(times[order], first), np.add.reduceat(check[order], first) & CHECK, np.minimum.reduceat(place[order], first)


_SUMS = "h long, lang string, times long, check long, place long"


def _sum_rows(h: np.ndarray, *sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(h), BATCH):
        part = h[at : at + BATCH]
        yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.nulls(len(part), pa.string()), *[pa.array(x[at : at + BATCH]) for x in sums]], ["h", "lang", "times", "check", "place"])


def _sum_task(kinds, size: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the n-grams that kinds(stretch) gives as (n, where), and rows without a fingerprint for the words of each lang."""
    words: Counter[str] = Counter()
    had: list[Sums] = []
    for batch in batches:
        for found in stretches(batch, size, bits):
            words.update({found.langs[i]: int(n) for i, n in enumerate(np.bincount(found.lang[found.carried :], minlength=len(found.langs))) if n})
            for n, where in kinds(found):
                at = np.flatnonzero(where)
                had.append(_summed([(found.grams(n)[0][at], np.ones(len(at), np.int64), found.checks(n)[at] if len(at) else at, found.place[at])]))
            if sum(len(x[0]) for x in had) > FLUSH_COUNTS:
                had = [_summed(had)]
                if 2 * len(had[0][0]) > FLUSH_COUNTS:
                    yield from _sum_rows(*had.pop())
    if had:
        yield from _sum_rows(*_summed(had))
    rows = [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), *[pa.nulls(len(words), pa.int64())] * 2]
    yield pa.RecordBatch.from_arrays(rows, ["h", "lang", "times", "check", "place"])


def _words_and_pairs(found: Stretch) -> list[tuple[int, np.ndarray]]:
    return [(n, found.grams(n)[1]) for n in (1, 2)]


def _triples(pairs, found: Stretch) -> list[tuple[int, np.ndarray]]:
    valid, reach = found.grams(3)[1], pairs.value.has(found.grams(2)[0])
    return [(3, valid & reach[: len(valid)] & reach[1 : 1 + len(valid)])]


def _longer(triples, found: Stretch) -> list[tuple[int, np.ndarray]]:
    out, reach = [], triples.value.has(found.grams(3)[0])
    for n in (4, 5):
        valid = found.grams(n)[1].copy()
        for i in range(n - 2):
            valid &= reach[i : i + len(valid)]
        out.append((n, valid))
    return out


def _occurring(found: Stretch, n: int, keep: np.ndarray, h: np.ndarray) -> pa.Table:
    """h, check, lang, phrase, size, times of the n-grams at the kept places, by text: each is compared with the first of its fingerprint."""
    at = np.flatnonzero(keep)
    order = np.argsort(h[at], kind="stable")
    at, h = at[order], h[at][order]
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    pointer = at[first]
    same = found.lang[at] == found.lang[pointer][group]
    for i in range(n):
        same &= found.code[at + i] == found.code[pointer + i][group]
    times = np.bincount(group, same, len(first)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    if not same.all():  # other texts of the same fingerprint, by their words
        words = lambda i: (int(found.lang[i]), *found.code[i : i + n].tolist())
        rest, where = Counter(words(i) for i in at[~same]), {words(i): i for i in at[~same]}
        pointer, times = np.append(pointer, [where[k] for k in rest]), np.append(times, list(rest.values()))
    parts = [found.dictionary.take(pa.array(found.code[pointer + i])) for i in range(n)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0]
    lang = pa.array(found.langs, pa.string()).take(pa.array(found.lang[pointer]))
    prints = [found.grams(n)[0][pointer].view(np.int64), found.checks(n)[pointer]] if len(pointer) else [pointer, pointer]
    return pa.table({"h": prints[0], "check": prints[1], "lang": lang, "phrase": phrase.cast(pa.string()), "size": np.full(len(pointer), n, np.int32), "times": times})


_TEXTS = "h long, check long, lang string, phrase string, size int, times long"


def _text_task(chosen, placed: bool, size: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams whose fingerprints are chosen, by text. placed: those alone that the fingerprint's pointer points to."""
    names = ["h", "check", "lang", "phrase", "size"]
    had: list[pa.Table] = []

    def grouped() -> pa.Table:
        out = pa.concat_tables(had).combine_chunks().group_by(names).aggregate([("times", "sum")])
        return out.select([*names, "times_sum"]).rename_columns([*names, "times"])

    for batch in batches:
        for found in stretches(batch, size, bits):
            for n in range(1, MOST_WORDS + 1):
                h, valid = found.grams(n)
                key = h ^ (found.place[: len(h)].astype(np.uint64) << np.uint64(32)) if placed else h
                had.append(_occurring(found, n, valid & chosen.value.has(key), h))
            if sum(len(x) for x in had) > FLUSH_PHRASES:
                had = [grouped()]
                if 2 * len(had[0]) > FLUSH_PHRASES:
                    yield from had.pop().to_batches(BATCH)
    if had:
        yield from grouped().to_batches(BATCH)


def phrase_counts(docs: DataFrame, least: int, stretch: int = STRETCH, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of every language, n being its words; and (lang, phrase, size, f) of every phrase of one to five words that occurs `least` times.

    Fingerprints of fewer bits collide more; the counts are the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    # tasks have counted before, so their rows are dealt as they are: counting them once more before the shuffle would only take memory
    def summed(kinds, name: str) -> DataFrame:
        rows = texts.mapInArrow(partial(_sum_task, kinds, stretch, bits), _SUMS).repartition("h", "lang")
        rows = rows.groupBy("h", "lang").agg(F.sum("times").alias("times"), F.sum("check").bitwiseAND(CHECK).alias("check"), F.min("place").alias("place"))
        return materialise(rows.where((F.col("times") >= least) | F.col("h").isNull()), name)

    def known(keys: DataFrame, each: int):
        return spark.sparkContext.broadcast(_bitmap(spark, keys, each))

    def read(keys: DataFrame, placed: bool) -> DataFrame:
        chosen = known(keys, BITS_PLACED if placed else BITS_EACH)
        return texts.mapInArrow(partial(_text_task, chosen, placed, stretch, bits), _TEXTS)

    first = summed(_words_and_pairs, "words_and_pairs")
    own = lambda table: table.where("h is not null").drop("lang")
    triples = summed(partial(_triples, known(own(first), BITS_EACH)), "triples")
    longer = summed(partial(_longer, known(own(triples), BITS_EACH)), "longer")
    sums = own(first).union(own(triples)).union(own(longer)).toDF("s_h", "s_times", "s_check", "s_place")
    placed = sums.select(F.col("s_h").bitwiseXOR(F.shiftleft("s_place", 32)).alias("h"))
    spelled = materialise(read(placed, True).select("h", "check", "lang", "phrase", "size").distinct().join(sums, F.col("h") == F.col("s_h")), "spelled")
    whole = F.pmod("s_times", F.lit(CHECK + 1)) * F.col("check")
    several = spelled.groupBy(F.col("h").alias("c_h")).agg(F.count(F.lit(1)).alias("n"), F.min(whole.bitwiseAND(CHECK) == F.col("s_check")).alias("right")).where("n > 1 or not right")
    several = materialise(several.select("c_h"), "collisions")
    found = spelled.join(several, F.col("h") == F.col("c_h"), "left_anti").select("lang", "phrase", "size", F.col("s_times").alias("f"))
    if several.limit(1).count():
        again = read(several.select(F.col("c_h").alias("h")), False).join(several, F.col("h") == F.col("c_h"), "left_semi")
        found = found.union(again.groupBy("lang", "phrase", "size").agg(F.sum("times").alias("f")).where(F.col("f") >= least))
    return first.where("h is null").select("lang", F.col("times").alias("n")), materialise(found, "phrases")


def _joined(words: str, start, length) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, stretch: int = STRETCH, bits: int = 64) -> DataFrame:
    """Each language's first `top` phrases of two to five words: lang, rank, phrase, a, l, r, n, score.

    docs: text, lang; other columns are ignored. Null texts are empty, null langs are NO_LANG. A-Z are lower-cased; pieces end at . , ; : ! ?
    and 0x0A-0x0D, words at 0x20 and 0x09. a is how often the phrase occurs in pieces (`least` at least, overlaps included), n the words of
    the language. A cut parts it into phrases that occur l and r times and scores floor(1000 a n / (l r)); the least score counts, of equal
    ones the first cut. A phrase goes if a longer one that holds it has percent / 100 of its occurrences or more. Ranks are by score and a,
    falling, then by the phrase's bytes. Repeated rows count again; an empty table, or one without frequent phrases, gives no rows.
    """
    totals, found = phrase_counts(docs, least, stretch, bits)
    phrases = found.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", "size", "f", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _joined("w", F.lit(1), F.col("k")).alias("first"), _joined("w", F.col("k") + 1, F.col("size")).alias("rest"))
    of = lambda name, count: found.select(F.col("lang").alias(f"lang_{name}"), F.col("phrase").alias(f"phrase_{name}"), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), (F.col("lang") == F.col("lang_first")) & (F.col("first") == F.col("phrase_first")))
    cuts = cuts.join(of("rest", "r"), (F.col("lang") == F.col("lang_rest")) & (F.col("rest") == F.col("phrase_rest")))
    cuts = cuts.join(totals.withColumnRenamed("lang", "lang_n"), F.col("lang") == F.col("lang_n"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"_up": (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(20,0)") * wide("n"), "_down": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("cast(_up div _down as long)"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a phrase of n words is held by one of n + 1 that has as many occurrences as any longer one
    held = phrases.where("size > 2").select("lang", "f", F.explode(F.array(_joined("w", F.lit(1), F.col("size") - 1), _joined("w", F.lit(2), F.col("size") - 1))).alias("inner"))
    held = held.groupBy(F.col("lang").alias("lang_h"), F.col("inner")).agg(F.max("f").alias("f_h"))
    kept = scored.join(held, (F.col("lang") == F.col("lang_h")) & (F.col("phrase") == F.col("inner")), "left").where((F.col("f_h").isNull()) | (100 * F.col("f_h") < percent * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    kept = kept.withColumn("_part", part).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
