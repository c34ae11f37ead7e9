"""Benchmark decontamination in DataFrame functions only.

A benchmark window is WINDOW consecutive words of an item, or all words of a shorter item. Three steps find every occurrence in a document:

1. Scan. Any run of w words holds a run of m words that starts at a multiple of w + 1 - m. So a document is hashed once at every such place,
   and looked up in a broadcast set of the hashes of all m-word runs of the items. Most documents end here, unchanged and unshuffled.
2. Of the documents with a hit, all windows are hashed and looked up in the broadcast table of windows.
3. A hit counts if the words are equal: the join compares hashes and texts.

Long texts are cut into parts of PART_WORDS words that overlap by a window, so no text is held as an array of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_names, materialise, release

#: Words of a window.
WINDOW = 10
#: Words of a part of a long text (a multiple of 1 to 5, so of each stride), and the characters of a long text.
PART_WORDS, LONG_CHARS = 480, 1 << 15
#: Bytes of windows, or of keys of documents, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same without lower-casing first.
_CASED_BREAK = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _lowered(text: Column) -> Column:
    """A-Z lower-cased and no other letter; lower() is the fast way where a text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(text), _BREAK + "+"), "")


def _parts(text: Column) -> Column:
    """The text, or PART_WORDS words of it each; null for null."""
    run = rf"(?:[{_CASED_BREAK}]*+[^{_CASED_BREAK}]++){{1,{PART_WORDS}}}"
    return F.when(F.length(text) <= LONG_CHARS, F.array(text)).when(text.isNotNull(), F.regexp_extract_all(text, F.lit(run), F.lit(0)))


def _cut(rows: DataFrame, keep: list[Column], text: str) -> DataFrame:
    """keep, and cut: (at, t, several) of each part: the number of its first word, its text with the next window's words, and whether there are others."""
    head = rf"^(?:[{_CASED_BREAK}]*+[^{_CASED_BREAK}]++){{1,{WINDOW - 1}}}"
    rows = rows.select(*keep, _parts(F.col(text)).alias("_p"))
    several = F.size("_p") > 1
    following = lambda i: F.when(i + 1 < F.size("_p"), F.concat(F.lit(" "), F.regexp_extract(F.get("_p", i + 1), head, 0))).otherwise(F.lit(""))
    cut = F.transform("_p", lambda p, i: F.struct((i * PART_WORDS).alias("at"), F.when(several, F.concat(p, following(i))).otherwise(p).alias("t"), several.alias("several")))
    return rows.select(*[c for c in rows.columns if c != "_p"], cut.alias("cut"))


def _part(cut: Column) -> Column:
    """Of one such part: at, own (how many words are its own), w (its words and the next ones). Its words are made once and bound to a name."""
    own = lambda w: F.when(cut["several"], F.least(F.size(w), F.lit(PART_WORDS))).otherwise(F.size(w))
    return F.transform(F.array(words(cut["t"])), lambda w: F.struct(cut["at"].alias("at"), own(w).alias("own"), w.alias("w")))


def _starts(part: Column, length: int, stride: int) -> Column:
    """Places, from 1, of the part's own words at which a run of so many words begins; every stride-th."""
    last = F.least(part["own"], F.size(part["w"]) - (length - 1))
    return F.when(last > 0, F.sequence(F.lit(1), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _hashed(part: Column, length: int, stride: int) -> Column:
    return F.transform(_starts(part, length, stride), lambda i: F.xxhash64(F.slice(part["w"], i, length)))


def _probes(lengths: list[int]) -> list[tuple[int, int]]:
    """(m, stride) that find any window of these lengths: one for all of six words or more, one for each shorter length."""
    least = sorted({n for n in lengths if n < 6} | {min([n for n in lengths if n >= 6], default=0)} - {0})
    return [(n // 2 + 1, n - n // 2) for n in least]


def _texts(part: Column, length: int) -> Column:
    found = lambda i: F.struct((part["at"] + i - 1).alias("pos"), F.lit(length).alias("len"), F.array_join(F.slice(part["w"], i, length), " ").alias("window"))
    return F.transform(_starts(part, length, 1), found)


def _windows(rows: DataFrame, keep: list[Column], text: str, lengths: list[int]) -> DataFrame:
    """keep, pos, len, h, window of every window of these lengths of each text."""
    rows = _cut(rows, keep, text)
    kept = [c for c in rows.columns if c != "cut"]
    # outer, for otherwise Spark infers conditions on the arrays and computes them for all documents, before the join that has left few
    rows = rows.select(*kept, F.explode_outer("cut").alias("cut")).where("cut is not null").select(*kept, _part(F.col("cut"))[0].alias("p"))
    p = F.col("p")
    every = [_texts(p, n) for n in lengths]
    rows = rows.select(*kept, F.explode_outer(F.concat(*every)).alias("x")).where("x is not null")
    return rows.select(*kept, F.col("x.pos").alias("pos"), F.col("x.len").alias("len"), F.xxhash64("x.window").alias("h"), F.col("x.window").alias("window"))


def _counted(rows: DataFrame, keep: list[Column], text: str, probes: list[tuple[int, int]]) -> DataFrame:
    """keep, n_words (long, 0 for null) and runs (hashes of the probes' runs)."""
    rows = _cut(rows, keep, text)
    kept = [c for c in rows.columns if c != "cut"]
    # one part after the other, so that only its numbers stay
    seen = F.transform("cut", lambda c: F.transform(_part(c), lambda p: F.struct(p["own"].alias("own"), F.concat(*[_hashed(p, m, s) for m, s in probes]).alias("runs")))[0])
    rows = rows.select(*kept, seen.alias("_seen"))
    n = F.aggregate("_seen", F.lit(0).cast("long"), lambda a, p: a + p["own"])
    return rows.select(*kept, F.coalesce(n, F.lit(0)).cast("long").alias("n_words"), F.flatten(F.col("_seen.runs")).alias("runs"))


def _bounded(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _items(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int], int]:
    """(item_id, h, window) of each item's windows, the lengths that occur, and the bytes of the distinct windows with their links to items."""
    rows = benchmark.select("item_id", "text")
    counted = _counted(rows, [F.col("item_id"), F.col("text")], "text", [(1, 1)]).where("n_words > 0").select("item_id", "text", F.least("n_words", F.lit(window)).cast("int").alias("size"))
    lengths = sorted(r.size for r in counted.select("size").distinct().collect())  # `window` values at most
    found = None
    for n in lengths:
        own = _windows(counted.where(F.col("size") == n), [F.col("item_id")], "text", [n]).select("item_id", "len", "h", "window")
        found = own if found is None else found.union(own)
    if found is None:
        found = rows.where("false").select("item_id", F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.lit("").alias("window"))
    found = materialise(found.distinct(), "benchmark_windows")
    size = found.agg(F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0))).first()[0]
    return found, lengths, size


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_words) of every row of docs; and doc_id, th, pos, len, h, window, item_id of each verified occurrence of an item's window.

    th is a hash of the text, which tells rows of one doc_id apart; h is that of the window. Rows repeated with one doc_id and text share their
    occurrences. A window of several items has a row for each.
    """
    if not 1 <= window <= WINDOW:
        raise ValueError(f"a window has 1 to {WINDOW} words")
    items, lengths, size = _items(benchmark, window)
    probes = _probes(lengths) or [(window, 1)]
    th = F.xxhash64("text")
    counted = materialise(_counted(docs.select("doc_id", "text"), [F.col("doc_id"), th.alias("th")], "text", probes), "word_counts")
    whole = F.struct(F.size("w").alias("own"), F.col("w"))
    known = items.select(F.split("window", " ").alias("w")).select(F.explode(F.concat(*[_hashed(whole, m, 1) for m, _ in probes])).alias("known")).distinct()
    met = counted.select("doc_id", "th", F.explode("runs").alias("run")).join(_bounded(known, size), F.col("run") == F.col("known"), "left_semi")
    keys = materialise(met.select("doc_id", "th").distinct().toDF("k_id", "k_th"), "suspects")
    suspects = docs.select("doc_id", "text").join(_bounded(keys, keys.count() * 64), F.col("doc_id").eqNullSafe(F.col("k_id")) & (th == F.col("k_th")), "left_semi")
    found = _windows(suspects, [F.col("doc_id"), th.alias("th")], "text", lengths or [window])
    wanted = items.select(F.col("h").alias("w_h"), F.col("window").alias("w_window")).distinct()
    hits = found.join(_bounded(wanted, size), (F.col("h") == F.col("w_h")) & (F.col("window") == F.col("w_window"))).select("doc_id", "th", "pos", "len", "h", "window")
    hits = materialise(hits.distinct(), "benchmark_hits")
    release(keys)
    of = items.select("item_id", F.col("h").alias("w_h"), F.col("window").alias("w_window"))
    hits = hits.join(_bounded(of, size), (F.col("h") == F.col("w_h")) & (F.col("window") == F.col("w_window"))).drop("w_h", "w_window")
    return counted.select("doc_id", "th", "n_words"), hits


def _spans(hits: DataFrame) -> DataFrame:
    """doc_id, th, begin, end: the words that hits cover, cut so that none is in two rows; in order of their places."""
    places = hits.groupBy("doc_id", "th", "pos").agg(F.max("len").alias("len")).withColumn("end", F.col("pos") + F.col("len"))
    before = F.max("end").over(Window.partitionBy("doc_id", "th").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return places.withColumn("begin", F.greatest("pos", F.coalesce(before, F.lit(0)))).where("end > begin").select("doc_id", "th", "begin", "end")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with an occurring window),
    items (their ids as sorted strings), items_sha256 (of those, joined by commas), contaminated.

    docs: doc_id (any type), text; benchmark: item_id (any type), text; other columns are ignored. Words are runs of characters outside
    0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F of the text with A-Z lower-cased. A null or blank text has no words and no hit; such an item has no
    window. Rows repeated under one doc_id each get a row; with the same text they have the same result. Items of one id count once; those
    without an id make hits but are not listed. Empty tables give no rows, or no hits.
    """
    counted, hits = benchmark_hits(docs, benchmark, window)
    covered = _spans(hits).groupBy("doc_id", "th").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n_hit"))
    listed = hits.select("doc_id", "th", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc_id", "th").agg(F.count("item").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    found = covered.join(listed.toDF("l_id", "l_th", "n_items", "items"), F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("th").eqNullSafe(F.col("l_th")))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "n_hit", "n_items", "items")
    rows = counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        items.alias("items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = True, window: int = WINDOW) -> DataFrame:
    """docs without what hits the benchmark, with its columns: without the documents (whole), or without the words hit.

    Without the words hit, a text keeps its other words and each one's following separators; case stays. Texts without a hit, and null
    texts, stay as they are. Columns of any name pass through.
    """
    hits = benchmark_hits(docs, benchmark, window)[1]
    d, key_id, key_th, runs = free_names(docs.columns, "d", "key_id", "key_th", "runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(d))
    same = F.col(f"{d}.doc_id").eqNullSafe(F.col(key_id)) & (F.xxhash64(f"{d}.text") == F.col(key_th))
    if whole:
        return rows.join(hits.select(F.col("doc_id").alias(key_id), F.col("th").alias(key_th)).distinct(), same, "left_anti").select(f"{d}.*")
    spans = _spans(hits).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(runs)).withColumnsRenamed({"doc_id": key_id, "th": key_th})
    rows = rows.join(spans, same, "left")
    gone, text = F.col(runs), F.col(f"{d}.text")
    word = f"[^{_CASED_BREAK}]+"
    units = F.when(gone.isNotNull(), F.zip_with(F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.slice(F.split(text, word), 2, 1 << 30), lambda w, s: F.concat(w, s)))
    rows = rows.select(d, runs, units.alias("_units"), F.when(gone.isNotNull(), F.split(text, word)[0]).alias("_lead"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda r: r["end"].cast("long")))
    ends = F.concat(F.transform(gone, lambda r: r["begin"].cast("long")), F.array(F.size("_units").cast("long")))
    kept = F.flatten(F.transform(F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] > r["a"]), lambda r: F.slice("_units", (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int"))))
    cut = F.when(gone.isNull(), text).otherwise(F.concat("_lead", F.array_join(kept, "")))
    return rows.select(*[cut.alias(c) if c.lower() == "text" else F.col(f"{d}.`{c}`").alias(c) for c in docs.columns])
