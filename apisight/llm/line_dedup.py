"""Line deduplication by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
SPAN = 3

BLANKS = " \t\n\x0b\x0c\r"


def line_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos (from 0), w1, w2 (two hashes of the window's lines) of every window that is not all blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= SPAN)
    line = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), (F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("c")))
    rows = rows.select("doc_id", "th", line.alias("lines"))
    n = F.size("lines") - (SPAN - 1)
    rows = rows.select("doc_id", "th", *[F.slice("lines", i + 1, n).alias(f"l{i}") for i in range(SPAN)])
    rows = rows.select("doc_id", "th", F.posexplode(F.arrays_zip(*[f"l{i}" for i in range(SPAN)])).alias("pos", "w"))
    parts = [F.col(f"w.l{i}") for i in range(SPAN)]
    word = parts[0]["c"]
    for p in parts[1:]:
        word = word | p["c"]
    return rows.where(word).select("doc_id", "th", "pos", F.xxhash64(*[p["a"] for p in parts]).alias("w1"), F.xxhash64(*[p["b"] for p in parts]).alias("w2"))


def dedup_lines(docs: DataFrame, removed: str = "removed_lines") -> DataFrame:
    """Removes the lines of every three-line window that occurred before, anywhere in the table.

    Occurrences are ordered by (doc_id, hash of the text, position); the first one stays, and lines that any later one covers go.
    Windows overlap, so a passage of n >= 3 lines goes as a whole. Windows of blank lines alone don't count. The kept lines are joined by \\n.

    Returns the columns of docs with the new text, and the number of removed lines in a column named by `removed` (an input column of that
    name is replaced). Null texts stay null, texts of under three lines stay as they are; both have 0. Rows repeated with the same doc_id
    and text count as one document and get the same result. A text whose lines all go is empty.
    """
    windows = line_windows(docs)
    columns = [c for c in docs.columns if c.lower() != removed.lower()]
    windows = line_windows(docs)
    place = F.struct("doc_id", "th", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), "first")
    later = windows.join(first, (F.col("w1") == F.col("f1")) & (F.col("w2") == F.col("f2"))).where(place > F.col("first"))
    covered = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("later"))
    # the input's columns stay inside a struct, so none can clash with what is made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"))
    joined = rows.join(covered, F.col("d.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("d.text") == F.col("th")), "left").select("d", "later")
    lines = F.split("d.text", "\n", -1)
    # between two later windows, what neither covers stays: runs from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0)), F.transform("later", lambda p: p + SPAN))
    ends = F.concat(F.col("later"), F.array(F.size(lines)))
    runs = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: r["e"] > r["s"])
    touched = F.col("later").isNotNull()
    joined = joined.select("d", F.when(touched, lines).alias("lines"), F.when(touched, runs).alias("runs"))
    joined = joined.select("d", "lines", F.flatten(F.transform("runs", lambda r: F.slice("lines", r["s"] + 1, r["e"] - r["s"]))).alias("kept"))
    text = F.when(F.col("lines").isNull(), F.col("d.text")).otherwise(F.array_join("kept", "\n"))
    gone = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long")
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col(f"d.`{c}`").alias(c) for c in columns], gone.alias(removed))
