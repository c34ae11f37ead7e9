"""Access logs: scan, gates, strict parsing with a reason for every discarded line."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight import ruleset as R
from apisight.sources.grammar import BUILT_IN, Grammar, compile_format

REQUEST_LINE = r"^([!#$%&'*+.^_`|~0-9A-Za-z-]+) ([^ ]+) (HTTP/[^ ]*)\z"
METHOD = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+\z"
LOCAL_TIME = r"^[0-9]{1,2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}\z"
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})\z"

#: Columns that parse_lines() adds.
PARSED = ("discard_reason", "method", "raw_path", "query_params", "auth", "status_code", "ts")
#: Bytes of a file that are read at once for its digest.
PIECE_BYTES = 8 << 20
#: Bytes of a range that one task reads.
RANGE_BYTES = 64 << 20
#: Tasks among which the ranges are dealt, one after the other in each.
MOST_TASKS = 20_000


class FormatNotRecognized(ValueError):
    """No line of the sample, or of the whole log, fits the declared grammar."""


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a log, ended by \\n alone."""
    return spark.read.option("lineSep", "\n").text(path)


def _store(name: str):
    """pyarrow's file system and the path in it for a path as Spark shows it (local paths, file:// and hdfs://)."""
    return FileSystem.from_uri(unquote(name).replace("file:/", "file:///", 1) if re.match("file:/[^/]", name) else name)


def range_lines(stream, begin: int, end: int, piece: int = PIECE_BYTES) -> Iterator[tuple[list[bytes], bytes]]:
    """The lines that start in [begin, end) of a seekable stream, in lists, with the bytes that they take, their ends included.

    A line is held up to a little over MAX_LINE_BYTES, which is enough to discard it; its other bytes are handed on for the digest alone.
    """
    at = max(0, begin - 1)
    stream.seek(at)
    skip, held, over = begin > 0, b"", False
    while data := stream.read(piece):
        if skip:  # up to the end of the line that has begun before
            cut = data.find(b"\n")
            at += len(data) if cut < 0 else cut + 1
            if cut < 0:
                continue
            data, skip = data[cut + 1 :], False
            if at >= end:
                return
        if not data:
            continue
        # the last line to take is the one in which the range ends
        last = data.find(b"\n", max(0, end - 1 - at)) if at + len(data) >= end else -1
        taken = data if last < 0 else data[: last + 1]
        *lines, rest = taken.split(b"\n")
        if lines:
            lines[0] = held + lines[0][: R.MAX_LINE_BYTES + 2] if over or held else lines[0]
            held = rest
        else:
            held += rest[: max(0, R.MAX_LINE_BYTES + 2 - len(held))]
        held = held[: R.MAX_LINE_BYTES + 2]
        over = bool(held)
        yield lines, taken
        at += len(taken)
        if last >= 0:
            return
    if held:
        yield [held], b""


def scan_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value (binary): the lines of a log, ended by \\n alone, read in ranges of bytes; and a row without a value for each range, with the file,
    its place, its bytes and their SHA-256. One read of the files gives the lines and what their digests are made of."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.select("file", "length", F.explode(starts).alias("begin"))
    names = ["value", "file", "range_begin", "range_bytes", "range_digest"]
    types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, begin in zip(*[batch.column(c).to_pylist() for c in ("file", "length", "begin")], strict=True):
                store, at = _store(name)
                digest, size = hashlib.sha256(), 0
                with store.open_input_file(at) as stream:
                    for lines, taken in range_lines(stream, begin, min(length, begin + range_bytes)):
                        digest.update(taken)
                        size += len(taken)
                        for i in range(0, len(lines), 20_000):
                            part = lines[i : i + 20_000]
                            yield pa.RecordBatch.from_arrays([pa.array(part, types[0]), *[pa.nulls(len(part), t) for t in types[1:]]], names)
                row = [None, name, begin, size, digest.hexdigest()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks, "file", "begin").mapInArrow(work, "value binary, file string, range_begin long, range_bytes long, range_digest string")


def range_digests(ranges: DataFrame) -> DataFrame:
    """path, algorithm, digest of each file from its ranges: that of its one range (the SHA-256 of its bytes), or the SHA-256 of the joined
    hexadecimal digests of several, each of RANGE_BYTES and of the lines that begin in it."""
    rows = ranges.where("range_digest is not null").groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("range_begin", "range_digest"))).alias("r"))
    one, joined = F.col("r")[0]["range_digest"], F.array_join(F.transform("r", lambda x: x["range_digest"]), "")
    return rows.select("path", F.when(F.size("r") == 1, "sha256").otherwise("sha256-ranges").alias("algorithm"), F.when(F.size("r") == 1, one).otherwise(F.sha2(joined.cast("binary"), 256)).alias("digest"))


def request_line(text: Column) -> tuple[Column, Column]:
    """Method and target of a request line; null where it is none."""
    fits = text.rlike(REQUEST_LINE)
    part = lambda i: F.when(fits, F.regexp_extract(text, REQUEST_LINE, i))
    return part(1), part(2)


def path_and_query(target: Column) -> tuple[Column, Column]:
    at = F.instr(target, "?")
    return F.when(at > 0, target.substr(F.lit(1), at - 1)).otherwise(target), F.when(at > 0, target.substr(at + 1, F.length(target))).otherwise(F.lit(""))


def query_params(query: Column) -> Column:
    """Map of name to its values in order; a part without = has an empty value, empty parts go, nothing is decoded."""
    pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), p.substr(F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit("")).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda x: x["k"] == n), lambda x: x["v"])))


def infer_auth(user: Column) -> Column:
    """A logged user proves authentication of some kind; none means that the log can't tell."""
    none = user.isNull() | user.isin("-", "")
    return F.struct(F.when(none, F.lit("NotObservable")).otherwise(F.lit("Present")).alias("state"), F.when(~none, F.lit("unspecified")).alias("scheme"))


def parse_local_time(text: Column) -> Column:
    return F.when(text.rlike(LOCAL_TIME), F.try_to_timestamp(text, F.lit("d/MMM/yyyy:HH:mm:ss Z")))


def parse_rfc3339(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def parse_lines(lines: DataFrame, log_format: str = BUILT_IN, value: str = "value") -> DataFrame:
    """lines with method, raw_path, query_params, auth, status_code, ts and discard_reason (null for a parsed line; the others are null then).

    A line has no \\n, so one replacement by the grammar's fields, each after a \\n, both tests and cuts it. The reasons come in a fixed order:
    length (in bytes, before a trailing \\r is taken off), encoding, blank, the grammar's structure, status, time, request; the byte count comes
    with the structure in the built-in grammar and last in a declared one. A value with \\n is a malformed line.

    The results are made in one generator, so that a condition on them is not pushed under it and computed twice.
    """
    g: Grammar = compile_format(log_format)
    given = F.col(value)
    line = F.when(F.endswith(given, F.lit("\r")), F.substring(given, F.lit(1), F.length(given) - 1)).otherwise(given)
    parts = F.split(F.regexp_replace(line, g.pattern, "".join(f"\n${i}" for i in g.fields.values())), "\n")
    rows = lines.select("*", F.is_valid_utf8(given).alias("_valid"), F.when(~F.contains(given, F.lit("\n")), parts).alias("_parts"))
    rows = rows.withColumn("_fields", F.when(F.col("_valid") & (F.size("_parts") == len(g.fields) + 1), F.col("_parts")))
    field = {name: F.col("_fields")[i + 1] for i, name in enumerate(g.fields)}
    if "request" in field:
        method, target = request_line(field["request"])
    else:
        method, target = field["request_method"], field["request_uri"]
        ok = (method != "-") & (target != "-") & (target != "") & method.rlike(METHOD)
        method, target = F.when(ok, method), F.when(ok, target)
    ts = parse_local_time(field["time_local"]) if "time_local" in field else parse_rfc3339(field["time_iso8601"])
    bad_bytes = ~field["body_bytes_sent"].rlike(r"^(?:[0-9]+|-)\z") if "body_bytes_sent" in field else F.lit(False)
    rows = rows.select("*", method.alias("_method"), target.alias("_target"), ts.alias("_ts"), bad_bytes.alias("_bad_bytes"))
    path, query = path_and_query(F.col("_target"))
    bad = F.col("_bad_bytes")
    reason = (
        F.when(F.octet_length(given) > R.MAX_LINE_BYTES, R.LINE_TOO_LONG)
        .when(~F.col("_valid"), R.INVALID_UTF8)
        .when(F.col("_fields").isNull() & given.rlike(r"(?U)^\s*\z"), R.BLANK_LINE)
        .when(F.col("_fields").isNull() | (F.lit(not g.declared) & bad), R.MALFORMED_LINE)
        .when(~field["status"].rlike(r"^[0-9]{3}\z"), R.INVALID_STATUS)
        .when(F.col("_ts").isNull(), R.INVALID_TIMESTAMP)
        .when(F.col("_method").isNull(), R.INVALID_REQUEST)
        .when(bad, R.MALFORMED_LINE)
    )
    rows = rows.select("*", reason.alias("_reason"))
    parsed = F.col("_reason").isNull()
    user = field["remote_user"] if "remote_user" in field else F.lit(None).cast("string")
    made = {"_reason": F.col("_reason"), "_method": F.col("_method"), "_path": path, "_query": query, "_user": user, "_status": field["status"], "_ts": F.col("_ts")}
    given_columns = [F.col(f"`{c}`") for c in lines.columns if c not in PARSED]
    rows = rows.select(*given_columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    # outside of the generator, so that what a query does not use is not computed
    out = (
        F.col("_reason"),
        F.when(parsed, F.col("_method")),
        F.when(parsed, F.col("_path")),
        F.when(parsed, query_params(F.col("_query"))),
        F.when(parsed, infer_auth(F.col("_user"))),
        F.when(parsed, F.try_to_number("_status", F.lit("999")).cast("smallint")),
        F.when(parsed, F.col("_ts")),
    )
    return rows.select(*given_columns, *[v.alias(k) for k, v in zip(PARSED, out, strict=True)])


def in_scope(prefix: str | None) -> Column:
    """Whether a request's raw path starts with the prefix; every one does without a prefix."""
    return F.startswith("raw_path", F.lit(prefix)) if prefix else F.lit(True)


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """discard_reason (`parsed` for the rest) and lines."""
    return parsed.groupBy(F.coalesce("discard_reason", F.lit("parsed")).alias("outcome")).agg(F.count(F.lit(1)).alias("lines"))


def check_format(parsed: DataFrame) -> None:
    """Raises FormatNotRecognized if the first FORMAT_SAMPLE_LINES lines that are not blank, or all of a shorter log, have no parsed one."""
    sample = parsed.where((F.col("discard_reason") != R.BLANK_LINE) | F.col("discard_reason").isNull()).select("discard_reason").limit(R.FORMAT_SAMPLE_LINES)
    seen, fit = sample.agg(F.count(F.lit(1)), F.count_if(F.col("discard_reason").isNull())).first()
    if seen and not fit:
        raise FormatNotRecognized(f"none of {seen} lines fits the log format")


def input_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, algorithm and SHA-256 of each file's bytes, of any size: a task reads a file in pieces and holds one of them.

    Files are listed by Spark and opened by pyarrow's file systems in the task (local paths, file:// and hdfs://).
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                store, at = _store(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(["sha256"] * len(found), pa.string()), pa.array(found, pa.string())], ["path", "algorithm", "digest"])

    return files.mapInArrow(work, "path string, algorithm string, digest string")
