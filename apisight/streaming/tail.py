"""A growing log file as a stream, and the continuous inventory built on it."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from apisight.operators.classify import classify
from apisight.operators.history import History
from apisight.functions.paths import canonical_segments
from apisight.operators.inventory import endpoints_of, inventory_from, merge_observations, observations
from apisight.operators.normalize import Collapse, collapse_more
from apisight.operators.publish import delete, names, publish, read_json
from apisight.plans.analysis import Analysis, Settings, html_lines, markdown_lines, write_lines
from apisight.ruleset import DEFAULT_STALENESS_DAYS, RULESET_VERSION
from apisight.session import cut_lineage
from apisight.sources.access_log import parse_lines
from apisight.sources.grammar import BUILT_IN

#: Bytes of one range, which one task reads at once besides the end of its last line; bytes that the driver looks at when it seeks a line's end.
RANGE_BYTES, LOOK_BYTES = 16 << 20, 1 << 20


class TailReader(SimpleDataSourceStreamReader):
    """Plans what is new as ranges of bytes; tasks read them. Offset: epoch (grows when the file has shrunk) and bytes, at the end of a line.

    An unterminated last line waits for its end: the driver looks for the last \\n from the file's end backwards, and reads nothing else.
    """

    def __init__(self, path: str, range_bytes: int = RANGE_BYTES):
        self.path, self.range_bytes = path, range_bytes

    def initialOffset(self) -> dict:
        return {"epoch": 0, "bytes": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        epoch, at = start["epoch"], start["bytes"]
        size = os.path.getsize(self.path) if os.path.exists(self.path) else 0
        if size < at:
            epoch, at = epoch + 1, 0
        end = {"epoch": epoch, "bytes": self._line_end(at, size)}
        return self._ranges(epoch, at, end["bytes"]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._ranges(end["epoch"], start["bytes"] if start["epoch"] == end["epoch"] else 0, end["bytes"])

    def _ranges(self, epoch: int, at: int, end: int) -> Iterator[tuple]:
        return iter([(epoch, self.path, at, a, min(a + self.range_bytes, end)) for a in range(at, end, self.range_bytes)])

    def _line_end(self, at: int, size: int) -> int:
        """Behind the last \\n in [at, size), or at."""
        while size > at:
            low = max(at, size - LOOK_BYTES)
            with open(self.path, "rb") as file:
                file.seek(low)
                found = file.read(size - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            size = low
        return at


def lines_of(path: str, first: int, begin: int, end: int) -> Iterator[bytes]:
    """The lines that start in [begin, end) of a file, where `first` is known to start one. The last one is read to its own end."""
    with open(path, "rb") as file:
        file.seek(max(first, begin - 1))
        if begin > first:
            file.readline()  # of the range before, up to its \\n
        while file.tell() < end and (line := file.readline()):
            yield line.removesuffix(b"\n")


class TailSource(DataSource):
    """Format `log_tail`: option path, a file that the driver and all executors can open. Columns: epoch, path, first, begin, end (a range of bytes)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "epoch long, path string, first long, begin long, end long"

    def simpleStreamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def tail_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a growing log as a stream of (epoch, value), read by the tasks that get their ranges.

    A row without a value follows each range's lines: range_begin, range_bytes and range_digest, the SHA-256 of just those lines' bytes.
    """
    spark.dataSource.register(TailSource)
    names = ["epoch", "value", "range_begin", "range_bytes", "range_digest"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def rows(epoch: int, values: list, *of_range: list) -> pa.RecordBatch:
        columns = [[epoch] * len(values), values, *(of_range or [[None] * len(values)] * 3)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                had: list[bytes] = []
                digest, size = hashlib.sha256(), 0
                for line in lines_of(r["path"], r["first"], r["begin"], r["end"]):
                    digest.update(line + b"\n")
                    size += len(line) + 1
                    had.append(line)
                    if len(had) == 10_000:
                        yield rows(r["epoch"], had)
                        had = []
                yield rows(r["epoch"], had)
                yield rows(r["epoch"], [None], [r["begin"]], [size], [digest.hexdigest()])

    ranges = spark.readStream.format("log_tail").option("path", path).load().repartition("begin")
    lines = ranges.mapInArrow(work, "epoch long, value binary, range_begin long, range_bytes long, range_digest string")
    return lines.withColumn("value", F.col("value").cast("string"))


_PATHS = "raw_path string, methods array<string>, observations long, first_seen timestamp, last_seen timestamp, auth_observable long, auth_present long"


class Watch:
    """Folds micro-batches of lines into an inventory that equals that of a single run over all lines so far.

    State: one row for each raw path (sums, minima, unions), in BUCKETS by a hash of the path. A batch is parsed once and summed up by path; it
    reads the buckets that its paths lie in, merges and writes them anew, and then names all buckets in one small commit file. So the state
    has as many rows as there are paths, and a batch's work follows its own paths. Identifiers that vary only later still collapse: the
    collapse goes on from batch to batch (collapse_more()), and walks only the paths that are new or below a prefix that has become variable.

    A batch that is run again starts from the commit before it and replaces its own; one that later batches have built on is not counted
    again. When the file starts anew (epoch), state, counts and digest do as well. The digest is a chain over the ranges of bytes consumed: each
    cycle reads what is new and goes on from the digest before.

    report: a folder that gets the report of every cycle, in a folder of its own that current.json names once it is complete.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, state: str, declared: DataFrame | None = None, history: History | None = None, target: str = "default", log_format: str = BUILT_IN, staleness_days: int = DEFAULT_STALENESS_DAYS, report: str | None = None):
        self.spark, self.state, self.declared, self.history = spark, state.rstrip("/"), declared, history
        self.target, self.log_format, self.staleness_days = target, log_format, staleness_days
        self.report = report and report.rstrip("/")

    def _name(self, batch_id: int) -> str:
        return f"{self.state}/commits/{batch_id:012d}.json"

    def _commits(self) -> list[dict]:
        """The commits that are there, the newest first; there are two at most, as a rule."""
        found = [read_json(self.spark, f"{self.state}/commits/{n}") for n in names(self.spark, f"{self.state}/commits") if re.fullmatch(r"[0-9]{12}\.json", n)]
        return sorted((c for c in found if c and "buckets" in c), key=lambda c: -c["batch"])

    def update(self, batch: DataFrame, batch_id: int) -> None:
        commits = self._commits()
        if commits and commits[0]["batch"] > batch_id:
            return  # a replay of what later batches have built on
        before = next((c for c in commits if c["batch"] < batch_id), None)
        had = next((c for c in commits if c["batch"] == batch_id), None)
        commit = self._fold(batch, batch_id, before)
        publish(self.spark, self._name(batch_id), commit, replace=True)
        for path in ([had["written"]] if had and had["written"] else []) + (before["replaced"] if before and not had else []):
            delete(self.spark, path)
        for old in commits:
            if old["batch"] < batch_id and old is not before:
                delete(self.spark, self._name(old["batch"]))
        if self.history is not None or self.report:
            self._record(batch_id, commit)

    def _fold(self, batch: DataFrame, batch_id: int, before: dict | None) -> dict:
        """The commit of a batch behind the one before it. Everything comes from one evaluation of the batch, a row for each path and reason."""
        ranges = ["range_begin", "range_bytes", "range_digest"]
        for c in ranges:
            if c not in batch.columns:
                batch = batch.withColumn(c, F.lit(None).cast("string" if c == "range_digest" else "long"))
        outcome = F.when(F.col("range_digest").isNull(), F.coalesce("discard_reason", F.lit("parsed")))
        seen = parse_lines(batch, self.log_format).withColumn("outcome", outcome).groupBy("epoch", "outcome", "raw_path", *ranges).agg(*observations())
        seen = cut_lineage(seen)
        epoch = seen.agg(F.max("epoch")).first()[0]
        if epoch is None and before is not None:  # an empty batch changes nothing
            return before | {"batch": batch_id, "written": None, "replaced": []}
        if before is None or epoch > before["epoch"]:
            before = {"epoch": epoch or 0, "buckets": {}, "lines": {}, "bytes": 0, "digest": None}
        epoch = before["epoch"]
        now = seen.where(F.col("epoch") == epoch)
        lines = dict(before["lines"])
        for r in now.where("outcome is not null").groupBy("outcome").agg(F.sum("observations").alias("n")).collect():
            lines[r.outcome] = lines.get(r.outcome, 0) + r.n
        consumed, digest = before["bytes"], before["digest"]
        for r in now.where("range_digest is not null").orderBy("range_begin").select(*ranges).collect():  # one for each RANGE_BYTES of the batch
            consumed += r.range_bytes
            digest = hashlib.sha256(f"{digest or ''}{r.range_bytes}:{r.range_digest}".encode()).hexdigest()
        bucket = F.pmod(F.xxhash64("raw_path"), F.lit(self.BUCKETS)).cast("int")
        fresh = now.where("outcome = 'parsed'").drop("epoch", "outcome", *ranges)
        touched = sorted(r.b for r in fresh.select(bucket.alias("b")).distinct().collect())
        had = [before["buckets"][str(b)] for b in touched if str(b) in before["buckets"]]
        rows = fresh.unionByName(self.spark.read.schema(_PATHS).parquet(*had)) if had else fresh
        written = f"{self.state}/paths/{batch_id:012d}-{uuid.uuid4().hex}" if touched else None
        if touched:
            merged = merge_observations(rows, "raw_path").withColumn("bucket", bucket)
            merged.repartition("bucket").write.partitionBy("bucket").parquet(written)
        collapse = before.get("collapse")
        known = Collapse.read(self.spark, collapse) if collapse else Collapse.empty(self.spark)
        more, changed = collapse_more(known, fresh.select(canonical_segments(F.col("raw_path")).alias("segs")))
        if changed:
            collapse, old = f"{written}/collapse", [collapse] if collapse else []
            more.write(collapse)
            had = [*had, *old]
        buckets = before["buckets"] | {str(b): f"{written}/bucket={b}" for b in touched}
        return {"batch": batch_id, "epoch": epoch, "buckets": buckets, "lines": lines, "bytes": consumed, "digest": digest, "written": written, "replaced": had, "collapse": collapse}

    def _record(self, batch_id: int, commit: dict) -> None:
        inventory = cut_lineage(self.inventory())
        findings = cut_lineage(classify(inventory, self.declared, self.staleness_days).withColumn("rule_line", F.lit(None).cast("long")))
        stamp = self.spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
        if self.history is not None:
            classes = findings.where("subject_kind = 'observed'").select(F.col("endpoint_id").alias("f_id"), "classification")
            seen = inventory.join(classes, F.col("id") == F.col("f_id"), "left").drop("f_id")
            manifest = F.get_json_object("manifest_json", "$.batch")
            if self.history.runs().where((F.col("target") == self.target) & (manifest == str(batch_id))).limit(1).count() == 0:
                self.history.record(self.target, stamp, seen, findings.drop("rule_line"), RULESET_VERSION, "apisight", self._manifest(commit, inventory, findings))
        if self.report:
            self._write_report(batch_id, commit, inventory, findings, stamp)

    def _write_report(self, batch_id: int, commit: dict, inventory: DataFrame, findings: DataFrame, stamp: str) -> None:
        """A whole report in a folder of its own, which the pointer then names in one step; the one before stays for its readers, older ones go."""
        by = {r.classification: r["count"] for r in findings.groupBy("classification").count().collect()}
        analysis = Analysis(inventory, findings, commit["lines"], by, 0, settings=Settings(target=self.target, staleness_days=self.staleness_days))
        pointer = f"{self.report}/current.json"
        had = read_json(self.spark, pointer)
        at = f"{self.report}/{batch_id:012d}-{uuid.uuid4().hex}"
        write_lines(html_lines(analysis), f"{at}/html")
        write_lines(markdown_lines(analysis), f"{at}/markdown")
        publish(self.spark, pointer, {"batch": batch_id, "written": stamp, "folder": at, "before": had and had["folder"]}, replace=True)
        if had and had.get("before"):
            delete(self.spark, had["before"])

    def _manifest(self, commit: dict, inventory: DataFrame, findings: DataFrame) -> str:
        """Of a cycle: the batch, the counts of all lines so far, endpoints and findings, the rows of the state, and the digest of the bytes consumed."""
        by = {r.classification: r.n for r in findings.groupBy("classification").agg(F.count(F.lit(1)).alias("n")).collect()}
        consumed = {"algorithm": "sha256-chain", "bytes": commit["bytes"], "digest": commit["digest"]}
        row = {"batch": commit["batch"], "lines": commit["lines"], "endpoints_found": inventory.count(), "findings_by_classification": by, "state_rows": self._state().count(), "consumed": consumed}
        return json.dumps(row, sort_keys=True)

    def _state(self) -> DataFrame:
        commits = self._commits()
        paths = list(commits[0]["buckets"].values()) if commits else []
        return self.spark.read.schema(_PATHS).parquet(*paths) if paths else self.spark.createDataFrame([], _PATHS)

    def inventory(self) -> DataFrame:
        """Endpoints of the state: each path's collapsed segments are looked up, none is walked again."""
        commits = self._commits()
        if not commits or not commits[0].get("collapse"):
            return inventory_from(self._state())
        rows = self._state().withColumn("segs", canonical_segments(F.col("raw_path"))).drop("raw_path")
        merged = merge_observations(rows, "segs")
        return endpoints_of(merged.join(Collapse.read(self.spark, commits[0]["collapse"]).known, "segs").drop("segs").withColumnRenamed("now", "segs"))

    def findings(self) -> DataFrame:
        return classify(cut_lineage(self.inventory()), self.declared, self.staleness_days)

    def start(self, lines: DataFrame, checkpoint: str, every: str | None = None):
        """Runs on a stream of tail_log(), or of (epoch, value): once over what is there, or every so often (such as `60 seconds`)."""
        writer = lines.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
