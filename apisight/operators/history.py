"""Run history: upserts, alerts that stay until acknowledged, and a store of Parquet tables with one commit file for each change."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apisight.operators.publish import delete, hadoop_path, names, publish
from apisight.operators.summaries import auth_label
from apisight.ruleset import VERDICTS

SCHEMA_VERSION = 4
#: Blocks of runs by id, a power of two: the largest group that clock_backwards sorts has one of so many parts of all runs.
BLOCKS = 1024
COMMIT = "version long, schema_version int, last_run long, runs string, findings string, endpoints string"
CHECKPOINT = "schema_version int, last_run long, runs array<struct<level: int, path: string>>, findings array<struct<level: int, path: string>>, endpoints array<string>, replaced array<string>, complete boolean"
RUNS = "id long, target string, run_timestamp string, tool_version string, ruleset_version string, endpoints long, manifest_json string"
FINDINGS = "run_id long, endpoint_id string, declared_path string, classification string, confidence string, severity string, evidence string"
ENDPOINTS = (
    "target string, endpoint_id string, path_pattern string, first_seen_run long, last_seen_run long, last_classification string, acknowledged boolean, "
    "alerted boolean, methods array<string>, observation_count long, auth_observed string, auth_observable_count long"
)


def valid_target(name: str) -> bool:
    return bool(name) and name == name.strip()


def upsert_endpoints(old: DataFrame, seen: DataFrame, target: str, run_id: int) -> DataFrame:
    """The endpoints table after a run: old rows, overwritten or added to by `seen` (an inventory with classification, null without a verdict).

    A row's first run and acknowledgement stay, its classification stays if the run has none, and an alert once raised stays. Rows that the
    run has not seen are as before.
    """
    n = seen.select(
        F.lit(target).alias("n_target"), F.col("id").alias("n_id"), F.col("path_pattern").alias("n_path"), F.col("methods").alias("n_methods"), F.col("observation_count").alias("n_count"),
        F.col("auth_observed").alias("n_auth"), F.col("auth_observable_count").alias("n_observable"), F.col("classification").alias("n_class"),
    )
    rows = old.join(n, (F.col("target") == F.col("n_target")) & (F.col("endpoint_id") == F.col("n_id")), "full")
    now = F.col("n_id").isNotNull()
    take = lambda new, had: F.when(now, F.col(new)).otherwise(F.col(had)).alias(had)
    return rows.select(
        F.coalesce("target", "n_target").alias("target"),
        F.coalesce("endpoint_id", "n_id").alias("endpoint_id"),
        take("n_path", "path_pattern"),
        F.coalesce("first_seen_run", F.lit(run_id)).cast("long").alias("first_seen_run"),
        F.when(now, F.lit(run_id)).otherwise(F.col("last_seen_run")).cast("long").alias("last_seen_run"),
        F.coalesce("n_class", "last_classification").alias("last_classification"),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"),
        (F.coalesce("alerted", F.lit(False)) | F.coalesce(F.col("n_class") == "Shadow", F.lit(False))).alias("alerted"),
        take("n_methods", "methods"),
        take("n_count", "observation_count"),
        take("n_auth", "auth_observed"),
        take("n_observable", "auth_observable_count"),
    )


def new_endpoints(old: DataFrame, seen: DataFrame, target: str) -> DataFrame:
    had = old.where(F.col("target") == target).select(F.col("endpoint_id").alias("had"))
    return seen.join(had, F.col("id") == F.col("had"), "left_anti")


def pending_alerts(endpoints: DataFrame) -> DataFrame:
    return endpoints.where("alerted and not acknowledged")


def acknowledge(endpoints: DataFrame, target: str, endpoint_id: str) -> DataFrame:
    hit = (F.col("target") == target) & (F.col("endpoint_id") == endpoint_id)
    return endpoints.withColumn("acknowledged", F.when(hit, F.lit(True)).otherwise(F.col("acknowledged")))


def clock_backwards(runs: DataFrame) -> DataFrame:
    """runs with went_back: its time, as text, is before that of the target's previous run by id; of runs with one id the earlier comes first.

    Quantiles of id split each target into blocks, so that no target is one task; a block's last time is carried to the next. runs is read
    three times.
    """
    steps = BLOCKS.bit_length() - 1
    bounds = runs.agg(F.percentile_approx("id", [(i + 1) / BLOCKS for i in range(BLOCKS - 1)], 100 * BLOCKS).alias("_bounds"))
    # binary search: how many of the bounds are not above the id
    block = F.expr(f"aggregate(sequence({steps - 1}, 0, -1), 0, (at, s) -> if(_bounds[at + shiftleft(1, s) - 1] <= id, at + shiftleft(1, s), at))")
    rows = runs.crossJoin(F.broadcast(bounds)).withColumn("_block", block).drop("_bounds")
    last = rows.groupBy(F.col("target").alias("_t"), F.col("_block").alias("_b")).agg(F.max(F.struct("id", "run_timestamp")).alias("_last"))
    last = last.select("_t", "_b", F.lag("_last.run_timestamp").over(Window.partitionBy("_t").orderBy("_b")).alias("_carried"))
    order = Window.partitionBy("target", "_block").orderBy("id", "run_timestamp")
    rows = rows.withColumn("_nth", F.row_number().over(order)).withColumn("_before", F.lag("run_timestamp").over(order))
    rows = rows.join(last, F.col("target").eqNullSafe(F.col("_t")) & (F.col("_block") == F.col("_b")), "left")
    before = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return rows.withColumn("went_back", F.coalesce(F.col("run_timestamp") < before, F.lit(False))).select(*runs.columns, "went_back")


def first_seen_in(endpoints: DataFrame, target: str, run_id: int) -> DataFrame:
    return endpoints.where((F.col("target") == target) & (F.col("first_seen_run") == run_id))


def target_inventory(endpoints: DataFrame, target: str) -> DataFrame:
    """A target's endpoints as the history shows them."""
    rows = endpoints.where(F.col("target") == target)
    return rows.select("path_pattern", "endpoint_id", F.greatest("observation_count", F.lit(0)).alias("observation_count"), auth_label(F.col("auth_observed")).alias("auth"), (F.col("alerted") & ~F.col("acknowledged")).alias("pending"))


def targets(runs: DataFrame) -> DataFrame:
    return runs.groupBy("target").agg(F.count(F.lit(1)).alias("runs"), F.max("id").alias("last_run"))


def last_run(runs: DataFrame, target: str) -> DataFrame:
    """The target's run with the highest id, if there is one."""
    return runs.where(F.col("target") == target).orderBy(F.desc("id")).limit(1)


#: Of a stored manifest, what the status view shows; anything else in it is left alone.
MANIFEST = "counts struct<lines_total: long, lines_parsed: long, lines_discarded: long, endpoints_found: long, findings_by_classification: map<string, long>>, lines map<string, long>, endpoints_found long, findings_by_classification map<string, long>"


def run_numbers(runs: DataFrame) -> DataFrame:
    """Each run's numbers out of its stored manifest: lines read, parsed and discarded, endpoints, findings, and those of each verdict.

    Manifests of an analysis and of a cycle both have them, in places of their own. One that is broken, or has none, leaves nulls (endpoints:
    the run's own count); a run without a manifest stays a row.
    """
    m = F.from_json("manifest_json", MANIFEST)
    rows = runs.select("id", "target", "endpoints", m.alias("m"))
    every = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    of_cycle = F.col("m.lines")
    by = F.coalesce(F.col("m.counts.findings_by_classification"), F.col("m.findings_by_classification"))
    total, parsed = F.coalesce(F.col("m.counts.lines_total"), every(of_cycle)), F.coalesce(F.col("m.counts.lines_parsed"), F.when(of_cycle.isNotNull(), F.coalesce(F.try_element_at(of_cycle, F.lit("parsed")), F.lit(0))))
    verdict = lambda name: F.when(by.isNotNull(), F.coalesce(F.try_element_at(by, F.lit(name)), F.lit(0)))
    return rows.select(
        "id",
        "target",
        total.alias("lines"),
        parsed.alias("parsed"),
        F.coalesce(F.col("m.counts.lines_discarded"), total - parsed).alias("discarded"),
        F.coalesce("m.counts.endpoints_found", "m.endpoints_found", "endpoints").alias("endpoints"),
        every(by).alias("findings"),
        *[verdict(v).alias(v.lower()) for v in VERDICTS],
    )


def status_counts(runs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The status view's numbers: each target's runs and last run, its endpoints, those first seen after its first run, and pending alerts."""
    of = endpoints.groupBy(F.col("target").alias("t")).agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("first_seen_run") > 1).alias("later"), F.count_if(F.col("alerted") & ~F.col("acknowledged")).alias("pending")
    )
    rows = targets(runs).join(of, F.col("target") == F.col("t"), "left")
    return rows.select("target", "runs", "last_run", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("endpoints", "later", "pending")])


def findings_of_run(findings: DataFrame, run_id: int) -> DataFrame:
    return findings.select(
        F.lit(run_id).cast("long").alias("run_id"),
        "endpoint_id",
        F.when(F.col("subject_kind") == "declared", F.col("path_pattern")).alias("declared_path"),
        "classification",
        "confidence",
        "severity",
        F.array_join("evidence", "\n").alias("evidence"),
    )


@dataclass
class _State:
    """What the log says so far: the next version's predecessor, the last run's id, the parts of the tables, (level, path) each, and the endpoints."""

    version: int = 0
    checkpoint: int = 0
    last_run: int = 0
    runs: list = field(default_factory=list)
    findings: list = field(default_factory=list)
    endpoints: list = field(default_factory=list)  # of the last two versions that wrote any
    replaced: list = field(default_factory=list)

    def add(self, row) -> None:
        for name in ("runs", "findings"):
            if row[name]:
                getattr(self, name).append((0, row[name]))
        if row["endpoints"]:
            self.endpoints = [*self.endpoints, row["endpoints"]][-2:]
        self.last_run = max(self.last_run, row["last_run"])


class HistoryBusy(RuntimeError):
    """Other writers were first each time."""


class History:
    """Three tables under one folder that Spark reads and writes.

    A record appends the run's own rows of runs and findings, writes the endpoints anew, and then names all of it in one small commit file,
    commits/<version>.json. That file is written under another name and published by a rename that overwrites nothing, so it is there whole or
    not at all, and of two writers one succeeds; the other starts again from what the first has committed. No run is lost, no id is given
    twice. A file that is torn all the same, or foreign, is no commit: readers pass it over, and the next version is behind its name.

    Every EVERY versions a writer merges parts, level by level as they become many, and publishes checkpoints/<version>.json with what is there
    then. A reader takes the last checkpoint and the commits behind it, some EVERY at most, whatever the number of runs. Endpoints two versions
    back, and parts that a checkpoint before the last has merged, are deleted.
    """

    #: Versions between two checkpoints, which is also how many parts of a level become one.
    EVERY = 32
    #: Attempts of a writer whom others are before each time.
    ATTEMPTS = 50

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        for name in ("commits", "checkpoints"):
            folder, fs = hadoop_path(spark, f"{self.path}/{name}")
            if not fs.exists(folder):
                if not create and name == "commits":
                    raise FileNotFoundError(f"no history at {path}")
                fs.mkdirs(folder)

    def _versions(self, folder: str) -> dict[int, str]:
        """Version and path of every file in commits or checkpoints that is named like one."""
        found = names(self.spark, f"{self.path}/{folder}")
        return {int(n[:12]): f"{self.path}/{folder}/{n}" for n in found if re.fullmatch(r"[0-9]{12}\.json", n)}

    def _rows(self, files: dict[int, str]) -> list:
        """The commits in these files, in order; what can't be read as one is left out."""
        if not files:
            return []
        rows = self.spark.read.schema(COMMIT).json(list(files.values())).where("version is not null and schema_version is not null").orderBy("version").collect()
        if not all(r.schema_version == SCHEMA_VERSION for r in rows):
            raise ValueError(f"a history of another version than {SCHEMA_VERSION}")
        return [r for r in rows if r.version in files and r.last_run is not None]

    def _state(self) -> _State:
        state = _State()
        for version, path in sorted(self._versions("checkpoints").items(), reverse=True):
            row = self.spark.read.schema(CHECKPOINT).json(path).first()
            if row is not None and row.schema_version == SCHEMA_VERSION and row.complete:
                state = _State(version, version, row.last_run, *[[tuple(x) for x in row[n]] for n in ("runs", "findings")], list(row.endpoints), list(row.replaced))
                break
        files = {v: p for v, p in self._versions("commits").items() if v > state.checkpoint}
        for row in self._rows(files):
            state.add(row)
        state.version = max([state.version, *files])
        return state

    def _table(self, name: str, schema: str, state: _State | None = None) -> DataFrame:
        state = self._state() if state is None else state
        at = state.endpoints[-1:] if name == "endpoints" else [path for _, path in getattr(state, name)]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._table("runs", RUNS)

    def findings(self) -> DataFrame:
        return self._table("findings", FINDINGS)

    def endpoints(self) -> DataFrame:
        return self._table("endpoints", ENDPOINTS)

    def last_run(self, target: str):
        return last_run(self.runs(), target).first()

    def has_target(self, target: str) -> bool:
        return self.last_run(target) is not None

    def _publish(self, folder: str, version: int, row: dict) -> bool:
        return publish(self.spark, f"{self.path}/{folder}/{version:012d}.json", row)

    def _commit(self, state: _State, tables: dict[str, DataFrame], last_run: int) -> bool:
        """Whether this was the next commit; if not, another one was first, and what was written is deleted."""
        version = state.version + 1
        row = {"version": version, "schema_version": SCHEMA_VERSION, "last_run": last_run, "runs": None, "findings": None, "endpoints": None}
        for name, table in tables.items():
            row[name] = f"{self.path}/{name}/{version}-{uuid.uuid4().hex}"
            table.write.parquet(row[name])
        if not self._publish("commits", version, row):
            for name in tables:
                self._delete(row[name])
            return False
        for old in state.endpoints[:-1] if row["endpoints"] else []:
            self._delete(old)
        if version - state.checkpoint >= self.EVERY:
            self._checkpoint()
        return True

    def _merged(self, name: str, schema: str, parts: list, version: int, replaced: list) -> list:
        """The parts, EVERY of one level made one of the next; what is merged goes to replaced."""
        parts, level = list(parts), 0
        while any(at >= level for at, _ in parts):
            own = [p for at, p in parts if at == level]
            if len(own) >= self.EVERY:
                new = f"{self.path}/{name}/{version}-merged-{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*own).coalesce(max(1, len(own) // self.EVERY)).write.parquet(new)
                replaced += own
                parts = [x for x in parts if x[0] != level] + [(level + 1, new)]
            level += 1
        return parts

    def _checkpoint(self) -> None:
        """Publishes what is there; if another writer has done so for this version, nothing changes."""
        state, replaced = self._state(), []
        if state.version == state.checkpoint:
            return
        runs, findings = (self._merged(n, s, getattr(state, n), state.version, replaced) for n, s in (("runs", RUNS), ("findings", FINDINGS)))
        row = {"schema_version": SCHEMA_VERSION, "last_run": state.last_run, "endpoints": state.endpoints, "replaced": replaced, "complete": True}
        row |= {n: [{"level": at, "path": p} for at, p in parts] for n, parts in (("runs", runs), ("findings", findings))}
        if not self._publish("checkpoints", state.version, row):
            return
        for old in state.replaced:  # by the checkpoint before, of which no reader starts any more
            self._delete(old)
        for folder in ("commits", "checkpoints"):
            for version, path in self._versions(folder).items():
                if version < state.checkpoint or (folder == "commits" and version == state.checkpoint):
                    self._delete(path)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)

    def _until_committed(self, attempt):
        """What attempt(state) returns in the end; None says that another writer was first."""
        for _ in range(self.ATTEMPTS):
            found = attempt(self._state())
            if found is not None:
                return found
        raise HistoryBusy(f"{self.ATTEMPTS} attempts to write to {self.path}, and another writer was first each time")

    def record(self, target: str, timestamp: str, inventory: DataFrame, findings: DataFrame, ruleset: str, tool: str, manifest: str = "{}") -> int:
        """Adds a run; inventory: with classification. Returns its id, which is the order of runs, whatever the clock says."""
        if not valid_target(target):
            raise ValueError("a target's name can't be empty or have white space around it")
        endpoints = inventory.count()

        def attempt(state: _State) -> int | None:
            run_id = state.last_run + 1
            run = self.spark.createDataFrame([(run_id, target, timestamp, tool, ruleset, endpoints, manifest)], RUNS)
            now = upsert_endpoints(self._table("endpoints", ENDPOINTS, state), inventory, target, run_id)
            return run_id if self._commit(state, {"runs": run, "findings": findings_of_run(findings, run_id), "endpoints": now}, run_id) else None

        return self._until_committed(attempt)

    def acknowledge(self, target: str, endpoint_id: str) -> bool:
        def attempt(state: _State) -> bool | None:
            rows = self._table("endpoints", ENDPOINTS, state)
            if not rows.where((F.col("target") == target) & (F.col("endpoint_id") == endpoint_id)).limit(1).count():
                return False
            return self._commit(state, {"endpoints": acknowledge(rows, target, endpoint_id)}, state.last_run) or None

        return self._until_committed(attempt)
