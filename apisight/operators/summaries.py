"""Counts and groupings of findings and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apisight import ruleset as R
from apisight.functions.paths import is_id_like, parent_prefix
from apisight.functions.redact import redact_text
from apisight.operators.order import joined, least_of, numbered


def urgency(classification: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, R.VERDICTS)), classification)


def finding_counts(findings: DataFrame) -> DataFrame:
    """By classification, silenced ones included."""
    return findings.groupBy("classification").agg(F.count(F.lit(1)).alias("findings"))


def _with_reason(findings: DataFrame) -> DataFrame:
    return findings.withColumn("reason", F.col("evidence")[0]).withColumn("urgency", urgency(F.col("classification")))


def grouped_findings(findings: DataFrame) -> DataFrame:
    """Findings of one first evidence and classification together: members (how many), paths (of the first GROUP_DETAIL_LIMIT members in the
    report's order: path, kind), first_path, in_detail and position.

    position: the place of the group by its first appearance in the report. A group is in detail up to GROUP_DETAIL_LIMIT members; beyond, the
    report gives its reason once. A group is a small row, whatever its size; whole_groups() and group_members() list who is in it.
    """
    keys, order = ["urgency", "classification", "reason"], ["path_pattern", "subject_kind"]
    rows = _with_reason(findings)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    first = least_of(rows, keys, order, R.GROUP_DETAIL_LIMIT, "of").withColumnsRenamed({k: f"l_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys]
    grouped = counted.join(first, same[0] & same[1] & same[2])
    # groups of one classification follow their first paths
    placed = numbered(grouped.withColumn("_first", F.col("of")[0]), "urgency", "_first", "reason", out="_position")
    starts = placed.groupBy(F.col("urgency").alias("u")).agg(F.min("_position").alias("_start"))  # a row for each verdict
    placed = placed.join(F.broadcast(starts), F.col("urgency").eqNullSafe(F.col("u")))
    position = (F.col("urgency") * 1_000_000 + F.col("_position") - F.col("_start") + 1).cast("long")
    return placed.select("classification", "reason", "members", F.col("of.path_pattern").alias("paths"), position.alias("position"), F.col("of")[0]["path_pattern"].alias("first_path"), (F.col("members") <= R.GROUP_DETAIL_LIMIT).alias("in_detail"))


def whole_groups(findings: DataFrame) -> DataFrame:
    """grouped_findings(), with the paths of all members, however many, as one text: in the report's order, blanks between."""
    return joined(_with_reason(findings), ["classification", "reason"], ["path_pattern", "subject_kind"], "path_pattern", grouped_findings(findings).drop("paths"), "paths")


def group_members(findings: DataFrame) -> DataFrame:
    """classification, reason, path_pattern, subject_kind: who is in which group of grouped_findings()."""
    return _with_reason(findings).select("classification", "reason", "path_pattern", "subject_kind")


def finding_mix(findings: DataFrame) -> DataFrame:
    """Findings by classification, severity and confidence."""
    return findings.groupBy("classification", "severity", "confidence").agg(F.count(F.lit(1)).alias("findings"))


def evidence_histogram(findings: DataFrame) -> DataFrame:
    """How often each piece of evidence is given, with numbers and names in it as one."""
    plain = lambda e: F.regexp_replace(F.regexp_replace(e, "/[^ ,;']*", "<path>"), "[0-9]+", "<n>")
    return findings.select(F.explode("evidence").alias("e")).groupBy(plain(F.col("e")).alias("evidence")).agg(F.count(F.lit(1)).alias("times"))


def redacted_share(inventory: DataFrame) -> DataFrame:
    """One row: patterns, and those that redaction changes."""
    changed = redact_text(F.col("path_pattern")) != F.col("path_pattern")
    return inventory.agg(F.count(F.lit(1)).alias("patterns"), F.count_if(changed).alias("redacted"))


def auth_label(auth: Column) -> Column:
    key = F.lower(F.regexp_replace(auth, " ", ""))
    return F.when(key.isin("yes", "no", "mixed"), key).when(key == "notobservable", "not observable").otherwise("not recorded")


def classification_label(classification: Column) -> Column:
    return F.when(classification.isin(*R.VERDICTS), classification).otherwise("no verdict")


def _zero_filled(rows: DataFrame, label: Column, names: tuple[str, ...]) -> DataFrame:
    counts = rows.groupBy(label.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "position int, label string")
    return every.join(counts, F.col("label") == F.col("l"), "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("endpoints"))


def auth_summary(inventory: DataFrame) -> DataFrame:
    return _zero_filled(inventory, auth_label(F.col("auth_observed")), R.AUTH_SUMMARY)


def class_summary(inventory: DataFrame) -> DataFrame:
    return _zero_filled(inventory, classification_label(F.col("last_classification")), R.CLASS_SUMMARY)


def compliance_rows(inventory: DataFrame) -> DataFrame:
    """The columns of the compliance export, in its order; sorted by pattern, then id, when it is written."""
    return inventory.select(
        "endpoint_id",
        "path_pattern",
        F.array_join("methods", " ").alias("methods"),
        F.col("observation_count").alias("observations"),
        classification_label(F.col("last_classification")).alias("classification"),
        auth_label(F.col("auth_observed")).alias("authentication"),
        F.coalesce(F.col("auth_observable_count").cast("string"), F.lit("not recorded")).alias("observable_requests"),
        "first_seen_run",
        "last_seen_run",
        F.when(F.col("alerted") & ~F.col("acknowledged"), "yes").otherwise("no").alias("pending_alert"),
    )


def trend(runs: DataFrame, target: str) -> DataFrame:
    """The last TREND_RUNS runs of a target in the order of their ids, with bar heights of at least 2 per cent of the peak."""
    last = runs.where(F.col("target") == target).orderBy(F.desc("id")).limit(R.TREND_RUNS)
    peak = F.greatest(F.max("endpoints").over(Window.partitionBy("target")), F.lit(1))
    return last.select("id", "endpoints", F.greatest(F.floor(F.col("endpoints") * 100 / peak), F.lit(2)).cast("long").alias("height"))


def noise_metrics(observed: DataFrame, findings: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: endpoints, findings that are not Known, those per ten endpoints, and the share of discarded lines."""
    e = observed.agg(F.count(F.lit(1)).alias("endpoints"))
    f = findings.agg(F.count_if(F.col("classification") != "Known").alias("to_look_at"))
    c = counts.agg(F.sum("lines").alias("lines"), F.sum(F.when(F.col("outcome") != "parsed", F.col("lines")).otherwise(0)).alias("discarded"))
    one = e.join(F.broadcast(f)).join(F.broadcast(c))  # one row each
    return one.select("endpoints", "to_look_at", F.round(F.when(F.col("endpoints") > 0, 10 * F.col("to_look_at") / F.col("endpoints")), 1).alias("per_ten_endpoints"), "lines", "discarded")


def literal_children(observed: DataFrame, limit: int = R.LITERAL_CHILDREN_LIMIT) -> DataFrame:
    """Prefixes with over `limit` literal last segments: identifiers that were not recognised, perhaps."""
    last = F.substring_index("path_pattern", "/", -1)
    rows = observed.where(last != R.ID_PLACEHOLDER)
    return rows.groupBy(parent_prefix(F.col("path_pattern")).alias("parent")).agg(F.count(F.lit(1)).alias("children"), F.min(last).alias("sample")).where(F.col("children") > limit)


def swallowed_words(raw_paths: DataFrame, observed: DataFrame) -> DataFrame:
    """Segments of raw paths that are no identifiers and stand in no pattern: what a collapse has hidden, if anything."""
    words = raw_paths.select(F.explode(F.split("raw_path", "/")).alias("segment")).where((F.col("segment") != "") & ~is_id_like(F.col("segment")))
    words = words.groupBy("segment").agg(F.count(F.lit(1)).alias("times"))
    shown = observed.select(F.explode(F.split("path_pattern", "/")).alias("s")).distinct()
    return words.join(shown, F.col("segment") == F.col("s"), "left_anti")


def stratified_sample(findings: DataFrame, strata: list[str], quota: int, seed: int = 20260830) -> DataFrame:
    """quota rows of each stratum in a seeded order."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "subject_kind", "path_pattern")))
    return findings.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= quota)
