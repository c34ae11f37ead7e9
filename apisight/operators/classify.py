"""Verdicts on endpoints: the decision tables with and without a declared inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apisight.functions.paths import parent_prefix, suspicious_segment
from apisight.operators.match import candidates, declared_unseen, exact_matches, nearest
from apisight.ruleset import DEFAULT_STALENESS_DAYS, EVIDENCE

COLUMNS = ("subject_kind", "endpoint_id", "path_pattern", "methods", "classification", "confidence", "is_ambiguous", "evidence", "severity")


def say(key: str, *values: Column) -> Column:
    """An evidence text with its values filled in."""
    parts, rest = [], EVIDENCE[key]
    for i, value in enumerate(values):
        before, rest = rest.split(f"{{{i}}}", 1)
        parts += [F.lit(before), value.cast("string")]
    return F.concat(*parts, F.lit(rest))


def extra_evidence() -> Column:
    """Of an observed endpoint by itself: a suspicious segment; no authentication seen where it could be."""
    found = suspicious_segment(F.col("path_pattern"))
    no_auth = F.when(F.col("auth_observed") == "No", say("no_auth", F.col("auth_observable_count")))
    return F.array_compact(F.array(F.when(found.isNotNull(), say("suspicious", found)), no_auth))


def raised(severity: Column) -> Column:
    return F.when(severity == "Low", "Medium").otherwise("High")


def observation_window(observed: DataFrame) -> DataFrame:
    return observed.agg(F.min("first_seen").alias("first"), F.max("last_seen").alias("last")).withColumn("seconds", F.coalesce(F.unix_micros("last") - F.unix_micros("first"), F.lit(0)) / 1e6)


def _listed(methods: Column) -> Column:
    return F.array_join(methods, ", ")


def observed_findings(observed: DataFrame, declared: DataFrame) -> DataFrame:
    exact = exact_matches(observed, declared).groupBy(F.col("id").alias("e_id")).agg(F.min("declared_path").alias("exact_path"), F.array_distinct(F.flatten(F.collect_set("declared_methods"))).alias("exact_methods"))
    near = nearest(candidates(observed, declared)).select(F.col("id").alias("n_id"), F.col("declared_path").alias("near_path"), "spans", "divergence", "ties", "candidate_methods")
    rows = observed.join(exact, F.col("id") == F.col("e_id"), "left").join(near, F.col("id") == F.col("n_id"), "left")
    lacking = F.when(F.col("e_id").isNotNull(), F.array_except("methods", "exact_methods")).otherwise(F.array_except("methods", "candidate_methods"))
    rows = rows.withColumn("lacking", F.array_sort(lacking)).withColumn("extra", extra_evidence())
    known = F.col("e_id").isNotNull() & (F.size("lacking") == 0)
    undeclared = F.col("e_id").isNotNull()
    spanning = F.col("spans").isNotNull()
    partial = F.col("n_id").isNotNull()
    exposed = F.when(F.col("auth_observed") == "No", "High").otherwise("Medium")
    direction = F.lit(None).cast("string")
    for key in ("both", "observed_fixed", "observed_variable", "no_line_up"):
        direction = F.when(F.col("divergence") == key, F.lit(EVIDENCE[key])).otherwise(direction)
    partial_evidence = F.array_compact(F.concat(
        F.array(say("closest", F.col("near_path"), direction), F.when(F.col("ties") > 0, say("tie", F.col("ties"))), say("partial_verdict")),
        F.col("extra"),
        F.array(F.when(F.size("lacking") > 0, say("partial_methods", _listed(F.col("lacking"))))),
    ))
    evidence = (
        F.when(known, F.array(say("known", F.col("exact_path"))))
        .when(undeclared, F.array(say("undeclared_method", F.col("exact_path"), _listed(F.col("lacking"))), say("undocumented_operation")))
        .when(spanning, F.concat(F.array(say("spanning", F.col("near_path"), F.col("spans")), say("spanning_unknown"), say("spanning_verdict")), F.col("extra")))
        .when(partial, partial_evidence)
        .otherwise(F.concat(F.array(say("absent")), F.col("extra")))
    )
    severity = F.when(known, "Low").when(undeclared, "High").when(partial & ~spanning & (F.size("lacking") > 0), raised(exposed)).otherwise(exposed)
    return rows.select(
        F.lit("observed").alias("subject_kind"),
        F.col("id").alias("endpoint_id"),
        "path_pattern",
        "methods",
        F.when(known, "Known").when(undeclared | partial, "Undetermined").otherwise("Shadow").alias("classification"),
        F.when(undeclared | ~partial, "High").otherwise("Medium").alias("confidence"),
        (~known & (undeclared | partial)).alias("is_ambiguous"),
        evidence.alias("evidence"),
        severity.alias("severity"),
    )


def declared_findings(observed: DataFrame, declared: DataFrame, staleness_days: int = DEFAULT_STALENESS_DAYS) -> DataFrame:
    """Declared endpoints without an exact match: stale if the log covers the staleness window, else undetermined."""
    window = observation_window(observed).select("seconds")
    rows = declared_unseen(observed, declared).join(F.broadcast(window))
    stale = F.col("seconds") >= staleness_days * 86400
    days = F.floor(F.col("seconds") / 86400).cast("long")
    limit = F.lit(staleness_days)
    return rows.select(
        F.lit("declared").alias("subject_kind"),
        F.lit(None).cast("string").alias("endpoint_id"),
        "path_pattern",
        "methods",
        F.when(stale, "Zombie").otherwise("Undetermined").alias("classification"),
        F.when(stale, "High").otherwise("Low").alias("confidence"),
        (~stale).alias("is_ambiguous"),
        F.when(stale, F.array(say("unseen_long", days, limit))).otherwise(F.array(say("unseen"), say("unseen_short", days, limit))).alias("evidence"),
        F.lit("Low").alias("severity"),
    )


def classify_with_spec(observed: DataFrame, declared: DataFrame, staleness_days: int = DEFAULT_STALENESS_DAYS) -> DataFrame:
    if staleness_days < 0:
        raise ValueError("the staleness window can't be negative")
    return observed_findings(observed, declared).unionByName(declared_findings(observed, declared, staleness_days))


def auth_siblings(observed: DataFrame) -> DataFrame:
    """parent and how many endpoints under it show authentication."""
    return observed.groupBy(parent_prefix(F.col("path_pattern")).alias("parent")).agg(F.count_if(F.col("auth_observed").isin("Yes", "Mixed")).alias("with_auth"))


def classify_without_spec(observed: DataFrame) -> DataFrame:
    """Suspicions only; an endpoint with nothing to say gets no row."""
    siblings = auth_siblings(observed).where("with_auth > 0").withColumnRenamed("parent", "p")
    parent = parent_prefix(F.col("path_pattern"))
    rows = observed.withColumn("parent", parent).join(siblings, F.col("parent") == F.col("p"), "left").withColumn("extra", extra_evidence())
    anomaly = (F.col("auth_observed") == "No") & F.col("with_auth").isNotNull()
    rows = rows.where((F.size("extra") > 0) | anomaly)
    return rows.select(
        F.lit("observed").alias("subject_kind"),
        F.col("id").alias("endpoint_id"),
        "path_pattern",
        "methods",
        F.lit("Undetermined").alias("classification"),
        F.when(anomaly, "Medium").otherwise("Low").alias("confidence"),
        F.lit(True).alias("is_ambiguous"),
        F.array_compact(F.concat("extra", F.array(F.when(anomaly, say("siblings", F.col("with_auth"), F.col("parent"))), say("suspicion")))).alias("evidence"),
        F.when(anomaly, "High").otherwise("Medium").alias("severity"),
    )


def classify(observed: DataFrame, declared: DataFrame | None, staleness_days: int = DEFAULT_STALENESS_DAYS) -> DataFrame:
    return classify_without_spec(observed) if declared is None else classify_with_spec(observed, declared, staleness_days)
