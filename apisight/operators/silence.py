"""Allowlist rules on findings: silenced findings leave the view, not the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apisight.ruleset import BROAD_MAX_SILENCED, BROAD_MIN_LITERAL_SEGMENTS


def apply_allowlist(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with rule_line: the first rule of the file that fits, null for a visible finding.

    rules: line_number, kind, value. `endpoint` rules fit an observed endpoint's id; `pattern` rules a whole path, or what it starts with
    before a final *. All three are equi-joins: a path meets the prefix rules by its own beginnings of the lengths that such rules have.
    """
    key = F.xxhash64("subject_kind", F.coalesce("endpoint_id", F.lit("")), "path_pattern")
    findings = findings.withColumn("_key", key)
    ids = rules.where("kind = 'endpoint'").select(F.col("value").alias("v"), "line_number")
    paths = rules.where("kind = 'pattern' and not endswith(value, '*')").select(F.col("value").alias("v"), "line_number")
    prefixes = rules.where("kind = 'pattern' and endswith(value, '*')").select(F.regexp_replace("value", r"\*\z", "").alias("v"), "line_number")
    lengths = sorted(r.n for r in prefixes.select(F.length("v").alias("n")).distinct().collect())  # as many as the longest path has characters
    beginnings = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path_pattern")), lambda n: F.left(F.col("path_pattern"), n))
    subjects = findings.select("_key", "subject_kind", "endpoint_id", "path_pattern")
    hits = (
        subjects.where("subject_kind = 'observed'").join(ids, F.col("endpoint_id") == F.col("v")).select("_key", "line_number")
        .union(subjects.join(paths, F.col("path_pattern") == F.col("v")).select("_key", "line_number"))
        .union(subjects.select("_key", F.explode(beginnings).alias("_start")).join(prefixes, F.col("_start") == F.col("v")).select("_key", "line_number"))
    )
    first = hits.groupBy(F.col("_key").alias("_k")).agg(F.min("line_number").alias("rule_line"))
    return findings.join(first, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")


def broad_rules(applied: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that silence much, or could: over BROAD_MAX_SILENCED findings, or a prefix of under BROAD_MIN_LITERAL_SEGMENTS segments."""
    counts = applied.where("rule_line is not null").groupBy(F.col("rule_line").alias("n_line")).agg(F.count(F.lit(1)).alias("silenced"))
    rows = rules.join(counts, F.col("line_number") == F.col("n_line"), "left").withColumn("silenced", F.coalesce("silenced", F.lit(0)))
    segments = F.size(F.filter(F.split(F.regexp_replace("value", r"\*\z", ""), "/"), lambda s: s != ""))
    broad = (F.col("kind") == "pattern") & F.endswith("value", F.lit("*")) & (segments < BROAD_MIN_LITERAL_SEGMENTS)
    return rows.where(broad | (F.col("silenced") > BROAD_MAX_SILENCED)).select("line_number", "kind", "value", "silenced")
