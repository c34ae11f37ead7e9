"""One analysis from log to report: inventory, verdicts, allowlist, manifest, renderings, history and exit status."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight import ruleset as R
from apisight.functions.redact import redact_file, redact_text
from apisight.operators.classify import classify
from apisight.operators.history import History, first_seen_in, pending_alerts, status_counts, target_inventory
from apisight.operators.inventory import inventory_from, observations
from apisight.operators.order import numbered
from apisight.operators.silence import apply_allowlist, broad_rules
from apisight.operators.summaries import auth_label, compliance_rows, grouped_findings, trend, urgency
from apisight.session import cut_lineage
from apisight.sources.access_log import check_format, in_scope, input_digest, parse_lines, range_digests, scan_log, scan_ranges
from apisight.sources.allowlist import read_allowlist
from apisight.sources.grammar import BUILT_IN
from apisight.sources.openapi import read_spec

#: Name of the report's schema.
REPORT_SCHEMA = "apisight-report/1"
TOOL_VERSION = "0.2.0"


@dataclass
class Settings:
    log_format: str = BUILT_IN
    openapi_spec: str | None = None
    staleness_days: int = R.DEFAULT_STALENESS_DAYS
    allowlist_text: str | None = None
    path_prefix: str | None = None
    target: str = "default"
    redaction_enabled: bool = True
    fail_on_undetermined: bool = False
    #: The SHA-256 of whole logs, which one task has to read from end to end, in place of that of their ranges.
    plain_digest: bool = False

    def __post_init__(self):
        if self.staleness_days < 0:
            raise ValueError("the staleness window can't be negative")
        if self.path_prefix is not None and not self.path_prefix.startswith("/"):
            raise ValueError("a path prefix starts with /")


@dataclass
class Analysis:
    inventory: DataFrame
    findings: DataFrame  # with rule_line; null: visible
    counts: dict[str, int]
    by_class: dict[str, int]
    outside_scope: int
    broad: list = field(default_factory=list)
    inputs: list = field(default_factory=list)
    settings: Settings = field(default_factory=Settings)

    @property
    def exit_code(self) -> int:
        """3 if there is something to act on; silenced findings count."""
        confirmed = self.by_class.get("Shadow", 0) + self.by_class.get("Zombie", 0)
        open_ = self.by_class.get("Undetermined", 0) if self.settings.fail_on_undetermined else 0
        return 3 if confirmed + open_ else 0


def analyse(spark: SparkSession, log: str, settings: Settings | None = None) -> Analysis:
    """Distributed up to the endpoints: only counts and digests come to the driver.

    Besides a sample for the format guard the log is read and parsed once: requests are summed up by raw path, the other lines by their reason,
    and each range of bytes comes with its digest.
    """
    s = settings or Settings()
    check_format(parse_lines(scan_log(spark, log), s.log_format))
    scanned = scan_ranges(spark, log).withColumn("value", F.col("value").cast("string"))
    parsed = parse_lines(scanned, s.log_format)
    fine = F.col("discard_reason").isNull()
    outcome = F.when(F.col("range_digest").isNull(), F.coalesce("discard_reason", F.lit("parsed")))
    outside = F.coalesce(fine & ~in_scope(s.path_prefix), F.lit(False))
    keys = ["outcome", "outside", "raw_path", "file", "range_begin", "range_bytes", "range_digest"]
    seen = cut_lineage(parsed.withColumns({"outcome": outcome, "outside": outside}).groupBy(*keys).agg(*observations()))
    counted = seen.where("outcome is not null").groupBy("outcome", "outside").agg(F.sum("observations").alias("lines")).collect()
    counts: dict[str, int] = {}
    for r in counted:
        counts[r.outcome] = counts.get(r.outcome, 0) + r.lines
    inventory = cut_lineage(inventory_from(seen.where("outcome = 'parsed' and not outside").drop(*[k for k in keys if k != "raw_path"])))
    declared = read_spec(spark, s.openapi_spec) if s.openapi_spec else None
    findings = classify(inventory, declared, s.staleness_days)
    rules = read_allowlist(spark, s.allowlist_text) if s.allowlist_text else None
    findings = cut_lineage(apply_allowlist(findings, rules) if rules is not None else findings.withColumn("rule_line", F.lit(None).cast("long")))
    by_class = {r.classification: r["count"] for r in findings.groupBy("classification").count().collect()}
    specs = input_digest(spark, s.openapi_spec).collect() if s.openapi_spec else []
    logs = (input_digest(spark, log) if s.plain_digest else range_digests(seen)).collect()
    digests = [(role, r.path, r.algorithm, r.digest) for role, rows in (("log", logs), ("spec", specs)) for r in rows]
    broad = broad_rules(findings, rules).collect() if rules is not None else []
    return Analysis(inventory, findings, counts, by_class, sum(r.lines for r in counted if r.outside), broad, digests, s)


def _shown(column: str, settings: Settings):
    return redact_text(F.col(column)) if settings.redaction_enabled else F.col(column)


def ordered_findings(a: Analysis) -> DataFrame:
    """Visible findings by urgency and subject, redacted."""
    evidence = F.transform("evidence", redact_text) if a.settings.redaction_enabled else F.col("evidence")
    rows = a.findings.where("rule_line is null").withColumns({"path_pattern": _shown("path_pattern", a.settings), "evidence": evidence})
    return rows.orderBy(urgency(F.col("classification")), "path_pattern", "subject_kind")


def _configuration(spark: SparkSession, settings: Settings) -> dict:
    """Each setting with its source (given or default); texts are masked like those of the report, paths like files."""
    plain = Settings()
    out = {k: {"value": v, "source": "default" if v == getattr(plain, k) else "given"} for k, v in vars(settings).items() if k != "allowlist_text"}
    out["allowlist"] = {"value": settings.allowlist_text is not None, "source": "given" if settings.allowlist_text is not None else "default"}
    if settings.redaction_enabled:
        texts = [(k, x["value"], k == "openapi_spec") for k, x in out.items() if isinstance(x["value"], str)]
        rows = spark.createDataFrame(texts, "k string, v string, is_file boolean")
        for r in rows.select("k", F.when(F.col("is_file"), redact_file(F.col("v"))).otherwise(redact_text(F.col("v"))).alias("v")).collect():
            out[r.k]["value"] = r.v
    return out


def manifest(spark: SparkSession, a: Analysis, timestamp: str) -> dict:
    files = spark.createDataFrame(a.inputs, "role string, path string, algorithm string, digest string")
    shown = files.select("role", (redact_file(F.col("path")) if a.settings.redaction_enabled else F.col("path")).alias("path"), "algorithm", "digest").collect()
    total = sum(a.counts.values())
    return {
        "tool_version": TOOL_VERSION,
        "ruleset_version": R.RULESET_VERSION,
        "run_timestamp": timestamp,
        "inputs": [{"role": r.role, "path": r.path, "algorithm": r.algorithm, "digest": r.digest} for r in shown],
        "counts": {
            "lines_total": total,
            "lines_parsed": a.counts.get("parsed", 0),
            "lines_discarded": total - a.counts.get("parsed", 0),
            "discarded_by_reason": {k: v for k, v in sorted(a.counts.items()) if k != "parsed"},
            "endpoints_found": a.inventory.count(),
            "findings_by_classification": dict(sorted(a.by_class.items())),
        },
        "configuration": _configuration(spark, a.settings),
    }


def report_json(spark: SparkSession, a: Analysis, timestamp: str) -> str:
    """The report of one run: endpoint-sized rows, made into JSON by Spark and joined here."""
    inventory = a.inventory.withColumn("path_pattern", _shown("path_pattern", a.settings)).orderBy("path_pattern", "id")
    auth = F.struct(F.lower("auth_observed").alias("observed"), F.col("auth_observable_count").alias("observable_requests")).alias("auth")
    endpoints = inventory.select(F.to_json(F.struct("id", "path_pattern", "methods", "observation_count", "first_seen", "last_seen", auth)).alias("j"))
    low = lambda c: F.lower(c).alias(c)
    findings = ordered_findings(a).select(F.to_json(F.struct("classification", low("confidence"), low("severity"), "is_ambiguous", "endpoint_id", "path_pattern", "evidence")).alias("j"))
    rows = lambda df: [json.loads(r.j) for r in df.collect()]
    document = {
        "schema": REPORT_SCHEMA,
        "redaction_enabled": a.settings.redaction_enabled,
        "endpoints": rows(endpoints),
        "findings": rows(findings),
        "findings_silenced_by_allowlist": a.findings.where("rule_line is not null").count(),
        "requests_outside_scope": a.outside_scope,
        "manifest": manifest(spark, a, timestamp),
    }
    return json.dumps(document, indent=2, sort_keys=False, ensure_ascii=False)


def _cell(c: Column) -> Column:
    """A value in a Markdown table: its bars escaped, its line breaks made spaces."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), r"\|", r"\\|")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sections(a: Analysis) -> list[tuple[str, list[str], DataFrame]]:
    """Title, headings and rows (position, cells) of the report's tables: groups of findings, findings, endpoints, discarded lines."""
    evidence = F.transform("evidence", redact_text) if a.settings.redaction_enabled else F.col("evidence")
    found = cut_lineage(a.findings.where("rule_line is null").withColumns({"path_pattern": _shown("path_pattern", a.settings), "evidence": evidence}))
    groups = grouped_findings(found)
    some = F.array_join("paths", ", ")
    paths = F.when(F.col("in_detail"), some).otherwise(F.concat(F.lit("for example "), "first_path"))
    cells = lambda *c: F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in c]).alias("cells")
    shown = numbered(a.inventory.withColumn("path_pattern", _shown("path_pattern", a.settings)), "path_pattern", "id")
    listed = numbered(found.withColumn("_urgency", urgency(F.col("classification"))), "_urgency", "path_pattern", "subject_kind")
    lines = [(i, k, v) for i, (k, v) in enumerate(sorted(a.counts.items()) or [("parsed", 0)], 1)]
    discarded = found.sparkSession.createDataFrame(lines, "position long, outcome string, lines long")
    return [
        ("Findings by reason", ["classification", "reason", "members", "endpoints"], groups.select("position", cells(F.col("classification"), F.col("reason"), F.col("members"), paths))),
        ("Findings", ["classification", "severity", "endpoint", "evidence"], listed.select("position", cells(F.col("classification"), F.col("severity"), F.col("path_pattern"), F.array_join("evidence", "; ")))),
        ("Endpoints", ["id", "endpoint", "methods", "requests", "authentication"], shown.select("position", cells(F.col("id"), F.col("path_pattern"), F.array_join("methods", " "), F.col("observation_count"), auth_label(F.col("auth_observed"))))),
        ("Lines", ["outcome", "lines"], discarded.select("position", cells(F.col("outcome"), F.col("lines")))),
    ]


def _lines(spark: SparkSession, parts: list) -> DataFrame:
    """section, position, line of fixed texts and of rows; parts: text, or a DataFrame of position and line."""
    out = None
    for section, part in enumerate(parts):
        rows = spark.createDataFrame([(0, part)], "position long, line string") if isinstance(part, str) else part
        rows = rows.select(F.lit(section).alias("section"), "position", "line")
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("section", "position")


def markdown_lines(a: Analysis) -> DataFrame:
    """The report as Markdown: section, position, line, in order. Spark writes it as text; endpoints and findings stay out of the driver."""
    parts: list = []
    for title, heads, rows in _sections(a):
        bar = lambda cells: "| " + " | ".join(cells) + " |"
        parts += [f"## {title}\n\n{bar(heads)}\n{bar(['-'] * len(heads))}", rows.select("position", F.concat(F.lit("| "), F.array_join(F.transform("cells", _cell), " | "), F.lit(" |")).alias("line")), ""]
    return _lines(a.inventory.sparkSession, parts)


def html_lines(a: Analysis) -> DataFrame:
    """The report as one HTML page: section, position, line, in order."""
    parts: list = ["<!doctype html><meta charset=utf-8><title>Endpoints</title>"]
    for title, heads, rows in _sections(a):
        cells = F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>"))), "")
        parts += [f"<h2>{title}</h2><table><tr>{''.join(f'<th>{h}</th>' for h in heads)}</tr>", rows.select("position", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("line")), "</table>"]
    return _lines(a.inventory.sparkSession, parts)


def write_lines(lines: DataFrame, out: str) -> None:
    """Lines in order, as text files whose names follow that order; a folder is there whole or not at all (its _SUCCESS)."""
    lines.orderBy("section", "position").select("line").write.mode("overwrite").text(out)


def report_markdown(a: Analysis) -> str:
    return "\n".join(r.line for r in markdown_lines(a).collect()) + "\n"


def report_html(a: Analysis) -> str:
    return "\n".join(r.line for r in html_lines(a).collect())


def record_run(a: Analysis, history: History, timestamp: str, manifest_json: str = "{}") -> int:
    """Adds the run to the history, redacted."""
    classes = a.findings.where("subject_kind = 'observed'").select(F.col("endpoint_id").alias("f_id"), "classification")
    seen = a.inventory.join(classes, F.col("id") == F.col("f_id"), "left").drop("f_id").withColumn("path_pattern", _shown("path_pattern", a.settings))
    evidence = F.transform("evidence", redact_text) if a.settings.redaction_enabled else F.col("evidence")
    findings = a.findings.withColumn("path_pattern", _shown("path_pattern", a.settings)).withColumn("evidence", evidence)
    return history.record(a.settings.target, timestamp, seen, findings, R.RULESET_VERSION, "apisight", manifest_json)


def write_compliance(history: History, target: str, out: str, form: str = "csv") -> None:
    """A target's endpoints sorted by pattern and id, under a folder that Spark writes: csv (quotes doubled), json (a line each) or markdown."""
    rows = compliance_rows(history.endpoints().where(F.col("target") == target))
    if form == "markdown":
        rows = numbered(rows, "path_pattern", "endpoint_id")
    else:
        rows = rows.orderBy("path_pattern", "endpoint_id")
    if form == "csv":
        rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(out)
    elif form == "json":
        rows.write.json(out)
    elif form == "markdown":
        heads = rows.columns[:-1]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in heads]), F.lit(" |"))
        top = f"| {' | '.join(heads)} |\n|{'-|' * len(heads)}"
        write_lines(_lines(history.spark, [top, rows.select("position", line.alias("line"))]), out)
    else:
        raise ValueError(f"unknown form {form!r}")


def status_view(history: History, target: str) -> dict[str, DataFrame]:
    """What a status page shows of a target, as tables: its numbers, endpoints, pending alerts, those new in the last run, and the trend."""
    last = history.last_run(target)
    endpoints, runs = history.endpoints(), history.runs()
    of = endpoints.where(F.col("target") == target)
    return {
        "numbers": status_counts(runs, endpoints).where(F.col("target") == target),
        "inventory": target_inventory(endpoints, target).orderBy("path_pattern", "endpoint_id"),
        "pending": pending_alerts(of).orderBy("path_pattern", "endpoint_id"),
        "new": first_seen_in(endpoints, target, last.id if last else 0).orderBy("path_pattern", "endpoint_id"),
        "trend": trend(runs, target).orderBy("id"),
    }


__all__ = ["Analysis", "Settings", "analyse", "html_lines", "manifest", "markdown_lines", "ordered_findings", "record_run", "report_html", "report_json", "report_markdown", "status_view", "write_compliance", "write_lines"]
