"""One query for each operator, over data derived from the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight.functions import paths as P
from apisight.functions.redact import redact_text
from apisight.operators import classify as C
from apisight.operators import history as H
from apisight.operators import inventory as I
from apisight.operators import match as M
from apisight.operators import silence as A
from apisight.operators import summaries as S
from apisight.operators.order import numbered
from apisight.plans import derived as D
from apisight.session import cut_lineage, shared_dir
from apisight.sources import access_log as L
from apisight.sources.allowlist import parse_allowlists
from apisight.sources.openapi import parse_specs
from apisight.streaming.tail import Watch

TARGET = "shop"


def _csv(column: str):
    return F.array_join(F.array_sort(column), ",").alias(column)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # endpoint-sized, and read several times by what follows
    return cut_lineage(I.observed_inventory(D.derived_requests(spark, sf_dir)))


def _three_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(I.observed_inventory(D.three_state_requests(spark, sf_dir)))


def _inventory_rows(inventory: DataFrame) -> DataFrame:
    return inventory.select("id", "path_pattern", _csv("methods"), F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "observation_count", "auth_observed", "auth_observable_count")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(C.classify_with_spec(_observed(spark, sf_dir), D.declared(spark)))


def _finding_rows(f: DataFrame) -> DataFrame:
    return f.select("subject_kind", "path_pattern", "classification", "confidence", "is_ambiguous", F.array_join("evidence", "|").alias("evidence"), "severity")


# ---- scan and parsing


def scan_log(spark, d):
    """The derived log written as files and scanned again: lines end at \\n alone, and keep a \\r and broken bytes."""
    at = f"{shared_dir(spark)}/apisight-log-{uuid.uuid4().hex}"
    D.derived_log(spark, d).select("value").write.option("lineSep", "\n").text(at)
    return L.scan_log(spark, at).select(F.octet_length("value").alias("bytes"), F.md5(F.col("value").cast("binary")).alias("line_md5"))


def parse_combined(spark, d):
    r = L.parse_lines(D.derived_log(spark, d)).where("discard_reason is null")
    return r.select("event_id", "method", "raw_path", F.col("auth.state").alias("auth"), F.col("status_code").cast("int").alias("status_code"), F.unix_seconds("ts").alias("ts"))


def parse_declared(spark, d):
    """The same requests in a declared grammar: time first and split fields."""
    f = D.derived_fields(spark, d)
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), F.when(F.col("event_id") % 23 == 0, F.lit("-")).otherwise(F.col("method")), F.lit(" "), "path", F.lit("  "), "status", F.lit(" u="), F.when(F.col("remote_user") == "-", "").otherwise(F.col("remote_user")), F.lit(";"))
    r = L.parse_lines(f.select("event_id", line.alias("value")), "[$time_iso8601] $request_method $uri $status u=$remote_user;")
    return r.select("event_id", "method", "raw_path", F.col("auth.state").alias("auth"), F.col("status_code").cast("int").alias("status_code"), F.unix_seconds("ts").alias("ts"), "discard_reason")


def discard_reasons(spark, d):
    return L.ingest_counts(L.parse_lines(D.derived_log(spark, d)))


def scope_filter(spark, d):
    inside = L.in_scope("/api/v1/users")
    return D.derived_requests(spark, d).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def request_line(spark, d):
    f = D.derived_fields(spark, d)
    text = F.concat_ws(" ", "method", F.when(F.col("event_id") % 5 == 0, F.lit("two words")).otherwise(F.col("path")), F.when(F.col("event_id") % 11 == 0, "FTP/1").otherwise("HTTP/1.1"))
    method, target = L.request_line(text)
    return f.select("event_id", method.alias("method"), target.alias("target"))


def path_query(spark, d):
    path, query = L.path_and_query(F.col("url"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", path.alias("path"), query.alias("query"))


def query_params(spark, d):
    r = D.derived_requests(spark, d).where("size(query_params) > 0")
    return r.select(F.explode("query_params").alias("name", "values")).groupBy("name", F.array_join("values", ",").alias("vals")).agg(F.count(F.lit(1)).alias("times"))


def auth_infer(spark, d):
    return D.derived_fields(spark, d).select(L.infer_auth(F.col("remote_user")).alias("a")).groupBy(F.col("a.state").alias("state"), F.col("a.scheme").alias("scheme")).agg(F.count(F.lit(1)).alias("requests"))


def parse_time(spark, d):
    """Local and RFC 3339 times of the events, some broken, as epoch seconds."""
    e = spark.read.parquet(f"{d}/events.parquet")
    bad = F.col("event_id") % 13 == 0
    local = F.when(bad, "2024-01-01").otherwise(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0200"))
    iso = F.when(bad, "2024-01-01").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+02:00"))
    return e.select("event_id", F.unix_seconds(L.parse_local_time(local)).alias("local_s"), F.unix_seconds(L.parse_rfc3339(iso)).alias("iso_s"))


# ---- paths


def canonical_path(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ("", "/%41%2f", "/%252e", "/{x}", "/a%20b/", "/%zz%ff"))), (F.col("page_id") % 6 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), tail)
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", P.join_segments(P.canonical_segments(path)).alias("canonical"))


def id_like(spark, d):
    e = D.derived_fields(spark, d).select(F.explode(F.split("path", "/")).alias("segment")).union(spark.read.parquet(f"{d}/events.parquet").select(F.substring(F.md5(F.col("event_id").cast("string")), 1, 20 + 4 * (F.col("event_id") % 4).cast("int"))))
    return e.groupBy("segment", P.is_id_like(F.col("segment")).alias("id_like")).agg(F.count(F.lit(1)).alias("times"))


def endpoint_id(spark, d):
    return D.derived_fields(spark, d).select(F.col("path").alias("pattern")).distinct().select("pattern", P.endpoint_id(F.col("pattern")).alias("id"), P.parent_prefix(F.col("pattern")).alias("parent"))


def suspicious(spark, d):
    return D.derived_fields(spark, d).select(F.col("path").alias("pattern")).distinct().select("pattern", P.suspicious_segment(F.col("pattern")).alias("segment"))


def segment_types(spark, d):
    """Of each endpoint the shape, with a star for a variable segment, and how many declared paths have it."""
    shown = lambda s: F.array_join(F.transform(s, lambda x: F.coalesce(x, F.lit("*"))), "/")
    shapes = D.declared(spark).select(shown(P.declared_segments(F.col("path_pattern"))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    rows = _observed(spark, d).select("path_pattern", shown(P.observed_segments(F.col("path_pattern"))).alias("shape"))
    return rows.join(shapes, F.col("shape") == F.col("s"), "left").select("path_pattern", "shape", F.coalesce("n", F.lit(0)).alias("declared"))


# ---- inventory


def normalize_paths(spark, d):
    return I.observed_inventory(D.derived_requests(spark, d)).select("path_pattern", "observation_count")


def path_observations(spark, d):
    r = I.path_observations(D.derived_requests(spark, d))
    return r.select("raw_path", _csv("methods"), "observations", F.unix_seconds("first_seen").alias("first_seen"), F.unix_seconds("last_seen").alias("last_seen"), "auth_observable", "auth_present")


def auth_verdict(spark, d):
    return _three_state(spark, d).select("path_pattern", "auth_observed", "auth_observable_count")


def observed_inventory(spark, d):
    return _inventory_rows(_observed(spark, d))


def declared_merge(spark, d):
    rows = D.derived_fields(spark, d).select(F.concat(F.lit("/v"), (F.col("event_id") % 9).cast("string")).alias("path_pattern"), F.array("method").alias("methods"), F.array("status").alias("declared_auth_schemes"))
    return I.merge_declared(rows).select("path_pattern", _csv("methods"), _csv("declared_auth_schemes"))


def obs_window(spark, d):
    return C.observation_window(_observed(spark, d)).select(F.unix_seconds("first").alias("first"), F.unix_seconds("last").alias("last"))


# ---- matching and verdicts


def exact_match(spark, d):
    return M.exact_matches(_observed(spark, d), D.declared(spark)).select("path_pattern", "declared_path")


def partial_match(spark, d):
    return M.partial_matches(_observed(spark, d), D.declared(spark)).select("path_pattern", "declared_path")


def spanning_match(spark, d):
    return M.spanning_matches(_observed(spark, d), D.declared(spark)).select("path_pattern", "declared_path", "spans")


def match_distance(spark, d):
    return M.candidates(_observed(spark, d), D.declared(spark)).select("path_pattern", "declared_path", F.col("distance.mismatches").alias("mismatches"), F.col("distance.tail").alias("tail"))


def divergence(spark, d):
    return M.candidates(_observed(spark, d), D.declared(spark)).select("path_pattern", "declared_path", "divergence")


def nearest_declared(spark, d):
    observed = _observed(spark, d)
    near = M.nearest(M.candidates(observed, D.declared(spark)))
    return near.select("id", "declared_path", "ties", _csv("candidate_methods"))


def undeclared_methods(spark, d):
    """The methods that no declared path like the endpoint's has."""
    f = _findings(spark, d).where("classification = 'Undetermined' and subject_kind = 'observed'").select("path_pattern", "severity", F.explode("evidence").alias("e"))
    return f.where("e like '%method(s)%'").select("path_pattern", "severity", F.regexp_extract("e", r"method\(s\) ([A-Z, ]+) were", 1).alias("methods"))


def _full_findings(spark, d):
    return cut_lineage(C.classify_with_spec(_three_state(spark, d), D.declared(spark, D.FULL_DECLARED)))


def classify_full(spark, d):
    """Requests of 45 days more, with undeclared, tied and unprotected paths: all four verdicts."""
    return _finding_rows(_full_findings(spark, d))


def nearest_full(spark, d):
    near = M.nearest(M.candidates(_three_state(spark, d), D.declared(spark, D.FULL_DECLARED)))
    return near.select("id", "declared_path", "ties", _csv("candidate_methods"))


def allowlist_full(spark, d):
    return A.apply_allowlist(_full_findings(spark, d), D.rules(spark, D.FULL_RULES)).select("subject_kind", "path_pattern", "rule_line", F.col("rule_line").isNull().alias("visible"))


def finding_mix(spark, d):
    return S.finding_mix(_full_findings(spark, d))


def evidence_histogram(spark, d):
    return S.evidence_histogram(_full_findings(spark, d))


def redacted_share(spark, d):
    """Of the raw paths with a session key put behind every third one."""
    raw = D.derived_fields(spark, d).select(F.when(F.col("event_id") % 3 == 0, F.concat("path", F.lit("/"), F.md5("path"))).otherwise(F.col("path")).alias("path_pattern"))
    return S.redacted_share(raw.distinct())


def declared_inventory(spark, d):
    rows = parse_specs(D.derived_specs(spark, d), "user_id")
    return rows.select("user_id", "path_pattern", _csv("methods"), _csv("declared_auth_schemes"))


def allowlist_parse(spark, d):
    return parse_allowlists(D.derived_allowlists(spark, d), "user_id")


def declared_unseen(spark, d):
    return M.declared_unseen(_observed(spark, d), D.declared(spark)).select("path_pattern")


def classify_spec(spark, d):
    return _finding_rows(_findings(spark, d))


def classify_heuristic(spark, d):
    return _finding_rows(C.classify_without_spec(_three_state(spark, d)))


def auth_siblings(spark, d):
    return C.auth_siblings(_three_state(spark, d))


def finding_counts(spark, d):
    return S.finding_counts(_findings(spark, d))


def grouped_findings(spark, d):
    return S.whole_groups(_full_findings(spark, d))


def group_members(spark, d):
    return S.group_members(_full_findings(spark, d))


def endpoint_positions(spark, d):
    """The endpoints' places in a report: by pattern, then id."""
    return numbered(_three_state(spark, d).select("path_pattern", "id"), "path_pattern", "id")


def allowlist_apply(spark, d):
    return A.apply_allowlist(_findings(spark, d), D.rules(spark)).select("subject_kind", "path_pattern", "rule_line")


def broad_rules(spark, d):
    return A.broad_rules(A.apply_allowlist(_findings(spark, d), D.rules(spark)), D.rules(spark))


# ---- redaction

_SECRETS = "concat(text, ' mail=a', doc_id, '@x.org token=abc', doc_id, '.', ' jwt abcd', doc_id, '.efgh.ijkl page=2 /p/', md5(cast(doc_id as string)), '/q. a%2F', md5('x'), '%2Fb')"


def redact_documents(spark, d):
    """Whole texts of the documents, with an address, a named token, a JWT, an escaped key and an opaque one added to each."""
    text = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_SECRETS).alias("text"))
    text = text.select("doc_id", redact_text(F.col("text")).alias("redacted"))
    return text.select("doc_id", F.length("redacted").alias("chars"), F.md5("redacted").alias("redacted_md5"), F.substring_index("redacted", " page=2 ", -1).alias("ends"))


def redact_email(spark, d):
    e = D.derived_fields(spark, d)
    word = F.concat(F.element_at(F.array(*map(F.lit, ("u", "", "u@v"))), (F.col("event_id") % 3 + 1).cast("int")), F.lit("@"), F.element_at(F.array(*map(F.lit, ("x.org", ".org", "host", "a.b"))), (F.col("event_id") % 4 + 1).cast("int")))
    return e.select(word.alias("word")).groupBy("word", redact_text(F.col("word")).alias("redacted")).agg(F.count(F.lit(1)).alias("times"))


# ---- history and views


def _seen(spark, d, odd: int):
    """Endpoints of a run: users with a kind of event and a digit, seen in the events with even (0) or odd (1) ids. u: user_id."""
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_id") % 2 == odd)
    name = F.concat(F.lit("e"), "user_id", F.lit("-"), "event_type", F.lit("-"), F.regexp_extract("props", "([0-9])[^0-9]*$", 1))
    return e.groupBy(name.alias("id")).agg(F.count(F.lit(1)).alias("observation_count"), F.min("user_id").alias("u"))


def _old_endpoints(spark, d):
    """A history after run 1, of the events with even ids; the endpoints of users with even numbers are acknowledged."""
    return _seen(spark, d, 0).withColumnRenamed("id", "endpoint_id").select(
        F.lit(TARGET).alias("target"), "endpoint_id", F.concat(F.lit("/old/"), "endpoint_id").alias("path_pattern"), F.lit(1).cast("long").alias("first_seen_run"), F.lit(1).cast("long").alias("last_seen_run"),
        F.when(F.col("u") % 3 == 0, "Shadow").when(F.col("u") % 3 == 1, "Known").alias("last_classification"), (F.col("u") % 2 == 0).alias("acknowledged"), (F.col("u") % 3 == 0).alias("alerted"),
        F.array(F.lit("GET")).alias("methods"), "observation_count", F.lit("no").alias("auth_observed"), F.lit(None).cast("long").alias("auth_observable_count"),
    )


def _seen_now(spark, d):
    """Run 2, of the events with odd ids."""
    return _seen(spark, d, 1).select("id", F.concat(F.lit("/new/"), "id").alias("path_pattern"), F.array(F.lit("POST")).alias("methods"), "observation_count", F.lit("yes").alias("auth_observed"), F.col("observation_count").alias("auth_observable_count"), F.when(F.col("u") % 4 == 0, "Shadow").when(F.col("u") % 4 == 1, "Undetermined").alias("classification"))


def _after(spark, d):
    return H.upsert_endpoints(_old_endpoints(spark, d), _seen_now(spark, d), TARGET, 2)


def history_upsert(spark, d):
    return _after(spark, d).withColumn("methods", F.array_join("methods", ","))


def new_endpoints(spark, d):
    return H.new_endpoints(_old_endpoints(spark, d), _seen_now(spark, d), TARGET).select("id", "path_pattern")


def pending_alerts(spark, d):
    return H.pending_alerts(_after(spark, d)).select("endpoint_id", "path_pattern")


def first_seen_in(spark, d):
    return H.first_seen_in(_after(spark, d), TARGET, 2).select("endpoint_id")


def _runs(spark, d):
    """Every event as a run; the clock of some was a day behind."""
    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.when(F.col("event_id") % 97 == 0, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("target"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("run_timestamp"), F.col("user_id").alias("endpoints"))


def run_numbers(spark, d):
    """Every event as a run with a manifest of an analysis or of a cycle, a broken one, an empty one or none."""
    e = D.derived_fields(spark, d).join(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"), "event_id")
    n, text = F.col("event_id"), lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    analysis = text('{"tool_version": "x", "counts": {"lines_total": ', n + 10, ', "lines_parsed": ', n, ', "lines_discarded": 10, "endpoints_found": ', F.col("user_id"), ', "findings_by_classification": {"Shadow": ', n % 7, ', "Known": 2}}, "new": [1]}')
    cycle = text('{"batch": 1, "lines": {"parsed": ', n, ', "blank-line": 3}, "endpoints_found": ', F.col("user_id"), ', "findings_by_classification": {"Zombie": ', n % 3, "}}")
    broken = text('{"counts": {"lines_total": ', n)
    given = F.element_at(F.array(analysis, cycle, broken, F.lit("{}"), F.lit(None)), (n % 5 + 1).cast("int"))
    return H.run_numbers(e.select(n.alias("id"), F.lit(TARGET).alias("target"), F.lit(-1).cast("long").alias("endpoints"), given.alias("manifest_json")))


def clock_backwards(spark, d):
    return H.clock_backwards(_runs(spark, d)).select("id", "target", "went_back")


def trend(spark, d):
    return S.trend(_runs(spark, d), "t1")


def class_summary(spark, d):
    return S.class_summary(_after(spark, d))


def auth_summary(spark, d):
    return S.auth_summary(_after(spark, d))


def compliance_rows(spark, d):
    return S.compliance_rows(_after(spark, d))


def noise_metrics(spark, d):
    return S.noise_metrics(_observed(spark, d), _findings(spark, d), L.ingest_counts(L.parse_lines(D.derived_log(spark, d))))


def literal_children(spark, d):
    e = D.derived_fields(spark, d)
    return S.literal_children(e.select(F.concat(F.lit("/w/x"), F.col("event_id") % 3, F.lit("/v"), F.col("event_id") % 50).alias("path_pattern")).distinct())


def swallowed_words(spark, d):
    return S.swallowed_words(D.derived_requests(spark, d).select("raw_path"), _observed(spark, d).where("path_pattern not like '%/users/%'"))


def match_pairs(spark, d):
    """Every observed and declared pair that matches in some way, with the way."""
    o, declared = _observed(spark, d), D.declared(spark)
    kinds = [("exact", M.exact_matches), ("partial", M.partial_matches), ("spanning", M.spanning_matches)]
    parts = [f(o, declared).select("path_pattern", "declared_path", F.lit(k).alias("match")) for k, f in kinds]
    return parts[0].union(parts[1]).union(parts[2])


def format_guard(spark, d):
    """The log is accepted: the lines that are not blank, and how many of them parse."""
    parsed = L.parse_lines(D.derived_log(spark, d))
    L.check_format(parsed)
    shown = parsed.where(~F.coalesce(F.col("discard_reason") == "blank-line", F.lit(False)))
    return shown.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("discard_reason").isNull()).alias("fit"))


def run_counts(spark, d):
    """The counts of a run's manifest."""
    counts = L.ingest_counts(L.parse_lines(D.derived_log(spark, d)))
    by = S.finding_counts(_findings(spark, d))
    lines = counts.select(F.concat(F.lit("lines "), "outcome").alias("what"), F.col("lines").alias("number"))
    return lines.union(by.select(F.concat(F.lit("findings "), "classification"), "findings")).union(_observed(spark, d).agg(F.lit("endpoints"), F.count(F.lit(1))))


def labels(spark, d):
    rows = _after(spark, d)
    return rows.groupBy(S.auth_label(F.col("auth_observed")).alias("auth"), S.classification_label(F.col("last_classification")).alias("class")).agg(F.count(F.lit(1)).alias("endpoints"))


def history_inventory(spark, d):
    return H.target_inventory(_after(spark, d), TARGET)


def history_targets(spark, d):
    return H.targets(_runs(spark, d))


def status_counts(spark, d):
    """The status view's numbers of each target."""
    return H.status_counts(_runs(spark, d).withColumn("target", F.lit(TARGET)), _after(spark, d))


def stream_inventory(spark, d):
    """The log in six micro-batches, some of them twice: the inventory is that of a single run."""
    watch = Watch(spark, f"{shared_dir(spark)}/apisight-watch-{uuid.uuid4().hex}")
    lines = D.derived_log(spark, d).withColumn("epoch", F.lit(0).cast("long"))
    for i in (0, 1, 1, 2, 3, 2, 4, 5, 5):
        watch.update(lines.where(F.col("event_id") % 6 == i).drop("event_id"), i)
    return _inventory_rows(watch.inventory())


def stratified_sample(spark, d):
    rows = D.derived_fields(spark, d).select(F.col("method").alias("classification"), F.lit("observed").alias("subject_kind"), F.col("path").alias("path_pattern")).distinct()
    return S.stratified_sample(rows, ["classification"], 6).select("classification", "path_pattern", "nth")


QUERIES = {
    f.__name__: f
    for f in (
        scan_log, parse_combined, parse_declared, discard_reasons, scope_filter, request_line, path_query, query_params, auth_infer, parse_time, canonical_path, id_like, endpoint_id, suspicious,
        segment_types, normalize_paths, path_observations, auth_verdict, observed_inventory, declared_merge, obs_window, exact_match, partial_match, spanning_match, match_distance, divergence,
        nearest_declared, undeclared_methods, classify_full, nearest_full, allowlist_full, finding_mix, evidence_histogram, redacted_share, declared_inventory, allowlist_parse, status_counts, declared_unseen, classify_spec, classify_heuristic, auth_siblings, finding_counts, grouped_findings, group_members, endpoint_positions, allowlist_apply, broad_rules, redact_documents,
        redact_email, history_upsert, new_endpoints, pending_alerts, first_seen_in, run_numbers, clock_backwards, trend, class_summary, auth_summary, compliance_rows, noise_metrics, literal_children,
        swallowed_words, stratified_sample, match_pairs, format_guard, run_counts, labels, history_inventory, history_targets, stream_inventory,
    )
}
