"""What the queries give, in DuckDB's SQL. It starts from the events, not from log lines, so that parsing is tested as well."""

from __future__ import annotations

from apisight.plans.derived import DECLARED, FULL_DECLARED, FULL_RULES, RULES
from apisight.plans.queries import TARGET
from apisight.ruleset import EVIDENCE, SENSITIVE_FIELD_NAMES

_EVENTS = """
 ev AS (SELECT event_id, ts, user_id, event_type, regexp_extract(props, '[0-9]+') AS k,
   CASE WHEN event_id % 4 = 0 THEN 'u' || user_id ELSE '-' END AS remote_user,
   CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' END AS method,
   CASE event_type WHEN 'signup' THEN 201 WHEN 'error' THEN 500 ELSE 200 END AS status,
   CASE event_id % 7 WHEN 0 THEN '/api/v1/orders/' || event_id || '/items/' || regexp_extract(props, '[0-9]+') WHEN 1 THEN '/api/v1/debug/errors/' || regexp_extract(props, '[0-9]+')
     WHEN 2 THEN '/api/v1/users/me' ELSE '/api/v1/users/' || user_id || '/' || event_type END AS path
   FROM events),
 rs AS (SELECT *, CASE WHEN event_id % 107 <> 0 AND event_id % 127 = 0 THEN 'line-too-long' WHEN event_id % 107 <> 0 AND event_id % 113 = 0 THEN 'invalid-utf8' WHEN event_id % 107 = 0 THEN 'blank-line'
   WHEN event_id % 109 = 0 OR (event_id % 139 = 0 AND event_id % 97 <> 0) THEN 'malformed-line' WHEN event_id % 101 = 0 THEN 'invalid-status-code'
   WHEN event_id % 103 = 0 OR event_id % 202 = 0 THEN 'invalid-timestamp' WHEN event_id % 131 = 0 THEN 'invalid-request-line' END AS reason,
   CASE WHEN remote_user = '-' THEN 'NotObservable' ELSE 'Present' END AS state FROM ev),
 rq AS (SELECT * FROM rs WHERE reason IS NULL),
 tp AS (SELECT * REPLACE (CASE WHEN event_id % 17 = 3 THEN '/admin/export' WHEN event_id % 17 = 4 THEN '/shop/main/items' ELSE path END AS path,
   CASE WHEN event_id % 19 = 0 THEN ts + INTERVAL 45 DAY ELSE ts END AS ts) FROM ev),
 ts3 AS (SELECT *, CASE WHEN event_id % 7 = 1 OR path LIKE '/admin%' THEN 'Absent' WHEN path LIKE '%/view' THEN 'Present' WHEN path LIKE '%/click' THEN CASE WHEN event_id % 2 = 0 THEN 'Present' ELSE 'Absent' END
   WHEN path LIKE '%/signup' THEN 'Absent' ELSE 'NotObservable' END AS state3 FROM tp)"""


def _inventory(source: str, state: str, name: str) -> str:
    """Endpoints of a request table: the levels of the derived paths are 4, 5 and 6."""
    out = f"{name}0 AS (SELECT *, string_split(path, '/')[2:] AS s FROM {source})"
    for i, d in enumerate((4, 5, 6)):
        out += f""",
 {name}v{d} AS (SELECT s[1:{d - 1}] AS p FROM {name}{i} WHERE regexp_full_match(s[{d}], '[0-9]+') GROUP BY 1 HAVING count(DISTINCT s[{d}]) >= 3),
 {name}{i + 1} AS (SELECT a.* EXCLUDE (s), CASE WHEN v.p IS NOT NULL AND regexp_full_match(s[{d}], '[0-9]+') THEN list_concat(s[1:{d - 1}], ['{{id}}'], s[{d + 1}:]) ELSE s END AS s
   FROM {name}{i} a LEFT JOIN {name}v{d} v ON a.s[1:{d - 1}] = v.p)"""
    return (
        out
        + f""",
 {name} AS (SELECT '/' || list_aggregate(s, 'string_agg', '/') AS path_pattern, list_sort(list(DISTINCT method)) AS methods, epoch(min(ts))::BIGINT AS first_seen, epoch(max(ts))::BIGINT AS last_seen,
   min(ts) AS t0, max(ts) AS t1, count(*) AS n, count(*) FILTER ({state} <> 'NotObservable') AS obs, count(*) FILTER ({state} = 'Present') AS pre FROM {name}3 GROUP BY 1),
 {name}x AS (SELECT *, substr(sha256(path_pattern), 1, 16) AS id, CASE WHEN obs = 0 THEN 'NotObservable' WHEN pre = obs THEN 'Yes' WHEN pre = 0 THEN 'No' ELSE 'Mixed' END AS auth,
   regexp_replace(path_pattern, '/[^/]*$', '') AS parent FROM {name})"""
    )


def _values(rows, columns: str, name: str) -> str:
    show = lambda v: "[" + ", ".join(map(show, v)) + "]::VARCHAR[]" if isinstance(v, list) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


_O = _inventory("rq", "state", "ob")
_T = _inventory("ts3", "state3", "th")
_D = _values(DECLARED, "declared_path, dm, ds", "de")
_R = _values(RULES, "line_number, kind, value", "ru")

_PAIRS = """
 typed AS (SELECT o.*, d.*, list_transform(string_split(o.path_pattern, '/')[2:], lambda x: CASE WHEN x = '{id}' THEN '*' ELSE x END) AS os,
   list_transform(string_split(d.declared_path, '/')[2:], lambda x: CASE WHEN x LIKE '{_%}' THEN '*' ELSE x END) AS dd FROM obx o, de d),
 cmp AS (SELECT *, len(os) AS ol, len(dd) AS dl, least(len(os), len(dd)) AS common FROM typed),
 dist AS (SELECT *, list_transform(range(1, common + 1), lambda i: os[i] <> dd[i]) AS diff,
   len(list_filter(range(1, common + 1), lambda i: os[i] <> dd[i] AND os[i] <> '*' AND dd[i] <> '*')) AS conflicts,
   len(list_filter(range(1, common), lambda i: os[i] <> dd[i] AND os[i] <> '*' AND dd[i] <> '*')) AS head_conflicts,
   len(list_filter(range(1, common + 1), lambda i: os[i] <> '*' AND dd[i] = '*')) > 0 AS fixed,
   len(list_filter(range(1, common + 1), lambda i: os[i] = '*' AND dd[i] <> '*')) > 0 AS variable FROM cmp),
 kinds AS (SELECT *, CASE WHEN ol = dl AND os = dd THEN 'exact' WHEN ol = dl AND conflicts = 0 THEN 'partial' WHEN ol > dl AND dd[dl] = '*' AND head_conflicts = 0 THEN 'spanning' END AS match,
   len(list_filter(diff, lambda x: x)) + greatest(ol - dl, 0) AS mismatches, CASE WHEN list_position(diff, true) > 0 THEN ol - list_position(diff, true) + 1 ELSE 0 END AS tail,
   CASE WHEN fixed AND variable THEN 'both' WHEN fixed THEN 'observed_fixed' WHEN variable THEN 'observed_variable' ELSE 'no_line_up' END AS divergence FROM dist),
 cands AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mismatches, tail, declared_path) AS nth, count(*) OVER (PARTITION BY id, mismatches, tail) - 1 AS ties FROM kinds WHERE match IN ('partial', 'spanning')),
 near AS (SELECT c.id AS nid, c.declared_path AS near_path, c.match, c.ol - c.dl + 1 AS spans, c.divergence, c.ties, m.cm FROM cands c
   JOIN (SELECT id, list_sort(list_distinct(flatten(list(dm)))) AS cm FROM cands GROUP BY id) m ON c.id = m.id WHERE nth = 1),
 exact AS (SELECT id AS eid, min(declared_path) AS exact_path, list_distinct(flatten(list(dm))) AS em FROM kinds WHERE match = 'exact' GROUP BY id)"""


def _say(key: str, *values: str) -> str:
    text = "'" + EVIDENCE[key].replace("'", "''") + "'"
    for i, v in enumerate(values):
        text = text.replace(f"{{{i}}}", f"' || {v} || '")
    return f"({text})"


_EXTRA = f"""CASE WHEN list_contains(string_split(path_pattern, '/'), 'debug') THEN '|' || {_say("suspicious", "'debug'")} ELSE '' END || CASE WHEN auth = 'No' THEN '|' || {_say("no_auth", "obs")} ELSE '' END"""
_DIVERGES = "CASE divergence " + " ".join(f"WHEN '{k}' THEN '{EVIDENCE[k]}'" for k in ("both", "observed_fixed", "observed_variable", "no_line_up")) + " END"

_FINDINGS = f"""
 jd AS (SELECT *, list_sort(list_filter(methods, lambda m: NOT list_contains(CASE WHEN eid IS NOT NULL THEN em ELSE cm END, m))) AS lacking, {_EXTRA} AS extra
   FROM obx LEFT JOIN exact ON id = eid LEFT JOIN near ON id = nid),
 ofi AS (SELECT 'observed' AS subject_kind, path_pattern, id,
   CASE WHEN eid IS NOT NULL AND len(lacking) = 0 THEN 'Known' WHEN eid IS NOT NULL OR nid IS NOT NULL THEN 'Undetermined' ELSE 'Shadow' END AS classification,
   CASE WHEN eid IS NOT NULL OR nid IS NULL THEN 'High' ELSE 'Medium' END AS confidence,
   NOT (eid IS NOT NULL AND len(lacking) = 0) AND (eid IS NOT NULL OR nid IS NOT NULL) AS is_ambiguous,
   CASE WHEN eid IS NOT NULL AND len(lacking) = 0 THEN {_say("known", "exact_path")}
     WHEN eid IS NOT NULL THEN {_say("undeclared_method", "exact_path", "list_aggregate(lacking, 'string_agg', ', ')")} || '|' || {_say("undocumented_operation")}
     WHEN match = 'spanning' THEN {_say("spanning", "near_path", "spans")} || '|' || {_say("spanning_unknown")} || '|' || {_say("spanning_verdict")} || extra
     WHEN nid IS NOT NULL THEN {_say("closest", "near_path", f"({_DIVERGES})")} || CASE WHEN ties > 0 THEN '|' || {_say("tie", "ties")} ELSE '' END || '|' || {_say("partial_verdict")} || extra
       || CASE WHEN len(lacking) > 0 THEN '|' || {_say("partial_methods", "list_aggregate(lacking, 'string_agg', ', ')")} ELSE '' END
     ELSE {_say("absent")} || extra END AS evidence,
   CASE WHEN eid IS NOT NULL AND len(lacking) = 0 THEN 'Low' WHEN eid IS NOT NULL OR auth = 'No' OR (match = 'partial' AND len(lacking) > 0) THEN 'High' ELSE 'Medium' END AS severity FROM jd),
 win AS (SELECT coalesce(epoch(max(t1) - min(t0)), 0) AS sec FROM obx),
 dfi AS (SELECT 'declared' AS subject_kind, declared_path AS path_pattern, NULL::VARCHAR AS id, CASE WHEN sec >= 2592000 THEN 'Zombie' ELSE 'Undetermined' END AS classification,
   CASE WHEN sec >= 2592000 THEN 'High' ELSE 'Low' END AS confidence, sec < 2592000 AS is_ambiguous,
   CASE WHEN sec >= 2592000 THEN {_say("unseen_long", "floor(sec / 86400)::BIGINT", "30")} ELSE {_say("unseen")} || '|' || {_say("unseen_short", "floor(sec / 86400)::BIGINT", "30")} END AS evidence, 'Low' AS severity
   FROM de, win WHERE declared_path NOT IN (SELECT declared_path FROM kinds WHERE match = 'exact')),
 fi AS (SELECT * FROM ofi UNION ALL SELECT * FROM dfi)"""

_OBSERVED = f"WITH {_EVENTS}, {_O}"
_THREE = f"WITH {_EVENTS}, {_T}"
_MATCHED = f"{_OBSERVED}, {_D}, {_PAIRS}"
_FOUND = f"{_MATCHED}, {_FINDINGS}"

_FULL_MATCHED = f"WITH {_EVENTS}, {_T}, {_values(FULL_DECLARED, 'declared_path, dm, ds', 'de')}, {_PAIRS}".replace("obx", "thx")
_FULL_FOUND = f"{_FULL_MATCHED}, {_FINDINGS}".replace("obx", "thx")
_FULL_R = _values(FULL_RULES, "line_number, kind, value", "ru")

_HISTORY = f"""WITH seen AS (SELECT event_id % 2 AS odd, 'e' || user_id || '-' || event_type || '-' || regexp_extract(props, '([0-9])[^0-9]*$', 1) AS id, count(*) AS n, min(user_id) AS u FROM events GROUP BY 1, 2),
 old AS (SELECT id AS endpoint_id, n, u FROM seen WHERE odd = 0), new AS (SELECT id, n, u FROM seen WHERE odd = 1),
 up AS (SELECT '{TARGET}' AS target, coalesce(endpoint_id, id) AS endpoint_id, CASE WHEN id IS NOT NULL THEN '/new/' || id ELSE '/old/' || endpoint_id END AS path_pattern,
   CASE WHEN endpoint_id IS NULL THEN 2 ELSE 1 END::BIGINT AS first_seen_run, CASE WHEN id IS NULL THEN 1 ELSE 2 END::BIGINT AS last_seen_run,
   coalesce(CASE new.u % 4 WHEN 0 THEN 'Shadow' WHEN 1 THEN 'Undetermined' END, CASE old.u % 3 WHEN 0 THEN 'Shadow' WHEN 1 THEN 'Known' END) AS last_classification,
   coalesce(old.u % 2 = 0, false) AS acknowledged, coalesce(old.u % 3 = 0, false) OR coalesce(new.u % 4 = 0, false) AS alerted,
   CASE WHEN id IS NULL THEN 'GET' ELSE 'POST' END AS methods, coalesce(new.n, old.n) AS observation_count, CASE WHEN id IS NULL THEN 'no' ELSE 'yes' END AS auth_observed,
   new.n AS auth_observable_count FROM old FULL JOIN new ON endpoint_id = id)"""
_CLASSES = "(VALUES (0, 'Shadow'), (1, 'Zombie'), (2, 'Known'), (3, 'Undetermined'), (4, 'no verdict')) t(position, label)"
_AUTHS = "(VALUES (0, 'yes'), (1, 'no'), (2, 'mixed'), (3, 'not observable'), (4, 'not recorded')) t(position, label)"
_RUNS = "WITH runs AS (SELECT event_id AS id, 't' || user_id % 3 AS target, strftime(ts - CASE WHEN event_id % 97 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%dT%H:%M:%SZ') AS run_timestamp, user_id AS endpoints FROM events)"
#: What a word's segment is masked for: {0} is the segment, {1} without punctuation around it.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"
_SECRET = r"(regexp_full_match({0}, '[A-Za-z0-9_-]{{4,}}(\.[A-Za-z0-9_-]{{4,}}){{2}}') OR (regexp_full_match({0}, '[A-Za-z0-9_+/=-]{{24,}}') AND regexp_matches({0}, '[0-9]')) OR regexp_matches({0}, '(?s)^[^@]+@[^.]+\.'))"
_BARE = "trim(part, ',;:.!?()[]\"''')"
_MASKED = f"""CASE WHEN instr(part, '=') > 0 AND length(part) > instr(part, '=') AND regexp_matches(lower(regexp_replace(substr(part, 1, instr(part, '=') - 1), '[^A-Za-z0-9]', '', 'g')), '{"|".join(SENSITIVE_FIELD_NAMES)}')
   THEN substr(part, 1, instr(part, '=')) || '<redacted>' WHEN {_SECRET.format(_BARE)} OR len(list_filter(string_split_regex({_BARE}, '%[0-9A-Fa-f]{{2}}'), lambda x: {_SECRET.format("x")})) > 0 THEN '<redacted>' ELSE part END"""

ORACLES = {
    "run_numbers": f"""SELECT event_id AS id, '{TARGET}' AS target, CASE event_id % 5 WHEN 0 THEN event_id + 10 WHEN 1 THEN event_id + 3 END AS lines, CASE WHEN event_id % 5 < 2 THEN event_id END AS parsed,
        CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 3 END::BIGINT AS discarded, CASE WHEN event_id % 5 < 2 THEN user_id ELSE -1 END AS endpoints, CASE event_id % 5 WHEN 0 THEN event_id % 7 + 2 WHEN 1 THEN event_id % 3 END AS findings,
        CASE event_id % 5 WHEN 0 THEN event_id % 7 WHEN 1 THEN 0 END AS shadow, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN event_id % 3 END AS zombie, CASE WHEN event_id % 5 < 2 THEN 0 END::BIGINT AS undetermined,
        CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 END::BIGINT AS known FROM events""",
    "parse_combined": f"WITH {_EVENTS} SELECT event_id, method, path AS raw_path, state AS auth, status::INT AS status_code, epoch(date_trunc('second', ts))::BIGINT AS ts FROM rq",
    "parse_declared": f"""WITH {_EVENTS}, p AS (SELECT *, CASE WHEN event_id % 23 = 0 THEN 'invalid-request-line' END AS why FROM rs) SELECT event_id, CASE WHEN why IS NULL THEN method END AS method, CASE WHEN why IS NULL THEN path END AS raw_path,
        CASE WHEN why IS NULL THEN state END AS auth, CASE WHEN why IS NULL THEN status END::INT AS status_code, CASE WHEN why IS NULL THEN epoch(date_trunc('second', ts)) END::BIGINT AS ts, why AS discard_reason FROM p""",
    "scan_log": f"""WITH {_EVENTS}, l AS (SELECT CASE WHEN event_id % 107 = 0 THEN encode('  ') ELSE encode('10.0.0.1 - ' || remote_user || ' [' || CASE WHEN event_id % 103 = 0 OR event_id % 202 = 0 THEN 'yesterday' ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') END || '] "' || method || ' ' || path
        || CASE WHEN event_id % 3 = 0 THEN '?page=' || k || '&sort=a&page=2' ELSE '' END || CASE WHEN event_id % 131 = 0 THEN ' FTP/1' ELSE ' HTTP/1.1' END || '" ' || CASE WHEN event_id % 101 = 0 THEN '2xx' ELSE status::VARCHAR END || ' '
        || CASE WHEN event_id % 97 = 0 THEN '-' WHEN event_id % 139 = 0 THEN '1k' ELSE '12' END || CASE WHEN event_id % 109 = 0 THEN ' "' ELSE ' "-" "' END || CASE WHEN event_id % 127 = 0 THEN repeat('long ', 14000) WHEN event_id % 113 = 0 THEN '' ELSE 'agent' END)
        || CASE WHEN event_id % 127 <> 0 AND event_id % 113 = 0 THEN '\\xFF'::BLOB ELSE encode('') END || encode('"' || CASE WHEN event_id % 5 = 0 THEN chr(13) ELSE '' END) END AS v FROM ev)
        SELECT octet_length(v)::INT AS bytes, md5(v) AS line_md5 FROM l""",
    "discard_reasons": f"WITH {_EVENTS} SELECT coalesce(reason, 'parsed') AS outcome, count(*) AS lines FROM rs GROUP BY 1",
    "scope_filter": f"WITH {_EVENTS} SELECT count(*) FILTER (starts_with(path, '/api/v1/users')) AS inside, count(*) FILTER (NOT starts_with(path, '/api/v1/users')) AS outside FROM rq",
    "request_line": f"WITH {_EVENTS} SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 11 <> 0 THEN method END AS method, CASE WHEN event_id % 5 <> 0 AND event_id % 11 <> 0 THEN path END AS target FROM ev",
    "path_query": "SELECT page_id, string_split(url, '?')[1] AS path, CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) ELSE '' END AS query FROM pages",
    "query_params": f"WITH {_EVENTS}, q AS (SELECT k FROM rq WHERE event_id % 3 = 0) SELECT 'page' AS name, k || ',2' AS vals, count(*) AS times FROM q GROUP BY k UNION ALL SELECT 'sort', 'a', count(*) FROM q HAVING count(*) > 0",
    "auth_infer": f"WITH {_EVENTS} SELECT state, CASE WHEN state = 'Present' THEN 'unspecified' END AS scheme, count(*) AS requests FROM rs GROUP BY 1, 2",
    "parse_time": "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 END AS local_s, CASE WHEN event_id % 13 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 END AS iso_s FROM events",
    "canonical_path": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
        SELECT page_id, '/' || ltrim(p, '/') || CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/A%2F' WHEN 2 THEN '/%252e' WHEN 3 THEN '/%7Bx%7D' WHEN 4 THEN '/a b/' ELSE '/%25zz%25ff' END AS canonical FROM p""",
    "id_like": f"""WITH {_EVENTS}, s AS (SELECT unnest(string_split(path, '/')) AS segment FROM ev UNION ALL SELECT substr(md5(event_id::VARCHAR), 1, (20 + 4 * (event_id % 4))::INT) FROM ev)
        SELECT segment, regexp_full_match(segment, '[0-9]+') OR (regexp_full_match(segment, '[0-9a-fA-F]+') AND length(segment) IN (24, 32, 40, 64)) AS id_like, count(*) AS times FROM s GROUP BY 1, 2""",
    "endpoint_id": f"WITH {_EVENTS} SELECT DISTINCT path AS pattern, substr(sha256(path), 1, 16) AS id, regexp_replace(path, '/[^/]*$', '') AS parent FROM ev",
    "suspicious": f"WITH {_EVENTS} SELECT DISTINCT path AS pattern, CASE WHEN list_contains(string_split(path, '/'), 'debug') THEN 'debug' END AS segment FROM ev",
    "segment_types": f"{_MATCHED} SELECT path_pattern, list_aggregate(os, 'string_agg', '/') AS shape, count(*) FILTER (os = dd) AS declared FROM typed GROUP BY 1, 2",
    "normalize_paths": f"{_OBSERVED} SELECT path_pattern, n AS observation_count FROM obx",
    "path_observations": f"""WITH {_EVENTS} SELECT path AS raw_path, list_aggregate(list_sort(list(DISTINCT method)), 'string_agg', ',') AS methods, count(*) AS observations, epoch(date_trunc('second', min(ts)))::BIGINT AS first_seen,
        epoch(date_trunc('second', max(ts)))::BIGINT AS last_seen, count(*) FILTER (state <> 'NotObservable') AS auth_observable, count(*) FILTER (state = 'Present') AS auth_present FROM rq GROUP BY 1""",
    "auth_verdict": f"{_THREE} SELECT path_pattern, auth AS auth_observed, obs AS auth_observable_count FROM thx",
    "observed_inventory": f"{_OBSERVED} SELECT id, path_pattern, list_aggregate(methods, 'string_agg', ',') AS methods, epoch(date_trunc('second', t0))::BIGINT AS first_seen, epoch(date_trunc('second', t1))::BIGINT AS last_seen, n AS observation_count, auth AS auth_observed, obs AS auth_observable_count FROM obx",
    "declared_merge": f"WITH {_EVENTS} SELECT '/v' || event_id % 9 AS path_pattern, list_aggregate(list_sort(list(DISTINCT method)), 'string_agg', ',') AS methods, list_aggregate(list_sort(list(DISTINCT status::VARCHAR)), 'string_agg', ',') AS declared_auth_schemes FROM ev GROUP BY 1",
    "obs_window": f"{_OBSERVED} SELECT epoch(date_trunc('second', min(t0)))::BIGINT AS first, epoch(date_trunc('second', max(t1)))::BIGINT AS last FROM obx",
    "exact_match": f"{_MATCHED} SELECT path_pattern, declared_path FROM kinds WHERE match = 'exact'",
    "partial_match": f"{_MATCHED} SELECT path_pattern, declared_path FROM kinds WHERE match = 'partial'",
    "spanning_match": f"{_MATCHED} SELECT path_pattern, declared_path, (ol - dl + 1)::INT AS spans FROM kinds WHERE match = 'spanning'",
    "match_distance": f"{_MATCHED} SELECT path_pattern, declared_path, mismatches::INT AS mismatches, tail::INT AS tail FROM cands",
    "divergence": f"{_MATCHED} SELECT path_pattern, declared_path, divergence FROM cands",
    "nearest_declared": f"{_MATCHED} SELECT nid AS id, near_path AS declared_path, ties::INT AS ties, list_aggregate(cm, 'string_agg', ',') AS candidate_methods FROM near",
    "undeclared_methods": f"{_FOUND} SELECT path_pattern, severity, regexp_extract(evidence, 'method.s. ([A-Z, ]+) were', 1) AS methods FROM fi WHERE classification = 'Undetermined' AND subject_kind = 'observed' AND contains(evidence, 'method(s)')",
    "classify_full": f"{_FULL_FOUND} SELECT * EXCLUDE (id) FROM fi",
    "nearest_full": f"{_FULL_MATCHED} SELECT nid AS id, near_path AS declared_path, ties::INT AS ties, list_aggregate(cm, 'string_agg', ',') AS candidate_methods FROM near",
    "allowlist_full": f"""{_FULL_FOUND}, {_FULL_R}, a AS (SELECT subject_kind, path_pattern, (SELECT min(line_number) FROM ru WHERE (kind = 'endpoint' AND id = value)
        OR (kind = 'pattern' AND (path_pattern = value OR (ends_with(value, '*') AND starts_with(path_pattern, rtrim(value, '*'))))))::BIGINT AS rule_line FROM fi) SELECT *, rule_line IS NULL AS visible FROM a""",
    "finding_mix": f"{_FULL_FOUND} SELECT classification, severity, confidence, count(*) AS findings FROM fi GROUP BY 1, 2, 3",
    "evidence_histogram": f"""{_FULL_FOUND}, e AS (SELECT unnest(string_split(evidence, '|')) AS e FROM fi)
        SELECT regexp_replace(regexp_replace(e, '/[^ ,;'']*', '<path>', 'g'), '[0-9]+', '<n>', 'g') AS evidence, count(*) AS times FROM e GROUP BY 1""",
    "redacted_share": f"WITH {_EVENTS}, p AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN path || '/' || md5(path) ELSE path END AS p, event_id % 3 = 0 AS keyed FROM ev) SELECT count(*) AS patterns, count(*) FILTER (keyed) AS redacted FROM p",
    "declared_inventory": """WITH e AS (SELECT DISTINCT user_id, event_type FROM events),
        b AS (SELECT user_id, unnest(CASE user_id % 6 WHEN 0 THEN ['/u' || user_id] WHEN 1 THEN ['/v' || user_id] WHEN 2 THEN ['/w' || user_id] WHEN 3 THEN ['/y' || user_id] WHEN 4 THEN ['/z' || user_id, ''] ELSE [''] END) AS base
          FROM (SELECT DISTINCT user_id FROM events)),
        p AS (SELECT user_id, base || '/' || event_type || '/{id}' AS path_pattern, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS methods FROM e JOIN b USING (user_id) UNION ALL SELECT user_id, base || '/bare', 'GET' FROM b)
        SELECT *, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'key' END AS declared_auth_schemes FROM p""",
    "allowlist_parse": """WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, 4::BIGINT AS line_number, 'endpoint' AS kind, 'e' || user_id AS value FROM e GROUP BY user_id
        UNION ALL SELECT user_id, 4 + row_number() OVER (PARTITION BY user_id ORDER BY event_type), 'pattern', '/' || event_type || '/*' FROM e""",
    "declared_unseen": f"{_MATCHED} SELECT declared_path AS path_pattern FROM de WHERE declared_path NOT IN (SELECT declared_path FROM kinds WHERE match = 'exact')",
    "classify_spec": f"{_FOUND} SELECT * EXCLUDE (id) FROM fi",
    "classify_heuristic": f"""{_THREE}, sib AS (SELECT parent AS p, count(*) FILTER (auth IN ('Yes', 'Mixed')) AS w FROM thx GROUP BY 1),
        x AS (SELECT *, {_EXTRA} AS extra, auth = 'No' AND coalesce(w, 0) > 0 AS odd FROM thx LEFT JOIN sib ON parent = p)
        SELECT 'observed' AS subject_kind, path_pattern, 'Undetermined' AS classification, CASE WHEN odd THEN 'Medium' ELSE 'Low' END AS confidence, true AS is_ambiguous,
          substr(extra || CASE WHEN odd THEN '|' || {_say("siblings", "w", "parent")} ELSE '' END || '|' || {_say("suspicion")}, 2) AS evidence, CASE WHEN odd THEN 'High' ELSE 'Medium' END AS severity
        FROM x WHERE odd OR extra <> ''""",
    "auth_siblings": f"{_THREE} SELECT parent, count(*) FILTER (auth IN ('Yes', 'Mixed')) AS with_auth FROM thx GROUP BY 1",
    "finding_counts": f"{_FOUND} SELECT classification, count(*) AS findings FROM fi GROUP BY 1",
    "grouped_findings": f"""{_FULL_FOUND}, g AS (SELECT list_position(['Shadow', 'Zombie', 'Undetermined', 'Known'], classification) AS u, classification, string_split(evidence, '|')[1] AS reason, count(*) AS members,
        string_agg(path_pattern, ' ' ORDER BY path_pattern, subject_kind) AS paths, min(path_pattern) AS first_path, min(path_pattern || chr(1) || subject_kind) AS f FROM fi GROUP BY 1, 2, 3)
        SELECT classification, reason, members, paths, first_path, members <= 3 AS in_detail, (u * 1000000 + row_number() OVER (PARTITION BY u ORDER BY f, reason))::BIGINT AS position FROM g""",
    "group_members": f"{_FULL_FOUND} SELECT classification, string_split(evidence, '|')[1] AS reason, path_pattern, subject_kind FROM fi",
    "endpoint_positions": f"{_THREE} SELECT path_pattern, id, row_number() OVER (ORDER BY path_pattern, id) AS position FROM thx",
    "allowlist_apply": f"{_FOUND}, {_R} SELECT subject_kind, path_pattern, (SELECT min(line_number) FROM ru WHERE path_pattern = value OR (ends_with(value, '*') AND starts_with(path_pattern, rtrim(value, '*'))))::BIGINT AS rule_line FROM fi",
    "broad_rules": f"""{_FOUND}, {_R}, ap AS (SELECT (SELECT min(line_number) FROM ru WHERE path_pattern = value OR (ends_with(value, '*') AND starts_with(path_pattern, rtrim(value, '*')))) AS rule_line FROM fi),
        c AS (SELECT rule_line, count(*) AS n FROM ap GROUP BY 1)
        SELECT line_number::BIGINT AS line_number, kind, value, coalesce(n, 0)::BIGINT AS silenced FROM ru LEFT JOIN c ON line_number = rule_line
        WHERE coalesce(n, 0) > 5 OR (ends_with(value, '*') AND len(list_filter(string_split(rtrim(value, '*'), '/'), lambda s: s <> '')) < 2)""",
    "redact_documents": rf"""WITH t AS (SELECT doc_id, text || ' mail=a' || doc_id || '@x.org token=abc' || doc_id || '.' || ' jwt abcd' || doc_id || '.efgh.ijkl page=2 /p/' || md5(doc_id::VARCHAR) || '/q. a%2F' || md5('x') || '%2Fb' AS t FROM documents),
        c AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^ \t]*[ \t]|[^ \t]+')) AS c, generate_subscripts(regexp_extract_all(t, '[^ \t]*[ \t]|[^ \t]+'), 1) AS i FROM t),
        b AS (SELECT *, regexp_replace(c, '{_SPACE}', '') AS body FROM c),
        p AS (SELECT doc_id, i, c, body, unnest(string_split(body, '/')) AS part, generate_subscripts(string_split(body, '/'), 1) AS j FROM b),
        m AS (SELECT doc_id, i, CASE WHEN body = '' THEN c ELSE string_agg({_MASKED}, '/' ORDER BY j) || substr(c, length(body) + 1) END AS word FROM p GROUP BY doc_id, i, c, body),
        r AS (SELECT doc_id, string_agg(word, '' ORDER BY i) AS redacted FROM m GROUP BY doc_id)
        SELECT doc_id, length(redacted)::INT AS chars, md5(redacted) AS redacted_md5, substr(redacted, length(redacted) - length(string_split(redacted, ' page=2 ')[-1]) + 1) AS ends FROM r""",
    "redact_email": f"""WITH {_EVENTS}, w AS (SELECT ['u', '', 'u@v'][event_id % 3 + 1] || '@' || ['x.org', '.org', 'host', 'a.b'][event_id % 4 + 1] AS word FROM ev)
        SELECT word, CASE WHEN word IN ('u@x.org', 'u@a.b', 'u@v@x.org', 'u@v@a.b', 'u@v@.org') THEN '<redacted>' ELSE word END AS redacted, count(*) AS times FROM w GROUP BY 1, 2""",
    "history_upsert": f"{_HISTORY} SELECT * FROM up",
    "new_endpoints": f"{_HISTORY} SELECT id, '/new/' || id AS path_pattern FROM new WHERE id NOT IN (SELECT endpoint_id FROM old)",
    "pending_alerts": f"{_HISTORY} SELECT endpoint_id, path_pattern FROM up WHERE alerted AND NOT acknowledged",
    "first_seen_in": f"{_HISTORY} SELECT endpoint_id FROM up WHERE first_seen_run = 2",
    "clock_backwards": f"{_RUNS} SELECT id, target, coalesce(run_timestamp < lag(run_timestamp) OVER (PARTITION BY target ORDER BY id), false) AS went_back FROM runs",
    "trend": f"{_RUNS}, l AS (SELECT id, endpoints FROM runs WHERE target = 't1' ORDER BY id DESC LIMIT 20) SELECT id, endpoints, greatest(endpoints * 100 // greatest((SELECT max(endpoints) FROM l), 1), 2)::BIGINT AS height FROM l",
    "class_summary": f"{_HISTORY} SELECT position::INT AS position, label, count(endpoint_id) AS endpoints FROM {_CLASSES} LEFT JOIN up ON label = coalesce(last_classification, 'no verdict') GROUP BY 1, 2",
    "auth_summary": f"{_HISTORY} SELECT position::INT AS position, label, count(endpoint_id) AS endpoints FROM {_AUTHS} LEFT JOIN up ON label = auth_observed GROUP BY 1, 2",
    "compliance_rows": f"""{_HISTORY} SELECT endpoint_id, path_pattern, methods, observation_count AS observations, coalesce(last_classification, 'no verdict') AS classification, auth_observed AS authentication,
        coalesce(auth_observable_count::VARCHAR, 'not recorded') AS observable_requests, first_seen_run, last_seen_run, CASE WHEN alerted AND NOT acknowledged THEN 'yes' ELSE 'no' END AS pending_alert FROM up""",
    "noise_metrics": f"""{_FOUND} SELECT (SELECT count(*) FROM obx) AS endpoints, (SELECT count(*) FROM fi WHERE classification <> 'Known') AS to_look_at,
        round(10.0 * (SELECT count(*) FROM fi WHERE classification <> 'Known') / (SELECT count(*) FROM obx), 1)::DOUBLE AS per_ten_endpoints, count(*) AS lines, count(reason) AS discarded FROM rs""",
    "literal_children": "WITH p AS (SELECT DISTINCT '/w/x' || event_id % 3 AS parent, 'v' || event_id % 50 AS v FROM events) SELECT parent, count(*) AS children, min(v) AS sample FROM p GROUP BY 1 HAVING count(*) > 20",
    "swallowed_words": f"""{_OBSERVED}, w AS (SELECT unnest(string_split(path, '/')) AS segment FROM rq), s AS (SELECT unnest(string_split(path_pattern, '/')) AS x FROM obx WHERE path_pattern NOT LIKE '%/users/%')
        SELECT segment, count(*) AS times FROM w WHERE segment <> '' AND NOT regexp_full_match(segment, '[0-9]+') AND segment NOT IN (SELECT x FROM s) GROUP BY 1""",
    "stratified_sample": f"""WITH {_EVENTS}, r AS (SELECT DISTINCT method AS classification, path AS path_pattern FROM ev),
        n AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY md5('20260830:observed:' || path_pattern))::INT AS nth FROM r) SELECT * FROM n WHERE nth <= 6""",
    "match_pairs": f"{_MATCHED} SELECT path_pattern, declared_path, match FROM kinds WHERE match IS NOT NULL",
    "format_guard": f"WITH {_EVENTS} SELECT count(*) AS lines, count(*) FILTER (reason IS NULL) AS fit FROM rs WHERE reason IS DISTINCT FROM 'blank-line'",
    "run_counts": f"""{_FOUND} SELECT 'lines ' || coalesce(reason, 'parsed') AS what, count(*) AS number FROM rs GROUP BY 1 UNION ALL SELECT 'findings ' || classification, count(*) FROM fi GROUP BY 1
        UNION ALL SELECT 'endpoints', count(*) FROM obx""",
    "labels": f"{_HISTORY} SELECT auth_observed AS auth, coalesce(last_classification, 'no verdict') AS class, count(*) AS endpoints FROM up GROUP BY 1, 2",
    "history_inventory": f"{_HISTORY} SELECT path_pattern, endpoint_id, observation_count, auth_observed AS auth, alerted AND NOT acknowledged AS pending FROM up",
    "status_counts": f"""{_HISTORY} SELECT '{TARGET}' AS target, (SELECT count(*) FROM events) AS runs, (SELECT max(event_id) FROM events) AS last_run, count(*) AS endpoints, count(*) FILTER (first_seen_run > 1) AS later,
        count(*) FILTER (alerted AND NOT acknowledged) AS pending FROM up""",
    "history_targets": f"{_RUNS} SELECT target, count(*) AS runs, max(id) AS last_run FROM runs GROUP BY 1",
}
ORACLES["stream_inventory"] = ORACLES["observed_inventory"]
