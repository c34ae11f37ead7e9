"""Fixed values of the rule set: they must be as they are for results to agree."""

from __future__ import annotations

RULESET_VERSION = "0.8.0"

MAX_LINE_BYTES = 65536
FORMAT_SAMPLE_LINES = 100
MIN_DISTINCT_VALUES_FOR_VARIABLE = 3
ID_PLACEHOLDER = "{id}"
HEX_ID_LENGTHS = (24, 32, 40, 64)
DEFAULT_STALENESS_DAYS = 30
SUSPICIOUS_PATH_SEGMENTS = ("test", "debug", "old", "internal")
MAX_SPEC_BYTES = 8 * 1024 * 1024
MAX_SPEC_DEPTH = 64
SENSITIVE_FIELD_NAMES = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "session", "sig", "signature", "credential", "apikey", "access", "refresh")
OPAQUE_SECRET_MIN_LEN = 24
REDACTED, REDACTED_PATH = "<redacted>", "<path>"
BROAD_MIN_LITERAL_SEGMENTS, BROAD_MAX_SILENCED = 2, 5
GROUP_DETAIL_LIMIT = 3
TREND_RUNS = 20
LITERAL_CHILDREN_LIMIT = 20
HTTP_VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")

#: Reasons for which a line is discarded.
LINE_TOO_LONG = "line-too-long"
INVALID_UTF8 = "invalid-utf8"
BLANK_LINE = "blank-line"
MALFORMED_LINE = "malformed-line"
INVALID_STATUS = "invalid-status-code"
INVALID_TIMESTAMP = "invalid-timestamp"
INVALID_REQUEST = "invalid-request-line"

#: Verdicts, most urgent first.
VERDICTS = ("Shadow", "Zombie", "Undetermined", "Known")
#: Rows of the summaries, in this order.
CLASS_SUMMARY = ("Shadow", "Zombie", "Known", "Undetermined", "no verdict")
AUTH_SUMMARY = ("yes", "no", "mixed", "not observable", "not recorded")

#: Evidence texts; {0} and so on are filled in.
EVIDENCE = {
    "known": "path and methods both declared in the spec as {0}",
    "undeclared_method": "path declared in the spec as {0}, but method(s) {1} were observed and are not declared",
    "undocumented_operation": "an undeclared method on a declared path is an undocumented operation, not a known endpoint",
    "spanning": "no exact match in the spec; the declared path {0} would cover this endpoint only if its final variable segment spanned {1} path segments",
    "spanning_unknown": "OpenAPI cannot say whether a path parameter contains slashes, so whether this is that declared endpoint or an undocumented one cannot be read from the spec",
    "spanning_verdict": "reported as undetermined and not as shadow: absence from the declared inventory is not verifiable while a declared path could cover it",
    "closest": "no exact match in the spec; the closest declared path is {0}, {1}",
    "observed_fixed": "which has a variable segment where this endpoint has a fixed one",
    "observed_variable": "which has a fixed segment where this endpoint has a variable one",
    "both": "which differs in both directions: a variable segment where this endpoint has a fixed one, and a fixed segment where this endpoint has a variable one",
    "no_line_up": "which does not line up with it segment by segment",
    "tie": "{0} other declared path(s) are just as close, so which one this endpoint belongs to cannot be read from the spec",
    "partial_verdict": "reported as undetermined on purpose: calling it known would hide an endpoint the spec does not describe",
    "partial_methods": "method(s) {0} were observed and are not declared on any of the closely matching declared paths",
    "absent": "not present in the declared inventory",
    "unseen_long": "declared in the spec but never observed in {0} day(s) of traffic, more than the staleness window of {1} day(s)",
    "unseen": "declared in the spec but never observed in this log",
    "unseen_short": "the analysed traffic covers {0} day(s), less than the staleness window of {1} day(s): too short to call it a zombie",
    "suspicious": "path contains the segment '{0}', which suggests a non-production surface",
    "no_auth": "no authentication observed on any of the {0} observable request(s)",
    "siblings": "no authentication observed here, while {0} sibling endpoint(s) under '{1}' do show it",
    "suspicion": "no declared inventory was provided, so this is a suspicion, not a verdict: supply an OpenAPI spec to get one",
}
