"""Scanning and parsing of access logs."""

import random

import pytest
from pyspark.sql import functions as F

from apisight import ruleset as R
from apisight.sources import access_log as L
from apisight.sources.grammar import GrammarError, compile_format

LINES = [
    '203.0.113.9 - - [05/Mar/2024:08:00:06 +0000] "GET /v1/books/1?page=2 HTTP/1.1" 200 512 "https://books.example.org/" "curl/8.5"',
    '203.0.113.7 - mira [05/Mar/2024:08:00:08 +0000] "POST /v1/stock/recount HTTP/1.1" 204 0 "-" "curl/8.5"',
    '203.0.113.8 - - [05/Mar/2024:10:02:01 +0200] "DELETE /v1/carts/c0ffee HTTP/1.1" 401 12 "-" "curl/8.5"',
]
C = '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"'


def parse(spark, lines, log_format="nginx-combined"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return L.parse_lines(rows, log_format).orderBy("i").collect()


def test_built_in_lines(spark):
    a, b, c = parse(spark, LINES)
    assert (a.method, a.raw_path, a.query_params, a.status_code) == ("GET", "/v1/books/1", {"page": ["2"]}, 200)
    assert b.auth.state == "Present" and a.auth.state == "NotObservable" and b.auth.scheme == "unspecified"
    assert c.ts.isoformat() == "2024-03-05T08:02:01"
    assert a.discard_reason is b.discard_reason is c.discard_reason is None


@pytest.mark.parametrize(
    "line, reason",
    [
        ("x" * 65537, R.LINE_TOO_LONG),
        ("  \t", R.BLANK_LINE),
        ("", R.BLANK_LINE),
        ("no log line", R.MALFORMED_LINE),
        (LINES[0] + " more", R.MALFORMED_LINE),
        (LINES[0].replace(" 512 ", " x "), R.MALFORMED_LINE),
        (LINES[0].replace(" 200 ", " 20 "), R.INVALID_STATUS),
        (LINES[0].replace("Mar", "Foo"), R.INVALID_TIMESTAMP),
        (LINES[0].replace("05/Mar", "32/Mar"), R.INVALID_TIMESTAMP),
        (LINES[0].replace("GET /v1/books/1?page=2 HTTP/1.1", "GET /x"), R.INVALID_REQUEST),
        (LINES[0].replace("HTTP/1.1", "FTP/1"), R.INVALID_REQUEST),
    ],
)
def test_reasons(spark, line, reason):
    row = parse(spark, [line])[0]
    assert row.discard_reason == reason and row.method is None and row.ts is None


def test_carriage_return_and_repeated_names(spark):
    row = parse(spark, [LINES[0].replace("page=2", "a=1&&b&a=2=3") + "\r"])[0]
    assert row.discard_reason is None and row.query_params == {"a": ["1", "2=3"], "b": [""]}


def test_bytes_that_are_no_utf8(spark, folder):
    with open(f"{folder}/log", "wb") as f:
        f.write(LINES[0].encode() + b"\n\xff\xfe\n" + LINES[1].encode())
    rows = L.parse_lines(L.scan_log(spark, f"{folder}/log")).groupBy("discard_reason").count().collect()
    assert {r.discard_reason: r["count"] for r in rows} == {None: 2, R.INVALID_UTF8: 1}


def test_lines_end_at_line_feeds_alone(spark, folder):
    with open(f"{folder}/log", "wb") as f:
        f.write(b"a\rb\nc\n")
    assert [r.value for r in L.scan_log(spark, f"{folder}/log").collect()] == ["a\rb", "c"]


VARIANTS = {
    C + ' "$http_x_forwarded_for"': LINES[0] + ' "1.2.3.4, 5.6.7.8"',
    C + " $request_time": LINES[0] + " 0.003",
    C + " $request_time $upstream_response_time": LINES[0] + " 0.003 -",
    "$request_time " + C: "0.1 " + LINES[0],
    '$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent': LINES[0].split(' "https')[0],
    C: LINES[0],
}


@pytest.mark.parametrize("form", VARIANTS)
def test_declared_formats(spark, form):
    row = parse(spark, [VARIANTS[form]], form)[0]
    assert row.discard_reason is None and row.raw_path == "/v1/books/1"
    assert parse(spark, [VARIANTS[form] + " extra"], form)[0].discard_reason == R.MALFORMED_LINE
    if form != C:
        assert parse(spark, [VARIANTS[form]])[0].discard_reason == R.MALFORMED_LINE


def test_split_request_fields(spark):
    form = "$time_iso8601 $request_method $uri $status"
    good, none, day = parse(spark, ["2024-01-02T03:04:05+01:00 GET /a?x=1 200", "2024-01-02T03:04:05Z - - 400", "2024-01-02 GET /a 200"], form)
    assert good.raw_path == "/a" and good.ts.isoformat() == "2024-01-02T02:04:05" and good.auth.state == "NotObservable"
    assert none.discard_reason == R.INVALID_REQUEST and day.discard_reason == R.INVALID_TIMESTAMP


@pytest.mark.parametrize("form", ["", "\\t$request", "$a$b", "${name", "$", "$status $request", "unknown", "${}"])
def test_refused_declarations(form):
    with pytest.raises(GrammarError):
        compile_format(form)


def positional(line):
    """A reader of the built-in grammar, field by field."""
    at = 0

    def spaces():
        nonlocal at
        while line[at : at + 1] == " ":
            at += 1

    def token():
        nonlocal at
        spaces()
        end = line.find(" ", at)
        end = len(line) if end < 0 else end
        value, at = line[at:end], end
        return value or None

    def enclosed(left, right):
        nonlocal at
        spaces()
        if line[at : at + 1] != left:
            return None
        end = line.find(right, at + 1)
        if end < 0:
            return None
        value, at = line[at + 1 : end], end + 1
        return value

    fields = [token(), token(), token(), enclosed("[", "]"), enclosed('"', '"'), token(), token(), enclosed('"', '"'), enclosed('"', '"')]
    return None if None in fields or line[at:].strip() else fields


def test_mutated_lines_against_a_positional_reader(spark):
    rng = random.Random(5)
    lines = []
    for _ in range(3000):
        x = list(rng.choice(LINES))
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(x))
            x[i : i + rng.randint(0, 1)] = rng.choice(['"', " ", "[", "]", "x", "", "  "])
        lines.append("".join(x))
    g = compile_format("nginx-combined")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    found = {r.i: list(r.f) if r.ok else None for r in rows.select("i", F.col("value").rlike(g.pattern).alias("ok"), F.array(*[F.regexp_extract("value", g.pattern, k) for k in range(1, 10)]).alias("f")).collect()}
    # a field that an unclosed quote leaves empty can't be told from none by a token reader
    assert all(found[i] == positional(x) for i, x in enumerate(lines))


def test_format_guard(spark):
    bad = L.parse_lines(spark.createDataFrame([("nope",)] * 3, "value string"))
    with pytest.raises(L.FormatNotRecognized):
        L.check_format(bad)
    L.check_format(L.parse_lines(spark.createDataFrame([], "value string")))
    L.check_format(L.parse_lines(spark.createDataFrame([("nope",), (LINES[0],)], "value string")))
