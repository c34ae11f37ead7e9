"""An access log, requests and a declared inventory derived from the events table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight.sources.access_log import parse_lines

#: Declared endpoints: path pattern, methods, schemes.
DECLARED = [
    ("/api/v1/users/{userId}/view", ["GET"], ["bearerAuth"]),
    ("/api/v1/users/{userId}/click", ["POST"], ["bearerAuth"]),
    ("/api/v1/users/{userId}/{action}", ["GET", "POST"], []),
    ("/api/v1/users/{userId}", ["GET"], ["bearerAuth"]),
    ("/api/v1/orders/{orderId}", ["GET"], ["bearerAuth"]),
    ("/api/v1/debug/{name}", ["GET"], []),
    ("/api/v1/reports/{reportId}", ["GET"], ["apiKey"]),
    ("/api/v1/users/{uid}/view", ["HEAD"], ["apiKey"]),
]

#: Allowlist rules: line, kind, value.
RULES = [(2, "pattern", "/api/v1/debug/errors/{id}"), (3, "pattern", "/api/v1/orders/*"), (4, "pattern", "/api/*")]

#: A specification with two paths of one shape, so that an observed path is as near to either.
FULL_DECLARED = [*DECLARED, ("/shop/{aisle}/items", ["GET"], []), ("/shop/{floor}/items", ["POST"], []), ("/never/called", ["GET"], [])]
#: An allowlist with an endpoint of its own, that leaves some findings visible.
FULL_RULES = [(2, "endpoint", hashlib.sha256(b"/shop/main/items").hexdigest()[:16]), (5, "pattern", "/api/v1/debug/errors/{id}"), (7, "pattern", "/api/v1/orders/*")]

METHODS = {"view": "GET", "click": "GET", "signup": "POST", "purchase": "PUT", "error": "DELETE"}
STATUS = {"signup": "201", "error": "500"}


def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.regexp_extract("props", "[0-9]+", 0)
    kind = F.col("event_type")
    method = F.coalesce(*[F.when(kind == t, m) for t, m in METHODS.items()])
    status = F.coalesce(*[F.when(kind == t, s) for t, s in STATUS.items()], F.lit("200"))
    seven = F.col("event_id") % 7
    path = (
        F.when(seven == 0, F.concat(F.lit("/api/v1/orders/"), "event_id", F.lit("/items/"), k))
        .when(seven == 1, F.concat(F.lit("/api/v1/debug/errors/"), k))
        .when(seven == 2, F.lit("/api/v1/users/me"))
        .otherwise(F.concat(F.lit("/api/v1/users/"), "user_id", F.lit("/"), kind))
    )
    user = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u"), "user_id")).otherwise("-")
    return e.select("event_id", "ts", user.alias("remote_user"), method.alias("method"), path.alias("path"), status.alias("status"), k.alias("k"))


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and value, a log line in the built-in grammar; some are broken in each of the known ways, some in two."""
    f = derived_fields(spark, sf_dir)
    bad = lambda n: F.col("event_id") % n == 0
    time = F.when(bad(103) | bad(202), F.lit("yesterday")).otherwise(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss +0000"))
    status = F.when(bad(101), F.lit("2xx")).otherwise(F.col("status"))
    target = F.concat("path", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("?page="), "k", F.lit("&sort=a&page=2"))).otherwise(""))
    size = F.when(bad(97), F.lit("-")).when(bad(139), F.lit("1k")).otherwise(F.lit("12"))
    head = F.concat(F.lit("10.0.0.1 - "), "remote_user", F.lit(" ["), time, F.lit('] "'), "method", F.lit(" "), target, F.when(bad(131), F.lit(" FTP/1")).otherwise(F.lit(" HTTP/1.1")), F.lit('" '), status, F.lit(" "), size)
    agent = F.when(bad(127), F.repeat(F.lit("long "), 14000)).when(bad(113), F.unhex(F.lit("FF")).cast("string")).otherwise(F.lit("agent"))
    tail = F.when(bad(109), F.concat(F.lit(' "'), agent, F.lit('"'))).otherwise(F.concat(F.lit(' "-" "'), agent, F.lit('"')))
    line = F.when(bad(107), F.lit("  ")).otherwise(F.concat(head, tail, F.when(bad(5), F.lit("\r")).otherwise("")))
    return f.select("event_id", line.alias("value"))


def derived_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of derived_log() that parse."""
    return parse_lines(derived_log(spark, sf_dir)).where("discard_reason is null")


def three_state_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with all three states of authentication, which no log yields, over more than the staleness window, and with undeclared paths."""
    f = derived_fields(spark, sf_dir)
    n = F.col("event_id")
    path = F.when(n % 17 == 3, F.lit("/admin/export")).when(n % 17 == 4, F.lit("/shop/main/items")).otherwise(F.col("path"))
    f = f.withColumns({"path": path, "ts": F.when(n % 19 == 0, F.col("ts") + F.expr("interval 45 days")).otherwise(F.col("ts")).cast("timestamp")})
    state = (
        F.when((n % 7 == 1) | F.startswith("path", F.lit("/admin")), F.lit("Absent"))
        .when(F.col("path").endswith("/view"), F.lit("Present"))
        .when(F.col("path").endswith("/click"), F.when(n % 2 == 0, "Present").otherwise("Absent"))
        .when(F.col("path").endswith("/signup"), F.lit("Absent"))
        .otherwise("NotObservable")
    )
    return f.select("method", F.col("path").alias("raw_path"), F.struct(state.alias("state"), F.when(state == "Present", "unspecified").alias("scheme")).alias("auth"), "ts")


def derived_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and a specification as text, with a path for each type of event that the user has."""
    verb = F.when(F.col("event_type").isin("view", "click"), "get").otherwise("post")
    item = F.concat(F.lit('"/'), "event_type", F.lit('/{id}": {"'), verb, F.lit('": {}, "parameters": []}'))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(item)), ", ").alias("items"))
    # bases with and without slashes, of the root, and what is no base: numbers, servers that are no list, malformed addresses
    u = F.col("user_id")
    bases = (
        ('"servers": [{"url": "https://x.org/u', '/"}, {"url": 3}, "x"], '), ('"basePath": "/v', '", "servers": 5, '), ('"basePath": "w', '//", '), ('"basePath": 7, "servers": [{"url": "http://[x/y', '"}], '),
        ('"servers": [{"url": "z', '"}, {"url": "https://x.org"}], '), ('"basePath": "/", "version": "', '", '),
    )
    base = F.element_at(F.array(*[F.concat(F.lit(a), u, F.lit(b)) for a, b in bases]), (u % len(bases) + 1).cast("int"))
    keys = F.when(u % 5 == 0, '5').when(u % 5 == 1, '[7, {"key": []}]').otherwise('[{"key": []}]')
    return e.select("user_id", F.concat(F.lit("{"), base, F.lit('"security": '), keys, F.lit(', "paths": {'), "items", F.lit(', "bare": {"get": {"security": 1}}, "no": 4}}')).alias("text"))


def derived_allowlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and an allowlist as text, with a rule for each type of event that the user has."""
    rule = F.concat(F.lit("pattern /"), "event_type", F.lit("/*  # seen"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(rule)), "\n").alias("rules"))
    return e.select("user_id", F.concat(F.lit("# rules\n\napisight-allowlist 1\nendpoint e"), "user_id", F.lit("\n"), "rules").alias("text"))


def declared(spark: SparkSession, rows: list = DECLARED) -> DataFrame:
    return spark.createDataFrame(rows, "path_pattern string, methods array<string>, declared_auth_schemes array<string>")


def rules(spark: SparkSession, rows: list = RULES) -> DataFrame:
    return spark.createDataFrame(rows, "line_number long, kind string, value string")
