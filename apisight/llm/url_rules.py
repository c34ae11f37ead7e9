"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Hex digits of a hash prefix.
DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); empty where url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _met(left: DataFrame, text: str, right: DataFrame, r_text: str) -> DataFrame:
    """Rows of left and right with equal texts: they meet on a short prefix of the texts' hashes, and the whole digests are confirmed then.

    The confirmation is no equality, so that it does not become a join key.
    """
    left = left.withColumn("digest", F.sha2(text, 256)).withColumn("prefix", F.substring("digest", 1, DIGITS))
    right = right.withColumn("r_digest", F.sha2(r_text, 256)).withColumn("r_prefix", F.substring("r_digest", 1, DIGITS))
    return left.join(right, (F.col("prefix") == F.col("r_prefix")) & F.startswith("digest", F.col("r_digest"))).drop("digest", "prefix", "r_digest", "r_prefix")


def apply_url_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on each row's url: that of the longest rule whose host is the url's or a parent domain of it and whose path starts the url's.

    rules: host, path, verdict (block or allow), as many as there are. Equally long rules: the longer host, then block before allow.

    Distinct urls are expanded in two steps, each joined on hash prefixes: their host suffixes, of the label counts that rules have, meet the
    rules' hosts; then the path prefixes, of the lengths that rules of such a host have, meet the rules as host + path. So a host with
    thousands of labels or a list with thousands of path lengths costs no url more than what may fit it. Only the distinct label counts of
    the rules' hosts, at most the square root of twice the list's dots, come to the driver.

    Returns page_id, url, host, path, rule (host + path, null if none fits), verdict. One row for each of pages; a null url has empty host
    and path and the default verdict. Rules with a null host are ignored, a null path is empty. Other columns are ignored; empty tables are
    fine.
    """
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("r_host"), F.coalesce(F.col("path"), F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where(F.col("r_host").isNotNull())
    rules = rules.withColumn("rule", F.concat("r_host", "r_path"))
    labels = lambda host: F.size(F.split(host, "\\."))
    counts = [r.labels for r in rules.select(labels("r_host").alias("labels")).distinct().orderBy("labels").collect()]
    hosts = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    distinct = pages.select("url", "host", "path").where(F.length("host") > 0).distinct()
    fit = F.filter(F.array(*map(F.lit, counts)).cast("array<int>"), lambda n: n <= labels("host"))
    suffixes = distinct.select("url", "host", "path", F.explode(fit).alias("n")).withColumn("suffix", F.expr("substring_index(host, '.', -n)"))
    known = _met(suffixes.select("url", "path", "suffix"), "suffix", hosts, "r_host")
    expressions = known.select("url", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("chars"))
    expressions = expressions.select("url", F.expr("concat(suffix, substring(path, 1, chars))").alias("expression"))
    found = _met(expressions, "expression", rules.drop("r_path"), "rule")
    rank = F.struct(F.length("rule"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"))
    best = found.groupBy(F.col("url").alias("u")).agg(F.max_by(F.struct("rule", "r_verdict"), rank).alias("best"))
    return pages.join(best, F.col("url") == F.col("u"), "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.r_verdict"), F.lit(default)).alias("verdict"))
