"""Paths, identifiers and the collapse."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apisight.functions import paths as P
from apisight.functions.redact import redact_file, redact_text
from apisight.operators.inventory import observed_inventory
from apisight.operators import normalize
from apisight.operators.normalize import Collapse, collapse_ids, collapse_more
from apisight.session import cut_lineage

CANONICAL = {
    "/api/users/1": "/api/users/1", "": "/", "/": "/", "/a/": "/a/", "//a": "//a", "/%41b": "/Ab", "/a%2Fb": "/a%2Fb", "/a%2fb": "/a%2Fb", "/%252e%252e": "/%252e%252e", "/%2e%2e/secret": "/../secret",
    "/%ff": "/%25ff", "/%25ff": "/%25ff", "/a%20b": "/a b", "/{id}": "/%7Bid%7D", "/citt\xe0/日本": "/citt\xe0/日本", "/%zz": "/%25zz", "/a+b": "/a+b", "/%C3%A0": "/\xe0", "/%": "/%25",
}
#: Invisible characters and their escapes.
INVISIBLE = {0x200B: "%E2%80%8B", 0x202E: "%E2%80%AE", 0xFEFF: "%EF%BB%BF", 0xA0: "%C2%A0", 0xAD: "%C2%AD", 0x2066: "%E2%81%A6", 0x9B: "%C2%9B", 0x01: "%01", 0x3000: "%E3%80%80"}
CANONICAL |= {f"/x{chr(c)}y": f"/x{escape}y" for c, escape in INVISIBLE.items()}


def test_canonical_paths(spark):
    rows = spark.createDataFrame([(k,) for k in CANONICAL], "p string")
    assert {r.p: r.c for r in rows.select("p", P.join_segments(P.canonical_segments(F.col("p"))).alias("c")).collect()} == CANONICAL


def test_identifiers(spark):
    yes = ["1", "007", "0" * 50, "a" * 24, "F" * 64, "0123456789abcdef0123456789ABCDEF", "123e4567-e89b-12d3-a456-426614174000"]
    no = ["", "cafe", "a" * 23, "1a", "g" * 24, "123e4567e89b-12d3-a456-426614174000", "1\n"]
    rows = spark.createDataFrame([(x,) for x in yes + no], "s string").select("s", P.is_id_like(F.col("s")).alias("y")).collect()
    assert {r.s: r.y for r in rows} == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def test_endpoint_ids(spark):
    row = spark.createDataFrame([("/api/admin", "/api/admin/reset")], "a string, b string").select(P.endpoint_id(F.col("a")), P.endpoint_id(F.col("b"))).first()
    assert tuple(row) == ("cc7359a30fd4e062", "7d9cfd7f1c092667")


def trie(paths):
    """Patterns by a recursive reading of the rule, one prefix at a time."""
    out = {}

    def walk(group, depth):
        done = [p for p in group if len(p[1]) == depth]
        for p in done:
            out[p[0]] = "/" + "/".join(p[1])
        rest = [p for p in group if len(p[1]) > depth]
        like = {p[1][depth] for p in rest if re.fullmatch("[0-9]+", p[1][depth])}
        merged = {}
        for key, segs in rest:
            s = "{id}" if len(like) >= 3 and segs[depth] in like else segs[depth]
            merged.setdefault(s, []).append((key, [*segs[:depth], s, *segs[depth + 1 :]]))
        for g in merged.values():
            walk(g, depth + 1)

    walk([(p, p.strip("/").split("/")) for p in paths], 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_collapse_against_a_trie(spark, seed):
    rng = random.Random(seed)
    paths = sorted({"/".join(rng.choice(["a", "b", "1", "2", "3", "4"]) for _ in range(rng.randint(1, 6))) for _ in range(60)})
    rows = spark.createDataFrame([(p, p.split("/")) for p in paths], "p string, segs array<string>").repartition(1 + 3 * seed)
    assert {r.p: "/" + "/".join(r.segs) for r in collapse_ids(rows).collect()} == trie(paths)


def requests(spark, paths):
    return spark.createDataFrame([("GET", p, ("NotObservable", None), i) for i, p in enumerate(paths)], "method string, raw_path string, auth struct<state string, scheme string>, ts_s long").withColumn("ts", F.timestamp_seconds("ts_s"))


@pytest.mark.parametrize(
    "paths, patterns",
    [
        (["/u/1", "/u/2", "/u/3"], {"/u/{id}"}),
        (["/u/1", "/u/2"], {"/u/1", "/u/2"}),
        ([f"/api/users/{i}/orders/{90 + i}" for i in (1, 2, 3)], {"/api/users/{id}/orders/{id}"}),
        ([f"/u/{i}" for i in range(300)] + ["/u/admin", "/u/me", "/u/current"], {"/u/{id}", "/u/admin", "/u/me", "/u/current"}),
        (["/x/cafe", "/x/dead", "/x/face"], {"/x/cafe", "/x/dead", "/x/face"}),
        (["/api/users/{id}"], {"/api/users/%7Bid%7D"}),
    ],
)
def test_patterns(spark, paths, patterns):
    assert {r.path_pattern for r in observed_inventory(requests(spark, paths)).collect()} == patterns
    assert {r.path_pattern for r in observed_inventory(requests(spark, paths[::-1]).repartition(7)).collect()} == patterns


def test_deep_path(spark):
    assert observed_inventory(requests(spark, ["/" + "/".join(["s"] * 2000) + "/1"])).count() == 1


REDACTED = {
    "eyJhbGci.eyJzdWIi.sig_1234": "<redacted>", "write to a@b.org, now": "write to <redacted> now", "password=hunter2": "password=<redacted>", "api-key=": "api-key=", "/u/abcdefgh12345678ijklmnop90/x": "/u/<redacted>/x",
    "page=2": "page=2", "group%2Fproject": "group%2Fproject", "%7Bcustomer_id%7D": "%7Bcustomer_id%7D", "abcdefghijklmnopqrstuvwxyz": "abcdefghijklmnopqrstuvwxyz", "a%20x@y.zz": "<redacted>", "": "",
    "Token=a\tb  c ": "Token=<redacted>\tb  c ", "x@.org": "x@.org", "@a.b": "@a.b",
}


def test_redaction(spark):
    rows = spark.createDataFrame([(k,) for k in REDACTED], "t string")
    assert {r.t: r.r for r in rows.select("t", redact_text(F.col("t")).alias("r")).collect()} == REDACTED


def model(text):
    def secret(v):
        def one(x):
            jwt = x.split(".")
            if len(jwt) == 3 and all(re.fullmatch("[A-Za-z0-9_-]{4,}", p) for p in jwt):
                return True
            if len(x.encode()) >= 24 and re.fullmatch("[A-Za-z0-9_+/=-]+", x) and re.search("[0-9]", x):
                return True
            local, at, domain = x.partition("@")
            return bool(at and local and "." in domain and not domain.startswith("."))

        v = v.strip(",;:.!?()[]\"'")
        return one(v) or any(map(one, re.split("%[0-9A-Fa-f]{2}", v)))

    def part(p):
        name, eq, value = p.partition("=")
        names = "token key secret password passwd pwd auth session sig signature credential apikey access refresh".split()
        if eq and value and any(n in re.sub("[^A-Za-z0-9]", "", name).lower() for n in names):
            return name + "=<redacted>"
        return "<redacted>" if secret(p) else p

    out = ""
    for chunk in re.findall(r"[^ \t]*[ \t]|[^ \t]+", text):
        word = chunk.rstrip(" \t")
        out += "/".join(map(part, word.split("/"))) + chunk[len(word) :]
    return out


def test_redaction_against_a_model(spark):
    rng = random.Random(3)
    bits = ["token", "key=", "=", "a@b.c", "/", " ", "\t", "%2F", "abcdefghijklmnopqrstuvw12", ".", "abcd.efgh.ijkl", "(", ")", "x", "@", "page"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.r for r in rows.select("i", redact_text(F.col("t")).alias("r")).orderBy("i").collect()] == [model(t) for t in texts]


def test_redacted_files(spark):
    rows = spark.createDataFrame([("/var/log/access.log",), ("access.log",), ("/x/a@b.org.log",)], "p string")
    assert [r[0] for r in rows.select(redact_file(F.col("p"))).collect()] == ["<path>/access.log", "access.log", "<path>/<redacted>"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab/%4 {}1", max_size=12), min_size=1, max_size=20))
def test_order_and_partitions_change_nothing(paths):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a = {tuple(r)[1:3] for r in observed_inventory(requests(spark, paths)).select("id", "path_pattern", "observation_count").collect()}
    b = {tuple(r)[1:3] for r in observed_inventory(requests(spark, paths[::-1]).repartition(3)).select("id", "path_pattern", "observation_count").collect()}
    assert a == b


# ---- the collapse that goes on


def random_path(rng):
    segment = lambda: rng.choice(["a", "b", "users", "", *map(str, range(7)), "0123456789abcdef01234567"])
    return [segment() for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5]))]


@pytest.mark.parametrize("seed, batches, size", [(1, 7, 5), (2, 5, 9), (3, 2, 40)])
def test_the_collapse_goes_on_as_the_whole_one(spark, seed, batches, size):
    rng = random.Random(seed)
    state, so_far = Collapse.empty(spark), set()
    for _ in range(batches):
        batch = [random_path(rng) for _ in range(rng.randrange(size + 1))]
        new = {tuple(p) for p in batch} - so_far
        so_far |= new
        state, changed = collapse_more(state, spark.createDataFrame([(p,) for p in batch], "segs array<string>"))
        assert changed == bool(new)
        state = Collapse(*[cut_lineage(x) for x in (state.known, state.values, state.varying)])
        paths = cut_lineage(spark.createDataFrame([(list(p), list(p)) for p in so_far], "was array<string>, segs array<string>"))
        want = sorted((tuple(r.was), tuple(r.segs)) for r in collapse_ids(paths).collect())
        assert sorted((tuple(r.segs), tuple(r.now)) for r in state.known.collect()) == want
        # what is kept of values is small, and of prefixes that paths still have
        prefixes = {(i, "/".join(now[:i])) for _, now in want for i in range(len(now))}
        kept = [(r.depth, r.prefix) for r in state.values.collect()]
        assert max([kept.count(k) for k in kept], default=0) <= 2 and set(kept) <= prefixes and {(r.depth, r.prefix) for r in state.varying.collect()} <= prefixes


def test_only_paths_below_a_changed_prefix_are_walked_again(spark, monkeypatch):
    walked = []
    real = normalize._depths
    monkeypatch.setattr(normalize, "_depths", lambda rows: walked.append(sorted(tuple(r.segs) for r in rows.collect())) or real(rows))
    more = lambda state, *paths: collapse_more(state, spark.createDataFrame([(list(p),) for p in paths], "segs array<string>"))[0]
    state = more(Collapse.empty(spark), ("a", "1", "x"), ("a", "2", "x"), ("b", "1"), ("b", "2"), ("c", "9"))
    walked.clear()
    state = more(state, ("a", "3"), ("c", "9"))
    assert walked == [[("a", "3")], [("a", "1", "x"), ("a", "2", "x")]]
    walked.clear()
    more(state, ("a", "4"))
    assert walked == [[("a", "4")]]
