"""Matching, verdicts, allowlists and summaries on directly built rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from apisight.operators import classify as C
from apisight.operators import match, silence
from apisight.operators.silence import apply_allowlist, broad_rules
from apisight.operators.order import numbered
from apisight.operators.summaries import group_members, grouped_findings, whole_groups
from apisight.ruleset import EVIDENCE
from apisight.sources.allowlist import AllowlistError, parse_allowlist

START = dt.datetime(2024, 1, 1)


def observed(spark, *rows):
    """(pattern, methods, auth, observable) with a span of days given by the last row's days."""
    data = [(f"id{i}", p, m, START, START + dt.timedelta(days=days), 5, auth, n) for i, (p, m, auth, n, days) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, path_pattern string, methods array<string>, first_seen timestamp, last_seen timestamp, observation_count long, auth_observed string, auth_observable_count long")


def declared(spark, *rows):
    return spark.createDataFrame([(p, m, []) for p, m in rows], "path_pattern string, methods array<string>, declared_auth_schemes array<string>")


def one(path, methods=("GET",), auth="NotObservable", n=0, days=0):
    return path, list(methods), auth, n, days


def verdict(spark, path, *specs, **kw):
    found = C.classify_with_spec(observed(spark, one(path, **kw)), declared(spark, *specs)).where("subject_kind = 'observed'").collect()
    assert len(found) == 1
    return found[0]


def test_known(spark):
    r = verdict(spark, "/api/users/{id}", ("/api/users/{userId}", ["GET", "POST"]))
    assert (r.classification, r.confidence, r.severity, r.is_ambiguous) == ("Known", "High", "Low", False)
    assert r.evidence == ["path and methods both declared in the spec as /api/users/{userId}"]


def test_absent(spark):
    r = verdict(spark, "/api/admin", ("/api/users/{userId}", ["GET"]))
    assert (r.classification, r.confidence, r.severity, r.evidence) == ("Shadow", "High", "Medium", [EVIDENCE["absent"]])
    r = verdict(spark, "/api/debug", ("/x", ["GET"]), auth="No", n=4)
    assert r.severity == "High" and r.evidence[1:] == ["path contains the segment 'debug', which suggests a non-production surface", "no authentication observed on any of the 4 observable request(s)"]


def test_undeclared_method(spark):
    r = verdict(spark, "/a", ("/a", ["GET"]), methods=("POST", "DELETE", "GET"))
    assert (r.classification, r.confidence, r.severity, r.is_ambiguous) == ("Undetermined", "High", "High", True)
    assert r.evidence[0] == "path declared in the spec as /a, but method(s) DELETE, POST were observed and are not declared"


def test_partial_nearest_and_ties(spark):
    r = verdict(spark, "/issues/{id}", ("/issues/comments", ["GET"]), ("/issues/{index}", ["GET"]))
    assert r.classification == "Known"
    r = verdict(spark, "/api/orders/summary", ("/api/{resource}/summary", ["GET"]), ("/api/orders/{id}", ["GET"]))
    assert r.evidence[0] == f"no exact match in the spec; the closest declared path is /api/orders/{{id}}, {EVIDENCE['observed_fixed']}"
    r = verdict(spark, "/api/orders/summary", ("/api/{x}/summary", ["GET"]), ("/api/{y}/summary", ["POST"]), methods=("PUT",))
    assert "1 other declared path(s) are just as close" in r.evidence[1] and r.severity == "High" and r.evidence[-1].startswith("method(s) PUT were observed")
    r = verdict(spark, "/a/{id}/b", ("/a/x/{y}", ["GET"]))
    assert EVIDENCE["both"] in r.evidence[0]


def test_spanning(spark):
    r = verdict(spark, "/repos/contents/config/app.yaml", ("/repos/contents/{filepath}", ["GET"]))
    assert r.classification == "Undetermined" and "spanned 2 path segments" in r.evidence[0]
    r = verdict(spark, "/api/users/1/comments/5", ("/api/users/{id}", ["GET"]), methods=("PATCH",))
    assert "spanned 3" in r.evidence[0] and r.severity == "Medium" and len(r.evidence) == 3
    assert verdict(spark, "/a/b/c", ("/a/{x}/d", ["GET"]), ("/", ["GET"])).classification == "Shadow"


def test_declared_but_unseen(spark):
    spec = declared(spark, ("/gone/{x}", ["GET"]))
    for days, want in ((30, "Zombie"), (29, "Undetermined")):
        r = C.classify_with_spec(observed(spark, one("/a", days=days)), spec).where("subject_kind = 'declared'").collect()
        assert [(x.classification, x.severity) for x in r] == [(want, "Low")]
        assert f"{days} day(s)" in r[0].evidence[-1]
    empty = C.classify_with_spec(observed(spark, one("/a")).limit(0), spec, 0).collect()
    assert [x.classification for x in empty] == ["Zombie"]
    with pytest.raises(ValueError):
        C.classify_with_spec(observed(spark, one("/a")), spec, -1)


def test_suspicions_without_spec(spark):
    rows = observed(spark, one("/p/a", auth="No", n=3), one("/p/b", auth="Yes", n=2), one("/p/c", auth="Mixed", n=2), one("/q/a", auth="No", n=1), one("/q/test", n=0), one("/r"))
    found = {r.path_pattern: r for r in C.classify_without_spec(rows).collect()}
    assert set(found) == {"/p/a", "/q/a", "/q/test"}
    assert (found["/p/a"].confidence, found["/p/a"].severity) == ("Medium", "High") and "while 2 sibling endpoint(s) under '/p'" in found["/p/a"].evidence[1]
    assert (found["/q/a"].confidence, found["/q/a"].severity) == ("Low", "Medium")
    assert found["/q/test"].evidence == ["path contains the segment 'test', which suggests a non-production surface", EVIDENCE["suspicion"]]


def test_distance_against_a_model(spark):
    import itertools

    def types(path, var):
        return [] if path == "/" else ["*" if var(s) else s for s in path.strip("/").split("/")]

    o_paths = ["/" + "/".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "{id}"], repeat=n)] + ["/"]
    d_paths = ["/" + "/".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "{v}"], repeat=n)] + ["/"]
    o = observed(spark, *[one(p) for p in o_paths])
    d = declared(spark, *[(p, ["GET"]) for p in d_paths])
    exact = {(r.path_pattern, r.declared_path) for r in match.exact_matches(o, d).collect()}
    near = {(r.path_pattern, r.declared_path): (r.spans, *r.distance) for r in match.candidates(o, d).collect()}
    for p, q in itertools.product(o_paths, d_paths):
        a, b = types(p, lambda s: s == "{id}"), types(q, lambda s: s[0] == "{")
        differ = [i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
        clash = lambda n: any(a[i] != b[i] and "*" not in (a[i], b[i]) for i in range(n))
        distance = (max(len(a) - len(b), 0) + len(differ), len(a) - differ[0] if differ else 0)
        if len(a) == len(b):
            assert ((p, q) in exact) == (a == b)
            assert near.get((p, q)) == ((None, *distance) if a != b and not clash(len(a)) else None)
        else:
            spans = b and len(a) > len(b) and b[-1] == "*" and not clash(len(b) - 1)
            assert near.get((p, q)) == ((len(a) - len(b) + 1, *distance) if spans else None)


RULES = """# known noise
shop-allowlist 1
endpoint id0   # by id
pattern /api/x
pattern /api/*
"""


def test_allowlist(spark):
    assert parse_allowlist(RULES) == [(3, "endpoint", "id0"), (4, "pattern", "/api/x"), (5, "pattern", "/api/*")]
    for bad in ("", "endpoint id", "any-allowlist 1\nother x", "any-allowlist 1\npattern"):
        with pytest.raises(AllowlistError):
            parse_allowlist(bad)
    rules = spark.createDataFrame(parse_allowlist(RULES), "line_number long, kind string, value string")
    found = C.classify_with_spec(observed(spark, one("/api/x"), one("/api/y"), one("/b")), declared(spark, ("/api/id0", ["GET"]), ("id0", ["GET"])))
    applied = apply_allowlist(found, rules)
    assert {r.path_pattern: r.rule_line for r in applied.collect()} == {"/api/x": 3, "/api/y": 5, "/b": None, "/api/id0": 5, "id0": None}
    assert [r.line_number for r in broad_rules(applied, rules).collect()] == [5]


def test_groups(spark):
    found = C.classify_with_spec(observed(spark, *[one(f"/a{i}") for i in range(5)]), declared(spark, ("/z", ["GET"])))
    rows = {r.classification: (r.members, r.in_detail) for r in grouped_findings(found).collect()}
    assert rows == {"Shadow": (5, False), "Undetermined": (1, True)}
    assert found.where(F.size("evidence") == 0).count() == 0


def test_a_large_group_is_a_small_row(spark):
    n = 200_000
    found = spark.range(n).selectExpr("case when id % 3 = 0 then 'declared' else 'observed' end as subject_kind", "concat('/p', lpad(cast(id as string), 9, '0')) as path_pattern", "'Shadow' as classification", "array('absent', 'x') as evidence")
    rows = grouped_findings(found.union(found.limit(1).selectExpr("subject_kind", "'/z'", "'Zombie'", "array('y')"))).orderBy("position").collect()
    assert [(r.classification, r.members, r.paths, r.position, r.in_detail) for r in rows] == [("Shadow", n, [f"/p{i:09}" for i in range(3)], 1_000_001, False), ("Zombie", 1, ["/z"], 2_000_001, True)]
    assert group_members(found).count() == n


def test_a_whole_group_has_every_member(spark):
    reasons = ["absent", "absent", "absent", "absent", "absent", "late", None]  # one group of several blocks, one of few members, one without a reason
    rows = [("declared" if i % 3 else "observed", f"/p{i * 7919 % 1009}/é{i % 2000}" if i % 5 else "", "Zombie" if i == 1 else "Shadow", [reasons[i % 7 if i < 40 else 0], "x"]) for i in range(20_000)]
    want = {}
    for kind, path, verdict, evidence in rows:
        want.setdefault((verdict, evidence[0]), []).append((path.encode(), kind))
    found = spark.createDataFrame(rows, "subject_kind string, path_pattern string, classification string, evidence array<string>").repartition(7)
    whole = {(r.classification, r.reason): r for r in whole_groups(found).collect()}
    assert {k: (r.members, r.paths) for k, r in whole.items()} == {k: (len(m), b" ".join(path for path, _ in sorted(m)).decode()) for k, m in want.items()}
    few = {(r.classification, r.reason): r for r in grouped_findings(found).collect()}
    assert all((r.position, r.first_path, r.in_detail, r.paths) == (whole[k].position, whole[k].first_path, whole[k].in_detail, whole[k].paths.split(" ")[: len(r.paths)]) for k, r in few.items()) and len(few) == len(whole)
    assert whole_groups(found.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_positions(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50)) for _ in range(n)]
    found = numbered(spark.createDataFrame(rows, "a string, b long").repartition(7), "a", F.desc("b")).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1, n + 1)) and [(r.a, r.b) for r in found] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", -x[1]))


# ---- plans, and matching against all pairs


def random_tables(spark, seed, n_observed, n_declared):
    rng = random.Random(seed)
    segment = lambda variable: rng.choice(["a", "b", "api", "v1", "é", "*", "=a", "?", variable, variable])
    path = lambda variable: "/" + "/".join(segment(variable) for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 12])))
    observed = sorted({path("{id}") for _ in range(n_observed)})
    declared = sorted({path("{x}") for _ in range(n_declared)} | {"/a/{x}", "/a/{y}", "/{x}", "/"})
    o = spark.createDataFrame([(str(i), p, ["GET"]) for i, p in enumerate(observed)], "id string, path_pattern string, methods array<string>")
    d = spark.createDataFrame([(p, [rng.choice(["GET", "PUT"])]) for p in declared], "path_pattern string, methods array<string>")
    return o, d, observed, declared


def every_pair(observed, declared):
    typed = lambda p, v: [None if s == v or (v == "{x}" and s == "{y}") else s for s in p[1:].split("/")] if p != "/" else []
    agree = lambda o, d: all(x is None or y is None or x == y for x, y in zip(o, d, strict=False))
    partial, spanning = set(), set()
    for op in observed:
        for dp in declared:
            o, d = typed(op, "{id}"), typed(dp, "{x}")
            if len(o) == len(d) and agree(o, d) and o != d:
                partial.add((op, dp))
            if d and d[-1] is None and len(o) > len(d) and agree(o, d[:-1]):
                spanning.add((op, dp, len(o) - len(d) + 1))
    return partial, spanning


@pytest.mark.parametrize("small", [True, False])
def test_matching_by_the_trie_equals_all_pairs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(match, "BROADCAST_EDGES", 0)
        monkeypatch.setattr(match, "LEVELS", 2)
    o, d, observed, declared = random_tables(spark, 5 + small, 150, 80)
    partial, spanning = every_pair(observed, declared)
    found = [(r.path_pattern, r.declared_path, r.spans) for r in match.candidates(o, d).collect()]
    assert len(found) == len(set(found)) and {x[:2] for x in found if x[2] is None} == partial and {x for x in found if x[2] is not None} == spanning
    assert {(r.path_pattern, r.declared_path) for r in match.partial_matches(o, d).collect()} == partial
    assert {(r.path_pattern, r.declared_path, r.spans) for r in match.spanning_matches(o, d).collect()} == spanning
    assert match.candidates(o, d.where("false")).collect() == [] and match.candidates(o.where("false"), d).collect() == []


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_plan_of_a_match_has_a_product_or_a_join_without_a_key(spark):
    o, d, _, _ = random_tables(spark, 9, 30, 20)
    rules = spark.createDataFrame([(2, "pattern", "/a*"), (3, "pattern", "/b")], "line_number long, kind string, value string")
    rows = o.selectExpr("'observed' as subject_kind", "id as endpoint_id", "path_pattern")
    for frame in (match.partial_matches(o, d), match.spanning_matches(o, d), match.nearest(match.candidates(o, d)), silence.apply_allowlist(rows, rules)):
        assert "CartesianProduct" not in plan_of(frame) and "NestedLoop" not in plan_of(frame)
    for frame in (match.partial_matches(o, d), match.spanning_matches(o, d)):
        assert "from_key" in plan_of(frame)


def test_the_first_prefix_rule_of_the_file_wins(spark):
    rng = random.Random(2)
    paths = ["/" + "".join(rng.choice("ab\U0001f600/") for _ in range(rng.randrange(8))) for _ in range(60)]
    rules = [(i + 2, "pattern", rng.choice(paths)[: rng.randrange(1, 7)] + rng.choice(["*", "*", ""])) for i in range(25)]
    rows = spark.createDataFrame([("observed", str(i), p) for i, p in enumerate(paths)], "subject_kind string, endpoint_id string, path_pattern string")
    found = silence.apply_allowlist(rows, spark.createDataFrame(rules, "line_number long, kind string, value string")).collect()
    want = {p: min((n for n, _, v in rules if (p.startswith(v[:-1]) if v.endswith("*") else p == v)), default=None) for p in paths}
    assert {r.path_pattern: r.rule_line for r in found} == want and len(found) == len(paths)
