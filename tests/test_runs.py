"""Specifications, whole analyses, history and the stream."""

import hashlib
import io
import json
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from apisight.operators import history as H
from apisight.operators import publish
from apisight.plans.analysis import Settings, _escaped, analyse, markdown_lines, record_run, report_html, report_json, report_markdown, status_view, write_compliance, write_lines
from apisight.sources import access_log
from apisight.sources.access_log import FormatNotRecognized, input_digest, range_digests, range_lines, scan_ranges
from apisight.sources.allowlist import parse_allowlist
from apisight.sources.openapi import SpecError, parse_spec, read_spec
from apisight.streaming import tail
from apisight.streaming.tail import TailReader, Watch, lines_of, tail_log

LOG = "\n".join(
    [f'203.0.113.9 - - [05/Mar/2024:08:00:0{i} +0000] "GET /v1/books/{i}?lang=en HTTP/1.1" 200 512 "-" "curl/8.5"' for i in (1, 2, 3)]
    + ['203.0.113.7 - mira [05/Mar/2024:08:01:00 +0000] "PUT /v1/stock/recount HTTP/1.1" 202 0 "-" "curl/8.5"', '203.0.113.8 - - [05/Mar/2024:10:02:01 +0200] "DELETE /v1/carts/c0ffee HTTP/1.1" 409 12 "-" "a|b <c>"']
)
SPEC = {
    "openapi": "3.0.3",
    "servers": [{"url": "https://books.example.org"}],
    "security": [{"shopKey": []}],
    "paths": {"/v1/books/{bookId}": {"get": {}, "post": {}}, "/v1/carts/{cartId}": {"delete": {}}, "/v1/orders/{orderId}": {"get": {}}},
}
ENDPOINTS = {
    (hashlib.sha256(path.encode()).hexdigest()[:16], path, methods, n, auth)
    for path, methods, n, auth in (("/v1/stock/recount", ("PUT",), 1, "Yes"), ("/v1/carts/c0ffee", ("DELETE",), 1, "NotObservable"), ("/v1/books/{id}", ("GET",), 3, "NotObservable"))
}


def write(folder, name, text):
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{folder}/{name}"


def test_specifications(spark, folder):
    assert parse_spec(json.dumps(SPEC))[0] == ("/v1/books/{bookId}", ["GET", "POST"], ["shopKey"])
    bases = {"swagger": "2.0", "basePath": "/v2/", "servers": [{"url": "https://x/api/"}], "paths": {"/a": {"GET": {"security": []}, "parameters": []}, "/b": {"summary": "x"}}}
    assert [p for p, _, _ in parse_spec(json.dumps(bases))] == ["/api/a", "/v2/a"]
    deep = "x"
    for _ in range(70):
        deep = [deep]
    for bad in ("{}", '{"paths": []}', json.dumps({"paths": {}, "x": deep}), "a: &x 1\nb: *x\npaths: {}"):
        with pytest.raises(SpecError):
            parse_spec(bad)
    with pytest.raises(SpecError):
        read_spec(spark, write(folder, "large.json", " " * (8 * 1024 * 1024 + 1)))
    assert read_spec(spark, write(folder, "s.json", json.dumps(SPEC))).count() == 3


@pytest.mark.parametrize(
    "given, bases",
    [
        ({"basePath": "v1"}, ["/v1"]), ({"basePath": "/"}, [""]), ({"basePath": 7}, [""]), ({"basePath": "v1//", "servers": 5}, ["/v1"]), ({"servers": [{"url": "http://[x/v1"}, 3, {"url": 4}]}, ["/v1"]),
        ({"servers": [{"url": "https://h"}, {"url": "a/b/"}]}, ["", "/a/b"]), ({"servers": {"url": "/x"}, "security": 5}, [""]),
    ],
)
def test_base_paths(given, bases):
    paths = {"users": {"get": {"security": "no"}}, "/items": {"GET": {"security": [3, {"k": []}]}}}
    assert parse_spec(json.dumps({**given, "paths": paths})) == sorted([(f"{b}/users", ["GET"], []) for b in bases] + [(f"{b}/items", ["GET"], ["k"]) for b in bases])


def test_allowlist_lines_end_at_line_feeds_alone():
    assert parse_allowlist("any-allowlist 1\r\npattern /a\u2028b\x0cc\r\n\npattern /d") == [(2, "pattern", "/a\u2028b\x0cc"), (4, "pattern", "/d")]


def test_five_characters_are_escaped(spark):
    assert spark.range(1).select(_escaped(F.lit("<a href='x' b=\"y\">&")).alias("e")).first().e == "&lt;a href=&#39;x&#39; b=&quot;y&quot;&gt;&amp;"


def test_analysis(spark, folder):
    log, spec = write(folder, "valid.log", LOG), write(folder, "spec.json", json.dumps(SPEC))
    a = analyse(spark, log, Settings(openapi_spec=spec, allowlist_text="any-allowlist 1\npattern /v1/carts/*"))
    assert {(r.id, r.path_pattern, tuple(r.methods), r.observation_count, r.auth_observed) for r in a.inventory.collect()} == ENDPOINTS
    assert a.by_class == {"Known": 1, "Shadow": 1, "Undetermined": 3} and a.exit_code == 3 and a.counts == {"parsed": 5}
    report = json.loads(report_json(spark, a, "2024-01-01T00:00:00Z"))
    assert [f["classification"] for f in report["findings"]] == ["Shadow", "Undetermined", "Known"] and report["findings_silenced_by_allowlist"] == 2
    assert report["manifest"]["counts"]["findings_by_classification"] == {"Known": 1, "Shadow": 1, "Undetermined": 3}
    assert report["manifest"]["inputs"][0]["path"] == "<path>/valid.log" and len(report["manifest"]["inputs"][0]["digest"]) == 64
    auth = {e["path_pattern"]: e["auth"] for e in report["endpoints"]}
    assert auth["/v1/stock/recount"] == {"observed": "yes", "observable_requests": 1}
    assert report["manifest"]["configuration"]["openapi_spec"] == {"value": "<path>/spec.json", "source": "given"} and report["manifest"]["configuration"]["staleness_days"] == {"value": 30, "source": "default"}
    text, page = report_markdown(a), report_html(a)
    assert text.index("## Findings by reason") < text.index("| Shadow | High | not present") if "| Shadow | High | not present" in text else "| Shadow |" in text
    assert text.count("\n## ") == 3 and "| parsed | 5 |" in text and "/v1/carts/c0ffee" in text
    assert page.count("<table>") == page.count("</table>") == 4 and "<td>/v1/stock/recount</td>" in page
    write_lines(markdown_lines(a), f"file://{folder}/report")
    assert sum(1 for r in spark.read.text(f"{folder}/report").collect() if r.value.startswith("| Shadow")) == text.count("| Shadow")
    scoped = analyse(spark, log, Settings(path_prefix="/v1/books"))
    assert scoped.inventory.count() == 1 and scoped.outside_scope == 2 and scoped.exit_code == 0


@pytest.mark.parametrize("text", [b"", b"a", b"a\n", b"\n", b"\n\na\n\nbc", b"abc\nde\r\n\nfghij\nk", b"x" * 40 + b"\ny\n" + b"z" * 9])
def test_ranges_of_lines(text, monkeypatch):
    monkeypatch.setattr(access_log.R, "MAX_LINE_BYTES", 10)
    want = [x[:12] for x in text.split(b"\n")]
    want = want[:-1] if want[-1] == b"" else want
    for size in (1, 2, 3, 7, 100):
        for piece in (1, 2, 5, 64):
            lines, bytes_ = [], b""
            for begin in range(0, max(1, len(text)), size):
                for some, taken in range_lines(io.BytesIO(text), begin, min(len(text), begin + size), piece):
                    lines += some
                    bytes_ += taken
            assert bytes_ == text and [x[:12] for x in lines] == want


def test_an_analysis_reads_a_log_once(spark, folder, monkeypatch):
    text = (LOG + "\n") * 300 + "broken\n"
    log, read, real = write(folder, "many.log", text), spark.sparkContext.accumulator(0), range_lines

    def counted(stream, begin, end, piece=1 << 20):
        for lines, taken in real(stream, begin, end, piece):
            read.add(len(taken))
            yield lines, taken

    monkeypatch.setattr(access_log, "range_lines", counted)
    a = analyse(spark, log, Settings(path_prefix="/v1/books"))
    assert read.value == len(text) and a.counts == {"parsed": 1500, "malformed-line": 1} and a.outside_scope == 600
    assert a.inputs == [("log", f"file:{log}", "sha256", hashlib.sha256(text.encode()).hexdigest())]
    parts = range_digests(scan_ranges(spark, log, 10_000)).first()
    ends = [0] + [text.index("\n", i - 1) + 1 for i in range(10_000, len(text), 10_000)] + [len(text)]
    assert parts.algorithm == "sha256-ranges" and parts.digest == hashlib.sha256("".join(hashlib.sha256(text[a:b].encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)).encode()).hexdigest()
    assert sorted(r.value for r in scan_ranges(spark, log, 777).where("value is not null").collect()) == sorted(text.encode().split(b"\n")[:-1])


def test_refusals(spark, folder):
    with pytest.raises(FormatNotRecognized):
        analyse(spark, write(folder, "other.log", "a\nb\n"))
    with pytest.raises(ValueError):
        Settings(path_prefix="api")
    with pytest.raises(ValueError):
        Settings(staleness_days=-1)
    assert input_digest(spark, write(folder, "x", LOG)).first().digest == hashlib.sha256(LOG.encode()).hexdigest()


def test_history(spark, folder):
    log, spec = write(folder, "valid.log", LOG), write(folder, "spec.json", json.dumps(SPEC))
    store = H.History(spark, f"file://{folder}/history")
    a = analyse(spark, log, Settings(openapi_spec=spec, target="shop"))
    assert record_run(a, store, "2024-01-02T00:00:00Z") == 1
    alerts = [r.path_pattern for r in H.pending_alerts(store.endpoints()).collect()]
    assert alerts == ["/v1/stock/recount"] and store.findings().count() == 5
    # a run without a specification has verdicts on none of these: the alert and the classification stay
    b = analyse(spark, log, Settings(target="shop"))
    assert record_run(b, store, "2024-01-01T00:00:00Z") == 2
    row = store.endpoints().where("path_pattern = '/v1/stock/recount'").first()
    assert (row.last_classification, row.first_seen_run, row.last_seen_run, row.alerted) == ("Shadow", 1, 2, True)
    assert [r.went_back for r in H.clock_backwards(store.runs()).orderBy("id").collect()] == [False, True]
    assert store.acknowledge("shop", row.endpoint_id) and not store.acknowledge("other", row.endpoint_id)
    assert H.pending_alerts(store.endpoints()).count() == 0
    record_run(analyse(spark, log, Settings(target="else")), store, "2024-01-03T00:00:00Z")
    assert store.endpoints().groupBy("target").count().count() == 2 and H.first_seen_in(store.endpoints(), "else", 3).count() == 3
    write_compliance(store, "shop", f"file://{folder}/csv")
    lines = [r.value for r in spark.read.text(f"{folder}/csv").collect()]
    assert lines[0] == "endpoint_id,path_pattern,methods,observations,classification,authentication,observable_requests,first_seen_run,last_seen_run,pending_alert" and len(lines) == 4
    write_compliance(store, "shop", f"file://{folder}/json", "json")
    write_compliance(store, "shop", f"file://{folder}/md", "markdown")
    assert spark.read.json(f"{folder}/json").count() == 3 and sum(r.value.startswith("| ") for r in spark.read.text(f"{folder}/md").collect()) == 4
    view = status_view(store, "shop")
    assert view["numbers"].first().asDict() == {"target": "shop", "runs": 2, "last_run": 2, "endpoints": 3, "later": 0, "pending": 0}
    assert view["inventory"].count() == 3 and view["new"].count() == 0 and view["pending"].count() == 0 and view["trend"].count() == 2
    assert store.has_target("else") and not store.has_target("none")
    with pytest.raises(ValueError):
        record_run(analyse(spark, log, Settings(target=" x")), store, "t")
    with pytest.raises(FileNotFoundError):
        H.History(spark, f"file://{folder}/missing", create=False)


def test_two_writers_lose_no_run(spark, folder):
    seen = spark.createDataFrame([("e1", "/a", ["GET"], 1, "no", 1, "Shadow")], "id string, path_pattern string, methods array<string>, observation_count long, auth_observed string, auth_observable_count long, classification string")
    none = spark.createDataFrame([], "endpoint_id string, subject_kind string, path_pattern string, classification string, confidence string, severity string, evidence array<string>")
    ids: list[int] = []
    store = H.History(spark, f"file://{folder}/history")
    work = lambda t: ids.append(H.History(spark, f"file://{folder}/history").record(t, "2024-01-01T00:00:00Z", seen, none, "r", "t"))
    writers = [threading.Thread(target=work, args=(f"t{i}",)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(ids) == [1, 2, 3] == sorted(r.id for r in store.runs().collect())
    assert {(r.target, r.first_seen_run) for r in store.endpoints().collect()} == {(r.target, r.id) for r in store.runs().collect()}


SEEN = "id string, path_pattern string, methods array<string>, observation_count long, auth_observed string, auth_observable_count long, classification string"
FOUND = "endpoint_id string, subject_kind string, path_pattern string, classification string, confidence string, severity string, evidence array<string>"


def one_run(spark, store, target="t", count=1):
    seen = spark.createDataFrame([("e1", "/a", ["GET"], count, "no", 1, "Shadow")], SEEN)
    found = spark.createDataFrame([("e1", "observed", "/a", "Shadow", "High", "High", ["x"])], FOUND)
    return store.record(target, "2024-01-01T00:00:00Z", seen, found, "r", "t")


@pytest.mark.parametrize("torn", ["", '{"version": 2, "schema_ver', '{"a": 1}', '{"version": "two", "schema_version": 4}', "\x00\xff"])
def test_a_torn_commit_is_passed_over(spark, folder, torn):
    store = H.History(spark, f"file://{folder}/history")
    assert one_run(spark, store) == 1
    write(folder, "history/commits/000000000002.json", torn)
    write(folder, "history/commits/000000000003.json.copying", "{}")
    assert store.runs().count() == 1 and store.endpoints().count() == 1
    assert one_run(spark, store, count=5) == 2 and store.acknowledge("t", "e1")
    assert [r.id for r in store.runs().orderBy("id").collect()] == [1, 2] and store.endpoints().first().observation_count == 5


def test_a_writer_that_dies_before_it_publishes_leaves_no_commit(spark, folder, monkeypatch):
    store = H.History(spark, f"file://{folder}/history")
    one_run(spark, store)
    with monkeypatch.context() as m:
        m.setattr(publish.os, "link", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            one_run(spark, store)
    write(folder, "history/commits/.unpublished-left", '{"version"')
    assert store.runs().count() == 1 and one_run(spark, store) == 2
    monkeypatch.setattr(publish.os, "link", lambda *a: (_ for _ in ()).throw(FileExistsError))
    monkeypatch.setattr(H.History, "ATTEMPTS", 2)
    with pytest.raises(H.HistoryBusy):
        one_run(spark, store)
    assert store.runs().count() == 2


def test_checkpoints_bound_what_a_reader_lists(spark, folder, monkeypatch):
    monkeypatch.setattr(H.History, "EVERY", 2)
    store = H.History(spark, f"file://{folder}/history")
    for i in range(1, 12):
        assert one_run(spark, store, f"t{i % 2}", i) == i
        assert len(list(Path(folder, "history/commits").glob("0*.json"))) <= 4 and len(list(Path(folder, "history/checkpoints").glob("0*.json"))) <= 2
        if i == 7:  # a torn checkpoint is no checkpoint
            write(folder, "history/checkpoints/000000000099.json", '{"schema_version": 4, "last_run": 1')
            Path(folder, "history/checkpoints/000000000099.json").unlink()
    assert len(store._state().runs) <= 6 and sorted(r.id for r in store.runs().collect()) == list(range(1, 12)) and sorted(r.run_id for r in store.findings().collect()) == list(range(1, 12))
    assert {(r.target, r.observation_count, r.first_seen_run) for r in store.endpoints().collect()} == {("t1", 11, 1), ("t0", 10, 2)}


def new_lines(reader, at):
    ranges, end = reader.read(at)
    ranges = list(ranges)
    assert ranges == list(reader.readBetweenOffsets(at, end))
    return [(r[0], x) for r in ranges for x in lines_of(*r[1:])], end


@pytest.mark.parametrize("range_bytes, look", [(3, 2), (1 << 20, 1 << 20)])
def test_tail_reader(folder, range_bytes, look, monkeypatch):
    monkeypatch.setattr(tail, "LOOK_BYTES", look)
    path = write(folder, "t.log", "a\nbcdefgh\n\npart")
    reader = TailReader(path, range_bytes)
    found, at = new_lines(reader, reader.initialOffset())
    assert found == [(0, b"a"), (0, b"bcdefgh"), (0, b"")] and at == {"epoch": 0, "bytes": 11}
    assert new_lines(reader, at) == ([], at)
    write(folder, "t.log", "a\nbcdefgh\n\npartial\n")
    found, end = new_lines(reader, at)
    assert found == [(0, b"partial")]
    write(folder, "t.log", "n\n")
    found, end = new_lines(reader, end)
    assert found == [(1, b"n")] and end == {"epoch": 1, "bytes": 2}


def test_stream_equals_a_single_run(spark, folder):
    lines = LOG.split("\n")
    log = write(folder, "grow.log", "")
    store = H.History(spark, f"file://{folder}/history")
    watch = Watch(spark, f"file://{folder}/state", history=store, target="live", report=f"file://{folder}/report")
    for n in (2, 5):
        write(folder, "grow.log", "\n".join(lines[:n]) + "\n")
        query = watch.start(tail_log(spark, log), f"{folder}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
        single = analyse(spark, log).inventory
        fields = ["id", "path_pattern", "methods", "observation_count", "auth_observed", "first_seen", "last_seen"]
        assert sorted(map(str, watch.inventory().select(fields).collect())) == sorted(map(str, single.select(fields).collect()))
    assert store.runs().count() >= 2
    last = json.loads(store.last_run("live").manifest_json)
    assert last["lines"] == {"parsed": 5} and last["endpoints_found"] == 3 and last["state_rows"] == 5
    text = "\n".join(lines) + "\n"
    cuts, digest = [0, text.index(lines[2]), len(text)], ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        digest = hashlib.sha256(f"{digest}{b - a}:{hashlib.sha256(text[a:b].encode()).hexdigest()}".encode()).hexdigest()
    assert last["consumed"] == {"algorithm": "sha256-chain", "bytes": len(text), "digest": digest}
    # the report of the last cycle is whole, and a reader of the one before still finds it
    shown = json.loads(Path(folder, "report/current.json").read_text())
    for name in (shown["folder"], shown["before"]):
        assert (Path(name.removeprefix("file://")) / "html/_SUCCESS").exists()
    assert any("/v1/books/{id}" in r.value for r in spark.read.text(f"{shown['folder']}/html").collect())
    # the same batch again replaces its part
    batch = spark.createDataFrame([(0, x) for x in lines], "epoch long, value string")
    for _ in range(2):
        watch.update(batch, 99)
    total = watch.inventory().agg(F.sum("observation_count")).first()[0]
    assert total == 2 * len(lines)


def test_the_state_has_a_row_for_each_path(spark, folder):
    rng = random.Random(3)
    paths = [f"/v1/books/{i}" for i in range(12)] + ["/v1/a", "/v1/b"]
    line = lambda path, user: f'203.0.113.9 - {user} [05/Mar/2024:08:00:00 +0000] "GET {path} HTTP/1.1" 200 512 "-" "x"'
    watch, everything = Watch(spark, f"file://{folder}/state"), []
    for batch in range(6):
        rows = [line(rng.choice(paths), rng.choice("-u")) for _ in range(rng.choice([0, 3, 20]))] + (["broken"] if batch % 3 == 0 else [])
        everything += rows
        for again in range(rng.choice([1, 2])):
            watch.update(spark.createDataFrame([(0, x) for x in rows], "epoch long, value string"), batch)
    watch.update(spark.createDataFrame([(0, x) for x in everything], "epoch long, value string"), 4)  # long since built on
    seen = {x.split('"')[1].split()[1] for x in everything if x != "broken"}
    assert watch._state().count() == len(seen) and len(list(Path(folder, "state/commits").glob("0*.json"))) <= 2
    single = analyse(spark, write(folder, "all.log", "\n".join(everything) + "\n"))
    fields = ["id", "path_pattern", "methods", "observation_count", "auth_observed", "auth_observable_count"]
    assert sorted(map(str, watch.inventory().select(fields).collect())) == sorted(map(str, single.inventory.select(fields).collect()))
    assert watch._commits()[0]["lines"] == single.counts
    # what buckets were replaced by is gone but for the last commit's
    kept = {Path(b).parent.name for c in watch._commits() for b in c["buckets"].values()}
    files = {p.parent.parent.name for p in Path(folder, "state/paths").glob("*/bucket=*/*.parquet")}
    assert kept <= files
    watch.update(spark.createDataFrame([(1, line("/new", "-"))], "epoch long, value string"), 50)
    assert [r.path_pattern for r in watch.inventory().collect()] == ["/new"] and watch._commits()[0]["lines"] == {"parsed": 1}
    watch.update(spark.createDataFrame([(0, line("/old", "-"))], "epoch long, value string"), 51)
    assert [r.path_pattern for r in watch.inventory().collect()] == ["/new"]
