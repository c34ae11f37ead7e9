"""Every query with SQL gives what DuckDB gives."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v
    return sorted([tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    found, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_redacted_documents(spark):
    found = QUERIES["redact_documents"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() and {r.ends for r in found} == {"/p/<redacted>/q. <redacted>"}


def test_grouped_findings_name_every_member(spark):
    want = {}
    for r in QUERIES["group_members"](spark, SF).collect():
        want.setdefault((r.classification, r.reason), []).append((r.path_pattern, r.subject_kind))
    found = QUERIES["grouped_findings"](spark, SF).collect()
    assert {(r.classification, r.reason): r.paths for r in found} == {k: " ".join(path for path, _ in sorted(m)) for k, m in want.items()}
    assert any(not r.in_detail for r in found)


def test_derived_data_shows_every_verdict_and_reason(spark):
    full = QUERIES["classify_full"](spark, SF).collect()
    assert {r.classification for r in full} == {"Shadow", "Zombie", "Undetermined", "Known"}
    assert any("just as close" in r.evidence and r.severity for r in full) and any(r.confidence == "Medium" and r.severity == "High" for r in full)
    assert len(QUERIES["discard_reasons"](spark, SF).collect()) == 8
    rules = QUERIES["allowlist_full"](spark, SF).collect()
    assert {2, 5, 7, None} == {r.rule_line for r in rules}
    for name in ("new_endpoints", "first_seen_in", "pending_alerts"):
        assert QUERIES[name](spark, SF).count() > 0
    assert QUERIES["clock_backwards"](spark, SF).where("went_back").count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
