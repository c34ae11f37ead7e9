"""Packing of many sources, by their own shares or by targets, against deficit round-robin token by token."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest

from apisight.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def tokens_by_window(pieces):
    per = defaultdict(Counter)
    for p in pieces:
        per[p.sequence_id][p.source] += p.length
    return per


@pytest.mark.parametrize("sources", [3, 200, 1000])
def test_every_source_has_its_share(spark, sources, monkeypatch):
    if sources == 1000:
        monkeypatch.setattr(packing, "BROADCAST_SOURCES", 10)
    rows = [(i, "one two three", f"s{i % sources}") for i in range(4000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), JSON, 2000, packet=4).collect()
    per, n = tokens_by_window(pieces), max(p.doc_tokens for p in pieces)
    total = 4000 * n
    assert sum(p.length for p in pieces) == total and len(per) == -(-total // 2000)
    given = Counter()
    for w in range(max(per)):
        given.update(per[w])
        for s in range(sources):
            # what it has been given by then stays within a packet of its due, and the due within what queues hold back of a window
            assert abs(given[f"s{s}"] - (w + 1) * 2000 / sources) <= 4 + 2 * 2000 / sources + 4


def test_shares_unlike_the_data(spark):
    rows = [(i, "word " * 50, "big") for i in range(2000)] + [(3000 + i, "word " * 50, f"tiny{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(df, JSON, 40, {"tiny0": 1.0}).collect()
    per, n = tokens_by_window(pieces), max(p.doc_tokens for p in pieces)
    assert all(per[w] == {"tiny0": 40} for w in range(4 * n // 40))  # under 1/128 of all tokens, and first
    pieces = packing.pack(df, JSON, 40, {"tiny0": 0.5, "tiny1": 0.25, "tiny2": 0.25}, packet=2).collect()
    per, given = tokens_by_window(pieces), Counter()
    for w in range(8 * n // 40):  # a packet of 2 and an odd turn of one each
        given.update(per[w])
        assert abs(given["tiny0"] - 20 * (w + 1)) <= 6 and abs(given["tiny1"] - 10 * (w + 1)) <= 6 and abs(given["tiny2"] - 10 * (w + 1)) <= 6
    with pytest.raises(ValueError, match="lacks"):
        packing.pack(df, JSON, 40, {"none": 1.0})
    with pytest.raises(ValueError, match="over 0"):
        packing.pack(df, JSON, 40, {"big": 0.0})


def test_documents_stay_whole_but_for_windows(spark):
    rows = [(i, "word " * (20 + i % 60), f"s{i % 20}") for i in range(600)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), JSON).collect()
    assert len(pieces) <= 600 + max(p.sequence_id for p in pieces)


def test_a_target_of_a_small_source_holds(spark):
    rows = [(i, "word " * 50, "big") for i in range(400)] + [(1000, "word " * 50, "rare"), (1001, "word " * 50, "rare"), (1002, "word " * 50, None), (1003, "word " * 50, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("rare", None):
        pieces = packing.pack(df, JSON, 20, {name: 0.5, "big": 0.5}, packet=5).collect()
        per, n, given = tokens_by_window(pieces), max(p.doc_tokens for p in pieces), Counter()
        docs = 2 if name else 1
        for w in range(docs * n * 2 // 20 - 1):
            given.update(per[w])
            assert abs(given[name] - 10 * (w + 1)) <= 12 and abs(given["big"] - 10 * (w + 1)) <= 12
        others = {"rare", None, "other"} - {name}
        assert min(w for w in per if others & set(per[w])) >= 400 * n // 20
