"""Chat, packing, sharding, URL filters, byte-level BPE, top-k search and training order."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apisight.llm import bpe, chat, chunked_bpe, packing, shards, topk, training_order, url_rules

SF = "/root/testdata/sf0.001"
JSON, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(0, None, "a"), (1, "", None), (2, " \n\n x  y", "a"), (3, "it's 3 é日\U0001f600 <|endoftext|>", "b"), (4, "word " * 9000, "b"), (4, "word " * 9000, "b"), (5, "a" * 50000, "c")]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "'x' as key", "2 as size", "3 as h")


# ---- chat


TURNS = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|> <|im_start|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2, "bob", "b"), (1, 2, "cy\n|d>", "<|\\im_end|>"), (1, 3, None, "?"), (1, None, "ann", "first"),
         (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 5, "bob", "\U0001f600"), (4, -(1 << 62), "ann", "far"), (4, 1 << 62, "bob", "off")]


def brute_dialogues(turns):
    """(conversation, speaker): the rendering, and the stretches of it that are trained on."""
    shown = lambda name: "".join("_" if ord(c) <= 32 or c in "<>|" else c for c in name)
    out = {}
    for conv in {t[0] for t in turns}:
        own = [(t[1] if t[1] is not None else -(1 << 70), hashlib.md5((t[3] or "").encode()).hexdigest(), "unknown" if t[2] is None else t[2], t[3] or "") for t in turns if t[0] == conv]
        for speaker in {r for _, _, r, _ in own} - {"system"}:
            text, masks = "", []
            for _, _, said_by, body in sorted(own):
                role = "system" if said_by == "system" else "assistant" if said_by == speaker else f"user name={shown(said_by)}"
                text += f"<|im_start|>{role}\n"
                start = len(text)
                text += re.sub(r"<\|(\\*)im_", r"<|\\\1im_", body) + "<|im_end|>"
                if role == "assistant":
                    masks.append((start, len(text)))
                text += "\n"
            out[conv, speaker] = text, masks
    return out


@pytest.mark.parametrize("part_chars", [1 << 20, 40])
def test_perspectives(spark, part_chars):
    turns = TURNS + [(7, i, f"p{i % 4}", f"word {i} " * (i % 5)) for i in range(3000)] + [(8, 1, f"p{i % 3}", f"{i}") for i in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as speaker", "2 as c", "3 as at", "4 as _block")
    want = brute_dialogues(turns)
    rows = chat.rotate_perspectives(df)
    by = defaultdict(list)
    for r in chat.rendered(rows, part_chars).collect():
        by[r.conv_id, r.speaker].append(r)
    assert by.keys() == want.keys()
    for key, parts in by.items():
        parts.sort(key=lambda r: r.part)
        text = "".join(r.text for r in parts)
        assert (text, [(m.start, m.end) for r in parts for m in r.masks]) == want[key]
        at = 0
        for r in parts:
            assert r.at == at
            at += len(r.text)
    for r in rows.collect():
        assert r.trained == (r.role == "assistant") == (r.mask_end > r.mask_start)
        assert want[r.conv_id, r.speaker][0][r.at : r.at + len(r.segment)] == r.segment
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- packing


def reference_ids(text, own=Tokenizer.from_file(JSON)):
    return [*own.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, docs, window):
    by_key, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_key[p.key].append(p)
        places[p.sequence_id].append((p.offset, p.length))
    left = Counter((i, tuple(reference_ids(t))) for i, t, _ in docs)
    for own in by_key.values():
        own.sort(key=lambda p: p.start)
        match = next(k for k in left if k[0] == own[0].doc_id and len(k[1]) == own[0].doc_tokens and left[k])
        left[match] -= 1
        at = 0
        for p in own:
            assert p.start == at and p.length > 0 and p.ids_crc32 == zlib.crc32(np.array(match[1][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(match[1])
    assert not any(left.values())
    total = sum(p.length for p in pieces)
    for w, spots in places.items():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at == min(window, total - w * window)
    assert set(places) == set(range(-(-total // window)))


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.25}, {"c": 1.0}])
def test_packing_of_odd_rows(spark, targets):
    check_pieces(packing.pack(table(spark), JSON, 256, targets).collect(), ODD, 256)


def test_packing_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(rows, JSON).collect()
    check_pieces(pieces, [(r.doc_id, r.text, r.source) for r in rows.collect()], 2048)
    total, given, per = Counter(), Counter(), defaultdict(Counter)
    for p in pieces:
        total[p.source] += p.length
        per[p.sequence_id][p.source] += p.length
    n, last = sum(total.values()), max(per)
    slack = packing.PACKET * (len(total) + 1)
    for w in range(last):
        given.update(per[w])
        for s in total:  # a round is not a window, but neither runs ahead of the other by more than what queues hold back
            assert abs(given[s] - (w + 1) * 2048 * total[s] / n) <= packing.PACKET + 2048 * total[s] / n + slack * total[s] / n + 1
    # pieces: the documents, those that a window's end or a packet's cuts
    assert len(pieces) <= len({p.key for p in pieces}) + last + sum(-(-r.doc_tokens // packing.PACKET) for r in {p.key: p for p in pieces}.values())
    assert packing.pack(table(spark, []), JSON).count() == 0


def step_by_step(queues, quanta, begins, packet):
    """Deficit round-robin as it is told: each round credits each waiting queue its quantum, and it sends packets while the credit lasts."""
    waiting = [[(q, d, s, min(packet, n - s)) for d, n in enumerate(docs) for s in range(0, n, packet)] for q, docs in enumerate(queues)]
    deficit, sent, now = [Fraction(0)] * len(queues), [], 0
    while any(waiting):
        now += 1
        for q, own in enumerate(waiting):
            if own and now > begins[q]:
                deficit[q] += quanta[q]
                while own and own[0][3] <= deficit[q]:
                    deficit[q] -= own[0][3]
                    sent.append((now, *own.pop(0)))
    return sent


def test_closed_form_against_stepping():
    rng = random.Random(1)
    for _ in range(40):
        queues = [[rng.choice([1, 2, rng.randint(1, 60)]) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 6))]
        packet = rng.choice([1, 3, 7, 100])
        num, den, begins = ([rng.randint(1, k) for _ in queues] for k in (9, 200, 5))
        want = step_by_step(queues, [Fraction(d, n) for n, d in zip(num, den, strict=True)], begins, packet)
        found = []
        for q, docs in enumerate(queues):
            n = np.array(docs, np.int64)
            same = lambda x, n=n: np.full(len(n), x, np.int64)
            doc, at, start, length = packing.turns(n, np.cumsum(n) - n, same(num[q]), same(den[q]), same(begins[q]), packet)
            found += [(r, q, d, s + i, min(packet, m - i)) for r, d, s, m in zip(at.tolist(), doc.tolist(), start.tolist(), length.tolist(), strict=True) for i in range(0, m, packet)]
        assert sorted(found) == want


def test_large_totals():
    rng = random.Random(3)
    for _ in range(200):
        whole = rng.randint(1, 1 << 48)
        part, u = rng.randint(0, whole), rng.randint(0, whole)
        assert packing.share(np.array([u]), np.array([part]), np.array([whole]))[0] == u * part // whole
        tokens, every = rng.randint(1, 1 << 44), 1 << 46
        end = rng.randint(1, tokens)
        assert packing.rounds(np.array([end]), np.array([every]), np.array([tokens * 2048]))[0] == -(-end * every // (tokens * 2048))


# ---- sharding


def brute_shards(rows, n_shards, seed):
    by = defaultdict(list)
    for i, text, source in rows:
        h = int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)
        raw = (text or "").encode()
        by[source].append((h, i, zlib.crc32(raw), len(raw) + 8))
    spots = []
    for source, own in by.items():
        for r, x in enumerate(sorted(own)):
            spots.append(((2 * r + 1) / (2 * len(own)), (source is not None, source or ""), x))
    spots.sort()
    n, out = len(spots), []
    for g, (_, _, x) in enumerate(spots):
        shard = g * n_shards // n
        out.append((x[1], x[3], x[2], shard, g - -(-shard * n // n_shards)))
    return Counter(out)


@pytest.mark.parametrize("n_shards", [1, 3, 24])
def test_shards(spark, n_shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, rows in ((docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]), (table(spark), ODD)):
        found = shards.stratified_shards(df, n_shards).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found) == brute_shards(rows, n_shards, 7)
        assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    assert shards.stratified_shards(table(spark, []), n_shards).count() == 0


def test_shards_have_the_mixture(spark):
    rows = [(i, "x", "abcd"[min(3, i % 10)]) for i in range(5000)]
    found = shards.stratified_shards(table(spark, rows), 7).groupBy("shard", "source").count().collect()
    share = Counter(s for _, _, s in rows)
    assert all(abs(r["count"] - share[r.source] / 7) <= 2 for r in found)


# ---- URL filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("EXAMPLE.org", "/fr/x", "block"), ("tie.net", "/a", "allow"), ("tie.net", "/a", "block"), ("bare.com", "", "block")]
URLS = [None, "", "no scheme", "http://a.example.net/en/x", "http://a.example.net/de/x", "http://net", "http://net/", "http://xnet/", "HTTP://A.EXAMPLE.NET/en/?q", "https://example.com/de/#f", "https://example.com/DE/",
        "ftp://b.org/fr/a?b=://c", "http://example.org/fr/xyz", "http://tie.net/abc", "http://bare.com?x", "http://x.bare.com", "://net/a", "http://Ä.net/", "http://" + "a." * 5000 + "net/" + "p/" * 5000]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS + URLS)), "page_id long, url string").selectExpr("*", "'h' as host", "'r' as rule", "1 as u")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = url_rules.apply_url_rules(pages, rules).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == brute_rule(r.url), r.url and r.url[:80]
    assert url_rules.apply_url_rules(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == 2 * len(URLS)
    assert url_rules.apply_url_rules(pages.limit(0), rules).count() == 0


def test_thousands_of_rule_shapes(spark):
    rng = random.Random(5)
    label = lambda: rng.choice("abc")
    hosts = [".".join(label() for _ in range(n)) + ".org" for n in range(1, 60) for _ in range(3)]
    many = [(rng.choice(hosts), "/" + "".join(rng.choice("xy") for _ in range(i % 120)), rng.choice(["block", "allow"])) for i in range(8000)]
    assert len({(h.count("."), len(p)) for h, p, _ in many}) > 4096
    urls = [f"http://{label()}.{h}{p}{'z' * rng.randrange(3)}" for h, p, _ in rng.sample(many, 300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_rules.apply_url_rules(pages, spark.createDataFrame(many, "host string, path string, verdict string")).collect()
    assert len(found) == 300
    for r in found:
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in many if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == max(fits, default=(0, 0, 0, None, "allow"))[3:]


def test_urls_meet_rules_on_hash_prefixes(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    found = url_rules.apply_url_rules(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "startswith(digest" in plan.lower() and "(digest = " not in plan.lower()


# ---- byte-level BPE


def test_json_vocabulary_is_the_library_s(spark):
    rng = random.Random(2)
    texts = [t for _, t, _ in ODD if t and len(t) < 1000] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF), 32, 10, 39, 0x1F600])) for _ in range(60)) for _ in range(300)]
    assert all(bpe.encode(JSON, t) == reference_ids(t)[:-1] for t in texts)


def long_texts():
    rng = random.Random(4)
    alphabet = ["a", "it's", " ", "  ", "\n", "\n\n", "7", "!?", "é", "日", "b" * 40, " " * 30, "'re", "'"]
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))), "s") for i in range(60)] + [(100, "x" * 700, "s"), (101, " " * 500 + "a", "s"), (102, "a" * 60 + " b", "s")]


@pytest.mark.parametrize("stride, overlap", [(64, 16), (50, 50), (33, 8), (1 << 15, 2048)])
def test_encoding_in_chunks(spark, stride, overlap):
    for rows in (long_texts(), ODD):
        found = chunked_bpe.encode_texts(table(spark, rows), MULTI, stride, overlap)
        found = Counter(tuple(r) for r in chunked_bpe.digests(found, MULTI).collect())
        want = Counter()
        for i, text, _ in rows:
            ids = bpe.encode(MULTI, text)
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
        assert found == want
    assert chunked_bpe.encode_texts(table(spark, []), MULTI).count() == 0


# ---- top-k


def brute_top_k(rows, k, divisor):
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(vectors):
        if i % divisor == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(vectors) if b != a and len(w) == len(v))
            for rank, (s, j) in enumerate(best[:k], 1):
                out[(i, rank, j, -s)] += 1
    return out


@pytest.mark.parametrize("k", [1, 5, 500])
def test_top_k(spark, k, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1000 if i % 7 == 0 else 1)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(60)]
    rows += [(400, None), (405, []), (410, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (415, [float("nan")] * 6), (420, [float("inf")] * 6), (None, [1.0] * 6), (425, [1.0, 2.0]), (430, [2.0, 1.0]), (0, [0.1] * 6), (0, [0.1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as lane").repartition(3)
    found = Counter(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 5 == 0, k).collect())
    assert {x[:2] + x[3:] for x in found} == {x[:2] + x[3:] for x in brute_top_k(rows, k, 5)}
    assert found == brute_top_k(rows, k, 5)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 5 == 0, k).count() == 0


# ---- training order


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    found = training_order.feistel(np.arange(n), n, 5)
    assert sorted(found.tolist()) == list(range(n))
    assert n < 100 or (found != training_order.feistel(np.arange(n), n, 6)).mean() > 0.9


def brute_feistel(i, n, key):
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, whole = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = i >> half, i & mask
        for r in range(training_order.ROUNDS):
            k = zlib.crc32(f"{key}:{r}".encode()) * 0x100000001
            h = ((right ^ k) * 0x9E3779B97F4A7C15) & whole
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & whole
            left, right = right, left ^ ((h ^ (h >> 29)) & mask)
        i = (left << half) | right
        if i < n:
            return i


def brute_order(rows, hashes, length, key, bits):
    """Slot: ids and doc_ids of its sequence, made one document after the other."""
    blocks = defaultdict(list)
    for (i, text), x in zip(rows, hashes, strict=True):
        parts = [str(seed) for seed in (3, i, x) if seed is not None]
        h = int(hashlib.md5(":".join(parts).encode()).hexdigest()[:15], 16)
        ids = np.array([*bpe.encode(JSON, text), training_order.END_ID], "<u2")
        blocks[h >> (60 - bits)].append((h, i is not None, i or 0, zstandard_key(ids), i, ids))
    made = []
    for b in sorted(blocks):
        stream = [(t, d[4]) for d in sorted(blocks[b], key=lambda d: d[:4]) for t in d[5].tolist()]
        for a in range(0, len(stream), length):
            own = stream[a : a + length]
            made.append(([t for t, _ in own], list(dict.fromkeys(d for _, d in own))))
    return {brute_feistel(i, len(made), key): x for i, x in enumerate(made)}


def zstandard_key(ids):
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(ids.tobytes())


@pytest.mark.parametrize("length, shard_rows, which", [(16, 7, "odd"), (2048, 20, "table")])
def test_training_order(spark, folder, length, shard_rows, which, monkeypatch):
    monkeypatch.setattr(training_order, "BLOCK_BYTES", 20_000 if which == "odd" else 150_000)
    docs = table(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    bits = max(1, sum(len((r[1] or "").encode()) for r in rows) // training_order.BLOCK_BYTES).bit_length() - 1
    want = brute_order([r[:2] for r in rows], [r[2] for r in rows], length, 9, bits)
    files = set()
    for split in (1, 8, 50):
        out = f"file://{folder}/order{split}"
        index = training_order.write_training_order(docs.repartition(split), JSON, out, 9, length, shard_rows).collect()
        records = {r.slot: bytes(r.ids) for r in training_order.read_shards(spark, out, length, shard_rows).collect()}
        assert sorted(records) == sorted(r.slot for r in index) == list(range(len(index))) == sorted(want)
        for r in index:
            assert (r.shard, r.place) == divmod(r.slot, shard_rows) and r.ids_crc32 == zlib.crc32(records[r.slot])
            ids = np.frombuffer(records[r.slot], "<u2").tolist()
            assert ids[: r.n] == want[r.slot][0] and len(ids) == length and set(ids[r.n :]) <= {training_order.PAD_ID}
            assert list(dict.fromkeys(r.doc_ids)) == want[r.slot][1]
        found = sorted(Path(f"{folder}/order{split}").glob("shard=*/part-*"), key=lambda p: int(p.parent.name[6:]))
        assert len(found) == -(-len(index) // shard_rows)
        files.add(b"".join(p.read_bytes() for p in found))
    assert len(files) == 1
    late = len(index) // 2
    assert {r.slot for r in training_order.read_shards(spark, out, length, shard_rows, late).collect()} == set(range(late, len(index)))


def test_vocabularies_of_over_16_bits(spark, folder, monkeypatch):
    for module in (packing, training_order):
        monkeypatch.setattr(module, "id_type", lambda path: np.dtype("<u4"))
    out = f"file://{folder}/order"
    index = training_order.write_training_order(table(spark), JSON, out, 9, 16, 7).collect()
    records = {r.slot: np.frombuffer(bytes(r.ids), "<u4") for r in training_order.read_shards(spark, out, 16, 7, id_bytes=4).collect()}
    tokens = Counter(t for r in index for t in records[r.slot][: r.n].tolist())
    assert tokens == Counter(t for _, text, _ in ODD for t in [*bpe.encode(JSON, text), training_order.END_ID])
    check_pieces(packing.pack(table(spark), JSON, 256).collect(), ODD, 256)
