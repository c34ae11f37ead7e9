"""Merkle manifests, benchmark decontamination and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from apisight.llm import collocations, decontaminate, merkle
from apisight.llm import queries as llm

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- Merkle manifest


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        out.append((nodes[first:at], nodes[at + 1 : first + 8]))
        at //= 8
    return out


def brute_manifest(rows):
    """Of (doc_id, source, lang, n_chars, text): the result's rows."""
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(levels_of([leaf(r) for r in langs[lang]]))
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for at, lang in enumerate(order):
        for i, row in enumerate(langs[lang]):
            path = path_of(trees[at], i) + path_of(top, at)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = leaf((*row[:4], row[4] and row[4].translate(LOWER))) if hit else leaf(row)
            for left, right in path:
                now = sha("".join([*left, now, *right]))
            out.append((row[0], leaf(row), trees[at][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def found_manifest(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=repr)


def some_rows(n, langs=("en", "de", None, "\U0001f600", "ﬀ", "é"), seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i - 5]) if rng.random() < 0.1 else i - 5, rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, i, -i]), rng.choice([None, "", "Ab É\U0001f600", "low"])) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("n", "levels"), [(1, 3), (2, 3), (8, 3), (9, 1), (200, 1), (700, 1), (700, 2), (1500, 3)])
def test_manifest_of_odd_rows(spark, n, levels):
    rows = some_rows(n)
    assert found_manifest(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), levels)) == brute_manifest(rows)


def test_manifest_of_one_group_with_a_third_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 50)
    rows = [(7, "s", "en", 1, "Same")] * 300 + [(i, None, "en", None, f"T{i}") for i in range(600)]
    assert found_manifest(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), 2)) == brute_manifest(rows)


def test_manifest_of_many_groups(spark):
    rows = [(i, None, f"l{i % 90}", 1, "X") for i in range(300)]
    assert found_manifest(merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), 1)) == brute_manifest(rows)


def test_manifest_of_the_table_and_of_nothing(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found_manifest(llm.op11_merkle(spark, SF)) == brute_manifest(rows)
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_finds_what_was_changed(spark):
    rows = spark.createDataFrame([(i, "g", bytes([i % 256]) * 32, None if i != 70 else b"\1" * 32) for i in range(100)], "id long, grp string, leaf binary, presented binary")
    found = merkle.audit(merkle.build_manifest(rows, "grp", ["id"]), "presented").collect()
    assert [r.id for r in found if not r.verified] == [70] and len(found) == 100


def test_layout_is_a_van_emde_boas_layout():
    for height in range(1, 6):
        every = [merkle.address(height, d, np.arange(8**d)) for d in range(height)]
        assert sorted(np.concatenate(every).tolist()) == list(range(merkle._size(height)))
    # four levels: two on top, then each tree of two levels after the other
    assert merkle.address(4, 1, np.arange(8)).tolist() == list(range(1, 9))
    assert merkle.address(4, 2, np.arange(3)).tolist() == [9, 18, 27]
    assert merkle.address(4, 3, np.arange(9)).tolist() == [*range(10, 18), 19]


# ---- decontamination


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in docs:
        w, hit, of = item_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    of |= wins[tuple(w[i : i + n])]
        listed = sorted(str(x) for x in of if x is not None)
        out.append((doc, len(w), len(hit), len(listed), sha(",".join(listed)), bool(hit)))
    return sorted(out, key=repr)


def found_hits(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()], key=repr)


def decontamination_case(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "\U0001f600x", "9", "don't", "É", "w-w"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "_", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 7, 9, 10, 11, 30]) if i > 3 else 40)) for i in range(25)]
    items = [x for x in items if len(item_words(x[1])) > 2] + [(90, None), (91, ""), (92, " ,"), (None, "q w e r t y u i o p"), (93, "Q w e r t y u i o p z"), (93, "dup dup dup dup")]
    docs = [(i, text(rng.choice([0, 1, 9, 50, 300]))) for i in range(60)]
    docs += [(100 + i, text(5) + items[i][1] + text(5)) for i in range(4)]
    docs += [(200, None), (201, ""), (202, "x q W e R t y u i o P"), (202, "x q W e R t y u i o P"), (202, "other"), (None, "é9 q w e r t y u i o p"), (203, "dup-dup,dup  dup dup")]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as th", "2 as pos", "3 as k_id"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h")


@pytest.mark.parametrize("seed", [3, 4])
def test_contamination(spark, seed):
    docs, items = decontamination_case(seed)
    found = found_hits(decontaminate.contamination(*tables(spark, docs, items)))
    assert found == brute_hits(docs, items) and sum(r[5] for r in found) > 5


def test_contamination_of_long_texts_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LONG_CHARS", 50)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 60)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    docs, items = decontamination_case(5)
    rng = random.Random(1)
    docs += [(300 + i, " ".join(rng.choice("abc") for _ in range(n)) + " z " + items[0][1]) for i, n in enumerate([49, 50, 51, 55, 59, 60, 61, 119, 120, 500])]
    assert found_hits(decontaminate.contamination(*tables(spark, docs, items))) == brute_hits(docs, items)


def test_contamination_of_a_smaller_window_and_of_nothing(spark):
    docs, items = decontamination_case(6)
    items = [x for x in items if len(item_words(x[1])) >= 7]
    d, b = tables(spark, docs, items)
    assert found_hits(decontaminate.contamination(d, b, 7)) == brute_hits(docs, items, 7)
    assert found_hits(decontaminate.contamination(d, b.where("false"))) == brute_hits(docs, [])
    assert found_hits(decontaminate.contamination(d.where("false"), b)) == []


def test_removal(spark):
    docs = [(1, "Keep this. ONE two, three four five six seven eight nine ten; and that"), (2, "clean É text"), (3, None), (4, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten eleven, x one two three four five six seven eight nine ten\n!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as d", "2 as runs", "3 as key_id", "4 as `a.b`")
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [2, 3]
    cut = decontaminate.decontaminate(d, b, whole=False)
    assert cut.columns == d.columns and {r.doc_id: r.text for r in cut.collect()} == {1: "Keep this. and that", 2: "clean É text", 3: None, 4: "", 5: "eleven, x "}


def test_contamination_of_the_table(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*[f"{'doc' if t == 'documents' else 'item'}_id", "text"]).collect()]
    assert found_hits(llm.op12_decontamination(spark, SF)) == brute_hits(read("documents"), read("benchmark"))


# ---- collocations


def brute_counts(docs):
    n, f = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    return n, f


def brute_collocations(docs, least, top):
    n, f = brute_counts(docs)
    some = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    rows = defaultdict(list)
    for p, a in some.items():
        longer = [q for q in some if q[0] == p[0] and len(q) > len(p) and any(q[1 + i : 1 + i + len(p) - 1] == p[1:] for i in range(len(q) - len(p) + 1))]
        if any(some[q] >= a for q in longer):
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        rows[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


def found_collocations(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def collocation_case(seed=1, texts=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "É", "\U0001f600", "d'd", "(x)", "\x00z", "ﬀ"]
    phrases = ["a B c", "é É é É é", "x y", "p q r s t", "one two three four five six"]
    text = lambda: "".join(rng.choice(words + phrases) + rng.choice([" "] * 8 + ["  ", "\t", ". ", "\n", ", ", "!", " \x0b "]) for _ in range(rng.choice([0, 1, 5, 80])))
    docs = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(texts)]
    return docs + [("en", None), ("en", ""), ("xx", " . "), (None, None)] + docs[:5]


def texts(spark, docs):
    return spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as h", "2 as times", "3 as phrase")


@pytest.mark.parametrize(("seed", "stretch", "top", "bits"), [(1, 1 << 21, 2000, 64), (2, 100, 2000, 64), (3, 7, 12, 64), (1, 1000, 2000, 9), (2, 50, 2000, 5)])
def test_collocations(spark, seed, stretch, top, bits):
    docs = collocation_case(seed)
    found = found_collocations(collocations.collocations(texts(spark, docs), 10, top, stretch=stretch, bits=bits))
    assert found == brute_collocations(docs, 10, top) and len(found) > 20


def test_collocations_with_colliding_fingerprints(spark, monkeypatch):
    docs = collocation_case(4, 40)
    few = lambda self, n: (np.full(max(0, len(self.code) - n + 1), n << 60, np.uint64), _grams(self, n)[1])
    _grams = collocations.Stretch.grams
    want = collocations.stretches
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in docs]), pa.array([x or "" for _, x in docs])], ["lang", "text"])
    real, blurred = Counter(), Counter()
    for counts in (real, blurred):
        if counts is blurred:
            monkeypatch.setattr(collocations.Stretch, "grams", few)
        for found in want(batch, 500):
            for n in range(1, 6):
                h, valid = found.grams(n)
                for row in collocations._occurring(found, n, valid, h).to_pylist():
                    counts[row["lang"], row["phrase"], row["size"]] += row["times"]
    n, f = brute_counts(docs)
    assert real == blurred == Counter({(p[0], " ".join(p[1:]), len(p) - 1): a for p, a in f.items()})


def test_long_words_and_blanks():
    text = "a b c " + "w" * 50 + " d" + " " * 60 + "e f. g" + "." * 40 + "h i j k l"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    for size in (1, 3, 10, 45, 1000):
        got = Counter()
        for found in collocations.stretches(batch, size):
            for n in range(1, 6):
                h, valid = found.grams(n)
                got.update({r["phrase"]: r["times"] for r in collocations._occurring(found, n, valid, h).to_pylist()})
        assert got == Counter({" ".join(p[1:]): a for p, a in brute_counts([("en", text)])[1].items()})


def test_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 7 * 10**12 + 1)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    real = collocations.phrase_counts
    collocations.phrase_counts = lambda *a: (totals, rows)
    try:
        found = collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    finally:
        collocations.phrase_counts = real
    assert [r.score for r in found] == [1000 * 10**12 * 10**14 // (3 * 10**12 * (7 * 10**12 + 1))]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(texts(spark, [("en", None)]), 1).collect() == []
    assert collocations.collocations(texts(spark, [("en", "x")]).where("false"), 1).collect() == []
