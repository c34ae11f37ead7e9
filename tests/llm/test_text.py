"""Line deduplication, quality rules, n-gram join and the pipeline against brute force."""

import re
from collections import Counter
from math import comb

import pytest

import corpus_pipeline
from apisight.llm import line_dedup, ngram_join, quality
from apisight.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in texts], schema)


ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "a b c d e f g"), (6, "A b c d e f g"), (6, "A b c d e f g"), (7, "x " * 30000), (8, "é 日 \U0001f600 # $"), (9, "l1\nl2\nl3\nl4"), (10, "l1\nl2\nl3\nl4"), (11, "z\nl2\nl3\nl4\nz")]


# ---- brute force


def dedup(docs):
    seen, out = set(), {}
    for i, text in sorted({(i, t) for i, t in docs if t is not None}):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if WORD.search("".join(w)):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def sets(docs, k):
    out = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def groups(docs, k, percent):
    s = sets(docs, k)
    parent = {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i in s:
        for g in s[i]:
            where.setdefault(g, []).append(i)
    for i in s:
        for j, n in Counter(j for g in s[i] for j in where[g] if j < i).items():
            if 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in s}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- line dedup


@pytest.mark.parametrize("which", ["odd", "table"])
def test_line_dedup(spark, documents, which):
    docs = ODD if which == "odd" else documents
    want = dedup(docs)
    found = line_dedup.dedup_lines(table(spark, docs)).collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r.text, r.removed_lines) == want.get(r.doc_id, (None, 0))


def test_line_dedup_of_nothing_and_of_clashing_names(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    df = table(spark, ODD).withColumnsRenamed({"lang": "lines", "source": "pos"}).selectExpr("*", "'x' as first", "1 as removed_lines", "2 as w1", "3 as _id", "4 as later", "5 as d", "6 as `a.b`")
    found = line_dedup.dedup_lines(df)
    assert found.columns == [c for c in df.columns if c != "removed_lines"] + ["removed_lines"]
    rows = found.collect()
    want = dedup(ODD)
    assert len(rows) == len(ODD) and all((r.text, r.removed_lines) == want.get(r.doc_id, (None, 0)) and (r["_id"], r.later, r.d, r["a.b"]) == (3, 4, 5, 6) for r in rows)


# ---- quality rules


@pytest.mark.parametrize("which", ["odd", "table"])
def test_metrics(spark, documents, which):
    docs = ODD if which == "odd" else documents
    for r in quality.text_metrics(table(spark, docs)).collect():
        assert {m: r[m] for m in quality.METRICS} == metrics(r.text)


def test_binomial_bounds():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (200, 17, 0.1)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_cdf(k, n, p) - exact) < 1e-9
        bound = quality.upper_bound(k, n, 0.05)
        assert abs(quality.binomial_cdf(k, n, bound) - 0.05) < 1e-6


def test_cutoffs_reject_certified_junk_only(spark):
    good = [(i, "w" + " word" * 5 + f" a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(2000)]
    bad = [(2000 + i, f"a{i} # b{i} # c{i} # d{i} # e{i} # f{i} #") for i in range(300)]
    few = [(9000 + i, f"a{i} # b{i} # c{i} # d{i} # e{i} # f{i} #") for i in range(20)]
    df = spark.createDataFrame([(i, t, "en") for i, t in good + bad] + [(i, t, "xx") for i, t in few], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad + few] + [(None, 1)], "doc_id long, quality int")
    found = quality.quality_verdicts(df, labels, "lang").collect()
    assert all(r.kept for r in found if r.doc_id < 2000)
    assert not any(r.kept for r in found if 2000 <= r.doc_id < 9000)
    assert all(r.kept for r in found if r.doc_id >= 9000)  # a stratum with too few labels has no cutoff


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    clash = table(spark, ODD).selectExpr("*", "1 as stratum", "true as kept", "2 as cut_symbols", "3 as _stratum", "4 as cutoffs", "5 as quality", "6 as _doc")
    rows = quality.quality_verdicts(clash, labels).collect()
    assert all((r.cut_symbols, r["_stratum"], r.cutoffs, r.quality) == (2, 3, 4, 5) for r in rows)
    assert len(rows) == len(ODD) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)
    assert quality.quality_verdicts(table(spark, []), labels).count() == 0


def exact_cdf(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def brute_cutoffs(rows, marks):
    """rows: (doc_id, stratum, text, metrics). The chosen cutoff of each stratum and rule, by the definition."""
    value = {"symbols": lambda m: m["n_symbols"] / max(m["n_words"], 1), "dup_lines": lambda m: m["n_dup_lines"] / max(m["n_lines"], 1), "repeats": lambda m: m["n_repeat_words"] / max(m["n_words"], 1)}
    held = {}
    for i, stratum, text, m in rows:
        if i in marks and m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]:
            mark = max(marks[i], held.get((stratum, text), (0,))[0])
            held[stratum, text] = (mark, m)
    strata = {s for s, _ in held}
    each, error = 0.05 / 3, 0.05 / (len(strata) * 3 * 7)
    out = {}
    for stratum in strata:
        good = [m for (s, _), (q, m) in held.items() if s == stratum and q == 1]
        bad = [m for (s, _), (q, m) in held.items() if s == stratum and q == 0]
        for rule, of in value.items():
            best = (0.0, None)
            for cut in quality.GRID:
                k, n = sum(of(m) > cut for m in good), len(good)
                if n and exact_cdf(k, n, each) <= error:
                    low, high = k / n, 1.0
                    for _ in range(40):
                        middle = (low + high) / 2
                        low, high = (low, middle) if exact_cdf(k, n, middle) <= error else (middle, high)
                    score = sum(of(m) > cut for m in bad) / max(len(bad), 1) - quality.GAIN * high
                    if score > 0 and score >= best[0]:
                        best = (score, cut)
            out[stratum, rule] = best[1]
    return out, value


def test_verdicts_against_brute_force(spark):
    """At a size where cutoffs exist; a third of the good documents are copies, which count once."""
    docs = []
    for i in range(2400):
        words = [f"{c}{i}" for c in "abcdefghijklmnop"]
        junk = i % 5 == 0
        words += ["#"] * (4 if junk else i % 40 == 1)
        docs.append((i, " ".join(words) if i % 3 else " ".join(words) + "\nx y\n" * (1 + i % 2), f"l{i % 2}"))
    docs += [(10_000 + i, docs[1][1], "l1") for i in range(1200)]
    marks = {i: int(i % 5 != 0) for i, _, _ in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    found = quality.quality_verdicts(df, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"), "lang").collect()
    rows = [(i, s, t, metrics(t)) for i, t, s in docs]
    cutoffs, value = brute_cutoffs(rows, marks)
    assert any(c is not None for c in cutoffs.values()) and any(c is None for c in cutoffs.values())
    want = {}
    for i, s, _, m in rows:
        failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
        want[i] = not failed and not any(cutoffs[s, r] is not None and of(m) > cutoffs[s, r] for r, of in value.items())
    assert {r.doc_id: r.kept for r in found} == want and not all(want.values())


# ---- n-gram Jaccard join


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_components_of_documents(spark, documents, k, percent):
    want = groups(documents, k, percent)
    found = ngram_join.ngram_components(table(spark, documents), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    kept = {r.doc_id for r in ngram_join.keep_one(table(spark, documents), k, percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_components_of_odd_rows(spark):
    want = groups(dict(ODD).items(), 4, 85)
    found = ngram_join.ngram_components(table(spark, ODD)).collect()
    assert len(found) == len(ODD) and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert ngram_join.ngram_components(table(spark, [])).count() == 0
    nulls = ngram_join.ngram_components(table(spark, [(None, "a b c d e"), (1, "a b c d e")])).collect()
    assert {(r.doc_id, r.component_id) for r in nulls} == {(None, None), (1, 1)}


def test_components_of_chains_and_large_groups(spark):
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*base[:i], *[f"x{j}" for j in range(i)], *base[i:]][i : i + 80])) for i in range(24)]
    for i in range(120):  # near copies, each changed in places of its own, some too much
        words = [f"g{j}" for j in range(60)]
        for j in range(i % 5):
            words[(7 * i + 13 * j) % 60] = f"own{i}_{j}"
        docs.append((100 + i, " ".join(words)))
    docs += [(300 + i, " ".join(f"s{i}_{j}" for j in range(8)) + " a passage that many of the documents share as it is") for i in range(40)]
    want = groups(docs, 4, 85)
    found = ngram_join.ngram_components(table(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


@pytest.mark.parametrize("bytes_per_range, step", [(40, 3), (200, 2)])
def test_components_by_many_ranges_in_steps(spark, documents, monkeypatch, bytes_per_range, step):
    """Ranges dealt in steps, small flushes, blocks of a few members and documents of all lengths in one bucket."""
    for name, value in (("BYTES_PER_RANGE", bytes_per_range), ("STEP_BITS", step), ("LEAST_BITS", 1), ("FLUSH_HASHES", 50), ("BLOCK", 2), ("OFTEN", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    passage = " a passage that many of the documents share as it is and that is long enough to fill a prefix"
    docs = [(i, " ".join(f"s{i}_{j}" for j in range(i % 5)) + passage) for i in range(30)] + [(100 + i, f"q{i} " * (i % 3) + passage) for i in range(20)]
    found = ngram_join.ngram_components(table(spark, docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(docs, 4, 85)


def test_components_with_frequent_shingles(spark):
    """Shingles of far more documents than OFTEN, spread unevenly, one of them with its rows repeated under one id."""
    passage = "a passage that very many of the documents share word for word in every copy"
    docs = [(i, " ".join(f"s{i}_{j}" for j in range(i % 4)) + " " + passage) for i in range(700)]
    docs += [(1000 + i, " ".join(f"t{i // 3}_{j}" for j in range(40 + i % 3)) + " " + passage) for i in range(60)]
    rows = [*docs, *[(5000, "only this row has these words but many times")] * 300]
    found = ngram_join.ngram_components(table(spark, rows).coalesce(2)).collect()
    assert len(found) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(dict(rows).items(), 4, 85)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1500)] + [(9100, 9101), (9103, 9101), (9200, 9200), (7, 3), (3, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1501), 0), **dict.fromkeys((9100, 9101, 9103), 9100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, documents):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    columns = rows.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, rows, SF)
    assert first.columns == columns
    kept = {r.doc_id: r.text for r in first.collect()}
    base = {i: t for i, t in documents if (m := metrics(t))["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"]}
    assert set(kept) <= set(base) and labels.count() < 1000 and kept == base  # too few labels here for any cutoff
    second = corpus_pipeline.STAGES[1][1](spark, first, SF)
    want = {i: t for i, (t, gone) in dedup(kept.items()).items() if t or not gone}
    assert {r.doc_id: r.text for r in second.collect()} == want and second.columns == columns
    third = corpus_pipeline.STAGES[2][1](spark, second, SF)
    want = {i for i, (_, c) in groups(want.items(), 5, 80).items() if c == i}
    assert {r.doc_id for r in third.collect()} == want and third.columns == columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_keep_columns_of_clashing_names(spark):
    rows = [(i, "one two three four five six seven" if i < 2 else f"t{i}\nl1\nl2\nl3", 5, 6, 7, 8, 9) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _removed long, n_chars long, component_id long, lines long")
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns and sorted((r.doc_id, r._id, r.component_id) for r in kept.collect()) == [(0, 5, 8), (2, 5, 8), (3, 5, 8), (4, 5, 8)]
    cut = corpus_pipeline.line_dedup(spark, docs, "")
    assert cut.columns == docs.columns and {(r.doc_id, r._removed, r.lines) for r in cut.collect()} == {(i, 6, 9) for i in range(5)}
    with pytest.raises(TypeError, match="integer"):
        ngram_join.keep_one(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_stages_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
