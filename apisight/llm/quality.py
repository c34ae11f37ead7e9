"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _IS_SPACE, Chunk, chunks, mix, runs
from .shared import free_names, materialise

#: Rules: name, and its value for a document; greater is worse.
RULES: dict[str, Column | str] = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}
#: Cutoffs that may be chosen, whatever the data.
GRID = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5)

#: Highest accepted share of good documents that the rules together reject in a stratum, and the chance of any such claim being wrong.
ALPHA, DELTA = 0.05, 0.05
#: A cutoff is used if it rejects so many times more of the bad documents than the bound on the good ones.
GAIN = 2.0

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, chunk: Chunk) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(flags)))
    return sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]


def chunk_metrics(chunk: Chunk) -> dict[str, np.ndarray]:
    starts, ends = chunk.words()
    owner = chunk.owner(starts)
    count = lambda x, w=None: np.bincount(x, weights=w, minlength=chunk.n).astype(np.int64) if len(x) else np.zeros(chunk.n, np.int64)
    space = _IS_SPACE[chunk.data]
    out = {"n_words": count(owner), "word_chars": _per_text(~space & ((chunk.data & 0xC0) != 0x80), chunk), "n_symbols": _per_text(_SYMBOL[chunk.data], chunk)}
    # lines with a word; an equal earlier one makes a duplicate
    l_start, l_end = chunk.spans(chunk.data == 10)
    words_before = np.concatenate((np.zeros(1, np.int64), np.cumsum(~space)))
    full = words_before[l_end] > words_before[l_start]
    l_start, l_end = l_start[full], l_end[full]
    l_owner = chunk.owner(l_start)
    keys = np.unique(np.stack((l_owner.astype(np.uint64), chunk.hashes(l_start, l_end))), axis=1)[0].astype(np.int64) if len(l_start) else np.zeros(0, np.int64)
    out["n_lines"] = count(l_owner)
    out["n_dup_lines"] = out["n_lines"] - count(keys)
    # words in five-word windows that the text has twice or more
    windows, at = runs(chunk.hashes(starts, ends), owner, 5)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(windows):
        _, which, times = np.unique(windows ^ mix(owner[at].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        twice = at[times[which] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    out["n_repeat_words"] = count(owner, np.cumsum(covered)[:-1] > 0)
    return out


def _metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [chunk_metrics(c) for c in chunks(batch.column("text"))]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        names = list(batch.schema.names)
        for m in METRICS:
            columns.append(pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()))
            names.append(m)
        yield pa.RecordBatch.from_arrays(columns, names)


def text_metrics(docs: DataFrame) -> DataFrame:
    """docs with the METRICS of its text, as long; a null text has none of anything. Input columns of these names are replaced."""
    docs = docs.drop(*METRICS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_metrics, f"{schema}, " + ", ".join(f"{m} long" for m in METRICS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, summed exactly from the probabilities."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.vectorize(math.lgamma, otypes=[float])
    terms = math.lgamma(n + 1) - log(i + 1) - log(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(terms).sum()))


def upper_bound(k: int, n: int, error: float) -> float:
    """One-sided exact (Clopper-Pearson) bound on a probability, from k of n, wrong with probability `error` at most."""
    low, high = k / max(n, 1), 1.0
    if k >= n:
        return 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if binomial_cdf(k, n, middle) <= error else (middle, high)
    return high


def certified_cutoffs(holdout: DataFrame, stratum: str, rules: dict | None = None, grid: tuple = GRID, alpha: float = ALPHA, delta: float = DELTA, gain: float = GAIN) -> DataFrame:
    """Cutoffs for each stratum that reject, with probability 1 - delta for all of them together, at most alpha of its good documents.

    holdout: labelled documents with the stratum, the columns that the rules use, and quality (1: good, 0: bad). The claim holds for the
    population that holdout is an independent sample of; so copies of a text must be in it once. Alpha is shared out among the rules. For every stratum, rule and cutoff of the grid the exact binomial bound on the share of good documents over the cutoff is taken at
    delta / (strata * rules * cutoffs) (Bonferroni), so the choice among them is free. Of those within alpha, the one is chosen for which the
    rejected share of bad documents exceeds gain times the bound by most (the higher one in a tie); without such a one there is no cutoff.

    Returns stratum and for each rule cut_<rule> (null: none) and bound_<rule> (the bound at that cutoff). Strata without labels have no row.
    """
    rules = RULES if rules is None else rules
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    for name, value in rules.items():
        for j, cut in enumerate(grid):
            over = F.expr(value) > cut
            counts += [F.count_if(over & good).alias(f"g_{name}_{j}"), F.count_if(over & bad).alias(f"b_{name}_{j}")]
    table = materialise(holdout.groupBy(F.col(stratum).alias("stratum")).agg(*counts), "holdout_counts")
    tests = max(1, table.count()) * len(rules) * len(grid)
    each = alpha / len(rules)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"stratum": frame["stratum"]}
            for name in rules:
                cuts, bounds = [], []
                for row in frame.to_dict("records"):
                    best = (0.0, None, None)
                    for j, cut in enumerate(grid):
                        k, n = row[f"g_{name}_{j}"], row["good"]
                        if not n or binomial_cdf(k, n, each) > delta / tests:
                            continue
                        bound = upper_bound(k, n, delta / tests)
                        score = row[f"b_{name}_{j}"] / max(row["bad"], 1) - gain * bound
                        if score > 0 and score >= best[0]:
                            best = (score, cut, bound)
                    cuts.append(best[1])
                    bounds.append(best[2])
                out[f"cut_{name}"], out[f"bound_{name}"] = pd.Series(cuts, dtype="float64"), pd.Series(bounds, dtype="float64")
            yield pd.DataFrame(out)

    kind = dict(table.dtypes)["stratum"]
    return table.mapInPandas(choose, f"stratum {kind}, " + ", ".join(f"cut_{r} double, bound_{r} double" for r in rules))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """docs with METRICS, base_failed and kept: false for documents that fail the base rules or that a certified cutoff of their stratum rejects.

    labels: doc_id, quality, one label for a document (of several the highest counts). The holdout is the labelled documents that pass the base
    rules, each distinct text of a stratum once: it is good if any of its rows is. What is certified, then, is the share of good ones among the
    distinct texts that pass the base rules, as far as the labelled texts are a random sample of them; near copies count as texts of their own.
    Documents that the base rules reject are no part of the claim.

    Documents of a stratum without labels, or with too few to certify a cutoff, are judged by the base rules alone. Null and empty texts fail
    the base rules. Null strata form one. Rows keep their order of columns; rows repeated under one doc_id are judged one by one. Texts are
    not shuffled: the metrics are computed once for the cutoffs and once more where they are applied.
    """
    rules = options.get("rules") or RULES
    slim = text_metrics(docs.select("doc_id", F.col(stratum).alias("_stratum"), F.md5("text").alias("_text"), "text")).drop("text")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("quality"))
    labelled = slim.join(marks, F.col("doc_id") == F.col("_doc")).where(~base_failed())
    holdout = labelled.groupBy("_stratum", "_text").agg(F.max("quality").alias("quality"), *[F.first(m).alias(m) for m in METRICS])
    cutoffs = materialise(certified_cutoffs(holdout, "_stratum", **options), "cutoffs")
    judged = text_metrics(docs.drop("base_failed", "kept"))
    own, cut = free_names(judged.columns, "stratum_of_cutoffs", "cutoffs")
    judged = judged.join(cutoffs.select(F.col("stratum").alias(own), F.struct(*[f"cut_{r}" for r in rules]).alias(cut)), F.col(stratum).eqNullSafe(F.col(own)), "left")
    over = F.lit(False)
    for name, value in rules.items():
        over = over | F.coalesce(F.expr(value) > F.col(f"{cut}.cut_{name}"), F.lit(False))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~(F.col("base_failed") | over)).drop(own, cut)
