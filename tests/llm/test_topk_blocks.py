"""Top-k search where every row is a query, where blocks are gathered from several Arrow batches, and with components of any size."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from apisight.llm import topk


@pytest.mark.parametrize("per_batch", [50, 40])
def test_all_rows_are_queries(spark, monkeypatch, per_batch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 10, (400, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    key, had = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(per_batch))
    try:
        sizes = [len(r.rows) // 8 for r in topk._blocks(df.withColumn("is_query", F.lit(True)), 1, 64).select("rows").collect()]
        found = Counter(tuple(r) for r in topk.exact_top_k(df, F.lit(True), 7, 1).collect())
    finally:
        spark.conf.set(key, had)
    assert max(sizes) <= 64 and sum(sizes) == 400
    want = Counter()
    for i, scores in enumerate(x @ x.T):
        best = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:7]
        want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert found == want


def test_components_of_any_finite_size(spark):
    rng = np.random.default_rng(4)
    values = [0.0, 1.0, -3.5, 1e10, -1e10, 2.0**62, 1e150, -1e300, 1e308]
    rows = [(i, [float(rng.choice(values)) for _ in range(3)]) for i in range(60)] + [(60 + i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(200 + i, [float(rng.choice(values)), 1.0]) for i in range(10)] + [(300, [1e10] * 64), (320, [1e10] * 64), (340, [0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    most, end = int(np.finfo(float).max), (1 << 63) - 1
    whole = [(i, [max(-most, min(most, int(np.floor(64 * x)) if abs(x) < 1e306 else (most if x > 0 else -most))) for x in v]) for i, v in rows]
    want = Counter()
    for a, (i, v) in enumerate(whole):
        if i % 20 == 0:
            scores = [(max(-end, min(end, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(whole) if b != a and len(w) == len(v)]
            want.update((i, rank, j, s) for rank, (s, j) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:5], 1))
    assert Counter(tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 20 == 0, 5).collect()) == want
