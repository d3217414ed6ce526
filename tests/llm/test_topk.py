import random

import numpy as np
from cases import SF
from pyspark.sql import functions as F

from proofweave.llm import topk


def plain(rows, k, every):
    whole = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, k=5, every=50, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("side", F.lit(9))
    got = topk.top_k(df, F.col("vec_id") % every == 0, k=k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, k, every)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.1, -0.2]), (50, None), (100, [None, 0.5]), (150, [nan, 0.5]), (200, [inf, 0.5]), (1, [0.1, -0.2]), (2, [0.5]), (3, []), (250, []), (4, [0.0, 0.0]), (None, [0.3, 0.3]), (300, [0.7, 0.1, -0.9])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(0, [0.5]), (7, [0.25])])


def test_ties_and_blocks(spark):
    r = random.Random(5)
    rows = [(k, [r.choice([-0.5, 0.0, 0.25]) for _ in range(6)]) for k in range(300)]
    check(spark, rows, every=10, block_rows=40, query_rows=7)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows)


def test_stops_before_all_postings_on_peaked_rows():
    r = np.random.default_rng(0)
    rows = r.integers(-20, 20, (4000, 32))
    rows[:8] = 200 - r.integers(0, 9, (8, 32))  # a few rows that stand out
    index = topk.ImpactIndex(np.arange(4000), rows)
    at, score, posted = index.best(rows[3], 3, 5)
    full = rows @ rows[3]
    full[3] = -1
    want = np.lexsort((np.arange(4000), -full))[:5]
    assert at.tolist() == want.tolist() and score.tolist() == full[want].tolist()
    assert posted < rows.size // 10
