import numpy as np
import pyarrow as pa
from cases import SF, frame, odd_rows
from pyspark.sql import functions as F

from proofweave.llm import common, quality


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_labels(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    held = docs.join(labels, "doc_id").where(common.fold(F.col("doc_id"), 3) == 1)
    rows = quality.with_scores(held.select("text", "quality"), model, "s").select("quality", "s").toPandas()
    y, p = rows.quality.to_numpy(), rows.s.to_numpy()
    assert auc(y, p) > 0.97 and ((p >= 0.5) == y).mean() > 0.97


def test_gradient_against_differences():
    r = np.random.default_rng(0)
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), 0.2)
    x, per_doc, y = r.normal(size=(9, quality.FEATURES)), np.array([2, 1, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.score(x, per_doc)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in model.gradient(x, per_doc, y).items():
        w = model.w[name] = np.array(model.w[name], float)
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            keep = w[at]
            w[at] = keep + 1e-5
            up = loss()
            w[at] = keep - 1e-5
            down = loss()
            w[at] = keep
            assert abs((up - down) / 2e-5 - np.asarray(g)[at]) < 1e-6


def test_passages_do_not_depend_on_their_neighbours():
    texts = [t for _, t in odd_rows()] + ["a b a b c", "Ab!!  x\n"]
    x, per_doc = quality.passages(pa.array(texts, pa.string()))
    assert per_doc.tolist() == [max(1, -(-len((t or "").encode()) // quality.PASSAGE)) for t in texts]
    at = np.cumsum(per_doc) - per_doc
    for k, t in enumerate(texts):
        own, n = quality.passages(pa.array(["", t, "zz"], pa.string()).slice(1, 1))
        assert n[0] == per_doc[k] and np.allclose(own, x[at[k] : at[k] + n[0]])
    last = x[at[-2]]
    assert np.isclose(last[quality.CLASSES + 4], 3 / 5)  # distinct words over words


def test_odd_rows_and_labels(spark):
    docs = frame(spark, odd_rows(), extra=True)
    labels = spark.createDataFrame([(2, 0), (3, None), (6, 1), (6, 1), (8, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    for given in (labels, labels.where("quality = 1"), labels.limit(0)):
        model = quality.train(docs, given)
        out = quality.with_scores(docs, model, "quality_score")
        assert out.columns == docs.columns + ["quality_score"] and out.count() == docs.count()
        assert out.where("quality_score is null or quality_score < 0 or quality_score > 1").isEmpty()
    assert quality.with_scores(frame(spark, []), model, "q").count() == 0
