import random

from cases import SF, frame, odd_rows, words
from pyspark.sql import functions as F

from proofweave.llm import common, secrets


def planted(n=240):
    r = random.Random(3)
    rows, spans = [], set()
    for k in range(n):
        before, after = words(25, k), words(25, 10_000 + k)
        value = {
            0: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            1: "".join(r.choice("0123456789abcdef") for _ in range(40)),
            2: "".join(r.choice("0123456789abcdef") for _ in range(18)),
        }.get(k % 6)
        if value is None:
            harmless = (words(1, k) + words(1, k + 1) + "longordinaryword", "1234567890123456", "x")[k % 3]
            rows.append((k, f"{before} {harmless} {after}"))
            continue
        lead = {0: "", 1: 'token = "', 2: "password="}[k % 6]
        rows.append((k, f"{before} {lead}{value}{'"' if k % 6 == 1 else ''} {after}"))
        spans.add((k, len(before) + 1 + len(lead), len(value)))
    return rows, spans


def test_planted_secrets_are_found_and_nothing_else(spark):
    rows, spans = planted()
    docs = frame(spark, rows + odd_rows()[:5], extra=True)
    forest = secrets.train(secrets.labelled_findings(docs))
    got = secrets.scan(docs, forest)
    assert got.columns == ["doc_id", "start", "length", "secret_sha256", "score"]
    assert {(r.doc_id, r.start, r.length) for r in got.collect()} == spans


def test_redaction_takes_effect(spark):
    rows, spans = planted()
    docs = frame(spark, rows + odd_rows(), extra=True)
    out = secrets.redact(docs, secrets.train(secrets.labelled_findings(docs)))
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r for r in out.where("doc_id >= 10").collect()}
    before = dict(rows)
    for k, start, n in spans:
        if k >= 10:
            assert texts[k].text == before[k][:start] + "[SECRET]" + before[k][start + n :] and texts[k].n_chars == len(texts[k].text)
    assert out.where("text is null").count() == docs.where("text is null").count() > 0


def test_few_or_no_findings(spark):
    empty = frame(spark, [])
    forest = secrets.train(secrets.labelled_findings(empty))
    assert secrets.scan(empty, forest).count() == 0
    only = frame(spark, [(k, f"password=abc123def456{k}") for k in range(9)])
    assert secrets.scan(only, None).count() == 9
    assert secrets.scan(only, secrets.train(secrets.labelled_findings(only))).count() == 9
    one = spark.createDataFrame([(None, "b", None, None, 1), ("x1", None, None, None, None), ("k3y9", None, None, None, 0)], "found string, before string, after string, path string, label int")
    assert secrets.train(one).share == 0.0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    forest = secrets.train(secrets.labelled_findings(docs))
    held = docs.where(common.fold(docs.doc_id, 3) == 1).collect()
    truth = {(r.doc_id, s) for r in held for s, f, b, _ in secrets.candidates(r.text) if secrets.label_by_form(f, b)}
    found = {(r.doc_id, r.start) for r in secrets.scan(docs, forest).where(common.fold(F.col("doc_id"), 3) == 1).collect()}
    assert len(truth & found) >= 0.95 * len(truth) and len(found - truth) <= 0.05 * len(truth) + 1
