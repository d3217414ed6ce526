"""op13: kept words against a plain table of windows; hot passages, hot anchors, odd rows."""

import hashlib
import random
import re

import pytest

from cases import SF, frame, odd_rows, words
from proofweave.llm import passages


def brute(rows):
    oldest, cut = {}, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), own in zip(rows, cut):
        for a in range(len(own) - 12) if i is not None else ():
            key = tuple(own[a : a + 13])
            oldest[key] = min(i, oldest.get(key, i))
    out = []
    for (i, _), own in zip(rows, cut):
        gone = set()
        for a in range(len(own) - 12) if i is not None else ():
            if oldest[tuple(own[a : a + 13])] < i:
                gone.update(range(a, a + 13))
        rest = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in passages.without_repeats(df, with_text=False, **options).collect()), key=str)


def test_given_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(table, block_bytes=50_000) == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])


def test_odd_rows_and_extra_columns(spark):
    assert found(frame(spark, odd_rows(), extra=True)) == brute(odd_rows())
    assert found(frame(spark, [])) == []


def test_passages_in_changing_surroundings(spark):
    r = random.Random(3)
    vocabulary = ["a", "b", "c", "d"]  # few words: anchors and windows repeat in all ways
    rows = [(r.randint(-50, 50), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 5, 12, 13, 14, 60, 200])))) for _ in range(120)]
    passage = words(40, 1)
    rows += [(1000 + k, words(r.randint(0, 30), 100 + k) + " " + passage[: r.randint(60, 200)] + " " + words(r.randint(0, 9), 200 + k)) for k in range(60)]
    rows += [(2000 + k, "same " * r.randint(10, 40)) for k in range(20)]
    r.shuffle(rows)
    expected = brute(rows)
    assert sum(n for _, _, n, _ in expected) > 1000
    assert found(frame(spark, rows)) == expected
    assert found(frame(spark, rows).repartition(5), block_bytes=2000) == expected


def test_hot_anchor_in_ever_new_surroundings(spark):
    seed = words(5, 9)
    rows = [(k, f"{words(10, 2 * k)} {seed} {words(10, 2 * k + 1)}") for k in range(1500)] + [(5000 + k, f"{words(8, 2 * k)} {words(10, 2 * k)} {seed} {words(4, 2 * k + 1)}") for k in range(50)]
    assert found(frame(spark, rows), block_bytes=20_000) == brute(rows)


def test_kept_text_and_idempotent_rule(spark):
    passage = words(30, 4)
    rows = [(2, f"x {passage} y"), (1, f"{passage} z"), (3, passage)]
    kept = {r.doc_id: r.kept for r in passages.without_repeats(frame(spark, rows)).collect()}
    assert kept == {1: f"{passage} z", 2: "x y", 3: ""}


def test_ids_must_have_an_order(spark):
    with pytest.raises(TypeError):
        passages.without_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
