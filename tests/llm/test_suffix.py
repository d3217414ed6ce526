import hashlib
import random

import numpy as np
from cases import SF, frame, odd_rows, words

from proofweave.llm import suffix


def plain(rows):
    """By a dictionary of all 50-byte strings."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - 49):
            if i is not None:
                s = b[k : k + 50]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    got = suffix.without_repeats(frame(spark, rows, extra=True), with_bytes=False, **options)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert suffix.without_repeats(frame(spark, [])).count() == 0


def test_planted_passages(spark):
    r = random.Random(4)
    passages = [words(60, 900 + k) for k in range(5)] + ["ab" * 60, "!" * 70, "x" * 49, "y" * 50]
    rows = [(r.randrange(300), " ".join(r.choice([words(20, r.random()), r.choice(passages), r.choice(passages)[r.randrange(30) :]]) for _ in range(6))) for _ in range(120)]
    check(spark, rows)
    check(spark, rows, block_bytes=4000)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in docs], block_bytes=100_000)


def test_suffix_array_orders_all_suffixes():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 3), (2, 2), (300, 2), (500, 4), (400, 256)):
        for _ in range(20):
            text = r.integers(1, kinds + 1, n).clip(1, 255).astype(np.uint8)
            order = suffix.suffix_array(text, suffix._words(text))
            raw = text.tobytes()
            assert sorted(order.tolist()) == list(range(n))
            cut = [raw[k : k + 50] for k in order]
            assert cut == sorted(cut)


def test_oldest_windows_against_a_dictionary():
    r = np.random.default_rng(6)
    for kinds in (2, 3, 30):
        base = r.integers(97, 97 + kinds, 300).astype(np.uint8).tobytes()
        strings = list({base[a : a + 50 + r.integers(0, 40)] for a in r.integers(0, 210, 40).tolist()} | {b"z" * n for n in (50, 51, 90)})
        oldest = r.integers(0, 1000, len(strings))
        first = {}
        for s, old in zip(strings, oldest.tolist(), strict=True):
            for k in range(len(s) - 49):
                first[s[k : k + 50]] = min(old, first.get(s[k : k + 50], old))
        rows, at = suffix.oldest_windows(strings, oldest)
        for k, s in enumerate(strings):
            got = np.repeat(rows[at[k] : at[k + 1], 1], rows[at[k] : at[k + 1], 0]).tolist()
            assert got == [first[s[i : i + 50]] for i in range(len(s) - 49)]
