import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import SF, frame, odd_rows, words
from pyspark.sql import functions as F

from proofweave.llm import common, ppm


def train_row(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def plain(rows):
    """The model byte by byte with explicit exclusion sets."""
    seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    words_seen, n_all = Counter(), 0
    sequences = [[ppm.START] * ppm.ORDER + list((t or "").encode()) + [ppm.END] for _, t in rows]
    lists = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for _, t in rows]
    for (i, _), s, w in zip(rows, sequences, lists, strict=True):
        if train_row(i):
            words_seen.update(w)
            for p in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    seen[k][tuple(s[p - k : p])][s[p]] += 1
    n_all = sum(words_seen.values())
    out = []
    for (i, _), s, w in zip(rows, sequences, lists, strict=True):
        score = 0.0
        for p in range(ppm.ORDER, len(s)):
            excluded, chance = set(), 1.0
            for k in range(ppm.ORDER, -1, -1):
                here = {c: n for c, n in seen[k][tuple(s[p - k : p])].items() if c not in excluded}
                total = sum(here.values()) + len(here)
                if s[p] in here:
                    chance *= here[s[p]] / total
                    break
                if here:
                    chance *= len(here) / total
                excluded |= here.keys()
            else:
                chance *= 1 / (257 - len(excluded))
            score += math.log10(chance)
        base = sum(math.log10((words_seen[x] + 1) / (n_all + len(words_seen) + 1)) for x in w)
        out.append((str(i), not train_row(i), len(w), sum(words_seen[x] > 0 for x in w), n_all, base, score))
    return sorted(out)


def check(spark, rows, **options):
    trains = F.coalesce(common.fold(F.col("doc_id"), 7) != 2, F.lit(True))
    got = ppm.score_documents(frame(spark, rows, extra=True), trains, **options).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(got, plain(rows), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert ppm.score_documents(frame(spark, []), F.lit(True)).count() == 0


def test_many_blocks(spark):
    check(spark, [(k, words(30 + k % 50, k % 17)) for k in range(90)], block_bytes=2000)


def test_no_training_text(spark):
    held = [k for k in range(60) if not train_row(k)]
    check(spark, [(k, words(5, k)) for k in held])


def test_model_beats_words_on_held_out_texts(spark):
    trains = F.coalesce(common.fold(F.col("doc_id"), 7) != 2, F.lit(True))
    rows = ppm.score_documents(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), trains).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
