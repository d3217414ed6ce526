import zlib

import numpy as np
import public_tokenizers
from cases import SF, frame, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofweave.llm import packing
from proofweave.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab.é'́日!1\x1c\x85\xa0ΣİS")), max_size=40), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        whole = Tokenizer.from_file(public_tokenizers.path(name))
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
        assert PieceEncoder(public_tokenizers.path(name), spaced, memo=3).encode(texts) == want


def test_cuts_cover_every_length_within_their_class():
    for n in range(1, 5000):
        cuts = packing.harmonic_cuts(n)
        assert sum(k for _, k in cuts) == n
        assert all(2048 // (j + 1) <= k <= 2048 // j for j, k in cuts)


def check(df, docs):
    whole = Tokenizer.from_file(PATH)
    rows = [r.asDict() for r in df.collect()]
    ids = {}
    for i, t in docs:
        ids.setdefault((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)), 0)
        ids[i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    pool = {}
    for r in rows:
        pool.setdefault(r["doc_id"], []).append(r)
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(i == r["doc_id"] and len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for i, x in ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = sum(len(x) * n for (_, x), n in ids.items())
    assert sum(r["length"] for r in rows) == want
    return len(used) * 2048 / want


def test_odd_rows_and_extra_columns(spark):
    rows = odd_rows()
    check(packing.pack(frame(spark, rows, extra=True).coalesce(2), PATH, 1, with_ids=False), rows)
    assert packing.pack(frame(spark, []), PATH, 1).count() == 0


def test_padding_is_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    df = packing.pack(docs, PATH, 1, with_ids=False)
    assert check(df, [(r.doc_id, r.text) for r in docs.collect()]) < 1.04


def test_many_small_texts_share_sequences(spark):
    rows = [(k, words(5 + k % 40, k)) for k in range(400)]
    assert check(packing.pack(frame(spark, rows).coalesce(1), PATH, 1), rows) < 1.15
