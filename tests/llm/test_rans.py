import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import SF, frame, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from proofweave.llm import rans
from proofweave.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000), st.integers(1, 64))
def test_blocks_come_back(ids, lanes):
    ids = np.array(ids, np.uint32)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=50)))
    state, words = rans.encode_block(ids, table, lanes)
    assert (rans.decode_block(len(ids), state, words, table) == ids).all()


def test_frequencies_fill_the_scale():
    r = np.random.default_rng(1)
    for _ in range(30):
        counts = np.where(r.random(40_000) < 0.9, r.integers(0, 3, 40_000), 0)
        counts[r.integers(0, 40_000)] = 10**9
        freq = rans.scaled(counts)
        assert freq.sum() == 1 << rans.SCALE and ((freq > 0) == (counts > 0)).all()
    assert rans.scaled(np.zeros(5, int)).sum() == 0


def test_damage_is_noticed():
    ids = np.arange(5000, dtype=np.uint32) % 7
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=9)))
    data = rans.write_segment([(3, 2000), (4, 3000)], ids, 10, table, lanes=16)
    assert [(d, s, i.tolist()) for d, s, i in rans.Segment(data, table).documents()] == [(3, 10, ids[:2000].tolist()), (4, 2010, ids[2000:].tolist())]
    for at in (0, 30, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            list(rans.Segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], table).documents())
    with pytest.raises(ValueError):
        rans.Segment(data, rans.Table(rans.scaled(np.bincount(ids, minlength=10))))


def check(spark, df, rows):
    path = scratch_path(spark, "rans-test")
    rans.write(df, path, PATH, 2, 49_408)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rans.read(spark, path).collect()]
    whole = Tokenizer.from_file(PATH)
    want = sorted((i is not None, i or 0, np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    assert sorted((d is not None, d or 0, b) for d, _, _, _, b in got) == want
    at = 0
    last = None
    for d, s, n, crc, b in sorted(got, key=lambda g: g[1]):
        assert s == at and n == len(b) // 4 and crc == zlib.crc32(b)
        assert last is None or d >= last
        last, at = d if d is not None else last, at + n


def test_odd_rows(spark):
    check(spark, frame(spark, odd_rows(), extra=True), odd_rows())
    check(spark, frame(spark, []), [])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
