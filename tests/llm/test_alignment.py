"""op12: groups, links and counts against plain loops over the libraries' own tokens; merge-path cuts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers

from cases import SF, frame, odd_rows, words
from proofweave.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = {c: i for i, c in [(i, chr(i)) for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i]}
    table = plain | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if chr(i) not in plain)}
    out, links = [], []
    for i, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(table[c] for c in a.id_to_token(t)) for t in x]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(t) else p.replace("▁", " ").encode() for t, p in ((t, b.id_to_piece(t)) for t in y)]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            out.append([i, 0, 0, 0, ""]), links.append([])
            continue
        ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(s) for s in side]).tolist())} for side in (xs, ys))
        groups, own, at_a, at_b = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            k, m = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, x[at_a:k])) + "|" + ",".join(map(str, y[at_b:m])))
            own.append((x[k - 1], y[m - 1]))
            at_a, at_b = k, m
        out.append([i, len(x), len(y), len(groups), ";".join(groups)]), links.append(own)
    count = Counter(p for own in links for p in own)
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(n, highest.get(y, 0))
    return sorted(((*r[:4], len(own), sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), r[4]) for r, own in zip(out, links)), key=str)


def hashed(rows):
    return sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in rows), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in alignment.aligned(df, A, B, **options).collect()), key=str)


def test_given_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert found(table, with_groups=False, block_bytes=100_000, piece=1000) == hashed(rows)


def test_odd_rows_in_small_pieces(spark):
    rows = odd_rows() + [(20, "a<|endoftext|>b <|endoftext|> <s> </s> <0x41>"), (21, "here ▁ is a mark"), (22, " lead"), (23, "trail "), (24, "a  b   c"), (25, "\ta\r\n b"),
                         (26, "Ａ full width, é combined 　 wide"), (27, "a " * 3000), (28, "ab" * 20_000), (29, "Ġ Ċ"), (30, "line\nline\n\nline"), (31, words(50, 3)), (31, words(50, 3))]
    expected = brute(rows)
    assert sum(r[1] == 0 for r in expected) >= 4
    assert found(frame(spark, rows, extra=True), piece=64) == expected
    assert found(frame(spark, rows), block_bytes=500) == expected
    assert found(frame(spark, [])) == []


def test_cuts_have_equal_work_and_never_part_equal_ends():
    r = random.Random(2)
    for _ in range(200):
        a, b = (np.array(sorted(r.sample(range(400), r.randint(0, 150))), np.int64) for _ in range(2))
        piece = r.randint(1, 40)
        i, j = alignment.merge_path(a, b, piece)
        assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b) and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        assert (np.diff(i) + np.diff(j) <= piece + 1).all()
        for k in range(1, len(i) - 1):
            left, right = np.concatenate([a[: i[k]], b[: j[k]]]), np.concatenate([a[i[k] :], b[j[k] :]])
            assert not len(left) or not len(right) or left.max() < right.min()
        x, y = alignment.common_ends(a, b, piece)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
