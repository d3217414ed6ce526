import re

import numpy as np
import xxhash
from cases import SF, frame, odd_rows, words

from proofweave.llm import simhash


def plain(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """Components over (id, fingerprint) by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, f, least.get(find(k))) for k, (i, f) in enumerate(prints)), key=str)


def check(spark, rows, **options):
    got = simhash.near_duplicates(frame(spark, rows, extra=True), **options)
    got = sorted(((r.doc_id, int(r.fp, 16), r.component_id) for r in got.select("doc_id", simhash.hexadecimal("fp").alias("fp"), "component_id").collect()), key=str)
    assert got == plain_components([(i, plain(t)) for i, t in rows])


def near_copies():
    base = words(400, 3)
    rows = [(100 + k, base) for k in range(40)]
    for k in range(60):
        own = base.split()
        own[(k * 7) % 400] = f"w{k}"
        rows.append((k, " ".join(own)))
    return rows + [(1000 + k, words(50, 50 + k)) for k in range(60)]


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_in_small_tiles(spark):
    check(spark, near_copies())
    check(spark, near_copies(), tile_rows=7)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text) for r in docs])


def test_subdivided_comparison_loses_no_pair():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 700, dtype=np.uint64)
    b = np.concatenate((a[:300] ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)), r.integers(0, 1 << 63, 300, dtype=np.uint64)))
    want = set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)), strict=True))
    got = [(int(i), int(j)) for x, y in simhash.close_pairs(a, b, 3, direct=50) for i, j in zip(x, y, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    r = np.random.default_rng(2)
    order = r.permutation(60).tolist()
    edges = list(zip(order, order[1:], strict=False)) + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = dict(simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {k: 0 for k in range(1, 60)} | {k: 100 for k in range(101, 150)}


def test_one_of_each_keeps_one_row(spark):
    rows = near_copies() + odd_rows()
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(frame(spark, rows)).collect()), key=str)
    groups = {c for _, _, c in plain_components([(i, plain(t)) for i, t in rows])}
    assert {i for i, _ in kept} == groups and len(kept) >= len(groups)
    assert sum(i == 0 for i, _ in kept) == 1 and sum(i == 4 for i, _ in kept) == 2
