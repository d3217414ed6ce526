import random

import corpus_pipeline
import numpy as np
from cases import frame, odd_rows, words

from proofweave.llm import copies


def plain_set(text):
    found = (text or "").lower().split()
    return {" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def plain_kept(rows):
    """Smallest id of each group by comparing all pairs of sets."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())


def edited(text, n, seed):
    """``n`` words replaced, at places that share no shingle."""
    own, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(own) // 10), n):
        own[k * 10 + 5] = f"w{seed}x{k}"
    return " ".join(own)


def planted():
    """Copies at similarities of 0.80 to 0.95, and others just below 0.8."""
    rows = []
    for k, (size, edits) in enumerate([(104, 1), (104, 2), (304, 3), (304, 6), (1004, 5), (1004, 10), (1004, 22), (49, 1), (504, 12), (504, 11)] * 4):
        base = words(size, 900 + k)
        rows += [(10 * k, base), (10 * k + 1, edited(base, edits, k))]
    base = words(400, 5)
    rows += [(1000 + k, edited(base, k % 5, k)) for k in range(30)]
    steps = [base := words(204, 6)]
    for k in range(6):  # a chain whose ends are far apart
        steps.append(" ".join(f"s{k}y{j}" if 30 * k <= j < 30 * k + 12 else w for j, w in enumerate(steps[-1].split())))
    return rows + [(2000 + k, t) for k, t in enumerate(steps)]


def check(spark, rows, of=copies.one_of_each):
    got = [-1 if r.doc_id is None else r.doc_id for r in of(frame(spark, rows, extra=True)).select("doc_id").collect()]
    assert sorted(got) == plain_kept(rows)


def test_copies_at_80_to_95_percent(spark):
    rows = planted()
    assert 0.3 * len(rows) < len(plain_kept(rows)) < 0.7 * len(rows)
    check(spark, rows)
    check(spark, rows, lambda docs: corpus_pipeline.keep_one_of_each(spark, docs, ""))


def test_odd_rows(spark):
    check(spark, odd_rows())
    assert copies.one_of_each(frame(spark, [])).count() == 0


def test_bands_meet_at_eight_tenths():
    r = np.random.default_rng(4)
    missed = 0
    for _ in range(300):
        both, own = r.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2), r.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(np.concatenate((both, own[:10]))), np.unique(np.concatenate((both, own[10:])))
        assert copies.similar(a, b) and not copies.similar(a, b[1:][b[1:] != both[0]])
        x = copies.bands([a, b])
        missed += not (x[0] == x[1]).any()
    assert missed == 0


def test_small_tiles_and_chunks_give_the_same_groups(spark):
    rows = planted()
    check(spark, rows, lambda docs: copies.one_of_each(docs, tile=4, group=3))
    check(spark, rows, lambda docs: copies.one_of_each(docs, tile=1, group=7))


def test_large_group_of_dissimilar_members_in_one_band(spark):
    """Members share half their words, so they meet in bands but are not copies; a few of them have copies of their own."""
    base = words(120, 77).split()
    rows = [(k, " ".join(base[:90] + words(40, 3000 + k).split())) for k in range(150)]
    rows += [(500 + k, rows[k][1] + " tail") for k in range(0, 150, 10)]
    check(spark, rows)
    check(spark, rows, lambda docs: copies.one_of_each(docs, tile=50, group=20))


def test_forest_finds_what_all_pairs_find():
    r = np.random.default_rng(9)
    whole = r.integers(1, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((whole[: 100 + 5 * (k % 4)], r.integers(1, 1 << 63, int(r.integers(0, 40)), dtype=np.uint64)))) for k in range(60)]
    fp = np.array([copies.fingerprint(s) for s in sets], np.int64)
    every = np.ones(60, bool)
    label = copies.similar_forest(fp, sets, np.arange(60), every, ~every)
    expected = np.arange(60)
    for a in range(60):
        for b in range(a):
            if copies.similar(sets[a], sets[b]):
                expected[expected == expected[a]] = expected[b]
    assert all((label[a] == label[b]) == (expected[a] == expected[b]) for a in range(60) for b in range(60))


def test_within_the_radius_at_eight_tenths():
    r = np.random.default_rng(14)
    far = []
    for _ in range(2000):
        both, own = r.integers(0, 1 << 63, 80, dtype=np.uint64) * np.uint64(2), r.integers(0, 1 << 63, 20, dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(np.concatenate((both, own[k : k + 10]))) for k in (0, 10))
        far.append(int(np.bitwise_count(np.int64(copies.fingerprint(a) ^ copies.fingerprint(b)).view(np.uint64))))
    assert 9 < np.mean(far) < 10.5 and np.mean(np.array(far) > copies.RADIUS) <= 0.001
