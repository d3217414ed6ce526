import random
from itertools import product

from cases import SF, frame, odd_rows, words

from proofweave.llm import decontam


def plain_tiling(doc, item, least):
    """Longest common unmarked run first, by comparing all places."""
    marked_d, marked_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d, i in product(range(len(doc)), range(len(item))):
            n = 0
            while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in marked_d and i + n not in marked_i:
                n += 1
            best = max(best, (n, -d, -i))
        n, d, i = best[0], -best[1], -best[2]
        if n < least:
            return total
        marked_d |= set(range(d, d + n))
        marked_i |= set(range(i, i + n))
        total += n


def test_tiling_covers_what_the_plain_one_covers():
    r = random.Random(7)
    for _ in range(150):
        doc = [r.randint(1, 30) for _ in range(r.randint(0, 60))]
        item = [r.randint(1, 30) for _ in range(r.randint(1, 30))]
        for _ in range(3):
            if len(item) > 6:
                a = r.randrange(len(item) - 5)
                at = r.randint(0, len(doc))
                doc[at:at] = item[a : a + r.randint(5, 12)]
        tiles = decontam.tiling(doc, item, 5)
        assert len({p for d, _, n in tiles for p in range(d, d + n)}) == sum(n for _, _, n in tiles) == len({p for _, i, n in tiles for p in range(i, i + n)})
        assert all(doc[d : d + n] == item[i : i + n] and n >= 5 for d, i, n in tiles)
        assert sum(n for _, _, n in tiles) == plain_tiling(doc, item, 5)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_planted_passages(spark):
    items = [(k, words(40, 500 + k)) for k in range(20)] + [(20, None), (21, ""), (22, "only four short words"), (3, words(40, 503)), (None, words(30, 900))]
    parts = items[5][1].split()
    reordered = " ".join([*parts[20:30], "gap", *parts[:20], "gap", *parts[30:]])
    docs = odd_rows() + [(50, words(200, 1) + " " + items[3][1].upper() + ", " + words(100, 2)), (51, reordered), (52, " ".join(parts[:31])), (53, " ".join(parts[:32])), (54, " ".join(parts[::-1])), (55, words(30, 900)), (55, words(30, 900))]
    want = {(50, 3), (51, 5), (53, 5), (55, None)}
    for block_bytes in (decontam.BLOCK_BYTES, 300):
        got = decontam.leaked_items(frame(spark, docs, extra=True), bench(spark, items), block_bytes=block_bytes)
        rows = got.collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == 6
        assert all(r.matched_words == sum(t.words for t in r.tiles) and r.coverage >= 0.8 for r in rows)
        kept = decontam.without_leaks(frame(spark, docs, extra=True), bench(spark, items), block_bytes=block_bytes)
        assert kept.columns == frame(spark, docs, extra=True).columns
        assert kept.count() == len(docs) - 5
    assert decontam.leaked_items(frame(spark, docs), bench(spark, [])).count() == 0
    assert decontam.leaked_items(frame(spark, []), bench(spark, items)).count() == 0


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_items(docs, items).collect()}
    told = [(r.item_id, decontam.words_of(r.text)) for r in items.collect()]
    want = set()
    for r in docs.collect():
        own = decontam.words_of(r.text)
        seeds = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        for i, w in told:
            if sum(tuple(w[k : k + 5]) in seeds for k in range(len(w) - 4)) > 0.4 * len(w) and plain_tiling(own, w, 5) >= 0.8 * len(w):
                want.add((r.doc_id, i))
    assert got == want and want
