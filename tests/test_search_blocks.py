"""Name search in blocks and slices, and frontiers that travel to the edges."""

import random

import numpy as np
import pyarrow as pa
import pytest

from proofweave.operators import graph, search
from proofweave.plans import reads
from proofweave.plans.catalog import QUERIES


def _grams(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


def test_blocks_meet_slices_once_and_nothing_below_the_floor_leaves_them(spark, monkeypatch):
    monkeypatch.setattr(search, "LEFT_TEXTS", 7)
    monkeypatch.setattr(search, "RIGHT_TEXTS", 9)
    monkeypatch.setattr(search, "CELLS", 20)
    rng = random.Random(3)
    left = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    right = left[::3] + ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    found = search.trigram_match(spark.createDataFrame([(x,) for x in left * 2], "t string"), spark.createDataFrame([(x,) for x in right], "t string"), 0.4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.left_text, r.right_text): r.score for r in found.collect()}
    want = {}
    for a in left:
        for b in right:
            x, y = _grams(a), _grams(b)
            if x and y and len(x & y) / len(x | y) >= 0.4:
                want[a, b] = len(x & y) / len(x | y)
    assert got == want
    assert found.count() == len(want)


def test_no_texts_find_nothing(spark):
    none, some = spark.createDataFrame([(None,), (" ",)], "t string"), spark.createDataFrame([("abc",)], "t string")
    assert search.trigram_match(none, some, 0.3).count() == 0
    assert search.trigram_match(some, none, 0.3).count() == 0


def test_mentions_with_equal_keys_are_matched_once(spark, monkeypatch):
    """A hundred mentions of one entity with the same keys make one hit before entities are grouped."""
    rows = [(f"m{i:03d}", "anna lee", "anna lee", "anl") for i in range(100)] + [("n1", "bob", "bob", "bb")]
    mentions = spark.createDataFrame(rows, "mention_id string, norm_key string, latin_key string, phonetic_key string")
    active = spark.createDataFrame([(r[0], "e1" if r[0][0] == "m" else "e2") for r in rows], "mention_id string, entity_id string")
    entities = spark.createDataFrame([("e1", "Anna Lee", "person")], "entity_id string, label string, entity_type string")  # e2 is not searched
    asked = spark.createDataFrame([(1, "ana lee", "ana lee", "anl"), (2, "bob", "bob", "bb")], "query_id int, norm_key string, latin_key string, phonetic_key string")
    sizes, kept = [], search.cut

    def counted(df):
        out = kept(df)
        if "phonetic_key" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(search, "cut", counted)
    hits = search.search_mentions(asked, entities, mentions, active).collect()
    assert sizes == [1]
    assert [(h.query_id, h.entity_id, h.matched) for h in hits] == [(1, "e1", "mention")]


def test_small_frontier_is_broadcast_to_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}") for i in range(12)], "edge_id string, subject_id string, object_id string")
    pairs = spark.createDataFrame([(1, "n2", "n5")], "pair_id int, source string, target string")
    sent, kept = [], graph.small
    monkeypatch.setattr(graph, "small", lambda df, *a: sent.append(df.columns) or kept(df, *a))
    row = graph.shortest_paths(edges, pairs).first()
    assert row.nodes == ["n2", "n3", "n4", "n5"] and sent and all(c == ["root", "near", "depth"] for c in sent)


def _batch(left, right):
    texts = [(True, k, g) for k, g in left.items()] + [(False, k, g) for k, g in right.items()]
    asks, text, grams = zip(*texts)
    return pa.RecordBatch.from_arrays([pa.array(asks), pa.array(text), pa.array(grams, pa.list_(pa.int64()))], ["asks", "text", "grams"])


@pytest.mark.parametrize("floor", [0.1, 0.28, 1 / 3, 0.35, 0.5, 0.7, 1.0])
def test_fewest_common_trigrams_reach_the_floor_and_one_less_does_not(floor):
    total = np.arange(2, 3000)
    least = search._least(total, floor)
    assert (least / (total - least) >= floor).all() and (least >= 1).all()
    assert all(c == 1 or (c - 1) / (n - c + 1) < floor for n, c in zip(total.tolist(), least.tolist()))


def test_sums_are_counted_for_every_bit_by_itself():
    rng = np.random.default_rng(5)
    for many in (0, 1, 2, 3, 7, 40, 129):
        bits, begin = rng.integers(0, 2, (many, 2, 128)), rng.integers(0, 16, 128)
        words = [np.packbits(x.astype(np.uint8), axis=1, bitorder="little").view("<u8") for x in bits]
        sums = search._sums(iter(words), [search._packed(begin >> k & 1, 2) for k in range(4)])
        got = sum(np.unpackbits(np.ascontiguousarray(np.broadcast_to(d, (2, 2))).view(np.uint8), axis=1, bitorder="little").astype(int) << k for k, d in enumerate(sums))
        assert (got == bits.sum(axis=0) + begin).all()


def test_frequent_trigrams_cost_no_more_than_rare_ones(monkeypatch):
    """Twelve trigrams that all texts share, too few for the floor: postings met one by one made twelve hits for each pair."""
    own = iter(range(100, 10_000_000))
    texts = lambda name, n, common: {f"{name}{i}": [*range(common), *(next(own) for _ in range(30 - common))] for i in range(n)}
    added, kept = [], search._sums
    monkeypatch.setattr(search, "_sums", lambda addends, digits: kept((added.append(1) or x for x in addends), digits))
    cost = []
    for common in (0, 12):
        added.clear()
        assert sum(b.num_rows for b in search._matches([_batch(texts("l", 90, common), texts("r", 1000, common))], 0.35)) == 0
        cost.append(len(added))
    assert cost[0] == cost[1] <= 90 * 30


def test_matches_leave_the_task_in_portions(monkeypatch):
    """Texts that all match: a portion holds what is waiting and the pairs counted at a time, not the whole block."""
    monkeypatch.setattr(search, "CELLS", 640)
    monkeypatch.setattr(search, "ROWS_OUT", 500)
    left, right = ({f"{x}{i}": [1, 2, 3, 10 + i % 2] for i in range(n)} for x, n in (("l", 50), ("r", 300)))
    out = list(search._matches([_batch(left, right)], 0.35))
    assert sum(b.num_rows for b in out) == 50 * 300 and max(b.num_rows for b in out) <= 500 + 640
    pairs = pa.Table.from_batches(out).to_pylist()
    assert len({(p["left_text"], p["right_text"]) for p in pairs}) == 50 * 300
    assert all(p["score"] == (1.0 if int(p["left_text"][1:]) % 2 == int(p["right_text"][1:]) % 2 else 0.6) for p in pairs)


def test_few_words_for_bitmaps_change_nothing(monkeypatch):
    rng = random.Random(11)
    left, right = ({f"{x}{i}": rng.sample(range(60), rng.randrange(1, 25)) for i in range(n)} for x, n in (("l", 40), ("r", 500)))
    want = {(a, b): len(x & y) / len(x | y) for a, p in left.items() for b, q in right.items() if len((x := set(p)) & (y := set(q))) / len(x | y) >= 0.3}
    for words, cells in ((1, 1), (200, 64 * 7), (2_000_000, 1_000_000)):
        monkeypatch.setattr(search, "BITMAP_WORDS", words)
        monkeypatch.setattr(search, "CELLS", cells)
        got = [p for b in search._matches([_batch(left, right)], 0.3) for p in b.to_pylist()]
        assert len(got) == len(want) and {(p["left_text"], p["right_text"]): p["score"] for p in got} == want


def test_each_block_and_slice_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(search, "LEFT_TEXTS", 10)
    monkeypatch.setattr(search, "RIGHT_TEXTS", 10)
    texts = spark.createDataFrame([(f"text {i} of {i * i}",) for i in range(60)], "t string")
    found = search.trigram_match(texts, texts, 0.9)
    assert found.rdd.getNumPartitions() == 36
    assert found.where("left_text = right_text").count() == 60


def test_documents_are_read_once_for_phrases(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(reads.search, "trigram_match", lambda left, right: sides.extend((left, right)) or right.selectExpr("name AS left_text", "name AS right_text", "1.0D AS score"))
    QUERIES["r1_phrase_match"](spark, "/root/testdata/sf0.001")
    assert len(sides) == 2 and sides[0].count() < sides[1].count()
    assert all("documents" not in side._jdf.queryExecution().executedPlan().toString() for side in sides)
