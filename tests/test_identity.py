import random

import pytest

from proofweave.operators import identity as idn

M = "membership_id string, mention_id string, entity_id string, opened_revision_id bigint, closed_revision_id bigint"


def lineage(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, parent_id string")


@pytest.mark.parametrize("rows,ends", [
    ([], {}),
    ([("b", "a")], {"b": "a"}),
    ([("c", "b"), ("b", "a")], {"c": "a", "b": "a"}),
    ([(f"n{i:02d}", f"n{i - 1:02d}") for i in range(1, 40)], {f"n{i:02d}": "n00" for i in range(1, 40)}),
])
def test_chains(spark, rows, ends):
    assert {r["entity_id"]: r["end_id"] for r in idn.chain_ends(lineage(spark, rows)).collect()} == ends


@pytest.mark.parametrize("rows", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]])
def test_cycles_are_refused(spark, rows):
    with pytest.raises(idn.LineageCycle, match="->"):
        idn.chain_ends(lineage(spark, rows))


def test_merge_then_split_restores(spark):
    rows = [("m1", "x", "a", 0, None), ("m2", "y", "b", 0, 1), ("m3", "y", "a", 1, 2), ("m4", "y", "b", 2, None)]
    members = spark.createDataFrame(rows, M)
    merge = spark.createDataFrame([("d1", "merge", 1)], "decision_id string, kind string, result_revision_id bigint")
    both = merge.union(spark.createDataFrame([("d2", "split", 2)], merge.schema))
    assert [tuple(r) for r in idn.lineage_replay(members, merge).collect()] == [("b", "a")]
    assert idn.lineage_replay(members, both).count() == 0
    assert {r["entity_id"] for r in idn.membership_as_of(members, 1).collect()} == {"a"}


def sequential(candidates, active, moved, parent):
    """The same batch taken one candidate at a time."""
    entity, touched, out = dict(active), set(moved), {}
    for cid, _, a, b, pre, state in sorted(candidates, key=lambda c: c[1]):
        if not pre or state != "open":
            out[cid] = False
            continue
        x, y = entity.get(a), entity.get(b)
        if x is None or y is None or x == y or x in touched or y in touched:
            out[cid] = False
            continue
        entity = {m: (x if e == y else e) for m, e in entity.items()}
        touched |= {x, y}
        out[cid] = True
    return out


def test_batch_confirm_equals_one_by_one(spark):
    rnd = random.Random(11)
    active = {f"m{i}": f"e{i // 2}" for i in range(40)}
    moved = {"e3", "e9"}
    members = [(f"k{m}", m, e, 5 if e in moved else 0, None) for m, e in active.items()]
    cands = [(f"c{i}", i, f"m{rnd.randint(0, 41)}", f"m{rnd.randint(0, 41)}", rnd.random() > 0.1, "open" if rnd.random() > 0.1 else "rejected") for i in range(60)]
    df = spark.createDataFrame(cands, "candidate_id string, position int, mention_a string, mention_b string, pre_verified boolean, disposition string")
    got = idn.batch_confirm(df, spark.createDataFrame(members, M), 3)
    assert {r["candidate_id"]: r["confirmed"] for r in got.collect()} == sequential(cands, active, moved, 3)
    moves = idn.confirm_moves(got, spark.createDataFrame(members, M), 100).collect()
    assert {r["op"] for r in moves} == {"open", "close"} and len(moves) % 2 == 0


def test_constraint_versions(spark):
    rows = [("n1", "b", "a", 1), ("n2", "a", "b", 2), ("n3", "a", "c", 3)]
    df = spark.createDataFrame(rows, "constraint_id string, mention_1 string, mention_2 string, decided_revision_id bigint")
    chain = {r["constraint_id"]: (r["version"], r["superseded_by"]) for r in idn.supersede_constraints(df).collect()}
    assert chain == {"n1": (1, "n2"), "n2": (2, None), "n3": (1, None)}
