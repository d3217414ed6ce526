import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofweave.functions import names
from proofweave.operators import resolution as er

SURNAMES = ["Quist", "Barrow", "Lindqvo", "Tamsin", "Orvell", "Hexham", "Drummel", "Fosk", "Grice", "Jubb", "Kestrel", "Munt", "Nyall", "Pellow", "Rusk", "Sorrel", "Thorne", "Upwell"]
GIVEN = ["Ada", "Bram", "Cyra"]


def golden(spark):
    """60 mentions: a cross-script pair, a spelling pair, two people of one name, and unrelated names."""
    named = [
        ("g1", "p1", "r1", "Nimal Perera", "Mali", "Harbour Club", "1990-06-15", "FIXTURE-ID-1"),
        ("g2", "p1", "r2", "නිමල් පෙරේරා", "Mali", "Harbour Club", "1990-06-15", "fixture-id - 1".replace(" - ", "-")),
        ("g3", "p2", "r3", "Mohamed Rizvi", "Riz", "Reading Circle", "1987-11-04", None),
        ("g4", "p2", "r4", "Mohammed Risvi", "Riz", "Reading Circle", "1987-11-04", None),
        ("g5", "p3", "r5", "Ruwan Silva", "North", None, "1984-03-12", None),
        ("g6", "p4", "r6", "Ruwan Silva", "South", None, "1992-10-08", None),
    ]
    others = [(f"h{i:02d}", f"q{i}", f"s{i}", f"{GIVEN[i % 3]} {SURNAMES[i // 3]}", None, None, None, None) for i in range(54)]
    return spark.createDataFrame(named + others, "mention_id string, truth_entity string, record_id string, raw_text string, alias string, affiliation string, dob string, nic string")


def frame_of(golden_set):
    keyed = names.mention_keys(golden_set)
    frame = keyed.select(F.col("mention_id").alias("unique_id"), F.col("mention_id").alias("entity_id"), "latin_key", "script_key", "phonetic_key", "norm_key", F.col("dob").alias("date_of_birth"))
    one = lambda kind, c: golden_set.where(f"{c} IS NOT NULL").select(F.col("mention_id").alias("entity_id"), F.lit(kind).alias("kind"), F.lower(c).alias("value"))
    return frame, one("alias", "alias").unionByName(one("affiliation", "affiliation"))


def test_golden_set(spark):
    g = golden(spark)
    frame, features = frame_of(g)
    scored = er.score_pairs(er.compare_pairs(er.block_pairs(frame, features), frame, features)).withColumnsRenamed({"id_a": "mention_a", "id_b": "mention_b"})
    model = scored.where(F.col("probability") >= er.THRESHOLD)
    observed = g.where("nic IS NOT NULL").select("mention_id", F.col("mention_id").alias("claim_id"), F.lit("has_nic").alias("predicate"), F.col("nic").alias("value"), F.lit("DEMO").alias("jurisdiction"),
                                                 F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    same_doc = er.same_key_pairs(names.mention_keys(g))
    pair = "mention_a string, mention_b string"
    report = er.evaluate(er.identifier_pairs(observed), model, same_doc, g, spark.createDataFrame([("g1", "g2"), ("g3", "g4")], pair), spark.createDataFrame([("g5", "g6")], pair)).first()
    assert report["rule_pairwise_precision"] == 1.0 and report["rule_true_positives"] == 1
    assert report["transliteration_pairwise_recall"] == 1.0
    assert report["review_load_per_1000_mentions"] == pytest.approx(33.333333)
    assert report["distinct_pairs_emitted"] == 0 and report["passed"]
    by_pair = {(r["mention_a"], r["mention_b"]): r["probability"] for r in scored.collect()}
    assert by_pair[("g5", "g6")] == pytest.approx(0.015, abs=0.01)


def test_pairs_above_loses_nothing(spark):
    rnd = random.Random(2)
    stems = ["perera", "pererra", "silva", "silvah", "fernando"]
    rows = [(f"m{i:03d}", f"m{i:03d}", f"{rnd.choice('ab')}_{rnd.choice(stems)}", rnd.choice(["x", "y", None]), rnd.choice("pqr"), rnd.choice(["1980-01-01", "1981-01-01", None])) for i in range(120)]
    frame = spark.createDataFrame(rows, "unique_id string, entity_id string, latin_key string, script_key string, phonetic_key string, date_of_birth string")
    feats = [(f"m{i:03d}", k, f"{k[:2]}{rnd.randint(0, 9)}") for i in range(120) for k in ("alias", "affiliation", "associate", "associate") if rnd.random() < 0.6]
    features = spark.createDataFrame(feats, "entity_id string, kind string, value string").distinct()
    score = lambda pairs: {(r["id_a"], r["id_b"]) for r in er.score_pairs(er.compare_pairs(pairs, frame, features)).where(F.col("probability") >= er.THRESHOLD).collect()}
    for whole in (False, True):
        full, pruned = score(er.block_pairs(frame, features, whole)), score(er.pairs_above(frame, features, whole_lists=whole))
        assert full and full == pruned


def test_agreement_list_is_complete():
    combos = er.sufficient_agreements()
    assert combos and all(len(c) == 2 for c in combos)
    assert er.sufficient_agreements(threshold=0.0001) is None  # one agreement may do: fall back to whole blocks


def test_jaro_winkler_against_the_checking_engine():
    import duckdb

    con, rnd = duckdb.connect(), random.Random(4)
    word = lambda: "".join(rnd.choice("abcde_") for _ in range(rnd.randint(1, 12)))
    left, right = [word() for _ in range(300)], [word() for _ in range(300)]
    got = names.jaro_winkler_values(pd.Series(left), pd.Series(right))
    for a, b, v in zip(left, right, got):
        assert v == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0], abs=1e-9)


def keys_of(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    return {r.raw_text: r for r in rows.withColumn("k", names.name_keys(F.col("raw_text"))).select("raw_text", "k.*").collect()}


@pytest.mark.parametrize("text,key", [("Kasun WIJERATNE", "kasun_wijeratne"), ("José  Núñez", "jose_nunez"), ("පෙරේරා", "පෙරේරා"), ("a--b", "a_b")])
def test_norm_keys(spark, text, key):
    import unicodedata

    assert keys_of(spark, text)[text].norm_key == unicodedata.normalize("NFKD", key)


def test_keys_without_letters_stay_apart(spark):
    keys = keys_of(spark, "!!!", "???", None, "")
    assert keys["!!!"].norm_key != keys["???"].norm_key and keys["!!!"].norm_key.startswith("u_") and keys["!!!"].latin_key == ""


def test_cross_script_keys(spark):
    keys = keys_of(spark, "නිමල් පෙරේරා", "Nimal Perera", "නිමල්", "123", "நிமல்", "ab නිමල්")
    assert keys["නිමල් පෙරේරා"].phonetic_key == keys["Nimal Perera"].phonetic_key == "NML PRR"
    assert [keys[k].script for k in ("නිමල්", "Nimal Perera", "123", "ab නිමල්")] == ["Sinh", "Latn", None, "Sinh"]
    assert keys["நிமல்"].latin_key == "niml"


def test_identifier_rules(spark):
    rows = [
        ("a", "c1", "has_nic", "id 1", "X", None, None), ("b", "c2", "has_nic", "ID1", "Y", None, None), ("c", "c3", "has_nic", "id1", None, None, None),
        ("d", "c4", "has_nic", "z", None, "2000-01-01", "2000-12-31"), ("e", "c5", "has_nic", "z", None, "2001-01-01", None),
    ]
    df = spark.createDataFrame(rows, "mention_id string, claim_id string, predicate string, value string, jurisdiction string, valid_from string, valid_to string").withColumns(
        {"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    assert {(r["mention_a"], r["mention_b"]) for r in er.identifier_pairs(df).collect()} == {("a", "c"), ("b", "c")}


def test_suppression_precedence(spark):
    pair = "mention_a string, mention_b string"
    scored = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.9), ("e", "f", 0.9), ("g", "h", 0.9), ("i", "j", 0.1)], pair + ", probability double")
    active = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "mention_id string, entity_id string")
    constraints = spark.createDataFrame([("a", "b"), ("c", "d")], pair)
    existing = spark.createDataFrame([("c", "d"), ("e", "f")], pair)
    got = {r["mention_a"]: r["outcome"] for r in er.judge_candidates(scored, active, constraints, existing).collect()}
    assert got == {"a": "same_entity", "c": "suppressed_constraint", "e": "already_open", "g": "emitted", "i": "below_threshold"}


def plain_report(mentions, features, constraints, existing, threshold):
    """Counters of a run by listing all pairs; mentions: (id, entity, latin, script, phonetic, born)."""
    held, lists = {}, {}
    for e, kind, value in features:
        held.setdefault((e, kind), set()).add(value)
    for e in {m[1] for m in mentions}:
        lists[e] = "|".join(sorted(held.get((e, "affiliation"), ())))
    out = dict.fromkeys(("compared", "below_threshold", "same_entity", "suppressed_constraint", "already_open", "emitted"), 0)
    for i, a in enumerate(mentions):
        for b in mentions[:i]:
            same = lambda k, cut=None: a[k] is not None and b[k] is not None and a[k][:cut] == b[k][:cut]
            if not (same(4) or same(2, 4) or lists[a[1]] == lists[b[1]]):
                continue
            out["compared"] += 1
            shared = {k: len(held.get((a[1], k), set()) & held.get((b[1], k), set())) for k in ("alias", "affiliation", "associate")}
            if a[2] is None or b[2] is None:
                name = -1
            elif same(3):
                name = 4
            elif a[2] == b[2]:
                name = 3
            else:
                j = similarity(a[2], b[2])
                name = 2 if j >= er.JW_CLOSE else 1 if j >= er.JW_NEAR else 0
            gammas = {"name": name, "alias": min(1, shared["alias"]), "affiliation": min(1, shared["affiliation"]), "associate": min(2, shared["associate"]),
                      "birth": -1 if a[5] is None or b[5] is None else int(a[5] == b[5])}
            odds = er.PRIOR / (1 - er.PRIOR)
            for n, g in gammas.items():
                odds *= er.COMPARISONS[n][g][0] / er.COMPARISONS[n][g][1] if g in er.COMPARISONS[n] else 1
            pair = tuple(sorted((a[0], b[0])))
            if odds / (1 + odds) < threshold:
                out["below_threshold"] += 1
            elif a[1] == b[1]:
                out["same_entity"] += 1
            else:
                out["suppressed_constraint" if pair in constraints else "already_open" if pair in existing else "emitted"] += 1
    return out


def similarity(a, b):
    """Jaro-Winkler similarity, prefix scale 0.1, at most four characters."""
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(hits, [c for c, u in zip(b, used) if u])) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


FRAME = "unique_id string, entity_id string, latin_key string, script_key string, phonetic_key string, date_of_birth string"


def report_of(spark, mentions, features, constraints, existing, threshold):
    frame = spark.createDataFrame(mentions, FRAME)
    feats = spark.createDataFrame(features, "entity_id string, kind string, value string")
    scored = er.score_pairs(er.compare_pairs(er.pairs_above(frame, feats, threshold, True), frame, feats)).withColumnsRenamed({"id_a": "mention_a", "id_b": "mention_b"})
    table = lambda rows: spark.createDataFrame(sorted(rows), "mention_a string, mention_b string")
    judged = er.judge_candidates(scored, frame.select(F.col("unique_id").alias("mention_id"), "entity_id"), table(constraints), table(existing), threshold)
    return er.run_report(frame, feats, judged, threshold).first().asDict()


@pytest.mark.parametrize("threshold", [0.8, 0.999])
def test_run_report_counts_what_it_does_not_list(spark, threshold):
    rnd = random.Random(12)
    stems = ["perera", "pereira", "silva", "silve", "fernando", "fernand", "dias"]
    mentions, features = [], []
    for e in range(24):
        born = rnd.choice([None, "1970-01-01", "1980-02-02"])
        for k in range(rnd.choice([1, 1, 2, 7])):
            latin = rnd.choice([None, *stems, *stems])
            mentions.append((f"m{e:02d}{k}", f"e{e:02d}", latin, rnd.choice([None, "s1", "s2"]), latin and latin[:3], born))
        features += [(f"e{e:02d}", kind, f"{kind}{rnd.randint(0, 2)}") for kind in ("alias", "affiliation", "associate", "associate") if rnd.random() < 0.8]
    features = sorted(set(features))
    ids = sorted(m[0] for m in mentions)
    constraints, existing = {tuple(sorted(rnd.sample(ids, 2))) for _ in range(300)}, {tuple(sorted(rnd.sample(ids, 2))) for _ in range(300)}
    want = plain_report(mentions, features, constraints, existing, threshold)
    assert want["same_entity"] > 0 and want["emitted"] > 0
    assert report_of(spark, mentions, features, constraints, existing, threshold) == want


def test_an_entity_of_ten_thousand_mentions_stays_linear(spark):
    mentions = [(f"m{k:05d}", "big", "perera", None, "PRR", "1970-01-01") for k in range(10_000)] + [("x1", "other", "perera", None, "PRR", "1970-01-01")]
    features = [(e, k, f"{k}1") for e in ("big", "other") for k in ("alias", "affiliation")]
    got = report_of(spark, mentions, features, set(), set(), 0.8)
    assert got["compared"] == 10_001 * 10_000 // 2 and got["same_entity"] == 10_000 * 9_999 // 2 and got["emitted"] == 10_000 and got["below_threshold"] == 0
