import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofweave.operators import search, windows
from proofweave.operators.windows import order_bucket, ordered_steps, pairs_within


def test_ordered_steps_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (F.col("id") * 7919 % 3001).alias("o"), F.col("id").cast("string").alias("v"))
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.row_number().over(w).alias("step"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"))
    got = ordered_steps(df, ["k"], "o", {"x": "v"}, splits=8).select("k", "o", "step", F.col("prev_x").alias("p"), F.col("next_x").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ordered_steps_without_keys(spark):
    df = spark.range(500).select((F.col("id") * 37 % 501).alias("o"))
    got = ordered_steps(df, [], "o", {"o": "o"}, splits=16).orderBy("o").collect()
    assert [r["step"] for r in got] == list(range(1, 501))
    assert [r["prev_o"] for r in got][1:] == [r["o"] for r in got][:-1] and got[-1]["next_o"] is None


def test_ordered_steps_with_ties_and_text_order(spark):
    ties = spark.range(600).select(F.lit(1).alias("o"), F.col("id").cast("string").alias("v"))
    got = ordered_steps(ties, [], "o", {"v": "v"}, tie="v", splits=8).orderBy("v").collect()
    assert [r["step"] for r in got] == list(range(1, 601)) and [r["prev_v"] for r in got][1:] == [r["v"] for r in got][:-1]
    assert order_bucket(ties, ["o", "v"], 8) is not None
    assert ties.select(order_bucket(ties, ["o", "v"], 8).alias("b")).distinct().count() > 4
    text = spark.range(300).select(F.concat(F.lit("t"), F.col("id") % 97).alias("o"), F.col("id").alias("v"))
    got = ordered_steps(text, [], "o", {}, tie="v", splits=8).orderBy("o", "v").collect()
    assert [r["step"] for r in got] == list(range(1, 301))
    assert ordered_steps(text.limit(0), [], "o", {}, tie="v").count() == 0


def test_pairs_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(90)] + [("cold", i) for i in range(200, 210)] + [("one", 500)]
    df = spark.createDataFrame(rows, "k string, i int")
    got = {(r["k"], r["a"]["i"], r["b"]["i"]) for r in pairs_within(df, ["k"], "i", chunk=16).collect()}
    want = {(k, a, b) for k, a in rows for kk, b in rows if k == kk and a < b}
    assert got == want
    assert pairs_within(df, ["k"], "i", chunk=16).count() == len(want)


def grams(text):
    import re

    words = [w for w in re.split(r"[^\w]+", text.lower().replace("_", " ")) if w]
    return {("  " + w + " ")[i:i + 3] for w in words for i in range(len(w) + 1)}


def test_trigram_match_is_exact(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(3, 14))) for _ in range(150)]
    left, right = names[:60], names[40:]
    score = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) if grams(a) | grams(b) else 0
    for floor in (0.35, 0.6):
        want = {(a, b) for a in left for b in right if grams(a) and grams(b) and score(a, b) >= floor}
        got = search.trigram_match(spark.createDataFrame([(x,) for x in left], "t string"), spark.createDataFrame([(x,) for x in right], "t string"), floor)
        assert {(r[0], r[1]) for r in got.collect()} == want


def test_search_ranks_and_ties(spark):
    hit = "query_id int, entity_id string, label string, entity_type string, score double, matched string"
    label = spark.createDataFrame([(1, "e1", "Abe", "person", 0.6, "label"), (1, "e2", "Bob", "person", 0.4, "label")], hit)
    alias = spark.createDataFrame([(1, "e1", "Abe", "person", 0.6, "alias"), (1, "e2", "Bob", "person", 0.9, "alias")], hit)
    got = search.search_entities([label, alias], 5).orderBy("position").collect()
    assert [(r["entity_id"], r["score"], r["matched"]) for r in got] == [("e2", 0.9, "alias"), ("e1", 0.6, "label")]


def test_empty_query_finds_nothing(spark):
    assert search.query_texts(spark.createDataFrame([(1, "   ")], "query_id int, text string")).count() == 0


def test_join_in_slots_is_the_join(spark):
    rnd = random.Random(4)
    left = [(rnd.choice(["hot", "a", "b", None]), i) for i in range(300)]
    right = [(rnd.choice(["hot", "hot", "a", "c", None]), i) for i in range(200)]
    l, r = spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int")
    want = sorted((k, x, y) for k, x in left for j, y in right if k is not None and k == j)
    for chunk in (10, 100, 1000):
        assert sorted((row.k, row.x, row.y) for row in windows.join_within(l, r, ["k"], chunk).collect()) == want
    plan = windows.join_within(l, r, ["k"], 10)
    assert plan.columns == ["k", "x", "y"]


def test_the_floor_separates_before_scores_are_taken(spark):
    """Texts that all share frequent trigrams: what the filters let through is a small part of all pairs."""
    rnd = random.Random(5)
    texts = ["customer " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(200)]
    near = [t[:-1] + "q" for t in texts[:20]]
    got = search.trigram_match(spark.createDataFrame([(x,) for x in near], "t string"), spark.createDataFrame([(x,) for x in texts], "t string"), 0.5)
    assert {(r.left_text, r.right_text) for r in got.collect()} >= set(zip(near, texts)) and got.count() < 0.1 * len(near) * len(texts)
    best = search.trigram_match(spark.createDataFrame([(x,) for x in near], "t string"), spark.createDataFrame([(x,) for x in texts], "t string"), 0.1, best=3)
    assert {(r.left_text, r.right_text) for r in best.collect()} >= set(zip(near, texts)) and best.groupBy("left_text").count().where("count > 3").isEmpty()


def test_codes_tell_trigrams_apart(spark):
    text = spark.createDataFrame([("Añb 日本語 ab😀c",)], "t string")
    row = text.select(search.trigrams(F.col("t")).alias("g"), search.trigram_codes(F.col("t")).alias("c")).first()
    assert [sum(ord(ch) << s for ch, s in zip(g, (42, 21, 0))) for g in row.g] == list(row.c) and len(set(row.c)) == len(row.c)


def test_buckets_are_of_one_size_whatever_the_input(spark):
    for rows in (4_000, 32_000):
        df = spark.range(rows).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 100_003).alias("o"))
        sizes = [r["count"] for r in windows.order_ranges(df, ["o"], bucket_rows=1000).groupBy("_b").count().collect()]
        assert len(sizes) == rows // 1000 + 1 and max(sizes) < 2500
    ties = spark.range(3000).select(F.lit(1).alias("o"), F.col("id").alias("t"))
    assert windows.order_ranges(ties, ["o", "t"], bucket_rows=500).select("_b").distinct().count() > 4
