"""Bounded reads over the edge projection, for many seed sets or pairs at once.

Traversal is level-synchronous: a frontier table joined with the edge table, cut to storage after each level. The
state kept per seed set is bounded by its element budget; shortest paths keep one ball for each distinct end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..session import cut, small
from . import projection as pj

# --- fixed values: caps of the graph reads ------------------------------------------------------
MAX_HOPS = 3
MAX_PATH_HOPS = 5
MAX_ELEMENTS = 2000
MAX_SEEDS = 100
MAX_PATHS = 25
MAX_WEIGHTED_HOPS = 4
TOP_WEIGHTED = 10
SALTS = 32  # shares in which the first edges of a set are picked
# -------------------------------------------------------------------------------------------------
EDGE = ["edge_id", "subject_id", "object_id", "predicate", "segment_from", "segment_to"]


def visible_edges(links: DataFrame, readable: DataFrame) -> DataFrame:
    """Edges with at least one readable supporting claim: an equality semi join, never a search inside arrays."""
    return links.join(readable.select("claim_id"), "claim_id", "left_semi").select(*EDGE).distinct()


def edges_in_window(edges: DataFrame, since=None, until=None, categories: list[str] = ()) -> DataFrame:
    if categories:
        edges = edges.where(F.col("predicate").isin(V.predicates_in_categories(list(categories))))
    if until is not None:
        edges = edges.where(F.col("segment_from").isNull() | (F.col("segment_from") <= F.lit(until)))
    if since is not None:
        edges = edges.where(F.col("segment_to").isNull() | (F.col("segment_to") >= F.lit(since)))
    return edges


UNBOUNDED = (1 << 62) - 1


def resolve_seeds(seeds: DataFrame, canonical: DataFrame, max_seeds: int | None = MAX_SEEDS) -> DataFrame:
    """``seeds(set_id, pos, entity_id)`` to (set_id, entity_id, pos): canonical, distinct, first place kept.

    ``max_seeds``: places used of each set, None for all; ``seed_counts`` tells which sets have more.
    """
    used = seeds if max_seeds is None else seeds.where(F.col("pos") < max_seeds)
    merged = canonical.where("entity_id <> canonical_entity_id").select("entity_id", "canonical_entity_id")
    return used.join(merged, "entity_id", "left").groupBy("set_id", F.coalesce("canonical_entity_id", "entity_id").alias("entity_id")).agg(F.min("pos").alias("pos"))


def seed_counts(seeds: DataFrame, max_seeds: int | None = MAX_SEEDS) -> DataFrame:
    """(set_id, seeds, truncated) as asked for."""
    over = F.lit(False) if max_seeds is None else F.max("pos") >= max_seeds
    return seeds.groupBy("set_id").agg(F.count(F.lit(1)).alias("seeds"), over.alias("truncated"))


def _both_ends(edges: DataFrame, *columns: str) -> DataFrame:
    out = edges.select(F.col("subject_id").alias("near"), F.col("object_id").alias("far"), *columns)
    back = edges.select(F.col("object_id").alias("near"), F.col("subject_id").alias("far"), *columns)
    return out.unionByName(back)


def _reading_order():
    return [F.col("subject_id"), F.col("object_id"), F.col("predicate"), F.col("segment_from").asc_nulls_last(), F.col("edge_id")]


def expand(edges: DataFrame, seeds: DataFrame, max_hops: int = 1, max_elements: int | None = MAX_ELEMENTS) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion of every seed set under its own node-plus-edge budget.

    Returns (set_id, hop, edge columns) and (set_id, elements, truncated). Each hop admits edges in reading order and
    stops at the first that does not fit. Only the first ``budget + 1`` new edges of a hop can matter, and a set holds at
    most ``budget`` edges already, so of each node's edges the first ``2 * budget + 1`` do. They are picked once for all sets,
    before sets meet edges, and like the first edges of a set from ``SALTS`` shares, so that a hub's edges never meet in one
    task nor repeat for each set that reaches it. ``max_elements`` None: no budget.
    """
    max_hops = max(0, max_hops)
    budget = UNBOUNDED if max_elements is None else max(1, max_elements)
    ends = edges.select(*EDGE)
    touch = ends.withColumn("node", F.col("subject_id")).unionByName(ends.withColumn("node", F.col("object_id")))
    reached = cut(seeds.select("set_id", F.col("entity_id").alias("node")).distinct())
    sets = reached.groupBy("set_id").agg(F.count(F.lit(1)).alias("elements")).withColumn("truncated", F.lit(False))
    frontier, taken, by_set = reached, None, Window.partitionBy("set_id")
    for hop in range(1, max_hops + 1):
        near = touch.join(small(frontier.select("node").distinct()), "node", "left_semi")
        if max_elements is not None:
            near = _first_of_nodes(near, 2 * budget + 1)
        found = frontier.join(near, "node").select("set_id", *EDGE).distinct()
        if taken is not None:
            found = found.join(taken.select("set_id", "edge_id"), ["set_id", "edge_id"], "left_anti")
        share = Window.partitionBy("set_id", "salt").orderBy(*_reading_order())
        salted = found.withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.lit(SALTS)))
        first = salted.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= budget + 1).drop("salt", "rank")
        ranked = cut(first.withColumn("rank", F.row_number().over(by_set.orderBy(*_reading_order()))).where(F.col("rank") <= budget + 1))
        ends_of = ranked.select("set_id", "rank", F.explode(F.array("subject_id", "object_id")).alias("node"))
        fresh = ends_of.join(reached, ["set_id", "node"], "left_anti").groupBy("set_id", "node").agg(F.min("rank").alias("rank"))
        new_nodes = fresh.groupBy("set_id", "rank").agg(F.count(F.lit(1)).alias("new"))
        weighed = (
            ranked.join(new_nodes, ["set_id", "rank"], "left").join(sets, "set_id")
            .withColumn("total", F.col("elements") + F.sum(1 + F.coalesce("new", F.lit(0))).over(by_set.orderBy("rank")))
            .withColumn("fits", ~F.col("truncated") & (F.col("total") <= budget))
        )
        weighed = cut(weighed.select("set_id", *EDGE, "rank", "total", "fits"))
        grown = weighed.groupBy("set_id").agg(F.max(F.when(F.col("fits"), F.col("total"))).alias("_total"), F.bool_or(~F.col("fits")).alias("_cut"))
        sets = cut(
            sets.join(grown, "set_id", "left").select(
                "set_id", F.coalesce("_total", "elements").alias("elements"), (F.col("truncated") | F.coalesce("_cut", F.lit(False))).alias("truncated")
            )
        )
        admitted = weighed.where("fits").select("set_id", F.lit(hop).alias("hop"), *EDGE)
        taken = admitted if taken is None else taken.unionByName(admitted)
        if hop == max_hops:
            break
        frontier = cut(
            admitted.select("set_id", F.explode(F.array("subject_id", "object_id")).alias("node")).distinct().join(reached, ["set_id", "node"], "left_anti")
        )
        reached = reached.unionByName(frontier)
        frontier = frontier.join(sets.where("NOT truncated").select("set_id"), "set_id", "left_semi")
    if taken is None:
        taken = ends.limit(0).select(F.lit(None).cast(seeds.schema["set_id"].dataType).alias("set_id"), F.lit(0).alias("hop"), *EDGE)
    return taken, sets


def _first_of_nodes(touch: DataFrame, most: int) -> DataFrame:
    """The first ``most`` different edges of each node in reading order; repeated rows count once."""
    shared = touch.withColumn("salt", F.pmod(F.xxhash64("edge_id"), F.lit(SALTS)))
    for by in (["node", "salt"], ["node"]):
        order = Window.partitionBy(*by).orderBy(*_reading_order())
        shared = shared.withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= most).drop("_r")
    return shared.drop("salt")


def overview(edges: DataFrame, max_elements: int = MAX_ELEMENTS) -> DataFrame:  # the feature is a bounded slice
    """Seedless slice: the first ``budget + 1`` edges in reading order, keeping each that fits the element budget.

    Returns the kept edges with ``truncated``. The fold runs over at most ``budget + 1`` rows picked by a bounded sort.
    """
    budget = max(1, max_elements)
    first = edges.select(*EDGE).orderBy(*_reading_order()).limit(budget + 1)
    numbered = first.withColumn("rank", F.row_number().over(Window.orderBy(*_reading_order())))
    rows = numbered.agg(F.array_sort(F.collect_list(F.struct("rank", *EDGE))).alias("rows"))  # at most budget + 1 rows
    start = F.struct(F.array().cast("array<string>").alias("nodes"), F.array().cast("array<int>").alias("kept"), F.lit(False).alias("full"))

    def admit(state, row):
        fresh = F.array_except(F.array(row["subject_id"], row["object_id"]), state["nodes"])
        fits = F.size(state["kept"]) + F.size(state["nodes"]) + F.size(fresh) + 1 <= budget
        return F.struct(
            F.when(fits, F.concat(state["nodes"], fresh)).otherwise(state["nodes"]).alias("nodes"),
            F.when(fits, F.concat(state["kept"], F.array(row["rank"]))).otherwise(state["kept"]).alias("kept"),
            (state["full"] | ~fits).alias("full"),
        )

    folded = rows.select("rows", F.aggregate("rows", start, admit).alias("s"))
    shown = folded.select(F.explode("rows").alias("r"), "s", (F.col("s.full") | (F.size("rows") > budget)).alias("truncated"))
    return shown.where(F.array_contains("s.kept", F.col("r.rank"))).select(*[F.col(f"r.{c}").alias(c) for c in EDGE], "truncated")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_PATH_HOPS, max_paths: int | None = MAX_PATHS) -> DataFrame:
    """All shortest undirected routes of each pair, parallel edges apart: (pair_id, hops, nodes, edge_ids, truncated).

    ``pairs(pair_id, source, target)``, ids already resolved. Every distinct end has one ball, whatever pairs ask for it. In
    each round every open pair names the end whose frontier has the fewer edges, and the named balls grow by one step; a pair
    is settled once its two balls meet. So a hub between two people is entered but not left, and a far side is never grown
    where the near side is cheaper. When more than ``max_paths`` routes exist, the ones a backward walk that prefers the
    largest (edge_id, previous node) meets first are kept; partial routes beyond that are pruned level by level, which loses
    nothing because each of them completes. ``max_paths`` None: all routes.
    """
    max_hops = max(1, max_hops)
    max_paths = UNBOUNDED if max_paths is None else max(1, max_paths)
    steps = _both_ends(edges, "edge_id")
    degree = cut(steps.groupBy(F.col("near").alias("node")).agg(F.count(F.lit(1)).alias("degree")))
    pairs = cut(pairs.select("pair_id", "source", "target"))
    open_ = pairs.where("source <> target")
    ball = cut(open_.select(F.explode(F.array("source", "target")).alias("root")).distinct().select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    links = None  # (root, node, toward, edge_id, depth): edges by which a ball was grown
    status = cut(ball.join(degree, "node", "left").select("root", F.lit(0).alias("reach"), F.coalesce("degree", F.lit(0)).alias("cost")))
    met = []
    for _ in range(2 * max_hops):
        side = lambda name, tag: status.select(F.col("root").alias(name), F.col("reach").alias(f"{tag}_reach"), F.col("cost").alias(f"{tag}_cost"))
        known = open_.join(side("source", "s"), "source").join(side("target", "t"), "target")
        # a ball that is all of its component, or two that reach as far as a route may, settle a pair without one
        asks = cut(
            known.where((F.col("s_reach") + F.col("t_reach") < max_hops) & (F.least("s_cost", "t_cost") > 0))
            .withColumn("named", F.when(F.col("s_cost") <= F.col("t_cost"), F.col("source")).otherwise(F.col("target")))
        )
        if asks.isEmpty():
            break
        named = asks.select(F.col("named").alias("root")).distinct()
        front = ball.join(status.join(named, "root", "left_semi").select("root", F.col("reach").alias("depth")), ["root", "depth"])
        # a frontier that is small travels to the edges, not the edges to it
        front = small(cut(front.select("root", F.col("node").alias("near"), (F.col("depth") + 1).alias("depth"))))
        found = front.join(steps, "near").select(
            "root", F.col("far").alias("node"), F.col("near").alias("toward"), "edge_id", "depth"
        ).distinct().join(ball.select("root", "node"), ["root", "node"], "left_anti")
        found = cut(found)
        links = found if links is None else links.unionByName(found)
        new = found.select("root", "node", "depth").distinct()
        ball = cut(ball.unionByName(new))
        costs = new.join(degree, "node").groupBy("root").agg(F.sum("degree").alias("grown"))
        status = cut(
            status.join(named.withColumn("named", F.lit(True)), "root", "left").join(costs, "root", "left").select(
                "root", (F.col("reach") + F.coalesce("named", F.lit(False)).cast("int")).alias("reach"),
                F.when(F.col("named"), F.coalesce("grown", F.lit(0))).otherwise(F.col("cost")).alias("cost"),
            )
        )
        # only the new nodes of a named ball can be the first ones that two balls have in common
        at = asks.select("pair_id", "source", "target")
        outer = new.select("root", F.col("node").alias("middle"), F.col("depth").alias("near_depth"))
        inner = ball.select(F.col("root").alias("other"), F.col("node").alias("middle"), F.col("depth").alias("far_depth"))
        both = [at.withColumnRenamed(one, "root").withColumnRenamed(two, "other") for one, two in (("source", "target"), ("target", "source"))]
        common = reduce(DataFrame.unionByName, [b.select("pair_id", "root", "other").join(outer, "root").join(inner, ["other", "middle"]) for b in both])
        least = common.groupBy("pair_id").agg(F.min(F.col("near_depth") + F.col("far_depth")).alias("hops")).where(F.col("hops") <= max_hops)
        reached = at.join(least, "pair_id").join(status.select(F.col("root").alias("source"), "reach"), "source")
        met.append(cut(reached.select("pair_id", "source", "target", "hops", F.least("reach", "hops").alias("middle"))))
        # a pair that a deep ball of another pair has settled beyond max_hops has no route
        open_ = asks.select("pair_id", "source", "target").join(met[-1], "pair_id", "left_anti")
    same = pairs.where("source = target").select(
        "pair_id", F.lit(0).alias("hops"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("edge_ids"), F.lit(1).alias("found")
    )
    out = same if not met else same.unionByName(_routes(reduce(DataFrame.unionByName, met), ball, links, max_hops, max_paths))
    return out.select("pair_id", "hops", "nodes", "edge_ids", (F.col("found") >= max_paths).alias("truncated"))


def _routes(met: DataFrame, ball: DataFrame, links: DataFrame, max_hops: int, max_paths: int) -> DataFrame:
    """Routes of ``met(pair_id, source, target, hops, middle)``, listed from the target back to the source.

    Up to the middle the source's ball says what lies before a node. Behind it the target's ball does, read outward from
    the nodes of the middle that both balls hold.
    """
    step = links.select("root", "node", "toward", "edge_id", "depth")
    back = met.join(ball.select(F.col("root").alias("source"), "node", F.col("depth").alias("middle")), ["source", "middle"])
    back = back.join(ball.select(F.col("root").alias("target"), "node", F.col("depth").alias("rest")), ["target", "node"]).where(F.col("middle") + F.col("rest") == F.col("hops"))
    useful = cut(back.select("pair_id", "target", "node", "hops", F.col("middle").alias("place")))
    behind = None
    for _ in range(max_hops):
        useful = useful.where(F.col("place") < F.col("hops"))
        if useful.isEmpty():
            break
        out = useful.withColumn("depth", F.col("hops") - F.col("place")).withColumnRenamed("target", "root").join(step, ["root", "node", "depth"])
        out = cut(out.select("pair_id", (F.col("place") + 1).alias("place"), F.col("toward").alias("node"), F.col("node").alias("previous"), "edge_id", F.col("root").alias("target"), "hops"))
        behind = out.drop("target", "hops") if behind is None else behind.unionByName(out.drop("target", "hops"))
        useful = out.select("pair_id", "target", "node", "hops", "place").distinct()
    walk = met.select(
        "pair_id", "source", "hops", "middle", F.col("hops").alias("place"), F.col("target").alias("node"), F.array("target").alias("nodes"),
        F.array().cast("array<struct<edge_id:string,previous:string>>").alias("trail"),
    )
    done = []
    order = Window.partitionBy("pair_id").orderBy(F.col("trail").desc())
    for _ in range(max_hops):
        before = walk.where("place <= middle").join(step.select(F.col("root").alias("source"), "node", F.col("depth").alias("place"), F.col("toward").alias("previous"), "edge_id"), ["source", "node", "place"])
        if behind is not None:
            before = before.unionByName(walk.where("place > middle").join(behind, ["pair_id", "node", "place"]))
        grown = before.select(
            "pair_id", "source", "hops", "middle", (F.col("place") - 1).alias("place"), F.col("previous").alias("node"), F.concat(F.array("previous"), "nodes").alias("nodes"),
            F.concat("trail", F.array(F.struct("edge_id", "previous"))).alias("trail"),
        )
        grown = cut(grown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_paths).drop("_r"))
        done.append(grown.where("place = 0"))
        walk = grown.where("place > 0")
        if walk.isEmpty():
            break
    routes = reduce(DataFrame.unionByName, done)
    counted = routes.groupBy("pair_id").agg(F.count(F.lit(1)).cast("int").alias("found"))
    return routes.join(counted, "pair_id").select("pair_id", "hops", "nodes", F.reverse(F.transform("trail", lambda t: t["edge_id"])).alias("edge_ids"), "found")


def hydrate_edges(edges: DataFrame, links: DataFrame, readable: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with counts recomputed over the readable claims behind the returned edges only."""
    seen = cut(links.join(edges.select("edge_id").distinct(), "edge_id", "left_semi").select("edge_id", "claim_id").join(readable.select("claim_id"), "claim_id", "left_semi"))
    index = pj.relation_index(relations, seen.select("claim_id").distinct())
    summary = pj.support_summary(seen, readable, index)
    claims = seen.groupBy("edge_id").agg(F.count(F.lit(1)).alias("claim_count"))
    return edges.join(summary, "edge_id").join(claims, "edge_id").withColumn("category", V.category_of(F.col("predicate")))


def hydrate_nodes(edges: DataFrame, entities: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Entities on the returned edges, and the asked-for ones even when nothing connects them."""
    ids = edges.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    if seeds is not None:
        ids = ids.unionByName(seeds.select("entity_id"))
    return entities.join(ids.distinct(), "entity_id", "left_semi").select("entity_id", "label", "entity_type")


# --- analyst queries over display edges: (source, target, relation, layer, confidence, weight, start_date, end_date, ...)


def snapshot_as_of(edges: DataFrame, day) -> DataFrame:
    d = F.lit(day).cast("date")
    return edges.where((F.col("start_date") <= d) & (F.col("end_date").isNull() | (F.col("end_date") >= d)))


def layer_projection(edges: DataFrame, layer: str) -> DataFrame:
    return edges.where(F.col("layer") == layer)


def hard_facts(edges: DataFrame) -> DataFrame:
    return edges.where("confidence = 'EXTRACTED'")


def ambiguous_queue(edges: DataFrame) -> DataFrame:
    return edges.where("confidence = 'AMBIGUOUS'")


def ongoing(edges: DataFrame) -> DataFrame:
    return edges.where("end_date IS NULL AND start_date IS NOT NULL")


def cell_members(assignment: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cell, size, member): members as rows, so a cell holding most of the graph stays spread."""
    sizes = assignment.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return assignment.join(nodes.select("node_id", "name"), "node_id").join(sizes, "cluster_id").select(F.col("cluster_id").alias("cell"), "size", F.col("name").alias("member"))


def cross_layer_brokers(edges: DataFrame) -> DataFrame:
    on = edges.select(F.explode(F.array("source", "target")).alias("node_id"), "layer").distinct()
    return on.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("layer")), ",").alias("layers"), F.count(F.lit(1)).alias("layer_count")).where("layer_count >= 2")  # layers: fixed short list


def _confidence(product) -> Column:
    return F.round(F.round(product, 9), 3)


def _first_parallel(steps: DataFrame, most: int) -> DataFrame:
    """Of parallel edges of one weight the ``most`` with the smallest ids."""
    order = Window.partitionBy("near", "far", "weight").orderBy("edge_id")
    return steps.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def _leaving(steps: DataFrame, nodes: DataFrame, column: str = "near") -> DataFrame:
    """Steps whose ``column`` is one of ``nodes(node)``; few nodes travel to the edges, not the edges to them."""
    return steps.join(small(nodes.select(F.col("node").alias(column)).distinct()), column, "left_semi")


def _hopeful(halves: DataFrame, limits: DataFrame, last: str, rest: float) -> DataFrame:
    """Half trails of pairs that are still open, unless even the best rest of the trail stays at or under the pair's limit."""
    hope = _confidence(F.col("product") * F.col(last) * F.lit(rest))
    return halves.join(limits, "pair_id").where(F.col("floor").isNull() | (hope > F.col("floor"))).select(*halves.columns)


def _ends_met(f: DataFrame, middles: DataFrame, b: DataFrame, limits: DataFrame) -> DataFrame:
    """``f`` and ``b`` halves of a pair joined through ``middles(near, far, weight, other_weight, ...)``, if they beat its limit."""
    front = f.select("pair_id", F.col("node").alias("near"), F.col("nodes").alias("f_nodes"), F.col("ids").alias("f_ids"), F.col("layers").alias("f_layers"), F.col("product").alias("f_product"))
    back = b.select("pair_id", F.col("node").alias("far"), F.col("nodes").alias("b_nodes"), F.col("ids").alias("b_ids"), F.col("layers").alias("b_layers"), F.col("product").alias("b_product"))
    met = front.join(middles, "near").join(back, ["pair_id", "far"]).where(~F.arrays_overlap("f_ids", "b_ids"))
    met = met.withColumn("path_confidence", _confidence((F.col("f_product") * F.col("weight")) * (F.col("b_product") * F.col("other_weight"))))
    return met.join(limits.select("pair_id", "floor"), "pair_id").where(F.col("floor").isNull() | (F.col("path_confidence") > F.col("floor"))).drop("floor")


def _two_steps(steps: DataFrame, f: DataFrame, b: DataFrame, limits: DataFrame, found: DataFrame, top: int, most: int) -> DataFrame:
    """Two edges each between the ends of ``f`` and ``b`` halves: all that the best ``top`` trails of a pair can hold.

    Where the node between lies on no half, neither edge can lie on one: such middles of the same ends and weights make trails
    that differ in the ids of these edges alone, and the first ``top`` of them do. How many there are is counted without
    their ids first, which tells a confidence that ``top`` trails of the pair reach; only weights that reach it are listed.
    """
    starts, stops = f.select("node"), b.select("node")
    on_halves = small(cut(f.select(F.explode("nodes").alias("far")).unionByName(b.select(F.explode("nodes").alias("far"))).distinct()))
    spokes = _leaving(steps, starts.unionByName(stops))
    free = spokes.join(on_halves, "far", "left_anti")

    # both edges of the same two nodes may be one edge, which is no middle
    tally = free.select("far", "near", "weight").repartition("far").groupBy("far", "near", "weight").agg(F.count(F.lit(1)).alias("n"))
    first = _leaving(tally, starts)
    second = _leaving(tally.select("far", F.col("near").alias("end"), F.col("weight").alias("other_weight"), F.col("n").alias("m")), stops, "end")
    same = ((F.col("near") == F.col("end")) & (F.col("weight") == F.col("other_weight"))).cast("long")
    classes = first.join(second, "far").groupBy("near", F.col("end").alias("far"), "weight", "other_weight").agg(F.sum(F.col("n") * (F.col("m") - same)).alias("n"))
    met = cut(_ends_met(f, cut(classes.where("n > 0")), b, limits).select("pair_id", "near", "far", "weight", "other_weight", "path_confidence", "n"))
    reached = met.select("pair_id", "path_confidence", "n")
    if found is not None:
        reached = reached.unionByName(found.select("pair_id", "path_confidence", F.lit(1).cast("long").alias("n")))
    down = Window.partitionBy("pair_id").orderBy(F.col("path_confidence").desc())
    so_far = reached.groupBy("pair_id", "path_confidence").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(down))
    least = so_far.where(F.col("n") >= top).groupBy("pair_id").agg(F.max("path_confidence").alias("least"))
    needed = met.join(least, "pair_id", "left").where(F.col("least").isNull() | (F.col("path_confidence") >= F.col("least")))
    needed = small(cut(needed.select("near", F.col("far").alias("end"), "weight", "other_weight").distinct()))

    def through(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select("far", F.col("near").alias("end"), F.col("weight").alias("other_weight"), F.col("edge_id").alias("other_id"), F.col("layer").alias("other_layer"))
        return left.join(other, "far").where(F.col("edge_id") != F.col("other_id"))

    one = free.join(small(needed.select("near", "weight").distinct()), ["near", "weight"], "left_semi")
    two = free.join(small(needed.select(F.col("end").alias("near"), F.col("other_weight").alias("weight")).distinct()), ["near", "weight"], "left_semi")
    kind = ["near", "end", "weight", "other_weight"]
    order = Window.partitionBy(*kind).orderBy("edge_id", "other_id")
    listed = through(one, two).join(needed, kind, "left_semi").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
    bound = cut(_first_parallel(spokes.join(on_halves, "far", "left_semi"), most))
    middles = listed.unionByName(through(_leaving(bound, starts), _leaving(bound, stops)).select(*listed.columns))
    return cut(
        middles.select(
            "near", F.col("end").alias("far"), "weight", "other_weight", F.array("far").alias("inner"),
            F.array("edge_id", "other_id").alias("ids"), F.array("layer", "other_layer").alias("layers"),
        )
    )


def weighted_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_WEIGHTED_HOPS, top: int = TOP_WEIGHTED) -> DataFrame:
    """Best ``top`` undirected trails (no edge twice) of each pair by product of weights, at most ``max_hops`` long.

    ``edges(edge_id, source, target, layer, weight)``, a stored table that is read for every length, weights of at least 0,
    ``pairs(pair_id, source, target)``. Ties: fewer hops, then edge ids.

    Lengths are searched one after the other. Once a pair has ``top`` trails, a longer one must beat the last of them, so that
    confidence is shared by all halves of the pair as a limit: a half stays only while its product, times the best weight at
    the other end and the best weights between, can exceed it, and a pair that nothing can improve is done.

    Two halves of equal length are joined by one edge, or by two through any node: a hub that ends a half is never left
    towards all its neighbours, and of the ways through the neighbours of two hubs only the first are listed. Edges are
    shuffled once or twice, by the node between, those alone that touch the end of a half.
    """
    ends = edges.select(F.col("source").alias("near"), F.col("target").alias("far"), "edge_id", "layer", "weight")
    back = ends.where(F.col("near") != F.col("far")).select(F.col("far").alias("near"), F.col("near").alias("far"), "edge_id", "layer", "weight")
    steps = ends.unionByName(back)
    most = top + max_hops - 1  # parallel edges of one weight: so many leave ``top`` that the rest of a trail does not hold
    pairs = cut(pairs.select("pair_id", "source", "target"))
    at_node = cut(_leaving(steps, pairs.select(F.explode(F.array("source", "target")).alias("node"))).groupBy("near").agg(F.max("weight").alias("best")))
    best_weight = edges.agg(F.max("weight")).first()[0]
    best_weight = 0.0 if best_weight is None else best_weight
    pairs = cut(
        pairs
        .join(at_node.select(F.col("near").alias("source"), F.col("best").alias("at_source")), "source")
        .join(at_node.select(F.col("near").alias("target"), F.col("best").alias("at_target")), "target")
    )

    def rest(edges_between: int) -> float:
        """Best product of so many edges; with weights above 1 more edges may be better, and all that may follow count."""
        return best_weight**edges_between if best_weight <= 1 else best_weight**max_hops

    def start(column: str) -> DataFrame:
        strings = F.array().cast("array<string>")
        return pairs.select("pair_id", F.col(column).alias("node"), F.array(column).alias("nodes"), strings.alias("ids"), strings.alias("layers"), F.lit(1.0).alias("product"))

    def grown(halves: DataFrame) -> DataFrame:
        further = _first_parallel(_leaving(steps, halves), most)
        return halves.withColumnRenamed("node", "near").join(further, "near").where(~F.array_contains("ids", F.col("edge_id"))).select(
            "pair_id", F.col("far").alias("node"), F.concat("nodes", F.array("far")).alias("nodes"), F.concat("ids", F.array("edge_id")).alias("ids"),
            F.concat("layers", F.array("layer")).alias("layers"), (F.col("product") * F.col("weight")).alias("product"),
        )

    limits = pairs.select("pair_id", "at_source", "at_target", F.lit(None).cast("double").alias("floor"))
    order = Window.partitionBy("pair_id").orderBy(F.col("path_confidence").desc(), "hops", "edge_ids")
    halves = {"at_target": start("source"), "at_source": start("target")}
    found = None
    for hops in range(1, max_hops + 1):
        length = (hops - 1) // 2  # of a half; the middle has the one or two edges left
        for last in halves:
            longer = grown(halves[last]) if hops > 1 and hops % 2 else halves[last]
            halves[last] = cut(_hopeful(longer, limits, last, rest(hops - length - 1)))
        f, b = halves["at_target"], halves["at_source"]
        if hops % 2:
            middles = cut(_first_parallel(_leaving(_leaving(steps, f), b, "far"), most).select(
                "near", "far", "weight", F.lit(1.0).alias("other_weight"), F.array().cast("array<string>").alias("inner"), F.array("edge_id").alias("ids"), F.array("layer").alias("layers")
            ))
        else:
            middles = _two_steps(steps, f, b, limits, found, top, most)
        now = _ends_met(f, middles, b, limits).where(~F.arrays_overlap("ids", "f_ids") & ~F.arrays_overlap("ids", "b_ids")).select(
            "pair_id", F.lit(hops).alias("hops"), F.concat("f_nodes", "inner", F.reverse("b_nodes")).alias("nodes"), F.concat("f_ids", "ids", F.reverse("b_ids")).alias("edge_ids"),
            F.concat("f_layers", "layers", F.reverse("b_layers")).alias("layers"), "path_confidence",
        )
        now = now if found is None else found.drop("rank").unionByName(now)
        found = cut(now.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        if hops == max_hops:
            break
        # pairs that a longer trail can still improve
        floors = found.where(F.col("rank") == top).select("pair_id", F.col("path_confidence").alias("floor"))
        hope = F.col("at_source") * F.col("at_target") * F.lit(rest(hops - 1))
        limits = cut(pairs.select("pair_id", "at_source", "at_target").join(floors, "pair_id", "left").where(F.col("floor").isNull() | (_confidence(hope) > F.col("floor"))))
        if limits.isEmpty():
            break
    return found
