"""Entity resolution: deterministic rules, blocked comparison, declared-weight scoring, candidate emission.

Features of an entity live in a long table ``features(entity_id, kind, value)`` with kinds ``alias``, ``affiliation``
and ``associate``: overlaps are joins on (kind, value), so a hub with a huge associate list is never an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.names import jaro_winkler
from ..session import cut
from .windows import join_within, pairs_within

# --- fixed values: declared m/u weights, first matching level wins -----------------------------
PRIOR = 1e-4
THRESHOLD = 0.80
NAME_LEVELS = {4: (0.55, 0.00005), 3: (0.20, 0.0004), 2: (0.13, 0.002), 1: (0.07, 0.01), 0: (0.05, 0.9875)}
ALIAS_LEVELS = {1: (0.4, 0.005), 0: (0.6, 0.995)}
AFFILIATION_LEVELS = {1: (0.5, 0.05), 0: (0.5, 0.95)}
ASSOCIATE_LEVELS = {2: (0.35, 0.01), 1: (0.25, 0.05), 0: (0.4, 0.94)}
BIRTH_LEVELS = {1: (0.9, 0.02), 0: (0.1, 0.98)}
JW_CLOSE, JW_NEAR = 0.92, 0.85
RULE_PRECISION_FLOOR, TRANSLITERATION_RECALL_FLOOR, REVIEW_LOAD_CEILING = 0.95, 0.70, 50.0
# ----------------------------------------------------------------------------------------------
COMPARISONS = {
    "name": NAME_LEVELS,
    "alias": ALIAS_LEVELS,
    "affiliation": AFFILIATION_LEVELS,
    "associate": ASSOCIATE_LEVELS,
    "birth": BIRTH_LEVELS,
}


def normalized_identifier(value: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit(""))


def identifier_observations(claims: DataFrame, active: DataFrame) -> DataFrame:
    """Identifier claims as observations: the anchor mention, else every active mention of the subject."""
    stated = claims.where(F.col("predicate").isin(*V.identifier_predicates()) & F.col("retracted_on").isNull() & F.col("object_value").isNotNull())
    fields = ["claim_id", "predicate", F.col("object_value").alias("value"), "jurisdiction", "valid_from", "valid_to"]
    anchored = stated.where("subject_mention_id IS NOT NULL").select(F.col("subject_mention_id").alias("mention_id"), *fields)
    spread = stated.where("subject_mention_id IS NULL").join(
        active.select("mention_id", F.col("entity_id").alias("subject_id")), "subject_id"
    ).select("mention_id", *fields)
    return anchored.unionByName(spread)


def identifier_pairs(observations: DataFrame) -> DataFrame:
    """Mentions with the same identifier, unless issuers differ or validity windows are disjoint.

    Conflicting issuers are never paired to begin with: rows are grouped by (predicate, value, issuer) and a row
    without an issuer meets every issuer's rows through the group without one.
    """
    keyed = observations.withColumn("_value", normalized_identifier(F.col("value"))).where("_value IS NOT NULL")
    one = keyed.groupBy("predicate", "_value", "mention_id").agg(
        F.max_by(F.struct("claim_id", "jurisdiction", "valid_from", "valid_to"), "claim_id").alias("o")
    ).select("predicate", "_value", "mention_id", "o.*")
    issued = one.where("jurisdiction IS NOT NULL")
    within = pairs_within(issued, ["predicate", "_value", "jurisdiction"], "mention_id").select("predicate", "a", "b", F.col("jurisdiction").alias("_issuer"))
    unissued = one.where("jurisdiction IS NULL").drop("jurisdiction")
    free = pairs_within(unissued, ["predicate", "_value"], "mention_id")
    fields = ["mention_id", "claim_id", "valid_from", "valid_to"]
    cross = join_within(
        issued.select("predicate", "_value", F.col("jurisdiction").alias("_issuer"), F.struct(*fields).alias("x")),
        unissued.select("predicate", "_value", F.struct(*fields).alias("y")), ["predicate", "_value"],
    )
    swap = F.col("x.mention_id") > F.col("y.mention_id")
    crossed = cross.select(
        "predicate", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), "_issuer"
    )
    shape = lambda d, issuer: d.select(
        "predicate", *[F.col(f"{s}.{f}").alias(f"{f}_{s}") for s in "ab" for f in fields], issuer.alias("jurisdiction")
    )
    met = reduce(
        DataFrame.unionByName,
        [shape(within, F.col("_issuer")), shape(free, F.lit(None).cast("string")), shape(crossed, F.col("_issuer"))],
    )
    apart = (F.col("valid_to_a") < F.col("valid_from_b")) | (F.col("valid_to_b") < F.col("valid_from_a"))
    return met.where(~F.coalesce(apart, F.lit(False))).select(
        F.col("mention_id_a").alias("mention_a"), F.col("mention_id_b").alias("mention_b"), "predicate",
        F.least("claim_id_a", "claim_id_b").alias("claim_low"), F.greatest("claim_id_a", "claim_id_b").alias("claim_high"), "jurisdiction",
    )


def suppressed_conflicts(observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many pairs of equal identifiers the issuer and validity rules kept out, counted without listing them."""
    keyed = observations.withColumn("_value", normalized_identifier(F.col("value"))).where("_value IS NOT NULL")
    sizes = keyed.select("predicate", "_value", "mention_id").distinct().groupBy("predicate", "_value").agg(F.count(F.lit(1)).alias("n"))
    possible = sizes.groupBy("predicate").agg(F.sum(F.expr("n * (n - 1) / 2")).cast("long").alias("possible"))
    kept = pairs.groupBy("predicate").agg(F.count(F.lit(1)).alias("kept"))
    return possible.join(kept, "predicate", "left").select("predicate", (F.col("possible") - F.coalesce("kept", F.lit(0))).alias("suppressed_conflict"))


def same_key_pairs(mentions: DataFrame) -> DataFrame:
    rows = mentions.select("record_id", "norm_key", "mention_id").distinct()
    return pairs_within(rows, ["record_id", "norm_key"], "mention_id").select(
        "record_id", "norm_key", F.col("a.mention_id").alias("mention_a"), F.col("b.mention_id").alias("mention_b")
    )


def entity_features(claims: DataFrame, alias_key: Column, affiliation_key: Column) -> DataFrame:
    """Long feature table from live claims; key columns are computed on ``value`` before they are de-duplicated."""
    live = claims.where("retracted_on IS NULL")
    if "object_value" not in live.columns:
        live = live.withColumn("object_value", F.lit(None).cast("string"))
    alias = live.where("predicate = 'known_as' AND object_value IS NOT NULL").select(
        F.col("subject_id").alias("entity_id"), F.lit("alias").alias("kind"), F.col("object_value").alias("value")
    ).distinct().withColumn("value", alias_key)
    affiliation = live.where("predicate = 'affiliated_with'").select(
        F.col("subject_id").alias("entity_id"), F.lit("affiliation").alias("kind"), F.coalesce("object_id", "object_value").alias("value")
    ).where("value IS NOT NULL").distinct().withColumn("value", affiliation_key)
    linked = live.where("object_id IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.col("subject_id").alias("entity_id"), F.col("object_id").alias("value")),
                             F.struct(F.col("object_id").alias("entity_id"), F.col("subject_id").alias("value")))).alias("e")
    associate = linked.select(ends).select("e.entity_id", F.lit("associate").alias("kind"), "e.value")
    return alias.unionByName(affiliation).unionByName(associate).distinct()


def birth_dates(claims: DataFrame) -> DataFrame:
    """(entity_id, date_of_birth) where exactly one distinct date is stated."""
    stated = claims.where("predicate = 'born_on' AND object_value IS NOT NULL AND retracted_on IS NULL")
    return stated.groupBy(F.col("subject_id").alias("entity_id")).agg(
        F.min("object_value").alias("date_of_birth"), F.max("object_value").alias("_last")
    ).where("date_of_birth = _last").drop("_last")


def feature_frame(mentions: DataFrame, active: DataFrame, births: DataFrame | None = None) -> DataFrame:
    """One row per resolved mention with its keys; ``mentions`` already carries them (see ``names.mention_keys``)."""
    keys = [c for c in ("latin_key", "script_key", "phonetic_key", "norm_key", "script") if c in mentions.columns]
    rows = mentions.select(F.col("mention_id").alias("unique_id"), *keys).join(
        active.select(F.col("mention_id").alias("unique_id"), "entity_id"), "unique_id"
    )
    if births is None:
        return rows.withColumn("date_of_birth", F.lit(None).cast("string"))
    return rows.join(births, "entity_id", "left")


def snapshot_digest(claims: DataFrame) -> DataFrame:
    """Content digest of the live association graph.

    A sum of row hashes instead of a hash over sorted lines: the same multiset gives the same digest, and each task
    adds up its own rows, so nothing is sorted or gathered.
    """
    live = claims.where("object_id IS NOT NULL AND retracted_on IS NULL")
    line = F.sha2(F.concat_ws("|", "subject_id", "object_id", "predicate"), 256)
    lanes = {f"lane_{i}": F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)}
    summed = live.agg(F.count(F.lit(1)).alias("edges"), *[F.coalesce(e, F.lit("0")).alias(n) for n, e in lanes.items()])
    return summed.select("edges", F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("|", *lanes), 256), 1, 32)).alias("graph_snapshot_id"))


def block_keys(frame: DataFrame, features: DataFrame, whole_lists: bool = False) -> DataFrame:
    """(unique_id, block): phonetic key, first four characters of the Latin key, each affiliation.

    ``whole_lists`` blocks on the equality of an entity's complete affiliation list instead, where all entities
    without any share one block. That block is quadratic to enumerate; use it with ``pairs_above``, which does not.
    """
    affiliated = features.where("kind = 'affiliation'")
    ids = frame.select("unique_id", "entity_id")
    if whole_lists:
        third = ids.join(_affiliation_lists(features), "entity_id", "left").select("unique_id", F.concat(F.lit("a:"), F.coalesce("list", F.lit(""))).alias("block"))
    else:
        by_entity = affiliated.select("entity_id", F.concat(F.lit("a:"), "value").alias("block"))
        third = ids.join(by_entity, "entity_id").select("unique_id", "block")
    return (
        frame.where("phonetic_key IS NOT NULL").select("unique_id", F.concat(F.lit("p:"), "phonetic_key").alias("block"))
        .unionByName(frame.where("latin_key IS NOT NULL").select("unique_id", F.concat(F.lit("l:"), F.substring("latin_key", 1, 4)).alias("block")))
        .unionByName(third)
        .distinct()
    )


def block_pairs(frame: DataFrame, features: DataFrame, whole_lists: bool = False) -> DataFrame:
    """Pairs meeting in any block, each pair once."""
    return pairs_within(block_keys(frame, features, whole_lists), ["block"], "unique_id").select(
        F.col("a.unique_id").alias("id_a"), F.col("b.unique_id").alias("id_b")
    ).distinct()


def shared_counts(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(entity_a, entity_b) with the number of shared aliases, affiliations and associates."""
    f = features.select("entity_id", "kind", "value")
    entities = pairs.select("entity_a", "entity_b").distinct()
    met = entities.join(f.withColumnRenamed("entity_id", "entity_a"), "entity_a").join(
        f.withColumnRenamed("entity_id", "entity_b"), ["entity_b", "kind", "value"]
    )
    return met.groupBy("entity_a", "entity_b").agg(
        *[F.count_if(F.col("kind") == k).alias(f"shared_{k}") for k in ("alias", "affiliation", "associate")]
    )


def compare_pairs(pairs: DataFrame, frame: DataFrame, features: DataFrame) -> DataFrame:
    """Level reached by each comparison: ``gamma_*`` with -1 where a value is missing."""
    side = lambda s: frame.select(
        F.col("unique_id").alias(f"id_{s}"), F.col("entity_id").alias(f"entity_{s}"), F.col("latin_key").alias(f"latin_{s}"),
        F.col("script_key").alias(f"script_{s}"), F.col("date_of_birth").alias(f"dob_{s}"),
    )
    rows = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    shared = shared_counts(rows, features)
    rows = rows.join(shared, ["entity_a", "entity_b"], "left")
    exact = F.coalesce((F.col("script_a") == F.col("script_b")) | (F.col("latin_a") == F.col("latin_b")), F.lit(False))
    jw = jaro_winkler(F.when(~exact, F.col("latin_a")), F.when(~exact, F.col("latin_b")))
    rows = rows.withColumn("jw", jw)
    missing = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    level = lambda c, top: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(top)).cast("int")
    return rows.select(
        "id_a", "id_b", "entity_a", "entity_b",
        F.when(missing("latin_a", "latin_b"), -1)
        .when(F.col("script_a") == F.col("script_b"), 4)
        .when(F.col("latin_a") == F.col("latin_b"), 3)
        .when(F.col("jw") >= JW_CLOSE, 2)
        .when(F.col("jw") >= JW_NEAR, 1)
        .otherwise(0).alias("gamma_name"),
        level("shared_alias", 1).alias("gamma_alias"),
        level("shared_affiliation", 1).alias("gamma_affiliation"),
        level("shared_associate", 2).alias("gamma_associate"),
        F.when(missing("dob_a", "dob_b"), -1).when(F.col("dob_a") == F.col("dob_b"), 1).otherwise(0).alias("gamma_birth"),
    )


def bayes_factor(gamma: Column, levels: dict) -> Column:
    return V.lookup(gamma, {g: m / u for g, (m, u) in levels.items()}, 1.0)


def score_pairs(compared: DataFrame, prior: float = PRIOR) -> DataFrame:
    factors = {f"bf_{n}": bayes_factor(F.col(f"gamma_{n}"), levels) for n, levels in COMPARISONS.items()}
    rows = compared.withColumns(factors)
    odds = F.lit(prior / (1 - prior))
    for n in factors:
        odds = odds * F.col(n)
    return rows.withColumn("odds", odds).withColumn("probability", F.col("odds") / (1 + F.col("odds"))).drop("odds")


# Every level combination that reaches the threshold agrees on at least two of these; joining on two agreeing values
# at once replaces "all pairs of a block" when only pairs above the threshold are wanted.
AGREEMENTS = ("script", "latin", "alias", "affiliation", "associate", "birth")


def sufficient_agreements(threshold: float = THRESHOLD, prior: float = PRIOR) -> list[tuple[str, str]] | None:
    """Pairs of agreements one of which every pair at or above ``threshold`` shows; None if one agreement could do.

    Read off the declared weights by going through all level combinations, so other weights or thresholds give
    another (still complete) list.
    """
    need: list[set[frozenset]] = []
    odds_floor = threshold / (1 - threshold) * (1 - prior) / prior if threshold < 1 else float("inf")
    named = {4: {"script"}, 3: {"latin"}, 2: set(), 1: set(), 0: set(), -1: set()}
    for g_name, bf_name in [*((g, m / u) for g, (m, u) in NAME_LEVELS.items()), (-1, 1.0)]:
        for g_al, bf_al in ((g, m / u) for g, (m, u) in ALIAS_LEVELS.items()):
            for g_af, bf_af in ((g, m / u) for g, (m, u) in AFFILIATION_LEVELS.items()):
                for g_as, bf_as in ((g, m / u) for g, (m, u) in ASSOCIATE_LEVELS.items()):
                    for g_b, bf_b in [*((g, m / u) for g, (m, u) in BIRTH_LEVELS.items()), (-1, 1.0)]:
                        if bf_name * bf_al * bf_af * bf_as * bf_b < odds_floor * (1 - 1e-9):
                            continue
                        agree = set(named[g_name])
                        agree |= {n for n, g in (("alias", g_al), ("affiliation", g_af), ("associate", g_as), ("birth", g_b)) if g > 0}
                        if len(agree) < 2:
                            return None
                        need.append({frozenset(p) for p in _two_of(sorted(agree))})
    chosen: set[frozenset] = set()
    while need:
        counts: dict[frozenset, int] = {}
        for options in need:
            for o in options:
                counts[o] = counts.get(o, 0) + 1
        best = min(counts, key=lambda o: (-counts[o], sorted(o)))
        chosen.add(best)
        need = [options for options in need if best not in options]
    return sorted(tuple(sorted(c)) for c in chosen)


def _two_of(items: list[str]):
    return [(x, y) for i, x in enumerate(items) for y in items[i + 1:]]


def pairs_above(frame: DataFrame, features: DataFrame, threshold: float = THRESHOLD, whole_lists: bool = False) -> DataFrame:
    """The blocked pairs of mentions of different entities that can reach ``threshold``, without enumerating the blocks.

    Exact: a pair is produced when it agrees on two values some above-threshold level combination needs, and kept
    when it also meets in a block. Agreeing values are paired by entity first, so an entity of many mentions meets
    others once and itself never; pairs inside an entity are counted by ``pairs_inside``.
    """
    combos = sufficient_agreements(threshold)
    owner = frame.select("unique_id", "entity_id")
    if combos is None:
        pairs = block_pairs(frame, features, whole_lists)
        return pairs.join(owner.toDF("id_a", "_ea"), "id_a").join(owner.toDF("id_b", "_eb"), "id_b").where("_ea <> _eb").select("id_a", "id_b")
    long = {
        "script": frame.select("unique_id", F.col("script_key").alias("v")),
        "latin": frame.select("unique_id", F.col("latin_key").alias("v")),
        "birth": frame.select("unique_id", F.col("date_of_birth").cast("string").alias("v")),
    }
    owned = owner.join(features, "entity_id")
    for kind in ("alias", "affiliation", "associate"):
        long[kind] = owned.where(F.col("kind") == kind).select("unique_id", F.col("value").alias("v"))
    long = {k: d.where("v IS NOT NULL") for k, d in long.items()}
    keyed = [
        long[x].withColumnRenamed("v", "_x").join(long[y].withColumnRenamed("v", "_y"), "unique_id")
        .select("unique_id", F.concat_ws("\u0001", F.lit(f"{x}+{y}"), "_x", "_y").alias("key"))
        for x, y in combos
    ]
    held = cut(reduce(DataFrame.unionByName, keyed).distinct().join(owner, "unique_id"))
    met = pairs_within(held.select("key", "entity_id").distinct(), ["key"], "entity_id").select("key", F.col("a.entity_id").alias("_ea"), F.col("b.entity_id").alias("_eb"))
    mentions = held.join(met.select(F.explode(F.array("_ea", "_eb")).alias("entity_id"), "key").distinct(), ["key", "entity_id"]).select("key", "entity_id", "unique_id")
    spread = met.join(mentions.toDF("key", "_ea", "_x"), ["key", "_ea"]).join(mentions.toDF("key", "_eb", "_y"), ["key", "_eb"])
    candidates = spread.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b")).distinct()
    blocks = block_keys(frame, features, whole_lists)
    blocked = candidates.join(blocks.toDF("id_a", "block"), "id_a").join(blocks.toDF("id_b", "block"), ["id_b", "block"])
    return blocked.select("id_a", "id_b").distinct()


def _choose_two(n: str) -> Column:
    """n * (n - 1) / 2 of a long column without overflow."""
    half = f"CAST(CASE WHEN {n} % 2 = 0 THEN {n} DIV 2 ELSE {n} END AS DECIMAL(19, 0)) * CAST(CASE WHEN {n} % 2 = 0 THEN {n} - 1 ELSE ({n} - 1) DIV 2 END AS DECIMAL(19, 0))"
    return F.expr(half)


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def _affiliation_lists(features: DataFrame) -> DataFrame:
    """(entity_id, list): the complete affiliation list of an entity as one value; entities without any are absent."""
    own = features.where("kind = 'affiliation'").select("entity_id", "value")
    return own.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("value")), "\u0001").alias("list"))


def compared_pairs(frame: DataFrame, features: DataFrame) -> DataFrame:
    """How many pairs meet in some block when whole affiliation lists block: one row, ``compared``.

    A mention has one phonetic key, one prefix and one list, so the union of the three relations follows from the sizes
    of seven groupings (inclusion and exclusion), all in one aggregation; no pair is listed.
    """
    rows = frame.select("entity_id", F.col("phonetic_key").alias("p"), F.substring("latin_key", 1, 4).alias("l"))
    rows = rows.join(_affiliation_lists(features), "entity_id", "left").withColumn("a", F.coalesce("list", F.lit("")))
    groups = []
    for names in ("p", "l", "a", "pl", "pa", "la", "pla"):
        key = F.struct(F.lit(names).alias("of"), *(F.when(F.lit(c in names), F.col(c)).alias(c) for c in "pla"))
        known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])
        groups.append(F.when(known, key))
    sizes = rows.select(F.explode(F.array(*groups)).alias("g")).where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sign = F.when(F.length("g.of") == 2, -1).otherwise(1)
    return sizes.agg(_total(_choose_two("n") * sign).alias("compared"))


def pairs_inside(frame: DataFrame, features: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """How many pairs of mentions of one entity reach ``threshold``: one row, ``same_entity``.

    Inside an entity everything but the name is the same for all pairs: every alias, affiliation and associate is shared,
    and so is the date of birth. So each entity says which levels of the name comparison would reach the threshold. The
    upper levels are counted from the sizes of groups of equal names; only where a similarity of names decides are
    different names of the entity compared, each pair of names once.
    """
    held = features.groupBy("entity_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("alias", "affiliation", "associate")])
    level = lambda c, top: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(top)).cast("int")
    mentions = frame.select("unique_id", "entity_id", "latin_key", "script_key", "date_of_birth")
    by_entity = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.count("latin_key").alias("named"), F.max("date_of_birth").alias("born")).where("n > 1")
    odds = F.lit(prior / (1 - prior))
    for name, gamma in (("alias", level("alias", 1)), ("affiliation", level("affiliation", 1)), ("associate", level("associate", 2)), ("birth", F.when(F.col("born").isNull(), -1).otherwise(1))):
        odds = odds * bayes_factor(gamma, COMPARISONS[name])
    floor = threshold / (1 - threshold) if threshold < 1 else float("inf")
    reaches = {g: F.col("odds") * F.lit(m / u) / (1 + F.col("odds") * F.lit(m / u)) >= threshold for g, (m, u) in NAME_LEVELS.items()}
    reaches[-1] = F.col("odds") / (1 + F.col("odds")) >= threshold
    best = max(m / u for m, u in NAME_LEVELS.values())
    entities = by_entity.join(held, "entity_id", "left").withColumn("odds", odds).where(F.col("odds") * F.lit(max(best, 1.0)) >= F.lit(floor * (1 - 1e-9)))
    entities = cut(entities.select("entity_id", "n", "named", *[r.alias(f"r{g}") for g, r in sorted(reaches.items())]).toDF("entity_id", "n", "named", "missing", "r0", "r1", "r2", "r3", "r4"))
    names = cut(mentions.where("latin_key IS NOT NULL").join(entities.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id", "latin_key", "script_key").agg(F.count(F.lit(1)).alias("n")))
    # equal names: same script (level 4), same Latin key only (level 3)
    scripted = names.where("script_key IS NOT NULL")
    equal = lambda d, column, name: d.groupBy("entity_id", column).agg(F.sum("n").alias("n")).groupBy("entity_id").agg(F.sum(_choose_two("n")).alias(name))
    script, latin = equal(scripted, "script_key", "same_script"), equal(names, "latin_key", "same_latin")
    both = scripted.groupBy("entity_id").agg(F.sum(_choose_two("n")).alias("same_both"))
    counts = entities.join(script, "entity_id", "left").join(latin, "entity_id", "left").join(both, "entity_id", "left").na.fill(0, ["same_script", "same_latin", "same_both"])
    at_3 = F.col("same_latin") - F.col("same_both")
    rest = _choose_two("named") - F.col("same_script") - at_3
    gain = lambda flag, count: F.when(F.col(flag), count).otherwise(F.lit(0))
    all_levels = F.col("r0") & F.col("r1") & F.col("r2")
    counted = counts.agg(
        _total(gain("missing", _choose_two("n") - _choose_two("named")) + gain("r4", F.col("same_script")) + gain("r3", at_3) + F.when(all_levels, rest).otherwise(F.lit(0))).alias("same_entity")
    )
    # a similarity decides: different names of those entities
    close = names.join(entities.where((F.col("r0") | F.col("r1") | F.col("r2")) & ~all_levels), "entity_id").select("entity_id", "latin_key", "script_key", names["n"].alias("m"), "r0", "r1", "r2")
    met = pairs_within(close.withColumn("name", F.concat_ws("\u0001", "latin_key", "script_key")), ["entity_id"], "name")
    differ = met.where((F.col("a.latin_key") != F.col("b.latin_key")) & ~F.coalesce(F.col("a.script_key") == F.col("b.script_key"), F.lit(False)))
    jw = jaro_winkler(F.col("a.latin_key"), F.col("b.latin_key"))
    judged = differ.select((F.col("a.m") * F.col("b.m")).alias("pairs"), F.col("a.r0").alias("r0"), F.col("a.r1").alias("r1"), F.col("a.r2").alias("r2"), jw.alias("jw"))
    hit = F.when(F.col("jw") >= JW_CLOSE, F.col("r2")).when(F.col("jw") >= JW_NEAR, F.col("r1")).otherwise(F.col("r0"))
    similar = judged.where(hit).agg(_total(F.col("pairs")).alias("same_entity"))
    return counted.unionByName(similar).agg(F.sum("same_entity").alias("same_entity"))


OUTCOMES = ("suppressed_constraint", "already_open", "emitted")


def run_report(frame: DataFrame, features: DataFrame, judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counters of a run in one row: compared, below_threshold, same_entity and the outcomes of ``judged``.

    ``judged``: ``judge_candidates`` of the pairs of ``pairs_above`` with whole lists. What is not listed is counted: pairs
    inside an entity by ``pairs_inside``, all blocked pairs by ``compared_pairs``; the rest is below the threshold.
    """
    outcomes = judged.agg(*[_total(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES])
    parts = [compared_pairs(frame, features), pairs_inside(frame, features, threshold), outcomes]
    names = ["compared", "same_entity", *OUTCOMES]
    rows = [d.select(*[F.col(n) if n in d.columns else F.lit(0).cast("long").alias(n) for n in names]) for d in parts]
    total = reduce(DataFrame.unionByName, rows).agg(*[F.sum(n).alias(n) for n in names])
    below = F.col("compared") - F.col("same_entity") - F.col("suppressed_constraint") - F.col("already_open") - F.col("emitted")
    return total.select("compared", below.alias("below_threshold"), "same_entity", *OUTCOMES)


def judge_candidates(
    scored: DataFrame, active: DataFrame, constraints: DataFrame, existing: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """Scored pairs with the first reason that keeps each out of the queue; ``emitted`` where none does.

    ``scored(mention_a, mention_b, probability)``, ``constraints``/``existing(mention_a, mention_b)``.
    """
    members = active.select("mention_id", "entity_id")
    pair = ["mention_a", "mention_b"]
    rows = (
        scored.join(members.toDF("mention_a", "_ea"), "mention_a", "left")
        .join(members.toDF("mention_b", "_eb"), "mention_b", "left")
        .join(constraints.select(*pair, F.lit(True).alias("_c")).distinct(), pair, "left")
        .join(existing.select(*pair, F.lit(True).alias("_x")).distinct(), pair, "left")
    )
    outcome = (
        F.when(F.col("probability") < threshold, "below_threshold")
        .when(F.col("_ea") == F.col("_eb"), "same_entity")
        .when(F.col("_c"), "suppressed_constraint")
        .when(F.col("_x"), "already_open")
        .otherwise("emitted")
    )
    return rows.withColumn("outcome", outcome).drop("_ea", "_eb", "_c", "_x")


def evaluate(rule_pairs: DataFrame, model_pairs: DataFrame, same_document: DataFrame, truth: DataFrame, transliteration: DataFrame, distinct: DataFrame) -> DataFrame:
    """Quality of the emitted pairs against ``truth(mention_id, truth_entity)``, one row with the pass verdict."""
    pair = ["mention_a", "mention_b"]
    flag = lambda d, n: d.select(*pair, F.lit(1).alias(n)).distinct()
    all_pairs = reduce(
        lambda x, y: x.join(y, pair, "full"),
        [flag(rule_pairs, "rule"), flag(model_pairs, "model"), flag(same_document, "same_doc"), flag(transliteration, "translit"), flag(distinct, "distinct")],
    ).na.fill(0)
    t = truth.select("mention_id", "truth_entity")
    rated = all_pairs.join(t.toDF("mention_a", "_ta"), "mention_a", "left").join(t.toDF("mention_b", "_tb"), "mention_b", "left")
    right = (F.col("_ta") == F.col("_tb")).cast("int")
    queued = F.greatest("rule", "model", "same_doc")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rated.agg(
        total(F.col("rule") * right).alias("rule_true_positives"),
        total("rule").alias("_rule"),
        total(F.col("translit") * F.col("model")).alias("transliteration_true_positives"),
        total("translit").alias("transliteration_pairs"),
        total(queued).alias("emitted_candidate_pairs"),
        total(queued * F.col("distinct")).alias("distinct_pairs_emitted"),
        F.lit(0).cast("long").alias("mention_count"),
    )
    counted = truth.agg(*[F.lit(0).cast("long").alias(c) for c in sums.columns[:-1]], F.count(F.lit(1)).alias("mention_count"))
    merged = sums.unionByName(counted).agg(*[F.sum(c).alias(c) for c in sums.columns])
    ratio = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    return (
        merged.withColumn("rule_false_positives", F.col("_rule") - F.col("rule_true_positives"))
        .withColumn("rule_pairwise_precision", F.round(ratio("rule_true_positives", "_rule"), 6))
        .withColumn("transliteration_pairwise_recall", F.round(ratio("transliteration_true_positives", "transliteration_pairs"), 6))
        .withColumn("review_load_per_1000_mentions", F.round(F.col("emitted_candidate_pairs") * 1000.0 / F.col("mention_count"), 6))
        .withColumn(
            "passed",
            (F.col("rule_pairwise_precision") >= RULE_PRECISION_FLOOR)
            & (F.col("transliteration_pairwise_recall") >= TRANSLITERATION_RECALL_FLOOR)
            & (F.col("review_load_per_1000_mentions") <= REVIEW_LOAD_CEILING),
        )
        .drop("_rule")
    )


def feature_map(scored: DataFrame) -> Column:
    """Scored columns as the string map stored with a candidate."""
    parts = []
    for n in COMPARISONS:
        for p in ("bf", "gamma"):
            parts += [F.lit(f"{p}_{n}"), F.col(f"{p}_{n}").cast("string")]
    return F.create_map(*parts)


def waterfall(candidates: DataFrame) -> DataFrame:
    """Factors of each candidate regrouped by comparison, with the strength that orders them."""
    entry = candidates.select("candidate_id", F.explode("features").alias("key", "value"))
    parsed = entry.select(
        "candidate_id", F.regexp_extract("key", "^(bf|gamma|tf)_(.+)$", 1).alias("part"), F.regexp_extract("key", "^(bf|gamma|tf)_(.+)$", 2).alias("comparison"), "value"
    ).where("part <> ''")
    return parsed.groupBy("candidate_id", "comparison").agg(
        F.max(F.when(F.col("part") == "bf", F.col("value").cast("double"))).alias("bayes_factor"),
        F.max(F.when(F.col("part") == "gamma", F.col("value").cast("double"))).cast("int").alias("gamma"),
        F.max(F.when(F.col("part") == "tf", F.col("value").cast("double"))).alias("term_frequency"),
    ).where("bayes_factor IS NOT NULL").withColumn("strength", F.abs(F.log10("bayes_factor")))
