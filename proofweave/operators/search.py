"""Name search as a set join: many query texts against labels, aliases and mention keys."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# --- fixed values --------------------------------------------------------------------------------
SIMILARITY_FLOOR = 0.35
PHONETIC_SCORE = 0.5
MAX_QUERY = 200
LEFT_TEXTS, RIGHT_TEXTS = 60_000, 50_000  # texts of a block and of a slice
CELLS = 2_000_000  # pairs counted at a time
BITMAP_WORDS = 2_000_000  # words of 64 bits that hold the trigrams of right texts at a time
ROWS_OUT = 50_000  # matches sent on together
# --------------------------------------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word led by two blanks and closed by one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_codes(text: Column) -> Column:
    """``trigrams`` as whole numbers: three code points of 21 bits each, so different trigrams have different codes."""
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    return F.transform(trigrams(text), lambda g: F.shiftleft(point(g, 1), 42).bitwiseOR(F.shiftleft(point(g, 2), 21)).bitwiseOR(point(g, 3)))


def trigram_match(left: DataFrame, right: DataFrame, floor: float = SIMILARITY_FLOOR, best: int | None = None) -> DataFrame:
    """(left_text, right_text, score) of distinct texts with trigram similarity at or above ``floor``.

    Texts are made distinct first, so copies cost nothing, and their trigrams are whole numbers. Left texts are dealt into
    blocks of about ``LEFT_TEXTS``, right ones into slices of about ``RIGHT_TEXTS``, and each block meets each slice in a task
    of its own. There a word of 64 bits holds a trigram of 64 right texts, so adding the words of a left text counts what it
    shares with all of them at once; no pair below the floor leaves the task, and no trigram costs more for being frequent.
    ``best``: keep only that many texts of each left text, by score and then text.
    """
    l, r = cut(_gram_rows(left, "text")), cut(_gram_rows(right, "text"))
    blocks, slices = max(1, math.ceil(l.count() / LEFT_TEXTS)), max(1, math.ceil(r.count() / RIGHT_TEXTS))
    part = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    row = part(blocks) * slices
    lt = l.select(F.explode(F.sequence(row, row + (slices - 1))).alias("task"), F.lit(True).alias("asks"), "text", "grams")
    rt = r.select(F.explode(F.sequence(part(slices), part(slices) + (blocks - 1) * slices, F.lit(slices))).alias("task"), F.lit(False).alias("asks"), "text", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _matches(batches, floor)

    met = lt.unionByName(rt).repartitionById(blocks * slices, "task").groupBy("task")
    found = met.applyInArrow(run, "left_text string, right_text string, score double")
    if best is None:
        return found
    order = Window.partitionBy("left_text").orderBy(F.col("score").desc(), "right_text")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= best).drop("_r")


def _matches(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Pairs of one block and one slice, some left texts of equally many trigrams and some right texts at a time.

    Counts begin at a power of two less the trigrams a pair must share, so those that arrive at that power are the matches.
    """
    both = pa.Table.from_batches(batches)
    asks = both.column("asks")
    (lt, ln, grams), (rt, rn, flat) = _texts(both.filter(asks)), _texts(both.filter(pc.invert(asks)))
    if not len(ln) or not len(rn):
        return
    vocabulary, code = np.unique(grams, return_inverse=True)
    begins, ends = np.cumsum(ln) - ln, np.append(0, np.cumsum(rn))
    step, found, waiting = max(1, BITMAP_WORDS // len(vocabulary)) * 64, [], 0
    for a in range(0, len(rn), step):
        lengths = rn[a:a + step]
        bitmaps = _bitmaps(vocabulary, flat[ends[a]:ends[a + len(lengths)]], lengths)
        width = bitmaps.shape[1]
        some = max(1, CELLS // (64 * width))
        for n in np.unique(ln):
            least = np.minimum(_least(n + lengths, floor), n + 1)
            top = int(least.max() - 1).bit_length()
            start = (1 << top) - least
            digits = [_packed(start >> k & 1, width) for k in range(top)]
            same = np.flatnonzero(ln == n)
            for j in np.split(same, range(some, len(same), some)):
                rows = code[begins[j] + np.arange(n)[:, None]]
                sums = _sums((bitmaps.take(x, axis=0) for x in rows), digits)
                i, column, count = _arrived(sums, top, (len(j), width))
                common = count - start[column]
                found.append((j[i], a + column, common / (n + lengths[column] - common)))
                waiting += len(i)
                if waiting >= ROWS_OUT:
                    yield _pairs(lt, rt, found)
                    found, waiting = [], 0
    yield _pairs(lt, rt, found)


def _texts(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts, the number of trigrams of each, and the trigrams of all."""
    text, grams = (table.column(x).combine_chunks() for x in ("text", "grams"))
    return text, np.asarray(grams.value_lengths()).astype(np.int64), np.asarray(grams.flatten())


def _pairs(left: pa.Array, right: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    j, i, score = (np.concatenate(x) for x in zip(*found)) if found else (np.array([], np.int64), np.array([], np.int64), np.array([]))
    return pa.RecordBatch.from_arrays([left.take(pa.array(j)), right.take(pa.array(i)), pa.array(score)], ["left_text", "right_text", "score"])


def _least(total: np.ndarray, floor: float) -> np.ndarray:
    """Fewest common trigrams, one at least, with which texts of ``total`` trigrams together reach the floor."""
    share = lambda c: c / np.maximum(total - c, 1e-9)
    c = np.ceil(total * (floor / (1 + floor)))
    c = np.where(share(c - 1) >= floor, c - 1, c)  # the estimate is rounded; the shares decide
    c = np.where(share(c) < floor, c + 1, c)
    return np.maximum(c, 1).astype(np.int64)


def _packed(flags: np.ndarray, width: int) -> np.ndarray:
    """A flag of each right text as bits of one row of words."""
    whole = np.zeros(width * 64, np.uint8)
    whole[:len(flags)] = flags
    return np.packbits(whole, bitorder="little").view("<u8")[None]


def _bitmaps(vocabulary: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each trigram of the vocabulary a row of bits: which of these right texts hold it."""
    width = -(-len(lengths) // 64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
    known = vocabulary[at] == grams
    at, text = at[known], text[known]
    bitmaps = np.zeros((len(vocabulary), width), "<u8")
    np.bitwise_or.at(bitmaps.reshape(-1), at * width + (text >> 6), np.uint64(1) << (text & 63).astype(np.uint64))
    return bitmaps


def _sums(addends: Iterable[np.ndarray], digits: list[np.ndarray]) -> list[np.ndarray]:
    """Binary digits, lowest first, of the number given by ``digits`` plus the addends, for every bit by itself."""
    waiting = [[d] for d in digits]  # of each weight; three become one and a carry. Only the first may be one of ``digits``

    def put(x: np.ndarray, k: int) -> None:
        while True:
            if k == len(waiting):
                waiting.append([])
            waiting[k].append(x)
            if len(waiting[k]) < 3:
                return
            a, b, c = waiting[k]
            odd = a ^ b
            waiting[k] = [odd ^ c]
            b &= a
            odd &= c
            b |= odd
            x, k = b, k + 1

    for x in addends:
        put(x, 0)
    k = 0
    while k < len(waiting):
        if len(waiting[k]) == 2:
            a, b = waiting[k]
            waiting[k] = [a ^ b]
            put(a & b, k + 1)
        k += 1
    return [w[0] for w in waiting]


def _arrived(sums: list[np.ndarray], top: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, right text, sum) where a sum is at least two to the power ``top``."""
    high = np.zeros(shape, "<u8")
    for digit in sums[top:]:
        high |= digit
    words = np.flatnonzero(high != 0)  # few: flags are searched faster than numbers
    place = np.flatnonzero(np.unpackbits(high.reshape(-1)[words].view(np.uint8), bitorder="little").view(bool))
    (row, column), bit = np.divmod(words[place >> 6], shape[1]), place & 63
    count, shift = np.zeros(len(row), np.int64), bit.astype(np.uint64)
    for k, digit in enumerate(sums):
        count += (digit[row if len(digit) > 1 else 0, column] >> shift & np.uint64(1)).astype(np.int64) << k
    return row, column * 64 + bit, count


def _gram_rows(texts: DataFrame, name: str) -> DataFrame:
    only = texts.select(F.col(texts.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
    # whether there are trigrams is told without making them: the planner moves a condition on them to every copy of a text
    return only.where(F.lower(name).rlike(r"[\p{L}\p{M}\p{N}]")).withColumn("grams", trigram_codes(F.col(name)))


def visible_entities(claims: DataFrame) -> DataFrame:
    return claims.select(F.col("subject_id").alias("entity_id")).unionByName(
        claims.where("object_id IS NOT NULL").select(F.col("object_id").alias("entity_id"))
    ).distinct()


def live_entities(entities: DataFrame, tombstoned: DataFrame, visible: DataFrame) -> DataFrame:
    return entities.join(tombstoned.where("tombstoned").select("entity_id"), "entity_id", "left_anti").join(visible, "entity_id", "left_semi")


def query_texts(queries: DataFrame, length: int | None = MAX_QUERY) -> DataFrame:
    """``queries(query_id, text)`` trimmed, and cut to the ``length`` searched unless that is None; empty ones find nothing."""
    text = F.trim("text") if length is None else F.substring(F.trim("text"), 1, length)
    return queries.select("query_id", text.alias("text")).where("text <> ''")


def search_labels(queries: DataFrame, entities: DataFrame, floor: float = SIMILARITY_FLOOR, best: int | None = None) -> DataFrame:
    """Entities by label. ``best``: labels kept for each text; the first so many hits by score and label are among them."""
    m = trigram_match(queries.select("text"), entities.select("label"), floor, best)
    return queries.join(m.withColumnRenamed("left_text", "text"), "text").join(entities.withColumnRenamed("label", "right_text"), "right_text").select(
        "query_id", "entity_id", F.col("right_text").alias("label"), "entity_type", "score", F.lit("label").alias("matched")
    )


def search_aliases(queries: DataFrame, entities: DataFrame, claims: DataFrame, predicate: str = "known_as", floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Entities by literal alias claims the reader may see."""
    aliases = claims.where((F.col("predicate") == predicate) & F.col("object_value").isNotNull()).select(F.col("subject_id").alias("entity_id"), F.col("object_value").alias("alias")).distinct()
    m = trigram_match(queries.select("text"), aliases.select("alias"), floor)
    hits = queries.join(m.withColumnRenamed("left_text", "text"), "text").join(aliases.withColumnRenamed("alias", "right_text"), "right_text")
    best = hits.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
    return best.join(entities.select("entity_id", "label", "entity_type"), "entity_id").select("query_id", "entity_id", "label", "entity_type", "score", F.lit("alias").alias("matched"))


def search_mentions(queries: DataFrame, entities: DataFrame, mentions: DataFrame, active: DataFrame, floor: float = SIMILARITY_FLOOR) -> DataFrame:
    """Entities through the keys of their active mentions.

    ``queries(query_id, norm_key, latin_key, phonetic_key)``; a romanized or normalized near match scores its own
    similarity, an equal phonetic key is worth a fixed modest score.
    """
    # mentions of one entity with the same keys are one; keys of entities that are not searched are no candidates
    members = active.select("mention_id", "entity_id").join(entities.select("entity_id"), "entity_id", "left_semi")
    forms = ["norm_key", "latin_key", "phonetic_key"]
    keys = mentions.select("mention_id", *forms).join(members, "mention_id").groupBy("entity_id", *forms).agg(F.min("mention_id").alias("mention_id"))
    keys = cut(keys)
    near = None
    for key in ("latin_key", "norm_key"):
        m = trigram_match(queries.select(key), keys.select(key), floor)
        hit = queries.select("query_id", F.col(key).alias("left_text")).join(m, "left_text").select("query_id", F.col("right_text").alias(key), "score")
        hit = keys.select("mention_id", "entity_id", key).join(hit, key).select("query_id", "entity_id", "mention_id", "score", F.lit("mention").alias("matched"))
        near = hit if near is None else near.unionByName(hit)
    sound = keys.where("phonetic_key <> ''").join(queries.where("phonetic_key <> ''").select("query_id", "phonetic_key"), "phonetic_key").select(
        "query_id", "entity_id", "mention_id", F.lit(PHONETIC_SCORE).alias("score"), F.lit("phonetic").alias("matched")
    )
    hits = near.unionByName(sound)
    # a mention that is near at all reports "mention" even where the phonetic score is the higher one
    per_mention = hits.groupBy("query_id", "entity_id", "mention_id").agg(F.max("score").alias("score"), F.min("matched").alias("matched"))
    best = per_mention.groupBy("query_id", "entity_id").agg(F.max(F.struct("score", (F.col("matched") == "mention").alias("m"))).alias("b"))
    return best.join(entities.select("entity_id", "label", "entity_type"), "entity_id").select(
        "query_id", "entity_id", "label", "entity_type", F.col("b.score").alias("score"), F.when(F.col("b.m"), "mention").otherwise("phonetic").alias("matched")
    )


def branch_size(limit: int) -> int:
    return max(limit * 3, limit + 1)


def search_entities(branches: list[DataFrame], limit: int = 20) -> DataFrame:
    """Best hit per entity over the branches in order (label, alias, mention); first ``limit`` of each query.

    Each branch brings its first ``branch_size(limit)``; an earlier branch keeps a tie.
    """
    per_branch = branch_size(limit)
    by_rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "label", "entity_id")
    capped = None
    for order, branch in enumerate(branches):
        part = branch.withColumn("_r", F.row_number().over(by_rank)).where(F.col("_r") <= per_branch).drop("_r").withColumn("_order", F.lit(order))
        capped = part if capped is None else capped.unionByName(part)
    best = capped.groupBy("query_id", "entity_id", "label", "entity_type").agg(F.max_by(F.struct("score", "matched"), F.struct("score", -F.col("_order"))).alias("b"))
    hits = best.select("query_id", "entity_id", "label", "entity_type", "b.score", "b.matched")
    return hits.withColumn("position", F.row_number().over(by_rank)).where(F.col("position") <= limit)
