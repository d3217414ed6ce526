"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters, digits and underscores, lower-cased. A document and a benchmark item are compared when
they share a seed of ``min_match`` consecutive words and the shared seeds alone could cover ``threshold`` of the item. The
comparison marks the longest non-overlapping common runs, longest first, found with running Karp-Rabin hashes and checked
word by word, until no run of ``min_match`` words is left. The item counts as leaked when the marked runs cover
``threshold`` of its words, in whatever order they stand in the document.

The benchmark is dealt into blocks of at most ``block_bytes`` of text; each block is sent to the tasks and all documents
pass it once, so what is broadcast has a fixed bound whatever the benchmark's size.

Null texts are empty. Items of fewer than ``min_match`` words hold no seed and never match; empty documents never match.
Repeated items and repeated documents each give their own rows. Empty tables: no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts_of

MIN_MATCH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"\w+")
_BASE = 1_000_003
_PRIME = (1 << 61) - 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _runs(side: list[int], free: list[bool], size: int):
    """(start, hash) of each window of ``size`` unmarked words, hashed on the run."""
    top = pow(_BASE, size - 1, _PRIME)
    value = have = 0
    for at, word in enumerate(side):
        if not free[at] or not word:
            value = have = 0
            continue
        if have == size:
            value = (value - side[at - size] * top) % _PRIME
            have -= 1
        value = (value * _BASE + word) % _PRIME
        have += 1
        if have == size:
            yield at - size + 1, value


def tiling(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of two sequences of word numbers; 0 matches nothing."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        index = defaultdict(list)
        for at, value in _runs(item, free_i, size):
            index[value].append(at)
        found, longest = set(), 0
        for d, value in _runs(doc, free_d, size) if index else ():
            for i in index.get(value, ()):
                if (d and i and free_d[d - 1] and free_i[i - 1] and doc[d - 1] == item[i - 1] and doc[d - 1]):
                    continue  # part of a match that began earlier
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and doc[d + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n >= size:
                    found.add((d, i, n))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        queue = sorted(found, key=lambda t: (-t[2], t[0], t[1]))
        late = False
        for d, i, n in queue:
            if all(free_d[d : d + n]) and all(free_i[i : i + n]):
                free_d[d : d + n] = free_i[i : i + n] = [False] * n
                tiles.append((d, i, n))
            else:
                late = True  # what is left of it is found again at this or a smaller size
        if late:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


class Benchmark:
    """Word numbers, seeds and items of one block of the benchmark."""

    def __init__(self, items: list[tuple], least: int):
        self.least, self.number, self.items = least, {}, []
        seeds = defaultdict(list)
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            if len(ids) >= least:
                for at, value in enumerate(self.seeds(np.array(ids, np.uint64)).tolist()):
                    seeds[value].append((len(self.items), at))
                self.items.append((item_id, ids))
        self.known = np.array(sorted(seeds), np.uint64)
        self.where = [seeds[v] for v in self.known.tolist()]

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        value = np.zeros(max(0, len(ids) - self.least + 1), np.uint64)
        for k in range(self.least):
            value = (value ^ ids[k : k + len(value)]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value

    def leaks(self, text: str, threshold: float):
        """(item id, matched words, item words, tiles) of each leaked item."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.uint64)
        if len(ids) < self.least or not len(self.known):
            return
        inside = np.convolve(ids == 0, np.ones(self.least, int), "valid") == 0
        if not inside.any():
            return
        at = np.flatnonzero(inside)
        values = self.seeds(ids)[at]
        slot = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        hit = self.known[slot] == values
        spots = defaultdict(list)
        for d, k in zip(at[hit].tolist(), slot[hit].tolist(), strict=True):
            spots[k].append(d)
        shared: dict[int, dict[int, int]] = defaultdict(dict)
        for k in spots:
            for item, i in self.where[k]:
                shared[item][i] = k
        words = ids.tolist()
        for item, starts in sorted(shared.items()):
            item_id, own = self.items[item]
            if len({p for i in starts for p in range(i, i + self.least)}) < threshold * len(own):
                continue
            # only words under a shared seed can lie in a tile; the rest shrinks to one gap
            keep = sorted({p for k in set(starts.values()) for d in spots[k] for p in range(d, d + self.least)})
            short, place, last = [], [], -1
            for p in keep:
                if p != last + 1:
                    short.append(0)
                    place.append(-1)
                short.append(words[p])
                place.append(p)
                last = p
            tiles = [(place[d], i, n) for d, i, n in tiling(short, own, self.least)]
            matched = sum(t[2] for t in tiles)
            if matched >= threshold * len(own):
                yield item_id, matched, len(own), tiles


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _flagged(docs: DataFrame, block: DataFrame, threshold: float, least: int):
    rows = [(r.item_id, r.text) for r in block.select("item_id", "text").orderBy("item_id", "text").collect()]
    return docs.sparkSession.sparkContext.broadcast(Benchmark(rows, least))


def leaked_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, matched_words, item_words, coverage, tiles (word positions)."""
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, matched_words long, item_words long, "
        "coverage double, tiles array<struct<doc_word: long, item_word: long, words: long>>"
    )
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def passing(sent):
        def run(batches):
            for batch in batches:
                rows = [
                    {"doc_id": doc, "item_id": item, "matched_words": m, "item_words": n, "coverage": m / n, "tiles": [{"doc_word": d, "item_word": i, "words": k} for d, i, k in tiles]}
                    for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)
                    for item, m, n, tiles in sent.value.leaks(text, threshold)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return docs.select("doc_id", "text").mapInArrow(run, ddl)

    return reduce(DataFrame.union, [passing(_flagged(docs, b, threshold, min_match)) for b in _blocks(benchmark, block_bytes)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is leaked, with all their columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def passing(rest: DataFrame, sent) -> DataFrame:
        def run(batches):
            for batch in batches:
                clean = [next(sent.value.leaks(t, threshold), None) is None for t in texts_of(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return rest.mapInArrow(run, docs.schema)

    return reduce(passing, [_flagged(docs, b, threshold, min_match) for b in _blocks(benchmark, block_bytes)], docs)
