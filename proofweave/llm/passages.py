"""Removal of repeated passages by seed and extend.

A word goes when it lies in a window of ``LENGTH`` consecutive words that also starts in a document with a smaller id.
Windows are looked up on the input; matches never cross documents.

1. **Seeds.** Among the grams of ``GRAM`` words inside a window, the one with the least hash is its anchor (the first, if
   equal). The choice depends on the words of the window alone, so equal windows have equal anchors at equal places, and
   about one gram in five is an anchor. Blocks of documents send their distinct anchors to parts by range of hash, with the
   smallest id and a hash of the reach: all words that lie in some window around the anchor.
2. **Join.** A part joins the anchors of all blocks. An anchor of one document only is no seed. If a seed's reach is the same
   wherever it stands, the whole reach matches in both directions at once, and only the smallest id is still to be known.
3. **Extension.** Where reaches differ, the seed is extended over every split of the remaining words to its left and right,
   for the windows it is the anchor of. Extensions meet like anchors do, by two independent hashes.
4. **Maximal repeats.** A block joins the overlapping extensions that stand in an older document to maximal runs of words.

Neither step lists pairs: a block sends one row for each distinct anchor or extension, so a passage that a third of all
documents hold is one row a block, and an anchor in ever new surroundings is dealt out by its extensions. Words are hashed to
64 bits (XXH64); two windows are taken as equal if anchor and reach, or two sums over the words, are.

Null texts are empty. A row with a null doc_id has no smaller document and is not one; it keeps all words. Rows with equal
ids are one document for this purpose: they never remove from each other. Ids must be whole numbers (a ``TypeError`` says
so). Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .common import BLOCK_BYTES, cut, grown, packed_blocks, settle, shrunk, texts_of, unpacked

LENGTH = 13
GRAM = 5
_SLACK = LENGTH - GRAM
_CHUNK_WORDS = 1 << 18
_MEMO = 300_000
_MESSAGE = "block long, part int, keys binary, seconds binary, oldest binary, flags binary"
_ANSWER = "block long, part int, step int, codes binary"
NOT_SHARED, OLDEST_HERE, OLDER_ELSEWHERE, CONTESTED = range(4)
_RANDOM = np.random.default_rng(13)
_GRAM, _REACH, _FIRST, _SECOND = (_RANDOM.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (GRAM, GRAM + 2 * _SLACK, LENGTH, LENGTH))


class _Words(dict):
    """64-bit hashes of words; a memo, emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, 13) or 1  # 0 stands for no word
        if len(self) >= _MEMO:
            self.clear()
        self[word] = value
        return value


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def _sums(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each ``len(weights)`` neighbours, mixed."""
    n = max(0, len(x) - len(weights) + 1)
    total = np.zeros(n, np.uint64)
    for k, w in enumerate(weights):
        total += x[k : k + n] * w
    total ^= total >> np.uint64(31)
    return total * _GRAM[0]


class Anchors:
    """Anchors of neighbouring texts: place, owner (text), first and last window they are chosen for, hash, hash of the reach."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        self.hashes, self.bounds = hashes, bounds
        grams = _sums(hashes, _GRAM)
        n = max(0, len(hashes) - LENGTH + 1)
        least, place = grams[:n].copy(), np.arange(n)
        for k in range(1, _SLACK + 1):
            lower = grams[k : k + n] < least
            least[lower] = grams[k : k + n][lower]
            place[lower] = np.flatnonzero(lower) + k
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
        window = np.flatnonzero(np.arange(n) + LENGTH <= bounds[1:][owner])
        place, owner = place[window], owner[window]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
        self.place, self.owner, self.first = place[first], owner[first], window[first]
        self.last = window[np.append(first[1:], len(window)) - 1] if len(first) else window
        self.key = grams[self.place]
        # the reach, clipped to the text
        self.start, self.stop = np.maximum(self.place - _SLACK, bounds[self.owner]), np.minimum(self.place + LENGTH, bounds[self.owner + 1])
        self.reach = np.zeros(len(self.place), np.uint64)
        for k, w in enumerate(_REACH):
            at = self.place - _SLACK + k
            inside = (at >= self.start) & (at < self.stop)
            self.reach += np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0)) * w

    def extensions(self, which: np.ndarray):
        """(anchor, start, first hash, second hash) of the windows that the anchors in ``which`` were chosen for."""
        n = self.last[which] - self.first[which] + 1
        anchor = np.repeat(which, n)
        start = self.first[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n)
        sums = [np.zeros(len(start), np.uint64) for _ in range(2)]
        for k in range(LENGTH):
            word = self.hashes[start + k]
            sums[0] += word * _FIRST[k]
            sums[1] += word * _SECOND[k]
        return anchor, start, *sums


def _chunks(docs: pa.Table):
    """(words of each, ids, anchors) of neighbouring documents, some at a time; a document without id has no anchors."""
    memo = _Words()
    texts, ids = docs["text"], docs["doc_id"].to_pylist()
    at, held, size = 0, [], 0
    for k in range(len(ids)):
        words = words_of(texts[k].as_py() or "")
        held.append(words)
        size += len(words)
        if size >= _CHUNK_WORDS or k == len(ids) - 1:
            known = [w if i is not None else [] for w, i in zip(held, ids[at : k + 1], strict=True)]
            bounds = np.cumsum([0] + [len(w) for w in known])
            hashes = np.fromiter((memo[w] for own in known for w in own), np.uint64, int(bounds[-1]))
            yield held, np.array([0 if i is None else i for i in ids[at : k + 1]], np.int64), Anchors(hashes, bounds)
            at, held, size = k + 1, [], 0


def _groups(key: np.ndarray, second: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order by key (or by both), and where each group starts in it."""
    order = np.lexsort((second, key)) if both else np.argsort(key, kind="stable")
    k, s = key[order], second[order]
    new = k[1:] != k[:-1]
    return order, np.flatnonzero(np.concatenate(([True], new | (s[1:] != s[:-1]) if both else new)))


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys; parts are equal ranges of hashes."""
    return np.searchsorted(keys >> np.uint64(32), -(-(np.arange(parts + 1) << 32) // parts))


def _gathered(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, second, owner = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.uint64, np.uint64, np.int64)))
    return key, second, owner


def _sent(block: int, found: list[tuple], parts: int, both: bool) -> pa.Table:
    """One entry for each distinct key of a block: smallest id, and whether it has several ids or seconds."""
    key, second, owner = _gathered(found)
    rows = []
    if len(key):
        order, start = _groups(key, second, both)
        own, sec = owner[order], second[order]
        low = np.minimum.reduceat(own, start)
        flags = (np.maximum.reduceat(own, start) != low) + 2 * (np.minimum.reduceat(sec, start) != np.maximum.reduceat(sec, start))
        key, second, flags = key[order][start], sec[start], flags.astype(np.uint8)
        cuts = _bounds(key, parts)
        for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if z > a:
                rows.append((block, p, shrunk(np.diff(key[a:z], prepend=np.uint64(0)).tobytes()), second[a:z].tobytes(), shrunk(low[a:z].tobytes()), shrunk(flags[a:z].tobytes())))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("block", "part", "keys", "seconds", "oldest", "flags"), (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True))})


def _joined(group: pa.Table, step: int) -> pa.Table:
    """A code for each entry of each block, in the order it was sent."""
    both = step == 2
    keys = [np.cumsum(np.frombuffer(grown(k), np.uint64), dtype=np.uint64) for k in group["keys"].to_pylist()]
    key, second = np.concatenate(keys), np.frombuffer(b"".join(group["seconds"].to_pylist()), np.uint64)
    low, flags = (np.frombuffer(b"".join(map(grown, group[n].to_pylist())), t) for n, t in (("oldest", np.int64), ("flags", np.uint8)))
    order, start = _groups(key, second, both)
    own, sec, flag = low[order], second[order], flags[order]
    oldest, flag = np.minimum.reduceat(own, start), np.bitwise_or.reduceat(flag, start)
    shared = (flag & 1 > 0) | (np.maximum.reduceat(own, start) != oldest)
    contested = shared & ((flag & 2 > 0) | (np.minimum.reduceat(sec, start) != np.maximum.reduceat(sec, start))) & (not both)
    size = np.diff(np.append(start, len(order)))
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(np.repeat(shared, size), np.where(np.repeat(contested, size), CONTESTED, np.where(own == np.repeat(oldest, size), OLDEST_HERE, OLDER_ELSEWHERE)), NOT_SHARED)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    blocks, answers = [], []
    for b, c in zip(group["block"].to_pylist(), np.split(code, cuts), strict=True):
        if c.any():
            blocks.append(b), answers.append(shrunk(c.tobytes()))
    settle()
    part = group["part"][0].as_py()
    return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([part] * len(blocks), pa.int32()), "step": pa.array([step] * len(blocks), pa.int32()), "codes": pa.array(answers, pa.binary())})


def _told(found: list[tuple], told: pa.Table, parts: int, step: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(code, smallest id of the block) of each key in ``found``, chunk by chunk."""
    key, second, owner = _gathered(found)
    if not len(key):
        return [(np.zeros(0, np.uint8), np.zeros(0, np.int64)) for _ in found]
    order, start = _groups(key, second, step == 2)
    cuts, distinct = _bounds(key[order][start], parts), np.zeros(len(start), np.uint8)
    for p, s, codes in zip(told["part"].to_pylist(), told["step"].to_pylist(), told["codes"].to_pylist(), strict=True):
        if s == step:
            distinct[cuts[p] : cuts[p + 1]] = np.frombuffer(grown(codes), np.uint8)
    size = np.diff(np.append(start, len(order)))
    code, low = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    code[order], low[order] = np.repeat(distinct, size), np.repeat(np.minimum.reduceat(owner[order], start), size)
    splits = np.cumsum([len(f[0]) for f in found])[:-1]
    return list(zip(np.split(code, splits), np.split(low, splits), strict=True))


def _seeds(docs: pa.Table) -> tuple[list, list]:
    """Chunks, and their (anchor, reach, id)."""
    chunks = list(_chunks(docs))
    return chunks, [(a.key, a.reach, ids[a.owner]) for _, ids, a in chunks]


def _extended(chunks: list, codes: list) -> tuple[list, list]:
    """Extensions of contested seeds by chunk, and their (first hash, second hash, id)."""
    own = [a.extensions(np.flatnonzero(code == CONTESTED)) for (_, _, a), (code, _) in zip(chunks, codes, strict=True)]
    return own, [(x[2], x[3], ids[a.owner[x[0]]]) for x, (_, ids, a) in zip(own, chunks, strict=True)]


def _covers(code: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (code == OLDER_ELSEWHERE) | ((code == OLDEST_HERE) & (ids > low))


def _kept(docs: pa.Table, told: pa.Table, parts: int, with_text: bool) -> pa.Table:
    docs = unpacked(docs["data"][0].as_py())
    chunks, sent = _seeds(docs)
    codes = _told(sent, told, parts, 1)
    own, extended = _extended(chunks, codes)
    count, removed, kept = [], [], []
    for (words, ids, a), (code, low), x, (code2, low2), (_, _, owners) in zip(chunks, codes, own, _told(extended, told, parts, 2), extended, strict=True):
        # +1 where a run of covered words begins, -1 behind it
        change = np.zeros(len(a.hashes) + 1, np.int32)
        whole = np.flatnonzero(_covers(code, low, ids[a.owner]))
        begin = x[1][_covers(code2, low2, owners)]
        for where, step in ((a.start[whole], 1), (a.stop[whole], -1), (begin, 1), (begin + LENGTH, -1)):
            np.add.at(change, where, step)
        gone = np.cumsum(change[:-1]) > 0
        for k, own_words in enumerate(words):
            mask = gone[a.bounds[k] : a.bounds[k + 1]]
            n = int(mask.sum())
            count.append(len(own_words)), removed.append(n)
            rest = b" ".join(compress(own_words, (~mask).tolist()) if n else own_words)
            kept.append(rest.decode("utf-8", "surrogatepass") if with_text else hashlib.sha256(rest).hexdigest())
    settle()
    names = ["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"]
    columns = [docs["doc_id"].combine_chunks(), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
    return pa.table(dict(zip(names, columns, strict=True)))


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``) or their digest (``kept_sha256``)."""
    key = docs.schema["doc_id"].dataType
    if not isinstance(key, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"doc_id must be a whole number to be ordered, not {key.simpleString()}")
    blocks = packed_blocks(docs, ["doc_id", "text"], block_bytes)
    parts = max(12, blocks.count() // 2)

    def seeds(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _sent(block, _seeds(unpacked(data.as_py()))[1], parts, False).to_batches()
        settle()

    def extensions(d: pa.Table, m: pa.Table) -> pa.Table:
        chunks, sent = _seeds(unpacked(d["data"][0].as_py()))
        out = _sent(d["block"][0].as_py(), _extended(chunks, _told(sent, m, parts, 1))[1], parts, True)
        settle()
        return out

    first = cut(blocks.mapInArrow(seeds, _MESSAGE).groupBy("part").applyInArrow(lambda g: _joined(g, 1), _ANSWER))
    asked = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(extensions, _MESSAGE)
    second = asked.groupBy("part").applyInArrow(lambda g: _joined(g, 2), _ANSWER)
    schema = f"doc_id {key.simpleString()}, n_words long, n_removed long, {'kept' if with_text else 'kept_sha256'} string"
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(lambda d, m: _kept(d, m, parts, with_text), schema)
