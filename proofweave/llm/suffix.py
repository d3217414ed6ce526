"""Removal of repeated byte strings with suffix arrays.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Strings are
looked up on the input; matches never cross documents.

1. Every window of LENGTH bytes has a smallest gram hash (its minimum over the grams inside). Windows with equal bytes have
   equal minima, so only stretches of windows whose minimum occurs in several documents can matter. A block of documents
   sends its distinct minima to parts by range, a part answers with a bit for each that occurs elsewhere.
2. A block sends each distinct stretch with a shared minimum, as bytes, with the smallest id it occurs under, and notes where
   its stretches stand.
3. A part lays its distinct stretches end to end and builds their suffix array in two stages: only suffixes that are smaller
   than their successors are sorted directly, all others are induced by scanning the buckets of first bytes from left to
   right. Common prefixes of neighbours give the classes of equal windows, and each class its smallest id.
4. The smallest ids go back to the blocks that asked, which cut the bytes out of their documents.

Minima are cut to HASH_BITS bits, which only lets a few more stretches through to the exact comparison.

Stretches meet after equal ones were made one, per block and per part, so a passage that a third of all documents share is
one row per block. Blocks and parts grow with the text, so a task's memory does not.

Null texts are empty. A row with a null doc_id has no smaller document and is not one; it keeps all bytes. Rows with equal
ids are one document for this purpose: they never remove from each other. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, grown, packed_blocks, settle, shrunk, texts_of, unpacked

LENGTH = 50
GRAM = 16
_CHUNK = 1 << 20
SORT_BYTES = 1 << 20
BLOCK_BYTES = 6 << 20
RUN_WINDOWS = 2 * (LENGTH - GRAM + 1)
_MESSAGE = "block long, kind int, part int, keys binary, extra binary, sizes binary"
MINIMA, SHARED, STRETCH, OLDEST, PLACES = range(5)
HASH_BITS = 44
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.iinfo(np.int64).max


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (16) bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        word |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    h = (word[:n] * _MIX) ^ (word[8:] * _ODD)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _joined(raw: list[bytes]):
    """Chunks of neighbouring texts: (index of the first, bytes, bounds of the texts)."""
    at = size = 0
    for k, text in enumerate(raw):
        size += len(text)
        if size >= _CHUNK or k == len(raw) - 1:
            sizes = np.array([len(t) for t in raw[at : k + 1]], np.int64)
            yield at, np.frombuffer(b"".join(raw[at : k + 1]), np.uint8), np.concatenate(([0], np.cumsum(sizes)))
            at, size = k + 1, 0


def _runs_of(raw: list[bytes]):
    """(index of the first text, bytes, text of each run, first, past, minimum) per chunk; runs stay inside texts."""
    for at, data, bounds in _joined(raw):
        if len(data) < LENGTH:
            continue
        least = _sliding_min(gram_hashes(data), LENGTH - GRAM + 1)
        place = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
        inside = np.arange(len(least)) + LENGTH <= bounds[1:][place]
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        stop = np.flatnonzero(np.append(change[1:], True) & inside) + 1
        # a run also ends where its text has no more windows
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        stop = np.union1d(stop, ends)
        # only periodic text keeps one minimum for long; cut evenly, its pieces repeat and are made one
        n = -(-(stop - first) // RUN_WINDOWS)
        begin = np.repeat(first, n) + RUN_WINDOWS * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        yield at, data, np.repeat(place[first], n), begin, np.minimum(begin + RUN_WINDOWS, np.repeat(stop, n)), np.repeat(least[first] >> np.uint64(64 - HASH_BITS), n)


def _raw(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts_of(column)]


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "extra": pa.binary(), "sizes": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def _bounds(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted minima; parts are equal ranges of hashes."""
    return np.searchsorted((values * np.uint64(parts)) >> np.uint64(HASH_BITS), np.arange(parts + 1))


def _ids(column) -> np.ndarray:
    return np.array([_NONE if v is None else v for v in column.to_pylist()], np.int64)


def _minima(block: int, group: pa.Table, parts: int) -> pa.Table:
    """Distinct minima of a block; ``extra`` tells which of them several ids of the block share."""
    ids = _ids(group["doc_id"])
    seen, low, high = [], [], []
    for at, _, text, _, _, least in _runs_of(_raw(group["text"])):
        order = np.argsort(least, kind="stable")
        value, owner = least[order], ids[at + text[order]]
        start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, int)
        if len(start):
            seen.append(value[start]), low.append(np.minimum.reduceat(owner, start)), high.append(np.maximum.reduceat(owner, start))
    if not seen:
        return _messages([])
    value, low, high = np.concatenate(seen), np.concatenate(low), np.concatenate(high)
    order = np.argsort(value, kind="stable")
    value, low, high = value[order], low[order], high[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    value, several = value[start], np.minimum.reduceat(low, start) != np.maximum.reduceat(high, start)
    cuts = _bounds(value, parts)
    rows = [(block, MINIMA, p, shrunk(np.diff(value[a:z], prepend=np.uint64(0)).tobytes()), np.packbits(several[a:z]).tobytes(), None) for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
    return _messages(rows)


def _shared(group: pa.Table) -> pa.Table:
    """A bit for each minimum of each block: it occurs under several ids of that block, or in several blocks."""
    part = group["part"][0].as_py()
    sent = [np.cumsum(np.frombuffer(grown(k), np.uint64), dtype=np.uint64) for k in group["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(e, np.uint8), count=len(s)).astype(bool) for e, s in zip(group["extra"].to_pylist(), sent, strict=True)]
    _, at, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[at[np.concatenate(several)]] = True
    cuts = np.cumsum([len(s) for s in sent])[:-1]
    rows = [(b, SHARED, part, None, np.packbits(m).tobytes(), None) for b, m in zip(group["block"].to_pylist(), np.split(shared[at], cuts), strict=True) if m.any()]
    settle()
    return _messages(rows)


def _known(values: np.ndarray, told: pa.Table, parts: int) -> np.ndarray:
    """The block's (sorted, distinct) minima that its answers mark as shared."""
    cuts, keep = _bounds(values, parts), np.zeros(len(values), bool)
    for p, bits in zip(told["part"].to_pylist(), told["extra"].to_pylist(), strict=True):
        keep[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(cuts[p + 1] - cuts[p]))
    return values[keep]


def _marked_runs(raw: list[bytes], told: pa.Table, parts: int):
    """(text index, offset in the text, bytes, minimum) of each run with a shared minimum."""
    runs = list(_runs_of(raw))
    known = _known(np.unique(np.concatenate([r[5] for r in runs])), told, parts) if runs else ()
    for at, data, text, first, stop, least in runs if len(known) else ():
        slot = np.minimum(np.searchsorted(known, least), len(known) - 1)
        hit = np.flatnonzero(known[slot] == least)
        if not len(hit):
            continue
        whole = data.tobytes()
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in raw[at : at + int(text.max()) + 1]])))
        begin = first[hit] - bounds[text[hit]]
        for t, b, a, z, m in zip((at + text[hit]).tolist(), begin.tolist(), first[hit].tolist(), (stop[hit] + LENGTH - 1).tolist(), least[hit].tolist(), strict=True):
            yield t, b, whole[a:z], m


def _pack(strings: list[bytes]) -> tuple[bytes, bytes]:
    return shrunk(b"".join(strings)), shrunk(np.array([len(s) for s in strings], np.int32).tobytes())


def _unpack(joined: bytes, sizes: bytes) -> list[bytes]:
    joined, ends = grown(joined), np.cumsum(np.frombuffer(grown(sizes), np.int32), dtype=np.int64).tolist()
    return [joined[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def _stretch(docs: pa.Table, told: pa.Table, parts: int) -> pa.Table:
    """Distinct stretches of a block with a shared minimum and the smallest id each occurs under (``extra``), and their places."""
    block, docs = docs["block"][0].as_py(), unpacked(docs["data"][0].as_py())
    ids = _ids(docs["doc_id"]).tolist()
    number: dict[bytes, int] = {}
    oldest: list[int] = []
    minimum: list[int] = []
    places: list[tuple[int, int, int]] = []
    for t, begin, run, m in _marked_runs(_raw(docs["text"]), told, parts):
        k = number.setdefault(run, len(number))
        if k == len(oldest):
            oldest.append(ids[t])
            minimum.append(m)
        elif ids[t] < oldest[k]:
            oldest[k] = ids[t]
        places.append((t, begin, k))
    if not number:
        return _messages([])
    runs, old, least = list(number), np.array(oldest, np.int64), np.array(minimum, np.uint64)
    order = np.argsort(least, kind="stable")
    cuts, rows = _bounds(least[order], parts), []
    for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if z > a:
            joined, sizes = _pack([runs[k] for k in order[a:z].tolist()])
            rows.append((block, STRETCH, p, joined, shrunk(old[order[a:z]].tobytes()), sizes))
    rank = np.empty(len(order), np.int64)  # a stretch's place among all answers of the block, parts in order
    rank[order] = np.arange(len(order))
    spot = np.array(places, np.int64).T
    rows.append((block, PLACES, -1, shrunk(np.diff(spot[0], prepend=0).astype(np.int32).tobytes()), shrunk(spot[1].astype(np.int32).tobytes()), shrunk(rank[spot[2]].astype(np.int32).tobytes())))
    settle()
    return _messages(rows)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte highest; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(LENGTH + 16, np.uint8)))
    words = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    return words


def _direct_order(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` sorted by the first LENGTH (or a few more) symbols from each on; eight at a time, ties only."""
    order, group = np.arange(len(places)), np.zeros(len(places), np.int64)
    open_ = np.arange(len(places))
    for at in range(0, LENGTH, 8):
        if not len(open_):
            break
        key = words[places[order[open_]] + at]
        sub = np.lexsort((key, group[open_])) if at else np.argsort(key)
        order[open_], key, own = order[open_][sub], key[sub], group[open_][sub]
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))]
        open_ = open_[~fresh | ~np.append(fresh[1:], True)]
    return places[order]


def _small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; a run of equal symbols goes by its last member, the end is smallest."""
    step = np.append(np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16)), -1)
    last = np.flatnonzero(step)
    return step[last[np.searchsorted(last, np.arange(len(text)))]] > 0


def suffix_array(text: np.ndarray, words: np.ndarray, small: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
    """Suffixes ordered by at least their first LENGTH symbols, in two stages.

    A suffix is small when it is smaller than its successor. Small ones are sorted directly. In one scan of the buckets of
    first symbols from left to right, each suffix that has its place gives its predecessor, if that is not small, the next
    free place at the front of the predecessor's bucket. ``keep`` marks the suffixes wanted; the successor of one that is not
    small must be wanted too.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = _small(text) if small is None else small
    keep = np.ones(n, bool) if keep is None else keep
    begin = np.concatenate(([0], np.cumsum(np.bincount(text[keep], minlength=256))))
    order = np.full(int(begin[-1]), -1, np.int64)
    direct = _direct_order(words, np.flatnonzero(small & keep))
    first = text[direct]
    ends = begin[1:]
    count = np.bincount(first, minlength=256)
    at_first = np.concatenate(([0], np.cumsum(count)))
    for c in np.flatnonzero(count):
        order[ends[c] - count[c] : ends[c]] = direct[at_first[c] : at_first[c + 1]]
    free = begin[:-1].copy()
    induced = keep & ~small

    def induce(found: np.ndarray) -> None:
        """Places the predecessors that are not small, stably, at the front of their buckets."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        own = text[before]
        before = before[np.argsort(own, kind="stable")]
        a = 0
        counts = np.bincount(own, minlength=256)
        for c in np.flatnonzero(counts).tolist():
            z = a + int(counts[c])
            order[free[c] : free[c] + z - a] = before[a:z]
            free[c] += z - a
            a = z

    if keep[-1]:  # the last suffix is not small and has no successor: it heads its bucket
        order[free[text[-1]]] = n - 1
        free[text[-1]] += 1
    for c in np.flatnonzero(np.diff(begin)):
        at = begin[c]
        while at < free[c]:  # what is induced into the bucket itself is scanned in turn
            stop = free[c]
            induce(order[at:stop])
            at = stop
        induce(order[begin[c + 1] - count[c] : begin[c + 1]])
    return order


def _prefix_breaks(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """True where the common prefix with the suffix before is shorter than LENGTH."""
    differs = np.ones(len(order), bool)
    alike = np.arange(1, len(order))
    for at in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        alike = alike[words[order[alike] + at] == words[order[alike - 1] + at]]
    differs[alike] = False
    return differs


def oldest_windows(strings: list[bytes], oldest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the smallest id under which each of its windows occurs in any string, as runs.

    Returns rows (windows, id) and where the rows of each string begin. Strings have at least LENGTH bytes.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    window = np.arange(len(text)) + LENGTH <= ends[owner]
    # wanted: the windows, and what follows each string's last one up to the next small suffix
    small = _small(text)
    spots = np.append(np.flatnonzero(small), len(text))
    limit = spots[np.searchsorted(spots, ends - LENGTH)]
    keep = window | (np.arange(len(text)) <= limit[owner])
    words = _words(text)
    order = suffix_array(text, words, small, keep)
    order = order[window[order]]
    group = np.flatnonzero(_prefix_breaks(words, order))
    result = np.empty(len(text), np.int64)
    result[order] = np.repeat(np.minimum.reduceat(oldest[owner[order]], group), np.diff(np.append(group, len(order))))
    at = np.flatnonzero(window)
    value, of = result[at], owner[at]
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1]))))
    rows = np.column_stack((np.diff(np.append(first, len(at))), value[first]))
    return rows, np.searchsorted(of[first], np.arange(len(strings) + 1))


def _first_minima(strings: list[bytes]) -> np.ndarray:
    """The minimum that all windows of each string share."""
    out = np.empty(len(strings), np.uint64)
    for a in range(0, len(strings), 8192):
        rows = np.frombuffer(b"".join(s[:LENGTH] for s in strings[a : a + 8192]), np.uint8)
        out[a : a + 8192] = gram_hashes(rows).take(np.arange(len(rows) // LENGTH)[:, None] * LENGTH + np.arange(LENGTH - GRAM + 1)).min(1)
    return out


def _shares(least: np.ndarray, sizes: np.ndarray):
    """Ranges of strings, sorted by minimum, that are sorted together: about SORT_BYTES each, one minimum never apart."""
    change = np.append(np.flatnonzero(least[1:] != least[:-1]) + 1, len(least))
    total = np.cumsum(sizes)
    a = 0
    while a < len(least):
        z = int(np.searchsorted(total, (total[a - 1] if a else 0) + SORT_BYTES)) + 1
        z = int(change[np.searchsorted(change, min(z, len(least)))])
        yield a, z
        a = z


def _oldest(group: pa.Table) -> pa.Table:
    """Smallest ids of the windows of every stretch, for each block in the order it asked."""
    part = group["part"][0].as_py()
    number: dict[bytes, int] = {}
    first: list[int] = []
    asked = []
    for keys, extra, sizes in zip(group["keys"].to_pylist(), group["extra"].to_pylist(), group["sizes"].to_pylist(), strict=True):
        own = []
        for run, old in zip(_unpack(keys, sizes), np.frombuffer(grown(extra), np.int64).tolist(), strict=True):
            k = number.setdefault(run, len(number))
            if k == len(first):
                first.append(old)
            elif old < first[k]:
                first[k] = old
            own.append(k)
        asked.append(own)
    strings, old = list(number), np.array(first, np.int64)
    del number
    least = _first_minima(strings)
    order = np.argsort(least, kind="stable")
    answer: list[bytes] = [b""] * len(strings)
    for a, z in _shares(least[order], np.array([len(strings[k]) for k in order.tolist()])):
        own = order[a:z].tolist()
        found, at = oldest_windows([strings[k] for k in own], old[own])
        raw, at = found.astype(np.int64).tobytes(), (16 * at).tolist()
        for j, k in enumerate(own):
            answer[k] = raw[at[j] : at[j + 1]]
    rows = []
    for b, own in zip(group["block"].to_pylist(), asked, strict=True):
        joined, sizes = _pack([answer[k] for k in own])
        rows.append((b, OLDEST, part, None, joined, sizes))
    settle()
    return _messages(rows)


def _removed(docs: pa.Table, told: pa.Table, key_type) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    docs = unpacked(docs["data"][0].as_py())
    raw, ids = _raw(docs["text"]), _ids(docs["doc_id"]).tolist()
    answers: dict[int, list[bytes]] = {}
    places: list[np.ndarray] = []
    for kind, part, keys, extra, sizes in zip(*(told[n].to_pylist() for n in ("kind", "part", "keys", "extra", "sizes")), strict=True):
        if kind == PLACES:
            places = [np.frombuffer(grown(x), np.int32) for x in (keys, extra, sizes)]
        else:
            answers[part] = _unpack(extra, sizes)
    oldest = [x for p in sorted(answers) for x in answers[p]]
    spans: dict[int, list[tuple[int, int]]] = {}
    for t, begin, k in zip(np.cumsum(places[0], dtype=np.int64).tolist(), places[1].tolist(), places[2].tolist(), strict=True) if places else ():
        if ids[t] == _NONE:
            continue
        for n, old in np.frombuffer(oldest[k], np.int64).reshape(-1, 2).tolist():
            if old < ids[t]:
                spans.setdefault(t, []).append((begin, begin + n + LENGTH - 1))
            begin += n
    removed, count, kept = [0] * len(raw), [0] * len(raw), list(raw)
    for t, own in spans.items():
        merged: list[list[int]] = []
        for a, z in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        removed[t], count[t] = sum(z - a for a, z in merged), len(merged)
        edges = [0, *(x for m in merged for x in m), len(raw[t])]
        kept[t] = b"".join(raw[t][a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
    columns = [docs["doc_id"].combine_chunks(), [len(r) for r in raw], removed, count, kept]
    settle()
    return pa.table({n: pa.array(c, t) if isinstance(c, list) else c for n, c, t in zip(names, columns, types, strict=True)})


def _digested(batches):
    for batch in batches:
        digests = [hashlib.sha256(k).hexdigest() for k in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.string())], names=[*batch.schema.names[:4], "kept_sha256"])


def without_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (``kept``) or their digest (``kept_sha256``)."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = docs.schema["doc_id"].dataType
    blocks = packed_blocks(docs, ["doc_id", "text"], block_bytes)
    parts = max(12, blocks.count())

    def minima(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _minima(block, unpacked(data.as_py()), parts).to_batches()

    asked = blocks.mapInArrow(minima, _MESSAGE)
    shared = cut(asked.groupBy("part").applyInArrow(_shared, _MESSAGE))
    # not written out: strings and places are worked out once each, which costs less than moving the strings twice
    runs = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda d, m: _stretch(d, m, parts), _MESSAGE)
    told = runs.where(F.col("kind") == STRETCH).groupBy("part").applyInArrow(_oldest, _MESSAGE)
    messages = runs.where(F.col("kind") == PLACES).union(told)
    kind = to_arrow_type(key)
    if with_bytes:
        schema, finish = f"doc_id {key.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary", None
    else:
        schema, finish = f"doc_id {key.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digested

    def last(d: pa.Table, m: pa.Table) -> pa.Table:
        found = _removed(d, m, kind)
        return pa.Table.from_batches(finish(found.to_batches())) if finish else found

    return blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(last, schema)
