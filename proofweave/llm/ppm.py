"""Language-model scoring by prediction by partial matching (PPM), and the word-unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes, learnt from all training documents. A byte is predicted in its
longest known context; when it was never seen there, the model escapes to the next shorter one (method C: a context with q
different symbols among T occurrences escapes with q / (T + q)) and excludes every symbol that the longer context would
have predicted. Below the empty context stands the uniform distribution over the symbols left. A text is its UTF-8 bytes
and one end symbol; its score is the log10 probability of them all.

Nothing of corpus size is broadcast. Documents are dealt into blocks; a block sends the distinct context strings and words
that it holds, with their training counts, to parts by key. A part adds the counts of all blocks, works out the
probability of each string, and answers every block with the values in the order in which it asked; the block then scores
its documents. All that tasks share is the table of byte pairs, at most 258 x 257 numbers. Blocks and parts grow with the
text, so a task's memory does not.

Null and empty texts consist of the end alone. A null doc_id has no remainder, so such a row trains and is not held out.
Repeated rows count and are scored as often as they occur. Without training text every symbol has probability 1/257.
Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, cut, grown, packed_blocks, settle, shrunk, texts_of, unpacked

ORDER = 5
BITS = 9
END, START, SYMBOLS = 256, 257, 257
_CHUNK = 2 << 20
_LOW = (1 << BITS) - 1
GRAM, WORD, PAIR, STAT, GRAM_VALUE, WORD_COUNT = range(6)
_MESSAGE = "block long, kind int, part int, keys binary, counts binary"


def _chunks(raw: list[bytes]):
    """Index ranges of neighbouring texts with about _CHUNK bytes."""
    at = size = 0
    for k, text in enumerate(raw):
        size += len(text)
        if size >= _CHUNK:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(raw):
        yield at, len(raw)


def context_keys(raw: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Key (context and symbol, 9 bits each, symbol lowest) of every position of the texts, and where each text begins."""
    sizes = np.array([len(t) for t in raw], np.int64)
    stride = sizes + order + 1
    begin = np.cumsum(stride) - stride + order
    codes = np.full(int(stride.sum()), START, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    codes[np.arange(len(data)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)] = data
    codes[begin + sizes] = END
    keys = codes[order:].copy()
    for back in range(1, order + 1):
        keys |= codes[order - back : len(codes) - back] << (BITS * back)
    return keys[codes[order:] != START], np.cumsum(sizes + 1) - (sizes + 1)


def _part_of_keys(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the two bytes before the symbol, so that all longer contexts of a string meet."""
    near = ((keys >> BITS) & ((1 << (2 * BITS)) - 1)).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _part_of_word(word: bytes, parts: int) -> int:
    return zlib.crc32(word) % parts


def _raw(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "kind": pa.int32(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def _sent_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return shrunk(np.diff(keys, prepend=0).tobytes())


def _read_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(grown(data), np.int64))


def _ask(block: int, group: pa.Table, parts: int) -> pa.Table:
    """What one block holds: context strings and words with their training counts."""
    raw = _raw(texts_of(group["text"]))
    trains = group["trains"].to_numpy(zero_copy_only=False).astype(bool)
    every: list[tuple[np.ndarray, np.ndarray]] = []
    words: Counter = Counter()
    others: set[bytes] = set()
    for lo, hi in _chunks(raw):
        for flag in (True, False):
            own = [t for t, f in zip(raw[lo:hi], trains[lo:hi], strict=True) if f == flag]
            if own:
                keys, n = np.unique(context_keys(own)[0], return_counts=True)
                every.append((keys, n if flag else np.zeros_like(n)))
                found = b" ".join(own).lower().split()
                if flag:
                    words.update(found)
                else:
                    others.update(found)
    keys, at = np.unique(np.concatenate([k for k, _ in every]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([n for _, n in every]), minlength=len(keys)).astype(np.int64)
    part = _part_of_keys(keys, parts)
    rows = [(block, GRAM, int(p), _sent_keys(keys[m]), shrunk(counts[m].tobytes())) for p in np.unique(part) for m in [part == p]]
    low = keys & ((1 << (2 * BITS)) - 1)
    pair, at = np.unique(low, return_inverse=True)
    rows.append((block, PAIR, 0, pair.tobytes(), np.bincount(at, weights=counts, minlength=len(pair)).astype(np.int64).tobytes()))
    rows.append((block, STAT, 0, b"", np.array([sum(words.values()), int(trains.sum())], np.int64).tobytes()))
    lists: list[list[bytes]] = [[] for _ in range(parts)]
    for w in sorted(words.keys() | others):
        lists[_part_of_word(w, parts)].append(w)
    rows += [(block, WORD, p, shrunk(b" ".join(ws)), shrunk(np.array([words[w] for w in ws], np.int64).tobytes())) for p, ws in enumerate(lists) if ws]
    return _messages(rows)


class Pairs:
    """Orders 0 and 1 of the trie, as dense tables, and the values that longer contexts fall back on."""

    def __init__(self, pair: np.ndarray, counts: np.ndarray):
        self.n1 = np.zeros((_LOW + 1, _LOW + 1), np.int64)
        np.add.at(self.n1, (pair >> BITS, pair & _LOW), counts)
        n0 = self.n1.sum(0)
        self.t1, self.q1 = self.n1.sum(1), (self.n1 > 0).sum(1)
        t0, q0 = n0.sum(), (n0 > 0).sum()
        below = -math.log10(max(1, SYMBOLS - q0))  # a symbol that no text holds
        excluded = ((self.n1 > 0) * n0).sum(1)
        room = (t0 - excluded + q0 - self.q1)[:, None]
        self.w1 = _fall(np.broadcast_to(n0, self.n1.shape), room, (q0 - self.q1)[:, None], below)


def _fall(n: np.ndarray, room: np.ndarray, fresh: np.ndarray, below) -> np.ndarray:
    """log10 probability in a context of which ``room`` is left after exclusion and ``fresh`` symbols are new."""
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log10(n / room)
        escape = np.where(room > 0, np.log10(fresh / room), 0.0) + below
    return np.where(n > 0, seen, escape)


def string_values(keys: np.ndarray, counts: np.ndarray, pairs: Pairs, order: int = ORDER) -> np.ndarray:
    """log10 probability of the symbol of each (distinct, sorted) key in its context. All keys of a context are given."""
    levels = [(keys, counts, None)]
    for k in range(order - 1, 1, -1):
        upper, n, _ = levels[-1]
        low, parent = np.unique(upper & ((1 << (BITS * (k + 1))) - 1), return_inverse=True)
        levels[-1] = (upper, n, parent)
        levels.append((low, np.bincount(parent, weights=n, minlength=len(low)).astype(np.int64), None))
    below = None
    for k, (own, n, _) in zip(range(2, order + 1), reversed(levels), strict=True):
        _, context = np.unique(own >> BITS, return_inverse=True)
        if k == 2:
            c, s = (own >> BITS) & _LOW, own & _LOW
            n_down, t_down, q_down, w_down = pairs.n1[c, s], pairs.t1[c], pairs.q1[c], pairs.w1[c, s]
        else:
            parent = levels[order - k][2]
            n_down, t_down, q_down, w_down = (v[parent] for v in below)
        total = lambda v: np.bincount(context, weights=v)[context]  # noqa: B023, E731
        t, q, excluded = total(n), total(n > 0), total((n > 0) * n_down)
        w = _fall(n_down, t_down - excluded + q_down - q, q_down - q, w_down)
        below = (n, t, q, w)
    n, t, q, w = below
    return _fall(n, t + q, q, w)


def _answer(group: pa.Table, pairs: Pairs) -> pa.Table:
    """Values of the keys, or counts of the words, of one part, for each block in the order it asked."""
    kind, part = group["kind"][0].as_py(), group["part"][0].as_py()
    blocks = group["block"].to_pylist()
    asked, counts = group["keys"].to_pylist(), [np.frombuffer(grown(c), np.int64) for c in group["counts"].to_pylist()]
    if kind == GRAM:
        sent = [_read_keys(a) for a in asked]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        value = string_values(keys, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64), pairs)
        cuts = np.cumsum([len(s) for s in sent])[:-1]
        return _messages([(b, GRAM_VALUE, part, b"", value[i].astype(np.float32).tobytes()) for b, i in zip(blocks, np.split(at, cuts), strict=True)])
    number: dict[bytes, int] = {}
    spots = []
    for a in asked:
        spots.append(np.array([number.setdefault(w, len(number)) for w in grown(a).split(b" ")], np.int64))
    total = np.zeros(len(number), np.int64)
    for i, c in zip(spots, counts, strict=True):
        total[i] += c
    known = np.array([(total > 0).sum()], np.int64).tobytes()  # the part's share of V, once
    return _messages([(b, WORD_COUNT, part, known if k == 0 else b"", shrunk(total[i].tobytes())) for k, (b, i) in enumerate(zip(blocks, spots, strict=True))])


def _score(docs: pa.Table, told: pa.Table, end_count: int, types: list) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"]
    docs = unpacked(docs["data"][0].as_py())
    sent: dict[tuple[int, int], tuple[bytes, bytes]] = {
        (k, p): (a, c) for k, p, a, c in zip(*(told[n].to_pylist() for n in ("kind", "part", "keys", "counts")), strict=True)
    }
    grams = [(_read_keys(a), np.frombuffer(sent[GRAM_VALUE, p][1], np.float32)) for (k, p), (a, _) in sent.items() if k == GRAM]
    keys, values = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    value: dict[bytes, float] = {}
    fresh: set[bytes] = set()
    for (k, p), (a, _) in sent.items():
        if k == WORD:
            words, c = grown(a).split(b" "), np.frombuffer(grown(sent[WORD_COUNT, p][1]), np.int64)
            value.update(zip(words, np.log10(c + 1.0).tolist(), strict=True))
            fresh.update(w for w, n in zip(words, c.tolist(), strict=True) if not n)
    raw = _raw(texts_of(docs["text"]))
    score = np.zeros(len(raw))
    logs, tokens, known = [], [], []
    for lo, hi in _chunks(raw):
        asked, begin = context_keys(raw[lo:hi])
        score[lo:hi] = np.add.reduceat(values[np.searchsorted(keys, asked)], begin, dtype=np.float64)
        for text in raw[lo:hi]:
            words = text.lower().split()
            logs.append(math.fsum(map(value.__getitem__, words)) + math.log10(end_count + 1))
            tokens.append(len(words) + 1)
            known.append(len(words) - sum(map(fresh.__contains__, words)) + (end_count > 0))
    settle()
    columns = [docs["doc_id"].combine_chunks(), pa.array(~docs["trains"].to_numpy(zero_copy_only=False).astype(bool)), tokens, known, logs, score]
    return pa.table({n: pa.array(c, t) if not isinstance(c, pa.Array) else c for n, c, t in zip(names, columns, types, strict=True)})


def score_documents(docs: DataFrame, trains: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``trains`` (of doc_id) marks what is learnt from."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = docs.schema["doc_id"].dataType
    blocks = packed_blocks(docs.select("doc_id", "text", trains.alias("trains")), ["doc_id", "text", "trains"], block_bytes)
    parts = max(12, blocks.count())

    def ask(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _ask(block, unpacked(data.as_py()), parts).to_batches()

    asked = cut(blocks.mapInArrow(ask, _MESSAGE))
    pair_rows = asked.where(F.col("kind") == PAIR).select("keys", "counts")
    # at most 258 * 257 pairs come back, added up on the way
    pair_sums = pair_rows.mapInArrow(_unpack_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = Pairs(pair_sums["pair"].to_numpy(), pair_sums["n"].to_numpy())
    told = cut(asked.where(F.col("kind").isin(GRAM, WORD)).groupBy("kind", "part").applyInArrow(lambda g: _answer(g, pairs), _MESSAGE))
    train_words, train_docs = _sum_of_longs(asked.where(F.col("kind") == STAT), "counts", 2)
    (distinct,) = _sum_of_longs(told.where((F.col("kind") == WORD_COUNT) & (F.octet_length("keys") > 0)), "keys", 1)
    tokens, vocabulary = train_words + train_docs, distinct + (train_docs > 0)
    types = [to_arrow_type(key), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    messages = asked.where(F.col("kind").isin(GRAM, WORD)).union(told).select("block", "kind", "part", F.when(F.col("kind") != WORD_COUNT, F.col("keys")).alias("keys"), "counts")
    scored = blocks.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(
        lambda d, m: _score(d, m, train_docs, types), f"doc_id {key.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    )
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + vocabulary + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _unpack_pairs(batches):
    for batch in batches:
        rows = [(np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in (0, 1)], names=["pair", "n"])


def _sum_of_longs(rows: DataFrame, column: str, n: int) -> list[int]:
    """Column-wise sums of the n longs packed in ``column``."""

    def run(batches):
        for batch in batches:
            total = sum((np.frombuffer(v, np.int64) for v in batch.column(0).to_pylist()), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(t)]) for t in total], names=[f"s{i}" for i in range(n)])

    sums = rows.select(column).mapInArrow(run, ", ".join(f"s{i} long" for i in range(n)))
    return [int(v or 0) for v in sums.agg(*[F.sum(f"s{i}") for i in range(n)]).first()]
