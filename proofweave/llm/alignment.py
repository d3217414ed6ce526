"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

Tokens of A (byte-level BPE of space + text) and of B (sentencepiece of the text, which adds the space itself) are laid on the
bytes of space + text. Offsets where a token of A and a token of B both end cut them into groups; the pairs of tokens that end
there are the links, and every link is weighed by how often its pair of ids is linked in the whole corpus.

**Merge path.** The ends of many texts form one ascending sequence for each side. Diagonals of the merge grid, equally far
apart, are searched by bisection for the place where the merge crosses them, which cuts it into pieces of ``PIECE_TOKENS``
ends whatever the texts' lengths. Pieces are merged by themselves and answer with their common ends; equal ends never lie
on two sides of a cut. A group that a cut divides is stitched: its first tokens come after the last common end of an earlier
piece. So one text of any length is as many pieces as it needs, and holds no more than its arrays.

**Corpus counts.** Tasks sum the pairs of their blocks (about ``BLOCK_BYTES`` of text), Spark sums those by pair and finds the
highest count of each B id; a block then gets back one row for each of its distinct pairs. A pair that every text holds is one
row a block. Nothing that grows with the corpus is broadcast or collected; texts are not shuffled, their links are numbers of
the block's pairs.

Special tokens' strings are plain text. Null and empty texts, and texts whose joined token bytes on either side differ from
space + text (as where U+2581 stands in them), have no tokens: zeros, and an empty digest. Rows with equal or null ids each
give a row. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, grown, settle, shrunk, small_slices, texts_of, unpacked
from .tokens import PieceEncoder

PIECE_TOKENS = 1 << 16
BLOCK_BYTES = 16 << 20
_MEMO = 300_000
_COMMA, _BAR, _SEMICOLON = range(3)


class _Pool:
    """Byte strings by number, joined by arrays of numbers."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        n = self.size[which]
        stop = np.cumsum(n)
        return self.bytes[np.repeat(self.start[which] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Both vocabularies: ids of texts and bytes of ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = PieceEncoder(path_a, spaced=True)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.memo: dict[str, np.ndarray] = {}
        table, library = _byte_level(), self.a.library
        names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = _Pool([bytes(table[c] for c in n) if all(c in table for c in n) else n.encode() for n in names])
        self.n_b = len(self.b)
        self.bytes_b = _Pool([bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n_b)])
        self.numbers = _Pool([f"{i}{c}".encode() for i in range(max(len(names), self.n_b)) for c in ",|;"])

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint32).astype(np.int64) for x in self.a.encode([" " + t for t in texts])]

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        """No piece has a space behind another character, so single spaces part a text; distinct parts are encoded once."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if not (t.startswith(" ") or t.endswith(" ") or "  " in t)]
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array(self.b.encode(texts[k], num_threads=1), np.int64)
        if plain:
            words = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
            coded = words.flatten().dictionary_encode()
            names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            if len(self.memo) > _MEMO:
                self.memo = {}
            new = [n for n in names if n not in self.memo]
            self.memo.update(zip(new, (np.array(x, np.int64) for x in self.b.encode(new, num_threads=1)), strict=True))
            held = [self.memo[n] for n in names]
            size = np.array([len(h) for h in held], np.int64)
            pool, start, n = np.concatenate(held), np.cumsum(size) - size, size[index]
            stop = np.cumsum(n)
            ids = pool[np.repeat(start[index] - (stop - n), n) + np.arange(int(stop[-1]))]
            ends = np.concatenate(([0], stop))[words.offsets.to_numpy()].tolist()
            for k, a, z in zip(plain, ends, ends[1:], strict=False):
                out[k] = ids[a:z]
        return out


_HELD: dict[tuple[str, str], Tokens] = {}


def tokens(path_a: str, path_b: str) -> Tokens:
    """One pair of vocabularies per worker process."""
    if (path_a, path_b) not in _HELD:
        _HELD[path_a, path_b] = Tokens(path_a, path_b)
    return _HELD[path_a, path_b]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (i, j) of the merge of two ascending arrays into pieces of ``piece`` elements; equal elements stay together."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        i, j = np.where(open_, middle, 0), np.where(open_, diagonal - 1 - middle, 0)
        first = open_ & (a[i] <= b[j])
        low, high = np.where(first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, diagonal - low
    # of two equal ends, that of a comes first: the cut may lie between them
    inner = np.flatnonzero((i > 0) & (j < len(b)))
    j[inner] += a[i[inner] - 1] == b[j[inner]]
    return i, j


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with a[i] == b[j], piece by piece along the merge path."""
    rows, columns = merge_path(a, b, piece)
    found = [np.intersect1d(a[i:k], b[j:m], assume_unique=True, return_indices=True)[1:] + (i, j) for i, k, j, m in zip(rows, rows[1:], columns, columns[1:], strict=False)]
    join = lambda side: np.concatenate([f[side] + f[2 + side] for f in found]) if found else np.zeros(0, np.int64)
    return join(0), join(1)


def _within(ids: list[np.ndarray], pool: _Pool, raw: list[bytes]) -> np.ndarray:
    """Whether the tokens of each text join to its bytes."""
    joined = np.concatenate(ids)
    sizes = np.add.reduceat(np.append(pool.size[joined], 0), np.cumsum([0] + [len(x) for x in ids[:-1]]))
    sizes[np.array([not len(x) for x in ids])] = 0
    data, at, out = pool.joined(joined).tobytes(), 0, []
    for n, text in zip(sizes.tolist(), raw, strict=True):
        out.append(n == len(text) and data[at : at + n] == text)
        at += n
    return np.array(out)


class Aligned:
    """Groups and links of neighbouring texts."""

    def __init__(self, texts: list[str], held: Tokens, piece: int = PIECE_TOKENS):
        raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        own = [k for k, r in enumerate(raw) if r]
        a, b = held.ids_a([texts[k] for k in own]), held.ids_b([texts[k] for k in own])
        if own:
            fits = _within(a, held.bytes_a, [raw[k] for k in own]) & _within(b, held.bytes_b, [raw[k] for k in own])
            own, a, b = ([x for x, f in zip(side, fits, strict=True) if f] for side in (own, a, b))
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.digests, self.pairs = [""] * len(texts), np.zeros(0, np.int64)
        self.links_of = np.zeros(0, np.int64)
        self.groups: list[bytes] = [b""] * len(texts)
        if not own:
            return
        self.n_a[own], self.n_b[own] = [len(x) for x in a], [len(x) for x in b]
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        # texts have the same bytes on both sides, so their ends are common and no group crosses them
        i, j = common_ends(np.cumsum(held.bytes_a.size[ids_a]), np.cumsum(held.bytes_b.size[ids_b]), piece)
        text = np.repeat(own, [len(x) for x in a])[i]
        self.n_groups = np.bincount(text, minlength=len(texts))
        self.links_of, self.pairs = text, ids_a[i] * held.n_b + ids_b[j]
        # group g is a[i[g - 1] + 1 .. i[g]] and b[j[g - 1] + 1 .. j[g]], written one after the other
        behind_a, behind_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        behind_a[i[:-1] + 1] = 1
        behind_b[j[:-1] + 1] = 1
        group_a, group_b = np.cumsum(behind_a), np.cumsum(behind_b)
        stream = np.empty(len(ids_a) + len(ids_b), np.int64)
        sign_a, sign_b = np.full(len(ids_a), _COMMA), np.full(len(ids_b), _COMMA)
        sign_a[i], sign_b[j] = _BAR, _SEMICOLON
        stream[np.arange(len(ids_a)) + np.append(0, j + 1)[group_a]] = 3 * ids_a + sign_a
        stream[np.arange(len(ids_b)) + (i + 1)[group_b]] = 3 * ids_b + sign_b
        written = held.numbers.joined(stream).tobytes()
        sizes = np.cumsum(held.numbers.size[stream])
        at = 0
        for k, end in zip(own, sizes[np.cumsum(self.n_a[own] + self.n_b[own]) - 1].tolist(), strict=True):
            self.groups[k] = written[at : end - 1]
            at = end


_BLOCK = "block long, pair long, n long, texts binary, links binary"


def _blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int, piece: int, with_groups: bool) -> DataFrame:
    """Per block: a row for each distinct pair (pair, n), and one with the rows of its texts and their links by pair."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    key = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["block", "pair", "n", "texts", "links"]

    def packed(block: int, held: list[tuple]):
        pair, place, n = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True, return_counts=True)
        none = pa.nulls(len(pair), pa.binary())
        for a in range(0, len(pair), 1 << 16):
            z = min(len(pair), a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([block] * (z - a), pa.int64()), pa.array(pair[a:z]), pa.array(n[a:z].astype(np.int64)), none[a:z], none[a:z]], names=names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.concat_tables([h[0] for h in held]).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, None, None, sink.getvalue().to_pybytes(), shrunk(place.astype(np.uint32).tobytes())), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        both, block, held, size = tokens(path_a, path_b), TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            for part in small_slices(batch, 1):
                texts = texts_of(part.column(1))
                found = Aligned(texts, both, piece)
                columns = {"doc_id": part.column(0).cast(key), "n_a": pa.array(found.n_a), "n_b": pa.array(found.n_b), "n_groups": pa.array(found.n_groups.astype(np.int64))}
                if with_groups:
                    columns["groups"] = pa.array([g.decode() for g in found.groups], pa.string())
                else:
                    columns["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string())
                held.append((pa.table(columns), found.pairs))
                size += part.column(1).nbytes
                if size >= block_bytes:
                    yield from packed(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield from packed(block, held)
        settle()

    return cut(docs.select("doc_id", "text").mapInArrow(run, _BLOCK))


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, block_bytes: int = BLOCK_BYTES, piece: int = PIECE_TOKENS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups (``a1,a2|b1;a3|b2,b3``) or ``groups_sha256``."""
    import sentencepiece

    n_b = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    blocks = _blocks(docs, path_a, path_b, block_bytes, piece, with_groups)
    pairs = blocks.where("pair IS NOT NULL").select("block", "pair", "n")
    totals = cut(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % n_b))
    # at most one row for each id of B
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    weighed = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = pairs.join(weighed, "pair").select(F.col("block").alias("asked"), "pair", "total", "best")
    last = "groups" if with_groups else "groups_sha256"

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        texts = unpacked(own["texts"][0].as_py())
        order = np.argsort(told["pair"].to_numpy(), kind="stable")
        total, best = told["total"].to_numpy()[order], told["best"].to_numpy(zero_copy_only=False)[order]
        place = np.frombuffer(grown(own["links"][0].as_py()), np.uint32)
        # every group has the one link of its last tokens
        links = texts["n_groups"].to_numpy()
        ends = np.cumsum(links)
        sums = [np.concatenate(([0], np.cumsum(x[place].astype(np.int64)))) for x in (best, total)]
        n_best, count_sum = (s[ends] - s[ends - links] for s in sums)
        settle()
        columns = {n: texts[n].combine_chunks() for n in ("doc_id", "n_a", "n_b", "n_groups")}
        return pa.table(columns | {"n_links": pa.array(links), "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), last: texts[last].combine_chunks()})

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {last} string"
    return blocks.where("texts IS NOT NULL").select("block", "texts", "links").groupBy("block").cogroup(told.groupBy("asked")).applyInArrow(finish, schema)
