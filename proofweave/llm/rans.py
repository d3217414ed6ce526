"""Token-id files coded with a static range asymmetric numeral system (rANS).

The ids of each document, an end id after each, are coded in ascending doc_id order. One frequency table, scaled to
2**SCALE, is shared by all segments. A segment holds neighbouring whole documents as independent blocks; each block deals
its ids to LANES interleaved coders, so a block is coded and decoded by vector operations over the lanes, and blocks are
decoded in parallel from their checkpoints.

Segment layout, little-endian: magic ``PWRA``, version u16, scale u16, lanes u32, documents u32, blocks u32, ids u64,
first id's global position u64, frequency-table crc32 u32; then per document doc_id i64 and ids u32; then per block the
checkpoint: first id u64, ids u32, words u32, crc32 of its ids u32; then per block LANES u64 states and its u32 words; last
the crc32 of all that precedes, u32. The table file is one row: the frequencies as u32 by id.

Segments are rows (segment, data) of a Parquet table, so any store that Spark reaches holds them; every row is readable on
its own with the table. A wrong magic, version, table or checksum raises.

Null texts are empty: they hold the end id alone. Rows with one doc_id stand in the order of their texts' hashes. Null ids come
first, stored as the smallest integer. Empty table: empty files, no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, settle, texts_of
from .tokens import encoder

SCALE = 20
LANES = 2048
BLOCK_IDS = 1 << 20
SEGMENT_IDS = 1 << 21
MAGIC, VERSION = b"PWRA", 1
_HEAD = struct.Struct("<4sHHIIIQQI")
_LOW = np.uint64(1 << 31)  # states lie in [2**31, 2**63), words have 32 bits
_NULL = -(1 << 63)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint32)
    occurs = counts > 0
    share = counts * (size / total)
    freq = np.where(occurs, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    spare = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")
    order = order[occurs[order]]
    while spare:
        if spare > 0:
            freq[order[0]] += spare
            spare = 0
        else:  # taken from the most frequent ids
            room = np.maximum(0, freq[order] - 1)
            take = np.minimum(room, -(-freq[order] * -spare // size))
            take = np.where(np.cumsum(take) <= -spare, take, np.maximum(0, -spare - (np.cumsum(take) - take)))
            freq[order] -= take
            spare += int(take.sum())
    return freq.astype(np.uint32)


class Table:
    """Frequencies, their running sums and, for decoding, the id of each slot."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.freq = scale, freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(final states, words) of one block; the decoder reads the words forward."""
    rows = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    scale, out = np.uint64(table.scale), []
    for row in range(rows - 1, -1, -1):
        own = ids[row * lanes : (row + 1) * lanes]
        f, b, x = table.freq[own], table.start[own], state[: len(own)]
        full = x >= (f << np.uint64(63 - table.scale))
        if full.any():
            out.append(x[full].astype(np.uint32))
            x = np.where(full, x >> np.uint64(32), x)
        state[: len(own)] = ((x // f) << scale) + x % f + b
    return state, np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)


def decode_block(count: int, state: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    lanes, state, at = len(state), state.astype(np.uint64), 0
    mask, scale, ids = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), np.empty(count, np.uint32)
    for row in range(-(-count // lanes)):
        n = min(lanes, count - row * lanes)
        x = state[:n]
        slot = x & mask
        own = table.slots[slot]
        ids[row * lanes : row * lanes + n] = own
        x = table.freq[own] * (x >> scale) + slot - table.start[own]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[:n] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("block does not end where it should")
    return ids


def write_segment(docs: list[tuple[int, int]], ids: np.ndarray, start: int, table: Table, lanes: int = LANES) -> bytes:
    """docs: (doc_id, ids of it), in order; start: ids of all documents before."""
    index, body = [], []
    for at in range(0, len(ids), BLOCK_IDS):
        own = ids[at : at + BLOCK_IDS]
        state, words = encode_block(own, table, lanes)
        index.append(struct.pack("<QIII", at, len(own), len(words), zlib.crc32(own.astype("<u4").tobytes())))
        body += [state.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    head = _HEAD.pack(MAGIC, VERSION, table.scale, lanes, len(docs), len(index), len(ids), start, table.crc)
    data = b"".join([head, *(struct.pack("<qI", *d) for d in docs), *index, *body])
    return data + struct.pack("<I", zlib.crc32(data))


class Segment:
    """Reader of one segment; blocks are decoded on demand."""

    def __init__(self, data: bytes, table: Table):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("segment checksum does not match")
        magic, version, scale, self.lanes, docs, blocks, self.ids, self.start, crc = _HEAD.unpack_from(data)
        if (magic, version, scale, crc) != (MAGIC, VERSION, table.scale, table.crc):
            raise ValueError("not a segment of this format and table")
        self.data, self.table, at = data, table, _HEAD.size
        self.docs = [struct.unpack_from("<qI", data, at + 12 * k) for k in range(docs)]
        at += 12 * docs
        self.index = [struct.unpack_from("<QIII", data, at + 20 * k) for k in range(blocks)]
        at += 20 * blocks
        self.place = []
        for _, _, words, _ in self.index:
            self.place.append(at)
            at += 8 * self.lanes + 4 * words

    def block(self, k: int) -> np.ndarray:
        _, count, words, crc = self.index[k]
        at = self.place[k]
        state = np.frombuffer(self.data, "<u8", self.lanes, at)
        ids = decode_block(count, state, np.frombuffer(self.data, "<u4", words, at + 8 * self.lanes), self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("block checksum does not match")
        return ids

    def documents(self):
        """(doc_id, start, ids) of each document."""
        ids = np.concatenate([self.block(k) for k in range(len(self.index))]) if self.index else np.zeros(0, np.uint32)
        at = 0
        for doc, n in self.docs:
            yield (None if doc == _NULL else doc), self.start + at, ids[at : at + n]
            at += n


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int, partitions: int | None = None) -> None:
    """Writes ``path``/table and ``path``/segments."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are told apart, so that many of them fill many partitions
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(12, total // (16 << 20) + 1)
    ordered = rows.repartitionByRange(int(n), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")

    def ids_of(batches):
        from pyspark import TaskContext

        part, coder, end, at = TaskContext.get().partitionId(), encoder(tokenizer_path, spaced=False), np.uint32(end_id).tobytes(), 0
        for batch in batches:
            coded = [c + end for c in coder.encode(texts_of(batch.column(1)))]
            sizes = np.array([len(c) // 4 for c in coded], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(coded), pa.int32()), batch.column(0), pa.array(starts), pa.array(sizes), pa.array([np.frombuffer(c, np.uint32).astype(narrow).tobytes() for c in coded], pa.binary())],
                names=["part", "doc_id", "start", "n", "ids"],
            )
        settle()

    narrow = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    tokens = cut(ordered.mapInArrow(ids_of, "part int, doc_id long, start long, n long, ids binary"))

    def histogram(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            # the ids of a batch lie one behind the other
            column = batch.column(0).cast(pa.large_binary())
            if not len(column):
                continue
            first, last = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)[[0, -1]].tolist()
            own = np.bincount(np.frombuffer(column.buffers()[2], narrow, (last - first) // np.dtype(narrow).itemsize, first) if last > first else np.zeros(0, narrow), minlength=1)
            counts[: len(own)] += own
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["id", "n"])

    # bounded by the vocabulary, and by the number of partitions
    found = tokens.select("ids").mapInArrow(histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    freq = scaled(counts)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "frequencies binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    sums = dict(tokens.groupBy("part").agg(F.sum("n")).collect())
    before, at = {}, 0
    for p in sorted(sums):
        before[p], at = at, at + sums[p]

    def segments(batches):
        table = Table(freq)
        held: list[tuple[int, int]] = []
        ids: list[bytes] = []
        size = first = 0
        part = after = None

        def flush():
            joined = np.frombuffer(b"".join(ids), narrow).astype(np.uint32)
            data = write_segment(held, joined, before[part] + first, table)
            return pa.RecordBatch.from_arrays([pa.array([before[part] + first]), pa.array([data], pa.binary())], names=["segment", "data"])

        for batch in batches:
            for p, doc, start, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (p != part or start != after or size >= SEGMENT_IDS):
                    yield flush()
                    held, ids, size = [], [], 0
                if not held:
                    part, first = p, start
                held.append((_NULL if doc is None else doc, n))
                ids.append(own)
                size, after = size + n, start + n
        if held:
            yield flush()

    tokens.mapInArrow(segments, "segment long, data binary").write.mode("overwrite").parquet(f"{path}/segments")


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, on demand, ids of every document in the files."""
    bounded_batches(spark)
    row = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(bytes(row.frequencies), "<u4")

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = [(d, s, len(i), zlib.crc32(raw := i.astype("<u4").tobytes()), raw) for d, s, i in Segment(data, table).documents()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "start", "n_tokens", "ids_crc32", "ids")
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(4 + with_ids)], names=list(names[: 4 + with_ids]))

    return spark.read.parquet(f"{path}/segments").select("data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
