"""Harmonic packing of documents into fixed-length token sequences.

Lengths fall into reciprocal classes: class j holds lengths in (C/(j+1), C/j], and every bin of class j takes exactly j
pieces. A document gives as many full sequences as it can; of the rest, exact members of reciprocal classes are cut off
(C // j tokens) until what is left fills its own class to within ``slack``. Every task fills its bins alone, so nothing is
shuffled and a lost task is simply run again. The pieces of the bins that are still open when a task ends are laid end to
end and cut at C, so a task pads one sequence at most besides the crumbs of full bins.

Null text: one piece holding only the end id. Repeated rows are packed as often as they occur. Empty table: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, settle, texts_of
from .tokens import encoder

CAPACITY = 2048
SLACK = 1 / 64


def harmonic_cuts(tokens: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document, in text order."""
    out = [(1, capacity)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        j = capacity // rest
        if rest * (1 + slack) >= capacity // j or rest <= 64:
            out.append((j, rest))
            break
        out.append((j + 1, capacity // (j + 1)))
        rest -= capacity // (j + 1)
    return out


class Bins:
    """The open bins of one task, one per class."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.next, self.open, self.rows = capacity, worker << 32, {}, []

    def add(self, j: int, piece: tuple) -> None:
        """piece: (doc_id, start, id bytes, tokens of the document)"""
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            self._close(self.open.pop(j))

    def _close(self, held: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in held:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset, ids))
            offset += n
        self.next += 1

    def finish(self) -> None:
        """Pieces of unfinished bins, largest class first, end to end and cut at the capacity."""
        held, room = [], self.capacity
        for j in sorted(self.open):
            for doc, start, ids, total in self.open[j]:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((doc, start, part, total))
                    start += len(part) // 4
                    room -= len(part) // 4
                    if not room:
                        self._close(held)
                        held, room = [], self.capacity
        if held:
            self._close(held)
        self.open = {}

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on demand, input_ids."""
    bounded_batches(docs.sparkSession)
    key = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(key)), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = pa.schema(fields + [("input_ids", pa.binary())] * with_ids)
    ddl = f"doc_id {key.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", input_ids binary" * with_ids

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        bins, coder, end = Bins(TaskContext.get().partitionId(), capacity), encoder(tokenizer_path, spaced=True), np.uint32(end_id).tobytes()
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(texts_of(batch.column(1))), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                for j, n in harmonic_cuts(total, capacity, slack):
                    bins.add(j, (doc, start, ids[4 * start : 4 * (start + n)], total))
                    start += n
            yield out(bins.take())
        bins.finish()
        yield out(bins.take())
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
