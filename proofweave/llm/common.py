"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator unless its docstring says otherwise:

* only the named input columns are read, so extra columns, whatever their names, never reach a result;
* a null text counts as empty; a row with a null id is processed like any other and keeps its null id;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..session import scratch_path as scratch

__all__ = ["cut", "scratch", "table", "bounded_batches", "settle", "small_slices", "fold", "packed_blocks", "unpacked", "shrunk", "grown", "texts_of"]

#: Bytes of one Arrow batch and of one block of documents; both bound what a Python worker holds at a time.
BATCH_BYTES = 8 << 20
BLOCK_BYTES = 12 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by size, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def settle() -> None:
    """Gives freed memory back at the end of a task or block; a reused worker otherwise keeps the peak of every step it ran."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20):
    """Parts of a batch with about ``size`` bytes of the text column, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, stop - at)
        at = stop


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null keys fall into no fold."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def packed_blocks(docs: DataFrame, columns: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): neighbouring rows of each scan task, with about ``block_bytes`` of text, compressed to one value.

    Blocks follow the scan, so no source, key or null id gathers in one. They are written out: every later step sees the same
    blocks, and moves a text at about a third of its size.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            at, bounds = 0, batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
            ends = np.cumsum(pc.fill_null(pc.binary_length(bounds), 0).to_numpy(zero_copy_only=False))
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                stop = min(len(batch), int(np.searchsorted(ends, before + block_bytes - size)) + 1)
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - before
                at = stop
                if size >= block_bytes:
                    yield _packed(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _packed(number, held)

    return cut(docs.select(*columns).mapInArrow(run, "block long, data binary"))


def _packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(batches).combine_chunks())
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True) if raw else b""


def grown(data: bytes | None) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def texts_of(column) -> list[str]:
    """An Arrow string column as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]
