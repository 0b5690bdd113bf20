"""Blocks of documents: the unit in which texts travel to what a whole corpus was needed to work out.

A block is a run of rows of one input partition, of about `most` text bytes; a longer text is a block of its own.
Its number is made of the partition's and its own within it, so reading the same input again gives the same blocks. A
checksum of its texts goes with both passes, and a difference fails the query.
"""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from .bytetext import column_bytes

MOST_BYTES = 16_000_000


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = MOST_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Numbered tables of whole rows."""
    partition = TaskContext.get().partitionId() << 32
    number, held, size = 0, [], 0
    for batch in batches:
        first = 0
        _, offsets = column_bytes(batch.column(column))
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most - size, "right")) - 1)
            held.append(batch.slice(first, last - first))
            size += int(offsets[last] - offsets[first])
            first = last
            if size >= most or first < batch.num_rows:
                yield partition | number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield partition | number, pa.Table.from_batches(held)


def checksum(table: pa.Table, column: str) -> int:
    data, offsets = column_bytes(table.column(column))
    return zlib.crc32(offsets.tobytes(), zlib.crc32(data))


def packed(table: pa.Table, *, small: bool = False) -> bytes:
    """The table as compressed bytes; small: by block sorting, which takes longer and makes texts a third smaller."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return bz2.compress(sink.getvalue()) if small else zstandard.compress(sink.getvalue(), 3)


def unpacked(data: bytes, *, small: bool = False) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bz2.decompress(data) if small else zstandard.decompress(data))).read_all()


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).data, 3) if values.size else b""


def released(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind) if data else np.empty(0, kind)
