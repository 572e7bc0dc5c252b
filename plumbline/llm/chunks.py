"""Questions from chunks of documents to hash partitions and back.

Counting every word or window as a row of its own is what makes corpus statistics dear. Here a task gathers documents
into a chunk of bounded size, asks each hash partition about its distinct keys in one packed row, and gets one packed
row back. However often a key occurs it is asked about once a chunk, so a frequent one makes no hot partition, and
no key is ever collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices


def pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data.tobytes() if isinstance(data, np.ndarray) else data)


def unpack(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def squeeze(a: np.ndarray) -> bytes:
    """Numbers packed with their bytes regrouped by place, which pays where high bytes are alike."""
    return pack(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    flat, size = unpack(data, "u1"), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).reshape(-1)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def gather(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(chunk id, keys, texts as bytes, null as empty) of chunks of limit bytes or one document more.

    The id holds the partition's number, so it is unique in the job that writes the chunks, retries included.
    """
    from pyspark import TaskContext

    first, count, keys, texts, size = TaskContext.get().partitionId() << 24, 0, [], [], 0
    for b in slices(batches):
        for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t or b"")
            size += len(t or b"")
            if size >= limit:
                yield first + count, keys, texts
                count, keys, texts, size = count + 1, [], [], 0
    if keys:
        yield first + count, keys, texts


def parts_for(total: int, least: int = 12, part_bytes: int = 24 << 20) -> int:
    """Hash partitions, a power of two, for so many bytes of text: each holds the questions about part_bytes of it or
    less, whatever the input, so a part's memory doesn't grow. A chunk sends a row to each part that it asks; with many
    parts a row holds few keys, one at least."""
    return 1 << max(int(least) - 1, int(total / part_bytes)).bit_length()


def ipc(**columns: pa.Array) -> bytes:
    """Columns as packed bytes."""
    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return pack(sink.getvalue().to_pybytes())


def unipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(data)).read_all()


def tables(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of few rows each, as the rows are large."""
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema)


def in_groups(df: DataFrame, by: str, f: Callable[[pa.Table], Iterator[pa.RecordBatch] | list], schema: str, arrow: pa.Schema) -> DataFrame:
    """f over the rows of each value of by."""

    def work(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(f(table.to_pylist()), arrow)

    return df.groupBy(by).applyInArrow(work, schema)


def in_pairs(left: DataFrame, right: DataFrame, by: str, f: Callable[[list, list], list], schema: str, arrow: pa.Schema) -> DataFrame:
    """f over the rows that two tables have for each value of by."""

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(f(a.to_pylist(), b.to_pylist()), arrow)

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(work, schema)
