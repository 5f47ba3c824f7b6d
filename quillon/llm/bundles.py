"""Bundles: rows of neighbouring documents packed and compressed into one binary row.

Operators that ask all documents about shared hashes work on bundles: each bundle sends one
packed block for each bucket of hashes, buckets answer the bundles, and the bundle meets its
answers by its number. Hashes that many documents of a bundle share are sent once, so a group
of copies costs at most one entry a bundle, and no task ever holds a group of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import shuffle_width, trim

#: Bytes of one bundle's rows before compression; a larger row has a bundle of its own.
BUNDLE_BYTES = 1 << 20
#: Bytes of text for one bucket of hashes, and for one task of bundles: about two million words.
TASK_BYTES = 12 << 20
BLOCKS = pa.schema([("bucket", pa.int32()), ("bundle", pa.int64()), ("payload", pa.binary())])
BLOCKS_DDL = "bucket int, bundle long, payload binary"
ANSWERS = pa.schema([("bundle", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
ANSWERS_DDL = "bundle long, bucket int, payload binary"


def tasks(docs: DataFrame, text: str = "text", size: int = TASK_BYTES) -> int:
    """Tasks, and buckets of hashes, for docs: as their bytes of text say, and no fewer than shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-total // size))


def pack(docs: DataFrame, parts: int, size: int = BUNDLE_BYTES) -> DataFrame:
    """docs as (bundle, payload), dealt by bundle to parts tasks. Rows keep their order and all their columns.

    A bundle's number follows from its partition and its place in it, the same each time a table is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            width = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
                        for c in b.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type))
            at = (np.cumsum(width) - width) // size if isinstance(width, np.ndarray) else np.zeros(b.num_rows, np.int64)
            cuts = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, b.num_rows]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                sink = pa.BufferOutputStream()
                part = pa.Table.from_batches([b.slice(i, j - i)]).rename_columns(names)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([bundle_number(task, made, parts)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bundle", "payload"])
                made += 1
        trim()

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow reads columns by name, and names may have dots
    return plain.mapInArrow(run, "bundle long, payload binary").repartition(parts, "bundle")


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def column(table: pa.Table, name: str | int) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One step of Murmur3 on 32-bit numbers."""
    k = k * np.uint32(0xCC9E2D51)
    k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
    h = h ^ k
    return ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)


def partition_of(x: np.ndarray, n: int) -> np.ndarray:
    """The partition of n that Spark's hash partitioning deals an int32 or int64 key to."""
    wide = x.dtype == np.int64
    words = x.astype(np.uint64)
    h = _mixed(np.full(len(x), 42, np.uint32), words.astype(np.uint32))
    if wide:
        h = _mixed(h, (words >> np.uint64(32)).astype(np.uint32))
    h = h ^ np.uint32(8 if wide else 4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32).astype(np.int64) % n


def labels(n: int, most: int = 1 << 20) -> np.ndarray:
    """A key for each of n buckets, each in a partition of its own, so that no task gets several; beyond most any keys."""
    if n > most:
        return np.arange(n, dtype=np.int32)
    tried = 8 * n
    while True:
        places, first = np.unique(partition_of(np.arange(tried, dtype=np.int32), n), return_index=True)
        if len(places) == n:
            return first.astype(np.int32)
        tried *= 2


def bundle_number(task: int, i: int, n: int) -> int:
    """A number for the i-th bundle of a task; of 4096 that it may have, one that deals bundles to n partitions in turn."""
    may = (np.int64(task) << np.int64(33)) + (np.int64(i) << np.int64(12)) + np.arange(4096, dtype=np.int64)
    hit = np.flatnonzero(partition_of(may, n) == (task * 7919 + i) % n)
    return int(may[hit[0] if len(hit) else 0])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """By the upper bits, so that sorted hashes lie in sorted buckets."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def cut(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket's hashes begin in a sorted array: n + 1 places."""
    return np.searchsorted(bucket_of(sorted_hashes, n), np.arange(n + 1))


def blocks(bundle: int, parts: list[tuple[int, bytes]], schema: pa.Schema = BLOCKS) -> pa.Table:
    return pa.table([pa.array([p[0] for p in parts], schema.field("bucket").type), pa.array([bundle] * len(parts), pa.int64()),
                     pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "bundle", "payload"]).select(schema.names)


def answers(bucket: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([p[0] for p in parts], pa.int64()), pa.array([bucket] * len(parts), pa.int32()), pa.array([p[1] for p in parts], pa.binary())], schema=ANSWERS)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lower width bytes of whole numbers, byte by byte plane, which compresses well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").reshape(-1)


def trimmed(f: Callable) -> Callable:
    """f of a key and one or two tables, after which the worker gives the memory that it no longer uses back."""

    def one(key, t):
        try:
            return f(key, t)
        finally:
            trim()

    def two(key, left, right):
        try:
            return f(key, left, right)
        finally:
            trim()

    return two if f.__code__.co_argcount == 3 else one


def deal(blocks_of: DataFrame, parts: int, by: str) -> DataFrame:
    """Rows dealt by their bucket or bundle to so many tasks, whatever spark.sql.shuffle.partitions says."""
    return blocks_of.repartition(parts, by)
