"""Hash exchange in packed rows.

Operators on shingles send far more hashes than there are documents. A task collects the hashes of its documents, keeps one
entry per hash where that is enough, and writes one row of binary arrays per bucket of the hash. Spark shuffles these rows
by bucket; a bucket is a few million hashes whatever the input, because the number of buckets follows the text.
A hash that very many documents share is thinned in each task first, so it never fills a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.words import mix, pieces

#: Entries that a task holds before it writes them out.
FLUSH_ENTRIES = 3_000_000


def runs(*keys: np.ndarray) -> np.ndarray:
    """Index of the first entry of each run of equal keys in sorted arrays, and the end."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), len(new))


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by other bits than those that hash tables and sorting use."""
    return (mix(codes ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int32)


def spread_of(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of what only passes through, by the document it belongs to."""
    return bucket_of(doc_ids.view(np.uint64) + np.uint64(1), buckets)


def pack(bucket: np.ndarray, ids: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, its entries in the order of ``ids``.

    Each column's values are the bytes of an array; the ids, which repeat and rise, are packed smaller."""
    order = np.lexsort((ids, bucket))
    bucket, ids = bucket[order], ids[order]
    first = runs(bucket)
    arrays = {"bucket": pa.array(bucket[first[:-1]], pa.int32()),
              "ids": pa.array([pack_ids(ids[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())}
    for name, values in columns.items():
        arrays[name] = binary_rows(values[order], first)
    return pa.RecordBatch.from_pydict(arrays)


def binary_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Row i holds the bytes of values[first[i]:first[i + 1]]."""
    values = np.ascontiguousarray(values)
    size = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * size).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids with repeats as compressed steps and run lengths."""
    first = runs(ids)
    steps = np.diff(ids[first[:-1]], prepend=np.int64(0))
    data = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), np.diff(first).astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def unpack_ids(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(data) // 12
    steps = np.ascontiguousarray(data[:8 * n].reshape(8, n).T).view(np.int64).ravel()
    return np.repeat(np.cumsum(steps), np.ascontiguousarray(data[8 * n:].reshape(4, n).T).view("<u4").ravel())


def unpack(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """All values of a packed column, rows one after another."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def all_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """All ids of a packed column, rows one after another."""
    parts = [unpack_ids(x) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def short(codes: np.ndarray) -> np.ndarray:
    """The low 48 bits of each code as six bytes, for filters in which a chance match does no harm."""
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def lengthened(data: np.ndarray) -> np.ndarray:
    """Codes of ``short`` bytes as integers."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """Group of a document by its id; ``group_column`` says the same in Spark."""
    return ((ids ^ (ids >> 11) ^ (ids >> 23)) % groups).astype(np.int32)


def group_column(doc_id: str, text: str, groups: int) -> Column:
    """Group of a document row by its id, or by its text where the id is null."""
    key = F.coalesce(F.col(doc_id), F.xxhash64(text))
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 11)).bitwiseXOR(F.shiftright(key, 23)), F.lit(groups)).cast("int")


def lists_by_group(ids: np.ndarray, codes: np.ndarray, groups: int, six_bytes: bool = False) -> pa.Table:
    """One row per group of documents with the distinct (id, code) entries of its documents."""
    order = np.lexsort((codes, ids))
    ids, codes = ids[order], codes[order]
    keep = runs(ids, codes)[:-1]
    ids, codes = ids[keep], codes[keep]
    batch = pack(group_of(ids, groups), ids, {"codes": short(codes) if six_bytes else codes})
    return pa.Table.from_batches([batch]).rename_columns(["group", "ids", "codes"])


LISTS = "group int, ids binary, codes binary"


class Collector:
    """Entries of one task: arrays per column, written out by ``flush`` when there are many."""

    def __init__(self, flush: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], most: int = FLUSH_ENTRIES):
        self.flush, self.most, self.parts, self.count = flush, most, [], 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.count += len(next(iter(columns.values())))
        if self.count >= self.most:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            columns = {k: np.concatenate([x[k] for x in self.parts]) for k in self.parts[0]}
            self.parts, self.count = [], 0
            yield from self.flush(columns)
        self.parts, self.count = [], 0


def collect_map(df: DataFrame, entries: Callable[[pa.RecordBatch], dict[str, np.ndarray] | None],
                flush: Callable[[dict[str, np.ndarray]], Iterator[pa.RecordBatch]], schema: str, column: str = "text",
                most: int = FLUSH_ENTRIES) -> DataFrame:
    """Entries of every piece of text, packed per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collector(flush, most)
        for batch in batches:
            for piece in pieces(batch, column):
                found = entries(piece)
                if found is not None:
                    yield from held.add(**found)
        yield from held.done()

    return df.mapInArrow(run, schema)


def by_bucket(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on all packed rows of one bucket."""
    def run(rows: pa.Table) -> pa.Table:
        return work(rows)

    return df.groupBy("bucket").applyInArrow(run, schema)


def by_group(docs: DataFrame, lists: DataFrame, work: Callable[[pa.RecordBatch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the documents of one group and the packed lists of these documents."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return docs.groupBy("group").cogroup(lists.groupBy("group")).applyInArrow(run, schema)


bucket_count = common.bucket_count
