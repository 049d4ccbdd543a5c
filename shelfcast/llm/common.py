"""Reading, mapping and packing helpers of the operators."""

from __future__ import annotations

import hashlib
import math
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.words import pieces
from shelfcast.session import shared_folder

#: Text bytes that one bucket of packed hashes stands for; the number of buckets follows the input.
BUCKET_TEXT_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str) -> DataFrame:
    """``work`` on pieces of a few megabytes of text each, whatever Spark's batch size is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                yield work(piece)

    return df.mapInArrow(run, schema)


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names; others cannot clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bucket_count(df: DataFrame, text_col: str = "text") -> int:
    """Buckets for packed hashes: as many as shuffle partitions, more if the text needs it."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_TEXT_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def span_text(spans: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """``kind:start:end`` of the spans in their order, joined by commas."""
    chosen = F.filter(spans, wanted) if wanted else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


class Stretches:
    """Spans (start, end) that can be asked what they hold or touch, in the logarithm of their number."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def hold(self, start: int, end: int) -> bool:
        """Whether one of the spans has all of this one inside."""
        n = bisect_right(self.starts, start)
        return n > 0 and self.reach[n - 1] >= end

    def touched(self, start: int, end: int) -> list[tuple[int, int]]:
        """The spans that share a place with this one."""
        n, out = bisect_left(self.starts, end), []
        while n and self.reach[n - 1] > start:
            n -= 1
            if self.spans[n][1] > start:
                out.append(self.spans[n])
        return out


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans_array(found: list[list[tuple]], schema: pa.ListType) -> pa.Array:
    """Lists of tuples as one Arrow list column of structs."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = [x for row in found for x in row]
    fields = list(schema.value_type)
    columns = [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(fields)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))
