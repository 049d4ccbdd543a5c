"""Concatenate and cut: all documents as one long row of token ids, cut into windows of equal length.

First pass: every task writes the ids of its documents, each followed by an end id, with the number of ids that the task wrote
before. The totals of the tasks, one number each, are summed up on the driver; so every stored row has its place in the whole
row of ids. Second pass: a row falls into the windows that its places touch; the cut parts are the boundary records of the
windows. Nothing is shuffled, no window is put together in the first place, and only the last one can be short of ids.

Ids are those of the vocabulary file (byte-level pairs, no special tokens: their strings are ordinary text), found by the faster
of two libraries that agree on it. Long texts are encoded in parts that end before a single space between two other
characters, where no token and no look-ahead of the split pattern can reach across, so the ids are those of the whole text.

A null text is empty and gives the end id alone; rows with a null id or a repeated id are documents like the others; ties keep
the order of the table. Very long texts are stored as several rows of at most ``ROW_TOKENS`` ids. An empty table gives no pieces.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.chat import PATTERN
from shelfcast.llm.words import pieces as text_pieces

LENGTH, END_ID = 2048, 1
#: Ids of one stored row at most (1 MB).
ROW_TOKENS = 1 << 18
#: Characters of a text that are encoded at a time.
PART_CHARS = 1 << 20
#: Ids in one batch that a task hands on.
_BATCH_TOKENS = 1 << 20
_ID = np.dtype("<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """How vocabulary files write bytes: printable ones as themselves, the others as characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Byte pairs by rank; the ids are the ranks."""

    ranks: dict[bytes, int]
    pattern: str = PATTERN
    _made: tiktoken.Encoding | None = field(default=None, repr=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, special = byte_letters(), {x["content"] for x in content["added_tokens"] if x["special"]}
        return cls({bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special})

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_made": None}

    def encode(self, text: str) -> np.ndarray:
        if self._made is None:
            self._made = tiktoken.Encoding("pairs", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        parts = [self._made.encode_to_numpy(x) for x in text_parts(text)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def decode(self, ids: np.ndarray) -> str:
        self.encode("")
        return self._made.decode_bytes(ids.tolist()).decode()


def text_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters that are tokenized as the whole is."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokenized(documents: DataFrame, vocabulary: Vocabulary, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (task, at, doc_id, start, ids, doc_tokens): ids ``start``.. of a document, at place ``at`` of its task's ids."""
    docs = common.documents(documents, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["task", "at", "doc_id", "start", "ids", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def batch(id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), id_type, pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        id_type = None
        for whole in batches:
            for piece in text_pieces(whole, "text"):
                id_type = piece["doc_id"].type
                for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["text"], strict=True):
                    ids = np.append(shared.value.encode(text.as_py() or ""), np.uint32(end_id)).astype(_ID)
                    for start in range(0, len(ids), ROW_TOKENS):
                        part = ids[start:start + ROW_TOKENS]
                        rows.append((task, at, doc_id, start, part.tobytes(), len(ids)))
                        at += len(part)
                        held += len(part)
                        if held >= _BATCH_TOKENS:
                            yield batch(id_type)
                            rows, held = [], 0
        if rows:
            yield batch(id_type)

    return docs.mapInArrow(run, f"task int, at long, doc_id {kind}, start long, ids binary, doc_tokens long")


def task_bases(rows: DataFrame) -> DataFrame:
    """(task, base): ids in all tasks before it; one record per task."""
    totals = rows.groupBy("task").agg(F.sum(F.octet_length("ids") / _ID.itemsize).cast("long").alias("n")).collect()
    base, out = 0, []
    for task, n in sorted(tuple(x) for x in totals):
        out.append((task, base))
        base += n
    return rows.sparkSession.createDataFrame(out, "task int, base long")


def pack(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ids are little-endian unsigned 32-bit numbers: the document's ids from ``start`` on, at ``offset`` of their sequence."""
    rows = common.stored(tokenized(documents, Vocabulary.read(vocabulary or default_vocabulary()), end_id, id_col, text_col), "tokens")
    placed = rows.join(F.broadcast(task_bases(rows)), "task").select(  # bases: one number per task
        "doc_id", "start", "ids", "doc_tokens", (F.col("base") + F.col("at")).alias("place"),
        F.expr(f"octet_length(ids) div {_ID.itemsize}").cast("long").alias("n"))
    windows = placed.select("*", F.explode(F.expr(f"sequence(place div {length}, (place + n - 1) div {length})")).alias("sequence_id"))
    begin, end = F.greatest("place", F.col("sequence_id") * length), F.least(F.col("place") + F.col("n"), (F.col("sequence_id") + 1) * length)
    inner = windows.select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "place", begin.alias("begin"), (end - begin).alias("length"))
    cut = F.substring("ids", ((F.col("begin") - F.col("place")) * _ID.itemsize + 1).cast("int"), (F.col("length") * _ID.itemsize).cast("int"))
    return inner.select(
        "doc_id", (F.col("start") + F.col("begin") - F.col("place")).alias("start"), "length", cut.alias("ids"), "doc_tokens",
        "sequence_id", (F.col("begin") - F.col("sequence_id") * length).alias("offset"))


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, boundaries, padding): a group has at most ``length`` pieces; full powers of two need no padding."""
    part = F.struct("offset", "length", "doc_id", "start", "doc_tokens", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    used = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    padded = F.when(used.bitwiseAND(used - 1) == 0, F.lit(0).cast("long")).otherwise(F.lit(length).cast("long") - used)
    return whole.select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: F.struct(*[x[c].alias(c) for c in ("offset", "length", "doc_id", "start", "doc_tokens")])).alias("boundaries"),
        padded.alias("padding"))


def packed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Query op11: every piece with the checksum of its ids."""
    return pack(common.table(spark, folder, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
