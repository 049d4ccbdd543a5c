"""Exact substring de-duplication with difference-cover anchors.

A window is ``WINDOW`` consecutive words. Anchors are the shingles of ``ANCHOR`` words that start at positions whose remainder
modulo ``PERIOD`` is in the difference cover; only these are hashed and exchanged. For any two positions there is a
shift below the period that brings both onto the cover, so two equal windows always share an aligned anchor that lies
inside both (PERIOD - 1 + ANCHOR = WINDOW). Documents then extend the anchors that some other document has: only the
windows around them are compared, by 128-bit hashes of all their words, and a window loses its words in every document
but the one with the smallest id.

Both exchanges are packed by bucket. In each task a hash that several of its documents share is settled there and only
announced, so a passage in every document costs one entry per task. Nothing is collected and no pairs are formed.

Null text has no words. Rows with a null id take no part: nothing is removed from them and they remove nothing. Rows with equal ids
count as one document and do not remove from each other; repeated rows stay as many rows. A text of fewer words than a window stays whole. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.packed import (
    FLUSH_ENTRIES, LISTS, Collector, all_ids, bucket_of, by_bucket, by_group, collect_map, group_column, lengthened, lists_by_group, pack, runs, short,
    spread_of, unpack)
from shelfcast.llm.words import Words, inside, mix, pieces, shingles, split_words

WINDOW, PERIOD, ANCHOR = 13, 7, 7
#: Every difference modulo the period occurs between two of these.
COVER = (0, 1, 3)

_PACKED = "bucket int, state int, ids binary, codes binary, checks binary"
#: The entries of a row are compared in their bucket, only announce a hash, or are settled and pass through.
COMPARED, ANNOUNCED, SETTLED = 0, 1, 2


def anchor_flags(words: Words) -> np.ndarray:
    """For each word: does an anchor start here?"""
    position = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts())
    return np.isin(position % PERIOD, COVER)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every anchor of the texts that hold a window."""
    codes = shingles(words.hashes(), ANCHOR)
    enough = np.repeat(words.counts() >= WINDOW, words.counts())
    at = np.flatnonzero((anchor_flags(words) & enough)[:len(codes)] & inside(words.first, ANCHOR))
    return at, codes[at]


#: Bits of an anchor's hash that are exchanged.
SHORT = np.uint64((1 << 48) - 1)


def candidate_windows(words: Words, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    at, codes = anchors(words)
    marked = np.zeros(len(words.start) + 1, np.int32)
    marked[at[np.isin(codes & SHORT, shared)] + 1] = 1
    total = np.cumsum(marked)
    allowed = inside(words.first, WINDOW)
    start = np.arange(len(allowed))
    return start[allowed & (total[start + PERIOD] > total[start])]


def window_codes(words: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at the given words."""
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return shingles(words.hashes(0), WINDOW)[start], shingles(words.hashes(1), WINDOW, 1)[start]


def _usable(piece: pa.RecordBatch) -> pa.RecordBatch:
    return piece.filter(pc.is_valid(piece.column(0))) if piece.column(0).null_count else piece


def _distinct(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One entry per hash and document, in the order of hash, check and id."""
    names = [x for x in ("codes", "checks", "ids") if x in columns]
    order = np.lexsort([columns[x] for x in reversed(names)])
    columns = {k: v[order] for k, v in columns.items()}
    keep = runs(*(columns[x] for x in names))[:-1]
    return {k: v[keep] for k, v in columns.items()}


def _rows(state: int, columns: dict[str, np.ndarray], chosen: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of the chosen entries."""
    columns = {k: v[chosen] for k, v in columns.items()}
    if not len(columns["ids"]):
        return
    where = spread_of(columns["ids"], buckets) if state == SETTLED else bucket_of(columns["codes"], buckets)
    ids, codes = columns["ids"], columns["codes"]
    if "checks" not in columns:
        batch = pack(where, ids, {"codes": short(codes)})
        checks = pa.array([None] * batch.num_rows, pa.binary())
    else:
        batch = pack(where, ids, {"codes": codes, "checks": columns["checks"]})
        checks = batch["checks"]
    yield pa.RecordBatch.from_arrays([batch["bucket"], pa.array([state] * batch.num_rows, pa.int32()), batch["ids"], batch["codes"], checks],
                                     ["bucket", "state", "ids", "codes", "checks"])


def _read(rows: pa.Table, *states: int) -> pa.Table:
    return rows.filter(pc.is_in(rows["state"], value_set=pa.array(states, pa.int32())))


def shared_anchors(docs: DataFrame, buckets: int, most: int = FLUSH_ENTRIES) -> DataFrame:
    """Per document the anchors that another document has too.

    Anchors travel as 48 bits: a chance match only adds a candidate window."""
    def entries(piece: pa.RecordBatch) -> dict[str, np.ndarray]:
        piece = _usable(piece)
        words = split_words(piece.column(1))
        at, codes = anchors(words)
        return {"codes": codes & SHORT, "ids": piece.column(0).to_numpy()[words.text_of_word()[at]]}

    def flush(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = _distinct(columns)
        first = runs(columns["codes"])
        many = np.diff(first) > 1
        inside_many = np.repeat(many, np.diff(first))
        yield from _rows(COMPARED, columns, np.flatnonzero(~inside_many), buckets)
        yield from _rows(SETTLED, columns, np.flatnonzero(inside_many), buckets)
        yield from _rows(ANNOUNCED, columns, first[:-1][many], buckets)

    def work(rows: pa.Table) -> pa.Table:
        settled, compared, announced = (_read(rows, x) for x in (SETTLED, COMPARED, ANNOUNCED))
        codes, told = (lengthened(unpack(x["codes"], np.uint8)) for x in (compared, announced))
        ids = all_ids(compared["ids"])
        order = np.argsort(codes, kind="stable")
        first = runs(codes[order])
        shared = np.zeros(len(codes), bool)
        shared[order] = np.repeat(np.diff(first) > 1, np.diff(first))
        shared |= np.isin(codes, told)
        return lists_by_group(np.concatenate([ids[shared], all_ids(settled["ids"])]),
                              np.concatenate([codes[shared], lengthened(unpack(settled["codes"], np.uint8))]), buckets, True)

    return by_bucket(collect_map(docs, entries, flush, _PACKED, most=most), work, LISTS)


def repeated_windows(docs: DataFrame, shared: DataFrame, buckets: int, most: int = FLUSH_ENTRIES) -> DataFrame:
    """Per document the hashes of windows that a document with a smaller id has too."""
    def entries(piece: pa.RecordBatch, anchors_of_group: np.ndarray) -> dict[str, np.ndarray]:
        words = split_words(piece.column(1))
        start = candidate_windows(words, anchors_of_group)
        codes, checks = window_codes(words, start)
        return {"codes": codes, "checks": (checks & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                "ids": piece.column(0).to_numpy()[words.text_of_word()[start]]}

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(lengthened(unpack(right["codes"], np.uint8)))
        held, out = Collector(flush, most), []
        if len(wanted):
            for batch in left.select(["doc_id", "text"]).to_batches():
                for piece in pieces(_usable(batch), "text"):
                    out += held.add(**entries(piece, wanted))
            out += held.done()
        return pa.Table.from_batches(out, _PACKED_ARROW)

    def later(columns: dict[str, np.ndarray]) -> np.ndarray:
        """Entries that are not of the smallest id of their window."""
        first = runs(columns["codes"], columns["checks"])
        return columns["ids"] > np.repeat(columns["ids"][first[:-1]], np.diff(first))

    def flush(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = _distinct(columns)
        gone = later(columns)
        yield from _rows(COMPARED, columns, np.flatnonzero(~gone), buckets)
        del columns["checks"]  # a settled window is only told to its own document
        yield from _settled(columns, np.flatnonzero(gone), buckets)

    def work(rows: pa.Table) -> pa.Table:
        settled, compared = _read(rows, SETTLED), _read(rows, COMPARED)
        columns = _distinct({"codes": unpack(compared["codes"], np.uint64), "checks": unpack(compared["checks"], np.uint32),
                             "ids": all_ids(compared["ids"])})
        gone = later(columns)
        return lists_by_group(np.concatenate([columns["ids"][gone], all_ids(settled["ids"])]),
                              np.concatenate([columns["codes"][gone], unpack(settled["codes"], np.uint64)]), buckets)

    return by_bucket(by_group(docs, shared, find, _PACKED), work, LISTS)


def _settled(columns: dict[str, np.ndarray], chosen: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows with whole codes that pass through a bucket."""
    ids, codes = columns["ids"][chosen], columns["codes"][chosen]
    if len(ids):
        batch = pack(spread_of(ids, buckets), ids, {"codes": codes})
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch["bucket"], pa.array([SETTLED] * n, pa.int32()), batch["ids"], batch["codes"],
                                          pa.array([None] * n, pa.binary())], ["bucket", "state", "ids", "codes", "checks"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FLUSH_ENTRIES) -> DataFrame:
    """doc_id, n_words, removed (word spans, end exclusive) and kept (words joined by a space) of every row.

    A task packs at most about ``most`` hashes at a time. Rows without an id are split into words where they lie: they meet
    no group, however many share a text."""
    everything = common.documents(docs, id_col, text_col)
    docs = everything.where(F.col("doc_id").isNotNull())
    buckets = common.bucket_count(docs)
    grouped = docs.withColumn("group", group_column("doc_id", "text", buckets))
    repeated = repeated_windows(grouped, shared_anchors(docs, buckets, most), buckets, most)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, codes = all_ids(right["ids"]), unpack(right["codes"], np.uint64)
        order = np.argsort(ids, kind="stable")
        ids, codes = ids[order], codes[order]
        out = []
        for batch in left.select(["doc_id", "text"]).to_batches():
            for piece in pieces(batch, "text"):
                out.append(result(piece, ids, codes))
        return pa.Table.from_batches(out, _RESULT) if out else _RESULT.empty_table()

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return result(batch, np.empty(0, np.int64), np.empty(0, np.uint64))

    lone = everything.where(F.col("doc_id").isNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return by_group(grouped, repeated, work, RESULT).unionByName(common.map_batches(lone, whole, RESULT, "text"))


def result(piece: pa.RecordBatch, ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """Words removed from and kept of each text, given the repeated windows of documents by id."""
    words = split_words(piece.column(1))
    gone = covered(words, *lists_of(piece.column(0), ids, codes))
    return pa.RecordBatch.from_arrays(
        [piece.column(0), pa.array(words.counts().astype(np.int64)), word_spans(words, gone), joined(words, ~gone)],
        ["doc_id", "n_words", "removed", "kept"])


RESULT = "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept string"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("state", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("checks", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                     ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def lists_of(doc_ids: pa.Array, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row's document from entries sorted by id, and the row each belongs to."""
    valid = np.asarray(doc_ids.is_valid())
    wanted = np.asarray(doc_ids.fill_null(0))
    first, last = np.searchsorted(ids, wanted, "left"), np.searchsorted(ids, wanted, "right")
    n = np.where(valid, last - first, 0)
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return codes[at], np.repeat(np.arange(len(n)), n)


def covered(words: Words, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that a window of their own text's list covers."""
    if not len(codes):
        return np.zeros(len(words.start), bool)
    salt = np.uint64(0x9E3779B97F4A7C15)
    windows = shingles(words.hashes(0), WINDOW)
    text = words.text_of_word()[:len(windows)].astype(np.uint64)
    found = np.isin(mix(windows + text * salt), mix(codes + row.astype(np.uint64) * salt)) & inside(words.first, WINDOW)
    edges = np.zeros(len(words.start) + 1, np.int32)
    at = np.flatnonzero(found)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return np.cumsum(edges)[:-1] > 0


def word_spans(words: Words, flags: np.ndarray) -> pa.Array:
    """Runs of flagged words per text, counted from the text's first word."""
    n = len(flags)
    opens, closes = flags.copy(), flags.copy()
    inner = words.first[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    opens[1:] &= ~flags[:-1]
    closes[:-1] &= ~flags[1:]
    opens[inner], closes[inner - 1] = flags[inner], flags[inner - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(a, words.first).astype(np.int32)
    base = np.repeat(words.first[:-1], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
        [pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], names=["start", "end"]))


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Kept words of each text joined by one space."""
    row = words.text_of_word()[kept]
    start, length = words.start[kept], (words.end - words.start)[kept]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
    size = length + ~last
    ends = np.cumsum(size)
    source = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    data = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if len(source) else np.empty(0, np.uint8)
    data[ends[~last] - 1] = 0x20
    bytes_of = np.zeros(len(words.first) - 1, np.int64)
    np.add.at(bytes_of, row, size)
    bounds = np.concatenate([[0], np.cumsum(bytes_of)])
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def substring_digests(spark, folder: str) -> DataFrame:
    """Query op6: words removed from every document, and a digest of what is kept."""
    done = remove_repeats(common.table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
