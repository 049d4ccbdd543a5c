"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of consecutive words, and windows into shingles. Shingles are ordered by how rare they are in
all documents. A document can only contain a window whole if it contains the window's rarest shingle, so that one shingle
is its necessary prefix. Documents meet windows on prefixes only; the prefix's place in the window gives the
positional bound (the window must begin and end inside the document), and the words are then compared one by one.

Items are a stated query set, taken in blocks of at most ``BLOCK_BYTES`` of text by a hash of the item's id; each block is
sent to the tasks and meets all documents. Nothing is cut off: more items mean more blocks.

Null text has no words and no hits. Items without words, without text or with a null id give no windows. Repeated document
rows stay as many rows, repeated items count once. An empty table on either side gives rows without hits or no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.words import LETTERS_DIGITS, Words, inside, shingles, split_words

WINDOW, SHINGLE = 13, 3
#: Item text that is sent to the tasks at a time.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 20

SCHEMA = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, digest binary"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_words(texts: pa.Array) -> Words:
    return split_words(texts, LETTERS_DIGITS, lower=True)


@dataclass
class Windows:
    """Distinct windows of one block of items as arrays; ``codes`` has both hashes of each word."""

    codes: np.ndarray  # windows x window size x 2
    length: np.ndarray
    owner_first: np.ndarray  # items of window i: owners[owner_first[i]:owner_first[i + 1]]
    owners: np.ndarray
    item_ids: list[str]
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by shingle size

    def shingle_codes(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per window its shingle hashes, under the shingle size that its length allows."""
        out: dict[int, list[tuple[int, np.ndarray]]] = {}
        for row, n in enumerate(self.length):
            size = min(SHINGLE, int(n))
            out.setdefault(size, []).append((row, shingles(self.codes[row, :n, 0], size)))
        return out

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle; a window with a shingle that no document has cannot occur."""
        self.prefix = {}
        for size, rows in self.shingle_codes().items():
            chosen = []
            for row, codes in rows:
                found = [(counts.get((size, int(c)), 0), int(c), at) for at, c in enumerate(codes)]
                rarest = min(found)
                if rarest[0]:
                    chosen.append((rarest[1], row, rarest[2]))
            if chosen:
                chosen.sort()
                codes = np.array([x[0] for x in chosen], np.uint64)
                keys, first = np.unique(codes, return_index=True)
                self.prefix[size] = (keys, np.append(first, len(codes)), np.array([x[1] for x in chosen]),
                                     np.array([x[2] for x in chosen]))


def build_windows(item_ids: list[str], texts: pa.Array, size: int = WINDOW) -> Windows:
    words = item_words(texts)
    codes = np.stack([words.hashes(0), words.hashes(1)], axis=1) if len(words.start) else np.empty((0, 2), np.uint64)
    seen: dict[bytes, int] = {}
    rows, lengths, owned = [], [], []
    for item, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        n = min(size, b - a)
        for at in range(a, b - n + 1) if n else ():
            block = codes[at:at + n]
            row = seen.setdefault(block.tobytes(), len(seen))
            if row == len(rows):
                padded = np.zeros((size, 2), np.uint64)
                padded[:n] = block
                rows.append(padded)
                lengths.append(n)
                owned.append(set())
            owned[row].add(item)
    first = np.concatenate([[0], np.cumsum([len(x) for x in owned])]).astype(int)
    owners = np.array([i for x in owned for i in sorted(x)], int)
    return Windows(np.array(rows).reshape(-1, size, 2), np.array(lengths, int), first, owners, item_ids, {})


def _table(keys: np.ndarray) -> np.ndarray:
    """Bit table that most shingles fail in one look-up."""
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(keys & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
    return table


def _places(codes: np.ndarray, allowed: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a shingle is one of ``keys``, and which."""
    at = np.flatnonzero(table[(codes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] & allowed)
    which = np.searchsorted(keys, codes[at])
    good = keys[np.minimum(which, len(keys) - 1)] == codes[at]
    return at[good], which[good]


def shingle_counts(docs: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """Occurrences in all documents of the windows' shingles."""
    wanted = {size: np.unique(np.concatenate([c for _, c in rows])) for size, rows in windows.shingle_codes().items()}
    if not wanted:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast({k: (v, _table(v)) for k, v in wanted.items()})

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = item_words(batch.column(1))
        codes, out = words.hashes(), []
        for size, (keys, table) in shared.value.items():
            allowed = inside(words.first, size)
            _, which = _places(shingles(codes, size), allowed, keys, table)
            found, n = np.unique(which, return_counts=True)
            out.append((np.full(len(found), size), keys[found].view(np.int64), n))
        size, code, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(code), pa.array(n.astype(np.int64))],
                                          ["size", "code", "n"])

    rows = common.map_batches(docs, work, "size int, code long, n long", "text").groupBy("size", "code").agg(F.sum("n").alias("n"))
    return {(r["size"], r["code"] & (2**64 - 1)): r["n"] for r in rows.collect()}  # at most the block's shingles


def occurrences(words: Words, windows: Windows, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of every occurrence in some texts."""
    codes, text_of = words.hashes(), words.text_of_word()
    starts, rows = [], []
    for size, (keys, first, row_of, offset_of) in windows.prefix.items():
        at, which = _places(shingles(codes, size), inside(words.first, size), keys, tables[size])
        many = np.diff(first)[which]
        entry = np.repeat(first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, row = np.repeat(at, many), row_of[entry]
        start = at - offset_of[entry]
        bounds = words.first[text_of[at]], words.first[text_of[at] + 1]
        fits = (start >= bounds[0]) & (start + windows.length[row] <= bounds[1])
        start, row = start[fits], row[fits]
        for k in range(windows.codes.shape[1]):  # confirm word by word
            check = windows.length[row] > k
            same = ~check
            same[check] = codes[start[check] + k] == windows.codes[row[check], k, 0]
            start, row = start[same], row[same]
        starts.append(start)
        rows.append(row)
    start = np.concatenate(starts) if starts else np.empty(0, int)
    row = np.concatenate(rows) if rows else np.empty(0, int)
    if len(start):  # the second hash of the words of what is left
        length = windows.length[row]
        place = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        k = place - np.repeat(start, length)
        again = Words(words.data, words.start[place], words.end[place], words.first, words.text_start).hashes(1)
        wrong = np.flatnonzero(again != windows.codes[np.repeat(row, length), k, 1])
        bad = np.unique(np.repeat(np.arange(len(start)), length)[wrong])
        start, row = np.delete(start, bad), np.delete(row, bad)
    return text_of[start], start, row


def matches(docs: DataFrame, windows: Windows) -> DataFrame:
    """Per document row: words, merged hit spans in words, and the ids of the items found."""
    tables = {size: _table(x[0]) for size, x in windows.prefix.items()}
    shared = docs.sparkSession.sparkContext.broadcast((windows, tables))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows, tables = shared.value
        words = item_words(batch.column(1))
        text, start, row = occurrences(words, windows, tables)
        n = len(words.start)
        edges = np.zeros(n + 1, np.int32)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + windows.length[row], -1)
        hit = np.cumsum(edges)[:n] > 0
        opens, closes = hit.copy(), hit.copy()
        inner = words.first[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        opens[1:] &= ~hit[:-1]
        closes[:-1] &= ~hit[1:]
        opens[inner], closes[inner - 1] = hit[inner], hit[inner - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        bounds = np.searchsorted(a, words.first).astype(np.int32)
        base = np.repeat(words.first[:-1], np.diff(bounds))
        spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
            [pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], fields=list(SPANS.value_type)))
        found: list[set] = [set() for _ in range(batch.num_rows)]
        for t, r in set(zip(text.tolist(), row.tolist(), strict=True)):
            found[t].update(windows.owners[windows.owner_first[r]:windows.owner_first[r + 1]].tolist())
        items = [sorted({windows.item_ids[i] for i in x}) for x in found]
        digest = [b"" for _ in items] if not batch.num_columns > 2 else batch.column(2)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts().astype(np.int64)), spans, pa.array(items, pa.list_(pa.string())),
             pa.array(digest, pa.binary()) if isinstance(digest, list) else digest],
            ["doc_id", "n_words", "spans", "items", "digest"])

    return common.map_batches(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}", "text")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (hit words, end exclusive) and items (sorted ids) of every document row."""
    docs = common.documents(docs, id_col, text_col)
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()  # one block
        windows = build_windows([r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), window)
        windows.order_by_rarity(shingle_counts(docs, windows))
        keyed = docs if blocks == 1 else docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
        parts.append(matches(keyed, windows).withColumn("block", F.lit(block)))
    if blocks == 1:
        return parts[0].drop("digest", "block")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("block") == 0).alias("copies"),
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return merged.select("doc_id", "n_words", merge_spans(F.col("spans")).alias("spans"), "items",
                         F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def merge_spans(spans):
    """Union of overlapping or touching spans of several blocks."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], span["end"]))
        return F.when(last["end"] >= span["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def contaminated(n_hit, n_words):
    """The contract's rule: at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated texts; all columns stay. Whether a row goes depends on its text alone."""
    digest = F.md5(F.col(f"`{text_col}`"))
    texts = docs.select(digest.alias("digest"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    found = find_contamination(texts, items, id_col="digest").withColumn("n_hit", hit_words())
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("digest")).distinct()
    # The rows go as one column, so none of theirs can clash with the digest.
    kept = docs.select(digest.alias("digest"), F.struct("*").alias("row")).join(bad, "digest", "left_anti")
    return kept.select("row.*")


def contamination(spark, folder: str) -> DataFrame:
    """Query op3: hits of the benchmark's windows in every document."""
    found = find_contamination(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))
    return found.withColumn("n_hit", hit_words()).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
