"""MinHash near-duplicates with tensored banding, verified on full sets.

A document's set holds its distinct word shingles. Two collections of ``HALVES`` half-keys are made from ``HALF`` minhashes
each; every pair of a half-key of the first and one of the second collection is a table key. So HALVES * HALVES tables of
2 * HALF minhashes need only 2 * HALVES * HALF minhashes, about the square root. Two documents of similarity s meet unless
all half-keys of one collection differ: 1 - (1 - (1 - s^HALF)^HALVES)^2, below 4e-4 at s = 0.8 and 1e-5 at 0.88.

Keys are grouped twice. In a task, a document that is linked to the smallest one of its key (confirmed at once on the full
sets) is not sent on under that key, so a group of copies of any size leaves each task as one entry per key. In the key's
bucket every entry is paired with the smallest. Pairs are confirmed on the full sets of both texts.

Pairs within a key that were not compared matter only where a hub stands between several components. The documents beside such
hubs, and the copies behind them, are joined exactly: pairs of different components are confirmed if they share a shingle of
both prefixes, rarest shingles first, which no linked pair can fail. So no link that a key found is lost, and no group is
expanded into all its pairs.

Null and empty texts have an empty set and are linked with nothing. Rows with a null id are linked with nothing and are kept
(their component is null). Rows that share an id are one document: a link of any of its texts is its link. Repeated rows
stay as many rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import stored
from shelfcast.llm.components import components
from shelfcast.llm.packed import all_ids, binary_rows, bucket_of, by_bucket, pack, runs, spread_of, unpack
from shelfcast.llm.words import NON_SPACE, Words, inside, mix, pieces, shingles, split_words

HALF, HALVES = 3, 12
#: Documents and shingles that a task holds before it writes its keys out.
FLUSH_DOCS, FLUSH_SHINGLES = 12_000, 8_000_000
#: Pairs that a bucket of the exact join looks at together.
PAIRS_AT_ONCE = 2_000_000
#: Share of equal minhashes below which a pair is not tried inside a task (it is still tried across tasks).
LIKELY = 0.5

#: Classes of shingles whose frequency is counted for the exact join of the rest.
RARITY_BITS = 18
_RARITY_MASK = np.uint64((1 << RARITY_BITS) - 1)

_GENERATOR = np.random.default_rng(20240229)
_MULTIPLIERS = _GENERATOR.integers(1, 2**63, 2 * HALVES * HALF, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _GENERATOR.integers(1, 2**63, 2 * HALVES * HALF, dtype=np.uint64)

DOC, LINK, PAIR = 0, 1, 2
_PACKED = "bucket int, kind int, ids binary, code binary, inter binary, total binary"
FOUND = "kind int, a long, b long, inter long, total long"


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in order of text and hash, and where each text's begin.

    A text of fewer words than a shingle has its whole sequence as the only one."""
    codes, counts = words.hashes(), words.counts()
    allowed = inside(words.first, size)
    hashes, text = [shingles(codes, size)[allowed]], [words.text_of_word()[:len(allowed)][allowed]]
    for n in range(1, size):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            hashes.append(mix(shingles(codes, n)[words.first[rows]] + np.uint64(n)))
            text.append(rows)
    hashes, text = np.concatenate(hashes), np.concatenate(text)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = runs(text, hashes)[:-1]
    hashes, text = hashes[keep], text[keep]
    return hashes, np.searchsorted(text, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minhashes (32 bits) of the nonempty sets."""
    starts = first[:-1]
    out = np.empty((len(starts), len(_MULTIPLIERS)), np.uint32)
    if len(starts):
        for i, (m, a) in enumerate(zip(_MULTIPLIERS, _ADDENDS, strict=True)):
            out[:, i] = np.minimum.reduceat(((hashes * m + a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def table_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of all tables per set: each combines one half-key of either collection."""
    parts = signature.astype(np.uint64).reshape(len(signature), 2 * HALVES, HALF)
    half = np.zeros(parts.shape[:2], np.uint64)
    for k in range(HALF):
        half = mix(half ^ parts[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    left, right = half[:, :HALVES], half[:, HALVES:]
    table = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(HALVES, HALVES)
    keys = left[:, :, None] * np.uint64(0xC2B2AE3D27D4EB4F) + right[:, None, :] + table[None]
    return mix(keys).reshape(len(signature), -1)


def linked(inter: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Is the intersection at least ``percent`` hundredths of the union? total: sum of both set sizes."""
    return 100 * inter >= percent * (total - inter)


class Held:
    """Sets of the documents of one task, until there are enough to write out."""

    def __init__(self, size: int, percent: int, buckets: int, most_docs: int = FLUSH_DOCS):
        self.size, self.percent, self.buckets, self.most_docs = size, percent, buckets, most_docs
        self.clear()

    def clear(self) -> None:
        self.ids, self.hashes, self.sizes, self.nulls, self.shingles, self.docs = [], [], [], 0, 0, 0

    def add(self, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hashes, first = shingle_sets(split_words(piece.column(1), NON_SPACE, lower=True), self.size)
        self.ids.append(piece.column(0).to_numpy())
        self.hashes.append(hashes)
        self.sizes.append(np.diff(first))
        self.shingles += len(hashes)
        self.docs += piece.num_rows
        if self.docs >= self.most_docs or self.shingles >= FLUSH_SHINGLES:
            yield from self.done()

    def done(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        ids, hashes, sizes = (np.concatenate(x) for x in (self.ids, self.hashes, self.sizes))
        self.clear()
        yield packed_rows(DOC, spread_of(ids, self.buckets), ids, inter=sizes)
        full = np.flatnonzero(sizes > 0)
        if not len(full):
            return
        first = np.concatenate([[0], np.cumsum(sizes[full])])
        ids, sizes = ids[full], sizes[full]
        order = np.argsort(ids, kind="stable")
        signature = signatures(hashes, first)
        keys = table_keys(signature)[order]
        place = np.repeat(order, keys.shape[1])
        keys = keys.ravel()
        by_key = np.argsort(keys, kind="stable")  # keeps ids ascending within a key
        keys, place = keys[by_key], place[by_key]
        bounds = runs(keys)
        lead = np.repeat(place[bounds[:-1]], np.diff(bounds))
        follows = ids[place] != ids[lead]
        pairs = np.unique(lead[follows].astype(np.int64) << 32 | place[follows])
        hub, other = pairs >> 32, pairs & 0xFFFFFFFF
        likely = np.array([np.count_nonzero(signature[a] == signature[b]) for a, b in zip(hub, other, strict=True)]) \
            >= LIKELY * signature.shape[1] if len(pairs) else np.empty(0, bool)
        hub, other = hub[likely], other[likely]
        inter = np.array([shared_count(hashes[first[a]:first[a + 1]], hashes[first[b]:first[b + 1]])
                          for a, b in zip(hub, other, strict=True)], np.int64)
        total = sizes[hub] + sizes[other]
        good = linked(inter, total, self.percent)
        hub, other, inter, total = hub[good], other[good], inter[good], total[good]
        if len(hub):
            yield packed_rows(LINK, spread_of(ids[other], self.buckets), ids[other], code=ids[hub], inter=inter, total=total)
        settled = hub << 32 | other
        sent = ~np.isin(lead.astype(np.int64) << 32 | place, settled)
        again = np.zeros(len(sent), bool)  # rows of one id count once per key
        again[1:] = (keys[1:] == keys[:-1]) & (ids[place[1:]] == ids[place[:-1]])
        sent &= ~again
        keys, found = keys[sent], ids[place[sent]]
        yield packed_rows(PAIR, bucket_of(keys, self.buckets), found, code=keys)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def candidates(docs: DataFrame, size: int, percent: int, most_docs: int = FLUSH_DOCS) -> DataFrame:
    """Documents with their set sizes, links confirmed in tasks, and hub pairs still to confirm."""
    buckets = common.bucket_count(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(size, percent, buckets, most_docs)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield from held.add(piece)
        yield from held.done()

    def pair(rows: pa.Table) -> pa.Table:
        """The smallest document of each key with every other one; the rest passes through."""
        entries = rows.filter(pa.array(np.asarray(rows["kind"]) == PAIR))
        keys, ids = unpack(entries["code"], np.uint64), all_ids(entries["ids"])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        bounds = runs(keys)
        lead = np.repeat(ids[bounds[:-1]], np.diff(bounds))
        hub, other = distinct_pairs(lead[lead != ids], ids[lead != ids])
        passed = rows.filter(pa.array(np.asarray(rows["kind"]) != PAIR))
        if not len(hub):
            return passed
        spread = bucket_of(mix(hub.view(np.uint64)) ^ other.view(np.uint64), buckets)
        return pa.concat_tables([passed, pa.Table.from_batches([packed_rows(PAIR, spread, other, code=hub)])])

    def unfold(rows: pa.Table) -> pa.Table:
        kinds = np.asarray(rows["kind"])
        docs, links, pairs = (rows.filter(pa.array(kinds == k)) for k in (DOC, LINK, PAIR))
        ids = all_ids(docs["ids"])
        none = np.zeros(len(ids), np.int64)
        out = [[np.full(len(ids), DOC), ids, none, unpack(docs["inter"], np.int64), none]]
        ids = all_ids(links["ids"])
        out.append([np.full(len(ids), LINK), unpack(links["code"], np.int64), ids, *(unpack(links[x], np.int64) for x in ("inter", "total"))])
        hub, other = distinct_pairs(unpack(pairs["code"], np.int64), all_ids(pairs["ids"]))
        none = np.zeros(len(hub), np.int64)
        out.append([np.full(len(hub), PAIR), hub, other, none, none])
        kind, a, b, inter, total = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": a, "b": b, "inter": inter, "total": total})

    entries = docs.where("doc_id IS NOT NULL").mapInArrow(run, _PACKED)
    return by_bucket(by_bucket(entries, pair, _PACKED), unfold, FOUND)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = runs(a, b)[:-1]
    return a[keep], b[keep]


def packed_rows(kind: int, bucket: np.ndarray, ids: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    batch = pack(bucket, ids, columns)
    empty = pa.array([None] * batch.num_rows, pa.binary())
    return pa.RecordBatch.from_pydict(
        {"bucket": batch["bucket"], "kind": pa.array([kind] * batch.num_rows, pa.int32()), "ids": batch["ids"]}
        | {k: batch[k] if k in columns else empty for k in ("code", "inter", "total")})


def payloads(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, compressed text) of the documents that any key brought together with another."""
    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        packed = [press.compress((x or "").encode()) for x in piece.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(packed, pa.binary())], ["id", "payload"])

    pairs = found.where(F.col("kind") != DOC)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    packed = common.map_batches(docs.where("doc_id IS NOT NULL"), work, "id long, payload binary", "text")
    return packed.join(ids.hint("merge"), "id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) with the size of the intersection and the sum of both sizes, from whole texts.

    Texts are always joined by sorting, so that small and large tables take the same way."""
    pairs = pairs.select("a", "b").distinct()
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "payload": "first"}).hint("merge"), "a").join(
        texts.withColumnsRenamed({"id": "b", "payload": "second"}).hint("merge"), "b").select("a", "b", "first", "second")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        expand = zstandard.ZstdDecompressor()
        rows = []
        for name in ("first", "second"):
            texts = pa.array([expand.decompress(x) for x in batch[name].to_pylist()], pa.binary()).cast(pa.string())
            hashes, first = shingle_sets(split_words(texts, NON_SPACE, lower=True), size)
            rows.append((hashes, np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(first)))
        hashes, row = (np.concatenate([rows[0][i], rows[1][i]]) for i in (0, 1))
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        twice = row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
        inter = np.bincount(twice, minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(inter), pa.array(rows[0][2] + rows[1][2])],
                                          ["a", "b", "inter", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield work(batch.slice(start, 256))

    return both.mapInArrow(run, "a long, b long, inter long, total long")


def is_linked(percent: int) -> Column:
    return 100 * F.col("inter") >= percent * (F.col("total") - F.col("inter"))


def unsettled(star: DataFrame, local: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of the documents whose hub stands between components, of these hubs, and of the copies behind them all."""
    named = labels.select("id", F.col("component").alias("label"))

    def labelled(ids: DataFrame) -> DataFrame:
        return ids.join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))

    rows = star.select(F.col("a").alias("hub"), F.col("b").alias("id"))
    rows = stored(labelled(rows.unionByName(rows.select("hub", F.col("hub").alias("id")).distinct())), "stars")
    between = rows.groupBy("hub").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("hub")
    beside = rows.join(between, "hub", "left_semi").select("id", "label").distinct()
    copies = local.select(F.col("a").alias("id"), "b").join(beside, "id", "left_semi").select(F.col("b").alias("id"))
    return beside.unionByName(labelled(copies.distinct())).distinct()


def _sets_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    texts = pa.array([expand.decompress(x) for x in batch["payload"].to_pylist()], pa.binary()).cast(pa.string())
    return shingle_sets(split_words(texts, NON_SPACE, lower=True), size)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def rarity(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents have a shingle of each hash class: a table of fixed size."""
    parts, width = 1 << (RARITY_BITS - 12), 1 << 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * width, np.int64)
        for batch in _slices(batches):
            total += np.bincount((_sets_of(batch, size)[0] & _RARITY_MASK).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), binary_rows(total, np.arange(parts + 1) * width)], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"].slice(0, 1), "n": [unpack(table["n"], np.int64).reshape(-1, width).sum(axis=0).tobytes()]})

    found = rows.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect()
    out = np.zeros((parts, width), np.int64)
    for r in found:
        out[r["part"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


def remaining_pairs(rows: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Pairs of different components that share a shingle of both prefixes: an exact join of what the keys left open.

    With shingles in one order, rarest first, what stands before the first shared one is missing in the other set, so in a
    linked pair it has at most n - o shingles before it, with o the overlap that both sizes ask for. ``rows`` has id, label and payload."""
    shared = rows.sparkSession.sparkContext.broadcast(rarity(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ids, labels, sizes, places = [], [], [], [], []
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                hashes, first = _sets_of(part, size)
                n = np.diff(first)
                order = np.lexsort((hashes, shared.value[(hashes & _RARITY_MASK).astype(np.int64)], np.repeat(np.arange(len(n)), n)))
                place = np.arange(len(hashes)) - np.repeat(first[:-1], n)
                kept = place <= np.repeat(n - (percent * n + 99) // 100, n)
                places.append(place[kept].astype(np.int32))
                row = np.repeat(np.arange(len(n)), n)[kept]
                codes.append(hashes[order][kept])
                ids.append(part["id"].to_numpy()[row])
                labels.append(part["label"].to_numpy()[row])
                sizes.append(n[row])
            if codes and sum(map(len, codes)):
                code, id_, label, n, place = (np.concatenate(x) for x in (codes, ids, labels, sizes, places))
                yield pack(bucket_of(code, buckets), id_, {"code": code, "label": label, "n": n.astype(np.int32), "place": place})

    def work(table: pa.Table) -> pa.Table:
        code, ids = unpack(table["code"], np.uint64), all_ids(table["ids"])
        label, n, place = unpack(table["label"], np.int64), unpack(table["n"], np.int32), unpack(table["place"], np.int32)
        order = np.lexsort((n, code))
        code, ids, label, n, place = code[order], ids[order], label[order], n[order].astype(np.int64), place[order]
        bounds = runs(code)
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        several = np.minimum.reduceat(label, bounds[:-1]) != np.maximum.reduceat(label, bounds[:-1]) if len(code) else np.empty(0, bool)
        # sizes rise within a group, so the partners of an entry follow it and end where they are too large
        wide = int(n.max(initial=0)) * 200 + 1
        to = np.searchsorted(group * wide + n, group * wide + 100 * n // percent, side="right")
        rows = np.flatnonzero(several[group])
        many, found = to[rows] - rows - 1, [np.empty((0, 2), np.int64)]
        for chosen in np.split(rows, np.searchsorted(np.cumsum(many), np.arange(PAIRS_AT_ONCE, many.sum() + 1, PAIRS_AT_ONCE))):
            k = to[chosen] - chosen - 1
            left = np.repeat(chosen, k)
            right = left + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            least = (percent * (n[left] + n[right]) + 99 + percent) // (100 + percent)  # shared shingles of a linked pair
            fits = (label[left] != label[right]) & (place[left] <= n[left] - least) & (place[right] <= n[right] - least)
            a, b = ids[left[fits]], ids[right[fits]]
            found.append(np.column_stack(distinct_pairs(np.minimum(a, b), np.maximum(a, b))))
        pairs = np.column_stack(distinct_pairs(*np.concatenate(found).T))
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return by_bucket(rows.mapInArrow(run, "bucket int, ids binary, code binary, label binary, n binary, place binary"), work, "a long, b long")


def find_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text_col: str = "text", most_docs: int = FLUSH_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    ``size`` words make a shingle; documents with a Jaccard similarity of ``percent`` hundredths or more are linked.
    A task compares at most about ``most_docs`` documents at once before it sends their keys on."""
    docs = common.documents(docs, id_col, text_col)
    found = stored(candidates(docs, size, percent, most_docs), "candidates")
    texts = stored(payloads(docs, found), "payloads")
    local = found.where(F.col("kind") == LINK).drop("kind").distinct()
    star = stored(confirm(found.where(F.col("kind") == PAIR), texts, size), "confirmed")
    labels = components(local.unionByName(star.where(is_linked(percent))).select("a", "b"))
    if star.where(~is_linked(percent)).limit(1).count():
        rest = stored(unsettled(star, local, labels).join(texts, "id"), "rest")
        more = stored(confirm(remaining_pairs(rest, size, percent, common.bucket_count(docs)), texts, size), "confirmed")
        more = more.where(is_linked(percent)).select("a", "b")
        if more.limit(1).count():
            labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    rows = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("inter").alias("n_shingles"))
    rows = rows.join(labels.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    rows = rows.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    loose = docs.where("doc_id IS NULL").select("doc_id", set_size(F.col("text"), size).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return rows.unionByName(loose).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def set_size(text: Column, size: int) -> Column:
    """Distinct shingles of a text, for rows that are not compared."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1))), lambda i: F.slice(words, i, size))
    return F.when(F.size(words) == 0, 0).otherwise(F.size(F.array_distinct(parts))).cast("long")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have a near-duplicate of smaller id; all columns stay."""
    gone = find_near_duplicates(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def near_duplicate_classes(spark, folder: str) -> DataFrame:
    """Query op8: two-word shingles, similarity of 0.8 or more."""
    return find_near_duplicates(common.table(spark, folder, "documents"), size=2)
