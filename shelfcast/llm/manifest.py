"""Merkle manifest of a table, its trees stored in the van Emde Boas layout.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group, in order of their ids, form a tree in which every node
stands for eight; the roots of the groups, in order of the groups, form the tree above. A tree is kept as aligned blocks, subtrees
of ``BLOCK`` leaves. A block is one row, and its nodes lie in the van Emde Boas order: split at half height, first the upper part, then
the lower subtrees from left to right, each laid out the same way. So at every scale a subtree is one contiguous stretch,
and a path from leaf to root crosses few of them. Places follow by arithmetic (`address`), also in the last block, where leaves
are missing at the right only: what stands before a subtree is always complete. The roots of blocks are the leaves of the next
blocks, until one is left; paths are handed down the same way, a block's path above its root to all that is under it.

The order of the leaves is a range partitioning by group, id, leaf and a number per stored row, so neither a large group
nor many rows of one id meet in a task. Where a task's first group begins is known from one record per task; all other
groups of the task begin in it. Blocks are dealt by group and number, at most ``BLOCK`` leaves each.

Null fields have a sign of their own; a null group comes first, and so does a null id in its group. Rows of the same id are leaves
of their own, in the order of their digests; repeated rows differ by place only. Empty texts are fields of no bytes. Texts of any length are
hashed by the JVM. An empty table has no root and gives no rows. Columns that are not among the fields are not read.
"""

from __future__ import annotations

import binascii
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import stored

ARITY, BLOCK_HEIGHT = 8, 4
#: Leaves of a block.
BLOCK = ARITY ** BLOCK_HEIGHT
_DIGEST = 32

# ---------------------------------------------------------------- layout


def size(leaves, height: int):
    """Nodes of a tree with its root ``height`` levels above the leaves."""
    return sum(-(-leaves // ARITY ** level) for level in range(height + 1))


def least_height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    height = 0
    while ARITY ** height < leaves:
        height += 1
    return height


def address(level: int, index, leaves, height: int):
    """Place of the ``index``-th node of a level (0: leaves) in the van Emde Boas order; arrays of indexes give arrays.

    A tree of ``height + 1`` levels is split into a top part and, below it, trees of half as many levels."""
    if height == 0:
        return index * 0
    low = (height + 1) // 2  # levels of the lower trees
    if level >= low:
        return address(level - low, index, -(-leaves // ARITY ** low), height - low)
    width = ARITY ** (low - 1)  # leaves of a lower tree
    tree = index // ARITY ** (low - 1 - level)
    before = size(-(-leaves // ARITY ** low), height - low) + tree * size(width, low - 1)
    return before + address(level, index - tree * ARITY ** (low - 1 - level), np.minimum(width, leaves - tree * width), low - 1)


@functools.lru_cache(maxsize=64)
def level_addresses(leaves: int, height: int) -> list[np.ndarray]:
    """Places of all nodes, level by level."""
    return [address(level, np.arange(-(-leaves // ARITY ** level)), leaves, height) for level in range(height + 1)]


def built(leaves: np.ndarray, height: int) -> np.ndarray:
    """All nodes of a block in their places; ``leaves`` has one row of bytes per digest."""
    places = level_addresses(len(leaves), height)
    nodes = np.empty((sum(len(x) for x in places), _DIGEST), np.uint8)
    nodes[places[0]] = leaves
    for level in range(1, height + 1):
        text = binascii.hexlify(nodes[places[level - 1]].tobytes())
        run = ARITY * 2 * _DIGEST
        parents = b"".join(hashlib.sha256(text[at:at + run]).digest() for at in range(0, len(text), run))
        nodes[places[level]] = np.frombuffer(parents, np.uint8).reshape(-1, _DIGEST)
    return nodes


def paths(nodes: np.ndarray, leaves: int, height: int, above: tuple) -> list[tuple]:
    """Per leaf the steps to the root as nested pairs ((left, right), rest): its run's other digests as hex text, left and
    right of it, and the steps from there; ``above`` are those above the block."""
    places, rests = level_addresses(leaves, height), [above]
    for level in range(height - 1, -1, -1):
        text, out = binascii.hexlify(nodes[places[level]].tobytes()).decode(), []
        for i in range(len(places[level])):
            begin = i - i % ARITY
            out.append(((text[64 * begin:64 * i], text[64 * (i + 1):64 * (begin + ARITY)]), rests[i // ARITY]))
        rests = out
    return rests


def steps(path: tuple) -> list[tuple[str, str]]:
    out = []
    while path:
        step, path = path
        out.append(step)
    return out


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """Root that a leaf and the digests beside its path give."""
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


# ---------------------------------------------------------------- leaves and their order


def encoded(value: Column) -> Column:
    """A field as text: its bytes counted, or a sign for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(x) for x in fields]), 256))


def leaves(table: DataFrame, fields: list[str], group_col: str, id_col: str, claimed: dict[str, Column], claims: Column | None) -> DataFrame:
    """(group, id, leaf, claim): ``claim`` is the digest of the row as it is found now, where ``claims`` says that it is checked
    with the columns of ``claimed`` in place of its own; null where nothing has changed."""
    now = [claimed.get(x, F.col(f"`{x}`")) for x in fields]
    claim = F.when(claims, leaf_digest(now)) if claims is not None else F.lit(None).cast("binary")
    return table.select(
        F.col(f"`{group_col}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("id"),
        leaf_digest([F.col(f"`{x}`") for x in fields]).alias("leaf"), claim.alias("claim"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of each task in order with (task, group_no, rank): which group of the task and which row of it.

    The last row of a task is its record: first and last group, their rows in the task, groups and rows of the largest."""
    ordered = rows.withColumn("copy", F.monotonically_increasing_id())
    keys = [F.col(x).asc_nulls_first() for x in ("group", "id", "leaf", "copy")]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("copy")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, counted, first, last, largest = TaskContext.get().partitionId(), -1, 0, None, None, 0
        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, id_type = batch["group"], batch["id"].type
            codes = group.dictionary_encode(null_encoding="encode").indices.to_numpy()
            opens = np.concatenate([[number < 0 or group[0].as_py() != last], codes[1:] != codes[:-1]])
            no = number + np.cumsum(opens)
            begins = np.flatnonzero(opens)
            at = np.arange(batch.num_rows)
            starts = np.concatenate([[-counted], begins]) if not opens[0] else begins
            rank = at - starts[np.searchsorted(starts, at, side="right") - 1]
            ends = np.concatenate([begins[begins > 0] - 1, [batch.num_rows - 1]])
            if first is None:
                first = [group[0].as_py(), 0]
            if no[0] == 0:
                first[1] = int(rank[no == 0][-1]) + 1
            largest = max(largest, int(rank[ends].max()) + 1)
            number, counted, last = int(no[-1]), int(rank[-1]) + 1, group[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(no.astype(np.int64)), pa.array(rank.astype(np.int64)),
                 batch["id"], batch["leaf"], batch["claim"], pa.nulls(batch.num_rows, _RECORD)], _NUMBERED)
        if first is not None:
            record = pa.array([{"first": first[0], "first_rows": first[1], "last": last, "last_rows": counted, "groups": number + 1, "largest": largest}], _RECORD)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, id_type),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), record], _NUMBERED)

    return ordered.mapInArrow(run, f"task int, group_no long, rank long, id {kind}, leaf binary, claim binary, "
                              "record struct<first:string,first_rows:long,last:string,last_rows:long,groups:long,largest:long>")


_NUMBERED = ["task", "group_no", "rank", "id", "leaf", "claim", "record"]
_RECORD = pa.struct([("first", pa.string()), ("first_rows", pa.int64()), ("last", pa.string()), ("last_rows", pa.int64()),
                     ("groups", pa.int64()), ("largest", pa.int64())])


@dataclass
class Places:
    """Per task the number of its first group and that group's rows before it; number of groups, rows of the largest."""

    tasks: list[tuple[int, int, int]]
    groups: int
    largest: int


def carried(records: list[tuple[int, dict]]) -> Places:
    """``records`` has one short record for each task that had rows."""
    tasks, groups, largest, last, rows = [], 0, 0, None, 0
    for task, x in sorted(records, key=lambda r: r[0]):
        goes_on = groups > 0 and x["first"] == last
        base = rows if goes_on else 0
        lead = groups - 1 if goes_on else groups
        tasks.append((task, lead, base))
        groups = lead + x["groups"]
        rows = x["last_rows"] + (base if x["groups"] == 1 else 0)
        last = x["last"]
        largest = max(largest, x["largest"], base + x["first_rows"], rows)
    return Places(tasks, groups, largest)


# ---------------------------------------------------------------- blocks


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with equal keys, which stand side by side, as one batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[0][k][0].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield joined(held)
            held = []
        for begin, end in zip(bounds, bounds[1:]):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield joined(held)
                held = []
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def digest_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _DIGEST)


def block_rows(rows: DataFrame) -> DataFrame:
    """Blocks (group_id, block, leaves, height, nodes, ids, claims) of rows (group_id, place, leaf, id, claim).

    A first block that is not full is the whole tree and as high as it must be; any other one has the full height."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("block", F.expr(f"place div {BLOCK}")).repartition("group_id", "block").sortWithinPartitions("group_id", "block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in whole_runs(batches, ["group_id", "block"]):
            block, count = x["block"][0].as_py(), x.num_rows
            height = least_height(count) if block == 0 and count < BLOCK else BLOCK_HEIGHT
            nodes = built(digest_rows(x["leaf"]), height)
            whole = lambda column: pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), column)
            yield pa.RecordBatch.from_arrays(
                [x["group_id"].slice(0, 1), x["block"].slice(0, 1), pa.array([count], pa.int32()), pa.array([height], pa.int32()),
                 pa.array([nodes.tobytes()], pa.binary()), whole(x["id"]), whole(x["claim"])],
                ["group_id", "block", "leaves", "height", "nodes", "ids", "claims"])

    return dealt.mapInArrow(run, f"group_id long, block long, leaves int, height int, nodes binary, ids array<{kind}>, claims array<binary>")


def tree(rows: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stored blocks from the leaves up; the last table has one block per group."""
    levels = [stored(block_rows(rows), name)]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        levels.append(stored(block_rows(roots(levels[-1], "block")), name))
    return levels


def roots(blocks: DataFrame, place: str, group: Column | None = None) -> DataFrame:
    """The roots of blocks as leaves of the next ones; a root is the first node of its block."""
    return blocks.select((F.col("group_id") if group is None else group).alias("group_id"), F.col(place).alias("place"),
                         F.expr(f"substring(nodes, 1, {_DIGEST})").alias("leaf"), F.lit(None).cast("int").alias("id"),
                         F.lit(None).cast("binary").alias("claim"))


@dataclass
class Manifest:
    """Trees of the groups and the tree above them, each as block tables from the leaves up."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def build(table: DataFrame, fields: list[str], group_col: str, id_col: str, claimed: dict[str, Column] | None = None,
          claims: Column | None = None) -> Manifest:
    """Manifest of the table; see `leaves` for what is claimed."""
    found = stored(leaves(table, fields, group_col, id_col, claimed or {}, claims), "leaves")
    rows = stored(numbered(found), "ordered")
    records = rows.where("group_no = -1").select("task", "record").collect()  # one per task
    places = carried([(x["task"], x["record"].asDict()) for x in records])
    spark = table.sparkSession
    lead = spark.createDataFrame(places.tasks, "task int, lead long, base long")
    placed = rows.where("group_no >= 0").join(F.broadcast(lead), "task").select(  # lead: one record per task
        (F.col("lead") + F.col("group_no")).alias("group_id"),
        (F.col("rank") + F.when(F.col("group_no") == 0, F.col("base")).otherwise(0)).alias("place"), "leaf", "id", "claim")
    groups = tree(placed, places.largest, "manifest")
    top = tree(roots(groups[-1], "group_id", F.lit(0).cast("long")), places.groups, "manifest-top")
    one = top[-1].select(F.hex(F.substring("nodes", 1, _DIGEST))).first()
    return Manifest(groups, top, one and one[0].lower())


# ---------------------------------------------------------------- paths

_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_STEPS_SQL = "array<struct<left:string,right:string>>"


def nested(path: list[dict] | None) -> tuple:
    out: tuple = ()
    for step in reversed(path or []):
        out = ((step["left"], step["right"]), out)
    return out


def block_paths(row: dict) -> tuple[np.ndarray, list[tuple]]:
    """Digests of a block's leaves and their paths to the root of everything."""
    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, _DIGEST)
    places = level_addresses(row["leaves"], row["height"])[0]
    return nodes[places], paths(nodes, row["leaves"], row["height"], nested(row["above"]))


def handed_down(blocks: DataFrame, to_groups: bool) -> DataFrame:
    """(group_id, block, above, subroot) for the blocks whose roots are the leaves of these; ``to_groups`` leaves the tree above the groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                digests, found = block_paths(row)
                place = row["block"] * BLOCK + np.arange(len(found))
                group = place if to_groups else np.full(len(found), row["group_id"])
                subroots = [x.tobytes() for x in digests] if to_groups else [row["subroot"]] * len(found)
                for begin in range(0, len(found), 512):
                    part = slice(begin, begin + 512)
                    above = [[{"left": a, "right": b} for a, b in steps(x)] for x in found[part]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[part]), pa.array((place * 0 if to_groups else place)[part]), pa.array(above, _STEPS), pa.array(subroots[part], pa.binary())],
                        ["group_id", "block", "above", "subroot"])

    return blocks.select("group_id", "block", "leaves", "height", "nodes", "above", "subroot").mapInArrow(
        run, f"group_id long, block long, above {_STEPS_SQL}, subroot binary")


def leaf_blocks(manifest: Manifest) -> DataFrame:
    """The blocks of the documents with the path above each and the root of its group."""
    none = [F.lit(None).cast(_STEPS_SQL).alias("above"), F.lit(None).cast("binary").alias("subroot")]
    known = manifest.top[-1].select("*", *none)
    lower = [*manifest.top[-2::-1], *manifest.groups[::-1]] if len(manifest.top) > 1 else manifest.groups[::-1]
    for i, blocks in enumerate(lower):
        down = stored(handed_down(known, to_groups=i == len(manifest.top) - 1), "paths")
        known = blocks.join(down, ["group_id", "block"])
    return known


def proofs(manifest: Manifest, with_steps: bool = False) -> DataFrame:
    """(id, leaf, subroot, proof, claim, folded, steps) of every row: digests in hex; ``proof`` hashes the digests beside the path from
    the leaf to the root, ``folded`` is the root that the claim, or else the leaf, gives with them."""
    blocks = leaf_blocks(manifest)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def rows(block: dict) -> Iterator[tuple]:
        digests, found = block_paths(block)
        subroot = binascii.hexlify(block["subroot"]).decode()
        for id_, claim, digest, path in zip(block["ids"], block["claims"], digests, found, strict=True):
            leaf, path = binascii.hexlify(digest.tobytes()).decode(), steps(path)
            now = binascii.hexlify(claim).decode() if claim is not None else leaf
            proof = hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()
            yield id_, leaf, subroot, proof, now, folded(now, path), [{"left": a, "right": b} for a, b in path] if with_steps else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch["ids"].type.value_type
            for at in range(batch.num_rows):
                out = list(zip(*rows(batch.slice(at, 1).to_pylist()[0]), strict=True))
                kinds = [id_type, *[pa.string()] * 5, _STEPS]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                                                 ["id", "leaf", "subroot", "proof", "claim", "folded", "steps"])

    return blocks.select("leaves", "height", "nodes", "ids", "claims", "above", "subroot", "block").mapInArrow(
        run, f"id {kind}, leaf string, subroot string, proof string, claim string, folded string, steps {_STEPS_SQL}")


#: Fields of a document's leaf, in their order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def document_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Query op12: proofs of all documents, a third of them checked with a text whose capitals have been lowered."""
    docs = common.table(spark, folder, "documents")
    lowered = {"text": F.translate("text", _UPPER, _UPPER.lower())}
    made = build(docs, FIELDS, "lang", "doc_id", lowered, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    return proofs(made).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(made.root).alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(made.root)).alias("verified"))
