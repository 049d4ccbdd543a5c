"""Prefix trie of conversations from vertical bitmaps.

A turn is known by a hash of its role and text, a node by the chained hash of its turns. Conversations are dealt by ranges of ids,
and a task takes them in shards of ``SHARD`` conversations. Per shard an index maps (position, turn) to the bitset of the
conversations that have the turn there. The trie of the shard is walked depth first: the bitset of a node meets the postings
of the next position, one for each child, taken at the lowest conversation that no child has claimed yet; its population is
the member count, its lowest bit the smallest id, and the bits of conversations that end here the end list of the shard. So a
node that much of the table shares is one row per shard, whatever the number of its members.

Rows of a node are then added up. Sums over subtrees go by doubling: a node knows its ancestors at distances 1, 2, 4, ..., and after k
rounds its sum covers the 2^k levels under it, so that there are as many rounds as the depth has binary digits, each a sum by ancestor
(combined before it is shuffled) and a join by node. A parent's least id reaches its children through one record per
(parent, part of the children), so a parent with very many children is dealt over many tasks. End lists are hashed as a stream in
the order of the shards; a hash over one ordered list cannot be split, but its task only holds one shard's list at a time.

Null roles and texts are empty. Turns go by turn number (null first), then by their hash, so repeated turns and ties have one
order; repeated rows are turns of their own. Rows with a null conversation id belong to no conversation and take no part. An
empty table gives no nodes, not even the root. A conversation is the unit of work: its hashes (24 bytes a turn) are held together,
its texts, of any length, are not. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import stored

#: Conversations of a shard: bits of a bitset.
SHARD = 2048
#: Turns at which a shard is closed early.
SHARD_TURNS = 1 << 17
#: Parts over which the children of a parent are dealt.
PARTS = 512
#: Rows handed on at a time.
_BATCH = 4096
_KEY = 16
ROOT = b"\0" * _KEY

TURNS = "turns array<struct<turn:long,key:binary,bytes:long>>"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, bytes): a turn by the hash of its role and text, with the UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"),
        F.octet_length(text).cast("long").alias("bytes"))


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, without their texts."""
    return turn_rows(conversations).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "key", "bytes"))).alias("turns"))


#: Conversations that may share a head stand together in families of so many ids; heads have fewer turns than ``HEADS``.
FAMILY, HEADS = 5, 9


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its family's first one in place of its own; see the query's contract.

    A head is asked for by at most the ids of its family, so the join has no large key."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    asked = convs.select("conv_id", "turns", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first_id"))
    firsts = convs.select(F.col("conv_id").alias("first_id"), F.slice("turns", 1, HEADS - 1).alias("lead")).where(f"first_id % {FAMILY} = 0")
    kept = F.coalesce(F.slice("lead", 1, F.col("head")), F.array().cast(TURNS.split(" ", 1)[1]))
    own = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    return asked.join(firsts, "first_id", "left").select("conv_id", F.concat(kept, own).alias("turns"))


# ---------------------------------------------------------------- shards


def shard_nodes(ids: list[int], keys: list[list[bytes]], sizes: list[list[int]]) -> Iterator[tuple]:
    """Nodes of the trie of some conversations, ``ids`` ascending: (node, parent, depth, least id, members, bytes of the last turn,
    ancestors at distances 1, 2, 4, ..., ids of those that end here)."""
    postings: dict[tuple[int, bytes], int] = {}
    ends: dict[int, int] = {}
    for i, turns in enumerate(keys):
        bit = 1 << i
        ends[len(turns)] = ends.get(len(turns), 0) | bit
        for at, key in enumerate(turns):
            postings[at, key] = postings.get((at, key), 0) | bit
    stack = [(ROOT, None, 0, (1 << len(ids)) - 1, 0)]
    path: list[bytes] = []
    while stack:
        node, parent, depth, members, size = stack.pop()
        del path[depth:]
        ancestors, step = [], 1
        while step <= depth:
            ancestors.append(path[depth - step])
            step *= 2
        path.append(node)
        ending = members & ends.get(depth, 0)
        yield node, parent, depth, ids[lowest(members)], members.bit_count(), size, ancestors, [ids[i] for i in bits(ending)]
        open_members = members ^ ending
        while open_members:
            i = lowest(open_members)
            key = keys[i][depth]
            child = members & postings[depth, key]
            open_members &= ~child
            stack.append((hashlib.blake2b(node + key, digest_size=_KEY).digest(), node, depth + 1, child, sizes[i][depth]))


def lowest(bitset: int) -> int:
    return (bitset & -bitset).bit_length() - 1


def bits(bitset: int) -> Iterator[int]:
    while bitset:
        yield lowest(bitset)
        bitset &= bitset - 1


_COLUMNS = ["node", "parent", "depth", "conv_id", "members", "bytes", "ancestors", "ends"]
_KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]


def shard_tries(convs: DataFrame) -> DataFrame:
    """The nodes of every shard of conversations (conv_id, turns); shards are ranges of ids in order."""
    ordered = convs.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("sizes")) \
        .repartitionByRange("conv_id").sortWithinPartitions("conv_id")

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == _BATCH:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes, held = [], [], [], 0
        for batch in batches:
            for conv_id, turn_keys, turn_sizes in zip(*(batch[c].to_pylist() for c in ("conv_id", "keys", "sizes")), strict=True):
                ids.append(conv_id)
                keys.append(turn_keys)
                sizes.append(turn_sizes)
                held += len(turn_keys)
                if len(ids) == SHARD or held >= SHARD_TURNS:
                    yield from batches_of(shard_nodes(ids, keys, sizes))
                    ids, keys, sizes, held = [], [], [], 0
        if ids:
            yield from batches_of(shard_nodes(ids, keys, sizes))

    return ordered.mapInArrow(run, "node binary, parent binary, depth long, conv_id long, members long, bytes long, "
                              "ancestors array<binary>, ends array<long>")


# ---------------------------------------------------------------- whole trie


def end_hashes(shards: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the ids that end at a node, ascending and joined by commas; nodes without ends are left out."""
    lists = shards.where("size(ends) > 0").select("node", "ends").repartition("node").sortWithinPartitions("node", F.col("ends")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch["node"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                text = ",".join(map(str, ids)).encode()
                if key == node:
                    hashed.update(b"," + text)
                    continue
                if hashed is not None:
                    out.append((node, hashed.hexdigest()))
                node, hashed = key, hashlib.sha256(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])
        if hashed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([hashed.hexdigest()])], ["node", "ends_sha256"])

    return lists.mapInArrow(run, "node binary, ends_sha256 string")


def with_children(nodes: DataFrame) -> DataFrame:
    """The nodes with n_children and parent_conv_id. A parent meets its children once per part of them, not once per child."""
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    parts = dealt.where("parent IS NOT NULL").groupBy("parent", "part").agg(F.count(F.lit(1)).alias("children"))
    known = parts.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    counts = parts.groupBy(F.col("parent").alias("node")).agg(F.sum("children").alias("n_children"))
    return (dealt.join(known.drop("children"), ["parent", "part"], "left").drop("part").join(counts, "node", "left")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))


def subtree_sums(nodes: DataFrame, depth: int, columns: list[str]) -> DataFrame:
    """Sums of ``columns`` over each node's subtree, its own included; ``depth`` is that of the deepest node."""
    sums = nodes.select("node", "ancestors", *columns)
    for k in range(depth.bit_length()):
        lower = sums.where(F.size("ancestors") > k).groupBy(F.col("ancestors")[k].alias("node")).agg(
            *[F.sum(c).alias(f"under_{c}") for c in columns])
        added = [(F.col(c) + F.coalesce(f"under_{c}", F.lit(0).cast("long"))).alias(c) for c in columns]
        sums = stored(sums.join(lower, "node", "left").select("node", "ancestors", *added), "subtrees")
    return sums.drop("ancestors")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turns): node, parent, depth, conv_id (least member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    shards = stored(shard_tries(convs), "shards")
    merged = shards.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("members").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("ancestors").alias("ancestors"))
    nodes = stored(with_children(stored(merged, "nodes")), "family")
    own = nodes.select("node", "ancestors", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, deepest, ["n_leaves", "saved_tokens"])
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.drop("ancestors", "bytes").join(sums, "node").join(end_hashes(shards), "node", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Query op13: the trie of all rebuilt conversations."""
    convs = rebuilt(stored(gathered(common.table(spark, folder, "conversations")), "conversations"))
    return prefix_trie(convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
