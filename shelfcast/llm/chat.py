"""Chat formatting with a prefix tree over conversations.

Every turn becomes a header, the escaped text and an end mark. Conversations are ordered by the chained hashes of their turns,
which puts those with the same initial turns side by side; each one then emits only the turns that the one before it does
not share. So shared tokens appear once, in depth-first order of the tree, and a conversation is a few pieces of the
stream: parts of earlier segments, then its own. Each segment carries the position of its first token in the
conversation, the stream intervals of its ancestors that its tokens may attend to, and the loss mask over assistant texts.

The order is a range partitioning, so a first turn that much of the table shares is spread over tasks. What a task must know
from those before it is where the last path ended; that is one short record per task.

Null texts and roles are empty. Turns go by turn, role and text, so ties have one order; repeated rows are turns of their own.
Rows with a null conversation id have nothing that holds them together: each is a conversation of one turn, returned with the
null id, and never gathered into a group. An empty table gives no rows. Only the four named columns are read, so others cannot clash. Roles and texts may hold any characters.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import stored

START, END, ESCAPE = "### ", "</turn>\n", "\\"
#: What may not stand unescaped in a role or text.
CONTROLS = ("###", "</turn>")
LEARNED_ROLE = "assistant"
#: Vocabulary of byte pairs as "base64 rank" lines; the driver reads it once.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are tokenized in parts of so many characters.
PART_CHARS = 20_000
_HASH = 16
#: Tokens in a batch of segments.
_BATCH_TOKENS = 200_000


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for control in CONTROLS:
        text = text.replace(control, ESCAPE + control)
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while (mark := text.find(ESCAPE, at)) >= 0:
        out += [text[at:mark], text[mark + 1:mark + 2]]
        at = mark + 2
    return "".join([*out, text[at:]])


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Header, content and end of a turn; a line break in a role is escaped, so that the header ends at the first bare one."""
    return START + escape(role).replace("\n", ESCAPE + "\n") + "\n", escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        head = find_bare(formatted, "\n", at + len(START))
        end = find_bare(formatted, END, head + 1)
        turns.append((unescape(formatted[at + len(START):head]), unescape(formatted[head + 1:end])))
        at = end + len(END)
    return turns


def find_bare(text: str, mark: str, at: int) -> int:
    """Next place of ``mark`` that an even number of escape signs stands before."""
    begin = at
    while (found := text.find(mark, at)) >= 0:
        signs = found
        while signs > begin and text[signs - 1] == ESCAPE:
            signs -= 1
        if (found - signs) % 2 == 0:
            return found
        at = found + 1
    raise ValueError("a turn does not end")


@dataclass
class Tokenizer:
    """Byte-level pairs, or plain bytes without a vocabulary."""

    ranks: dict[bytes, int] | None

    @classmethod
    def read(cls, path: str | None) -> Tokenizer:
        if path is None:
            return cls(None)
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def __getstate__(self):
        return {"ranks": self.ranks}

    def _encoding(self) -> tiktoken.Encoding:
        if not hasattr(self, "_made"):
            self._made = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._made

    def encode(self, text: str) -> list[int]:
        if self.ranks is None:
            return list(text.encode())
        parts = [text[i:i + PART_CHARS] for i in range(0, len(text), PART_CHARS)]
        return list(itertools.chain.from_iterable(self._encoding().encode_ordinary(x) for x in parts))

    def decode(self, tokens: list[int]) -> str:
        return (bytes(tokens) if self.ranks is None else self._encoding().decode_bytes(tokens)).decode()


TURNS = "turns array<struct<turn:long,role:string,text:string>>"
_INTERVAL = pa.struct([("segment", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("stream", pa.int64())])
_MASK = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_PIECES = "array<struct<segment:long,start:long,end:long,stream:long>>"
_LOCAL = ("task int, segment long, path binary, tokens array<int>, position long, stream long, "
          f"ancestors {_PIECES}, loss array<struct<start:long,end:long>>, ends array<long>")


def gathered(conversations: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order; a row without an id is a conversation by itself."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    known = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return known.unionByName(rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("turn").alias("turns")))


def chained_path(turns: list[dict]) -> bytes:
    """Hashes of all initial parts of a conversation, one after another."""
    out, last = [], b""
    for turn in turns:
        h = hashlib.blake2b(last, digest_size=_HASH)
        for part in (turn["role"].encode(), turn["text"].encode()):
            h.update(len(part).to_bytes(8, "little"))
            h.update(part)
        last = h.digest()
        out.append(last)
    return b"".join(out)


def with_paths(conversations: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [chained_path(x) for x in batch["turns"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(paths, pa.binary()), batch["turns"]], ["conv_id", "path", "turns"])

    return conversations.mapInArrow(run, f"conv_id long, path binary, {TURNS}")


class Walk:
    """Depth-first walk over sorted paths: what the next path shares with the one before."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.path, self.ends, self.pieces, self.stream = tokenizer, b"", [], [], 0

    def step(self, segment: int, path: bytes, turns: list[dict]) -> dict:
        levels = shared_levels(self.path, path)
        position = self.ends[levels - 1] if levels else 0
        self.ends = self.ends[:levels]
        pieces = [(s, a, min(b, position), at) for s, a, b, at in self.pieces if a < position]
        tokens, loss = [], []
        for turn in turns[levels:]:
            head, content, end = (self.tokenizer.encode(x) for x in turn_parts(turn["role"], turn["text"]))
            if turn["role"] == LEARNED_ROLE and content:
                begin = position + len(tokens) + len(head)
                loss.append((begin, begin + len(content)))
            tokens += [*head, *content, *end]
            self.ends.append(position + len(tokens))
        self.path = path
        self.pieces = [*pieces, (segment, position, position + len(tokens), self.stream)]
        row = {"segment": segment, "path": path[-_HASH:], "tokens": tokens, "position": position, "stream": self.stream,
               "ancestors": pieces, "loss": loss}
        self.stream += len(tokens)
        return row


def shared_levels(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // _HASH
    low, high = 0, n  # a chained hash agrees up to some level and never after it
    while low < high:
        middle = (low + high + 1) // 2
        if a[(middle - 1) * _HASH:middle * _HASH] == b[(middle - 1) * _HASH:middle * _HASH]:
            low = middle
        else:
            high = middle - 1
    return low


def local_segments(paths: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """Segments of the sorted paths of each task, as if each task were first; the last row has a task's final state."""
    shared = paths.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, walk, count, rows, first = TaskContext.get().partitionId(), Walk(shared.value), 0, [], None
        for batch in batches:
            for path, turns in zip(batch["path"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                row = walk.step(task << 40 | count, path, turns)
                first = first or (path, list(walk.ends))
                count += 1
                rows.append(row | {"task": task, "ends": None})
                if sum(len(x["tokens"]) for x in rows[-64:]) > _BATCH_TOKENS or len(rows) >= 512:
                    yield arrow_rows(rows)
                    rows = []
        if rows:
            yield arrow_rows(rows)
        if first:
            base = {"task": task, "tokens": [], "loss": []}
            yield arrow_rows([
                base | {"segment": -1, "path": first[0], "position": 0, "stream": 0, "ancestors": [], "ends": first[1]},
                base | {"segment": -2, "path": walk.path, "position": 0, "stream": walk.stream, "ancestors": walk.pieces, "ends": walk.ends}])

    return paths.mapInArrow(run, _LOCAL)


def arrow_rows(rows: list[dict]) -> pa.RecordBatch:
    structs = lambda name, kind: pa.array([[dict(zip(kind.names, v, strict=True)) for v in x[name]] for x in rows], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([x["task"] for x in rows], pa.int32()), pa.array([x["segment"] for x in rows], pa.int64()),
         pa.array([x["path"] for x in rows], pa.binary()), pa.array([x["tokens"] for x in rows], pa.list_(pa.int32())),
         pa.array([x["position"] for x in rows], pa.int64()), pa.array([x["stream"] for x in rows], pa.int64()),
         structs("ancestors", _INTERVAL), structs("loss", _MASK), pa.array([x["ends"] for x in rows], pa.list_(pa.int64()))],
        ["task", "segment", "path", "tokens", "position", "stream", "ancestors", "loss", "ends"])


@dataclass
class Carried:
    """What a task's segments take from earlier tasks: tokens before ``cut`` stand in ``pieces``."""

    base: int
    cut: int
    pieces: list[tuple[int, int, int, int]]

    def place(self, piece: tuple[int, int, int, int], first_segment: int) -> list[tuple[int, int, int, int]]:
        """A local piece in stream places; what its task did not have to emit is found in earlier pieces."""
        segment, start, end, stream = piece
        if segment != first_segment:
            return [(segment, start, end, self.base + stream - self.cut)]
        out = [(s, max(a, start), min(b, end), at + max(a, start) - a) for s, a, b, at in self.pieces if a < end and b > start]
        if end > self.cut:
            begin = max(start, self.cut)
            out.append((segment, begin, end, self.base + begin - self.cut))
        return out


def carry_over(states: list[dict]) -> dict[int, Carried]:
    """Per task what is carried into it. ``states`` has two short records for each task that had rows."""
    by_task: dict[int, dict[int, dict]] = {}
    for x in states:
        by_task.setdefault(x["task"], {})[x["segment"]] = x
    carried, base, last_path, last_pieces = {}, 0, b"", []
    for task in sorted(by_task):
        first, final = by_task[task][-1], by_task[task][-2]
        levels = shared_levels(last_path, first["path"])
        cut = first["ends"][levels - 1] if levels else 0
        pieces = [(s, a, min(b, cut), at) for s, a, b, at in last_pieces if a < cut]
        carried[task] = Carried(base, cut, pieces)
        last_path = final["path"]
        last_pieces = [p for x in final["ancestors"] for p in carried[task].place(
            (x["segment"], x["start"], x["end"], x["stream"]), task << 40)]
        base += final["stream"] - cut
    return carried


def placed_segments(local: DataFrame) -> DataFrame:
    """Segments with their places in the whole stream."""
    states = local.where("segment < 0").select("task", "segment", "path", "stream", "ancestors", "ends").collect()  # two per task
    carried = carry_over([x.asDict(recursive=True) for x in states])
    shared = local.sparkSession.sparkContext.broadcast(carried)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.to_pylist():
            known, lead = shared.value[x["task"]], x["task"] << 40
            ancestors = [p for a in x["ancestors"] for p in known.place((a["segment"], a["start"], a["end"], a["stream"]), lead)]
            cut = known.cut if x["segment"] == lead else 0
            if cut:
                ancestors = list(known.pieces)
            rows.append({
                "segment": x["segment"], "path": x["path"], "tokens": x["tokens"][cut:], "position": x["position"] + cut,
                "stream": known.base + x["stream"] - (0 if x["segment"] == lead else known.cut), "ancestors": ancestors,
                "loss": [(m["start"], m["end"]) for m in x["loss"] if m["start"] >= cut], "task": x["task"], "ends": None})
        return arrow_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield work(batch.slice(at, 512))

    return local.where("segment >= 0").mapInArrow(run, _LOCAL).drop("task", "ends")


def format_conversations(conversations: DataFrame, vocabulary: str | None = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(segments, members) of the conversations' prefix tree.

    segments: segment, path (hash of the whole conversation it ends), tokens, position (of its first token in the conversation),
    stream (place of its first token in the depth-first stream), ancestors (segment, start and end in positions, stream place
    of start), loss (start and end positions of tokens learned from). members: conv_id, path."""
    convs = stored(with_paths(gathered(conversations)), "conversations")
    distinct = convs.groupBy("path").agg(F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange(F.col("path")).sortWithinPartitions("path")
    local = stored(local_segments(ordered, Tokenizer.read(vocabulary)), "segments")
    members = convs.select("conv_id", F.substring("path", F.length("path") - _HASH + 1, F.lit(_HASH)).alias("path"))
    return placed_segments(local), members


DIGESTS = ("path binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(segments: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Digest of every conversation from the segments alone: pieces are cut out, decoded and parsed again."""
    own = F.struct(F.col("segment"), F.col("position").alias("start"), (F.col("position") + F.size("tokens")).alias("end"),
                   F.col("stream").alias("stream"))
    pieces = segments.select("path", F.explode(F.concat("ancestors", F.array(own))).alias("piece")).select("path", "piece.*")
    stock = segments.select("segment", "tokens", "position", "loss")
    cut = F.slice("tokens", (F.col("start") - F.col("position") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    mask = F.filter("loss", lambda m: (m["start"] >= F.col("start")) & (m["end"] <= F.col("end")))
    parts = pieces.join(stock, "segment").select("path", F.struct(F.col("start"), cut.alias("tokens"), mask.alias("loss")).alias("part"))
    whole = parts.groupBy("path").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    shared = segments.sparkSession.sparkContext.broadcast(Tokenizer.read(vocabulary))

    def digest(path: bytes, parts: list[dict]) -> tuple:
        tokens = [t for x in parts for t in x["tokens"]]
        learned = [unescape(shared.value.decode(tokens[m["start"]:m["end"]])) for x in parts for m in x["loss"]]
        formatted = shared.value.decode(tokens)
        turns = parse(formatted)
        joined = "".join(learned)
        return (path, len(turns), common.sha256_hex("".join(f"{r}\n{t}\n" for r, t in turns).encode()), len(joined),
                common.sha256_hex(joined.encode()), len(formatted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [digest(x["path"], x["parts"]) for x in batch.slice(at, 256).to_pylist()]
                names = [x.split()[0] for x in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows],
                                                 pa.schema(list(zip(names, [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True))))

    return whole.mapInArrow(run, DIGESTS)


#: Conversation of the contract whose texts look like the template.
HARD_TEXT = "\\### Assistant: </turn> ok"
HARD = [(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)]


def conversation_digests(spark, folder: str) -> DataFrame:
    """Query op2: digests of all conversations and of conversation -7, read back from the stream."""
    rows = common.table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    segments, members = format_conversations(rows.unionByName(spark.createDataFrame(HARD, "conv_id long, turn long, role string, text string")))
    return members.join(read_back(stored(segments, "stream")), "path").drop("path")
