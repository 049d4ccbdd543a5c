"""Secret scan: base patterns plus assignment-aware lexing.

The lexer reads ``name = literal``, ``name: literal``, ``name => literal`` and sums of literals and names. A name
bound to a literal is a constant, so ``x = "..."`` followed by ``password = x`` marks the literal of ``x``.
A literal is scored by the sensitive words in its target name and by how evenly its characters are used; each has a bound
of its own, so every listed word can mark a literal. Names of less weight also stand for much that is no secret: their
literals need signs that words and paths do not have.

A text is lexed once: bare literals are runs whose ends are looked up, and a constant refers to those it was made of instead of
copying them, so time stays in proportion to the text however operators and constants are chained. A literal or a
sum of literals is scored by its first ``VALUE_CHARS`` characters; its spans are whole.

Null text is empty and has no spans; repeated rows are scanned like any other row; an empty table gives no rows.
Spans count code points, end exclusive, and are ordered by start, kind and end. Only the id and text columns are
read. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

# Fixed values of the contract: the base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ["assign", "access", "hex", "literal", "constant"]

KEYWORDS = ("passw", "secret", "token", "api")
#: Weight of a sensitive word in a target name.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.6, "bearer": 0.8,
    "signature": 0.5, "salt": 0.5, "key": 0.5,
}
#: Least evenness and length of an added literal, and the weight from which any literal in quotes counts.
LEAST_EVENNESS, LEAST_LENGTH, STRONG_WEIGHT = 0.55, 8, 0.8
#: Below ``STRONG_WEIGHT``: least weight at which any sign that is no letter or digit tells, and least length of digits alone.
MIDDLE_WEIGHT, DIGITS_LENGTH = 0.6, 16

#: Longest name that is looked up as a constant.
NAME_CHARS = 128
#: Characters of a value that its score is taken from.
VALUE_CHARS = 512

_OPERATOR = re.compile(r"[:=]+>?")
_NAME = re.compile(r"""([A-Za-z_][A-Za-z0-9_.\-]{0,127})["'\]]{0,2}[ \t]*\Z""")
_TERM = re.compile(
    r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|(?=([A-Za-z0-9+/_.=$@!#%^&*~?-])))""")
_BARE = re.compile(r"[A-Za-z0-9+/_.=$@!#%^&*~?-]+")
_BLANKS = re.compile(r"[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_QUOTES = frozenset("\"'`")
_KEY_SIGN = re.compile(r"[+=$@!#%^&*~?]")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("name", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]))
SCHEMA = ("doc_id long, spans array<struct<kind:string,start:int,end:int,name:string,score:double,base:boolean>>")


def base_spans(text: str) -> list[tuple]:
    """Contract spans: leftmost, not overlapping within a kind, failing matches dropped."""
    found = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(word in low for word in KEYWORDS):
            found += [("assign", m.start(), m.end(), m[1], 1.0, True)
                      for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None, 1.0, True)
                  for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [("hex", m.start(), m.end(), None, 1.0, True) for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """Largest weight of a word, or of two joined words, in the last part of a name."""
    words = [x.lower() for x in _PARTS.findall(name)]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((NAME_WEIGHTS.get(x, 0.0) for x in words), default=0.0)


def evenness(literal: str) -> float:
    """Entropy of the characters as a share of what this length could have."""
    n = len(literal)
    if n < 2:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return entropy / math.log2(min(n, 64))


def tells(value: str, weight: float, quoted: bool) -> bool:
    """Whether a literal under a name of this weight reads as a secret and not as a word, a name or a path."""
    if weight >= MIDDLE_WEIGHT and (any(c.isdigit() for c in value) or not value.isalnum()):
        return True
    if weight >= STRONG_WEIGHT:  # words only: as long as the base pattern wants them, unless in quotes
        return quoted or len(value) >= ASSIGN_LENGTH
    if any(c.isdigit() for c in value):
        return any(c.isalpha() for c in value) or len(value) >= DIGITS_LENGTH
    return not any(c.isspace() for c in value) and bool(_KEY_SIGN.search(value))


class Lexer:
    """Terms of a text; the runs of bare literals are found once."""

    def __init__(self, text: str):
        self.text, runs = text, [(m.start(), m.end()) for m in _BARE.finditer(text)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]

    def terms(self, at: int) -> Iterator[tuple[str | None, int, int]]:
        """Literals and names of ``a + "b" + c`` from ``at`` on: (name or None for a literal, start, end)."""
        text, count = self.text, 0
        while m := _TERM.match(text, at):
            kind = m.lastindex
            start = m.start(kind)
            end = self.ends[bisect_right(self.starts, start) - 1] if kind == 4 else m.end(kind)
            after = _BLANKS.match(text, end if kind == 4 else m.end()).end()
            adds = text[after:after + 1] == "+"
            name = None
            if kind == 4 and end - start <= NAME_CHARS and _IDENTIFIER.match(text, start, end):
                name = text[start:end]
            yield name, start, end
            count += 1
            if not adds:
                return
            at = after + 1


@dataclass(eq=False)
class Constant:
    """What a name stands for: literals of its own and other constants, in order."""

    parts: list[tuple[int, int] | Constant]
    size: int
    value: str | None = None
    told: set[str] = field(default_factory=set)

    def head(self, text: str) -> str:
        """The first characters of the value, joined once."""
        if self.value is None:
            out, left, stack = [], VALUE_CHARS, [self]
            while stack and left > 0:
                x = stack.pop()
                if isinstance(x, Constant):
                    stack += reversed(x.parts)
                else:
                    out.append(text[x[0]:min(x[1], x[0] + left)])
                    left -= x[1] - x[0]
            self.value = "".join(out)
        return self.value

    def literals(self, kind: str) -> Iterator[tuple[int, int]]:
        """The literals below that have not been told as this kind."""
        stack = [self]
        while stack:
            x = stack.pop()
            if not isinstance(x, Constant):
                yield x
            elif kind not in x.told:
                x.told.add(kind)
                stack += reversed(x.parts)

    def first(self) -> tuple[int, int]:
        x = self
        while isinstance(x, Constant):
            x = x.parts[0]
        return x


def assigned_spans(text: str) -> list[tuple]:
    """Literals assigned to sensitive names, directly or through constants."""
    constants: dict[str, Constant] = {}
    found, lexer = [], Lexer(text)
    for operator in _OPERATOR.finditer(text):
        name = _NAME.search(text, max(0, operator.start() - 140), operator.start())
        if not name:
            continue
        parts, through, quoted, any_term = [], False, False, False
        for word, start, end in lexer.terms(operator.end()):
            any_term = True
            known = constants.get(word) if word else None
            if known is not None:
                through = True
                if known.size:
                    parts.append(known)
            else:  # an unknown name is a bare literal, as in configuration files
                quoted |= text[start - 1:start] in _QUOTES
                if end > start:
                    parts.append((start, end))
        if not any_term:
            continue
        if len(parts) == 1 and isinstance(parts[0], Constant):
            made = parts[0]
        else:
            made = Constant(parts, sum(x.size if isinstance(x, Constant) else x[1] - x[0] for x in parts))
        constants[name[1]] = made
        weight = name_weight(name[1])
        if not weight or made.size < LEAST_LENGTH:
            continue
        value = made.head(text)
        quoted |= any(text[x.first()[0] - 1:x.first()[0]] in _QUOTES for x in parts if isinstance(x, Constant))
        even = evenness(value)
        if even >= LEAST_EVENNESS and tells(value, weight, quoted):
            kind = "constant" if through else "literal"
            found += [(kind, start, end, name[1], round(weight * even, 6), False) for start, end in made.literals(kind)]
    return found


def scan_text(text: str | None) -> list[tuple]:
    """All spans of a text; an added span that lies inside a base span is left out."""
    if not text:
        return []
    base = base_spans(text)
    added = assigned_spans(text) if "=" in text or ":" in text else []
    covers = common.Stretches([x[1:3] for x in base])
    kept = {x[:3]: x for x in added if not covers.hold(x[1], x[2])}
    return sorted([*base, *kept.values()], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its secret spans."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan_text(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), common.spans_array(found, SPANS)], ["doc_id", "spans"])

    return common.map_batches(common.documents(docs, id_col, text_col), work, SCHEMA, "text")


def secret_digests(spark, folder: str) -> DataFrame:
    """Query op4: counts and digests of the spans of every document."""
    spans = F.col("spans")
    return scan_secrets(common.table(spark, folder, "documents")).select(
        "doc_id", *(common.base_count(spans, kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(common.span_text(spans, lambda s: s["base"]), 256).alias("base_sha256"),
        common.span_text(spans).alias("spans"))
