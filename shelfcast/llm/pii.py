"""Personal data: base patterns plus offset-preserving deobfuscation.

A text passes through transducers that rewrite look-alike characters, at/dot disguises and spelled digits. Each
keeps, for every character of its output, the piece of source it came from. The same detectors then run
on the normalised text and their spans are mapped back to the source.

Null text is empty and has no spans; repeated rows are handled like any other row; an empty table gives no rows.
Spans count code points of the source, end exclusive, ordered by start, kind and end. Texts are read whole, in time
in proportion to their length. Not read as an address: a spoken at before a plain host ("look at example.com").
Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.endings import ENDINGS

# Fixed values of the contract: the base patterns.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
KINDS = ["email", "ip", "card", "phone"]

# Look-alikes that Unicode's compatibility mapping does not cover: Cyrillic, then Greek.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТХаеорсухіјѕԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ" "‐‑‒–—−﹣",
    "ABEKMHOPCTXaeopcyxijsdqw" "ABEZHIKMNOPTYXovp" "-------", strict=True))
REMOVED = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
#: Digits, spelled or written, that a run needs before its words are read as digits.
LEAST_SPELLED = 7

# A sign in brackets, or between hyphens that stand alone; blanks before it are taken in afterwards.
_AT_DOT = re.compile(r"(?:[\[({<][ \t]*(at|@|dot|\.|punkt|punto|point|arroba)[ \t]*[\])}>]|(?<=[ \t])-(at|dot)-(?=[ \t]))[ \t]*", re.I)
_ENTITY = re.compile(r"&(?:#0*(64|46)|#x0*(40|2e)|(commat|period));", re.I)
# Spoken at sign and dot, or a written one in either place; which of them make an address is settled by ``address_end``.
_DOT = r"(?:[ \t]+dot[ \t]+|\.)"
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:[ \t]+dot[ \t]+[A-Za-z0-9_%+-]+){0,4}(?P<at>@|[ \t]+(?:at|@)[ \t]+)"
    rf"(?P<host>[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)", re.I)
_SPOKEN_HOST = re.compile(rf"({_DOT})([A-Za-z0-9-]+)", re.I)
_SPOKEN_IP = re.compile(rf"(?<![A-Za-z0-9.])[0-9]+(?:{_DOT}[0-9]+){{3}}(?![A-Za-z0-9])", re.I)
_SPOKEN_SIGN = re.compile(r"[ \t]+(at|@|dot)[ \t]+", re.I)
#: Endings that are read after any host; others not where the host is one of ``_NOT_HOSTS`` ("look at this dot here").
_USUAL_ENDINGS = frozenset(
    "com org net edu gov mil int info biz io dev app ai me tv co uk us eu de fr es it nl ch at be pl pt se no dk fi cz "
    "ru ua jp cn in br mx ar ca au nz za test example invalid local".split())
_NOT_HOSTS = frozenset("the this that these those a an each every my your his her its our their some any which what no one".split())
# A label up to its first hyphen, unless it is an encoded one.
_ENDING = re.compile(r"xn--[A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z0-9]+", re.I)
_NUMBER_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?:plus|\+)[ \t\r\n(]{{0,4}})?(?:(?:{_NUMBER_WORD})|[0-9])(?:[ \t\r\n,.()\-]{{0,4}}(?:(?:{_NUMBER_WORD})(?![^\W_])|[0-9]))"
    rf"{{{LEAST_SPELLED - 1},}}(?![^\W_])", re.I)
_SPELLED_TERM = re.compile(rf"plus|\+|{_NUMBER_WORD}|[0-9]", re.I)

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


@cache
def look_alikes() -> dict[int, str]:
    """Characters that read as one ASCII character, by Unicode's mapping or the list above."""
    table = {code: folded for code in (*range(0xA0, 0xD800), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800))
             if len(folded := unicodedata.normalize("NFKC", chr(code))) == 1 and folded.isascii()}
    for code in (0x660, 0x6F0):  # Arabic digits are decimal, but not compatible with ASCII
        table |= {code + d: str(d) for d in range(10)}
    return table | {ord(k): v for k, v in LOOK_ALIKES.items()} | {ord(x): "" for x in REMOVED}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: a match holds one @, so each @ is looked at from both sides."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    return found


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans of one text."""
    found = [("email", *x) for x in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                  if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
                  if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


class Tape:
    """A rewritten text that knows the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Put each new string in place of its span; all its characters share that span's source."""
        if not changes:
            return
        out, start, end, last = [], [], [], 0
        for a, b, new in changes:
            out += [self.text[last:a], new]
            start += self.start[last:a]
            end += self.end[last:a]
            start += [self.start[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            last = b
        out.append(self.text[last:])
        start += self.start[last:]
        end += self.end[last:]
        self.text, self.start, self.end = "".join(out), start, end


@cache
def _look_alike_class() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, map(chr, sorted(look_alikes())))) + "]")


def fold_look_alikes(tape: Tape) -> None:
    table = look_alikes()
    tape.rewrite([(m.start(), m.end(), table[ord(m[0])]) for m in _look_alike_class().finditer(tape.text)])


def fold_entities(tape: Tape) -> None:
    """At signs and dots written as character references."""
    tape.rewrite([(m.start(), m.end(), "@" if (m[1] or m[2] or m[3]).lower() in ("64", "40", "commat") else ".") for m in _ENTITY.finditer(tape.text)])


def address_end(tape: Tape, m: re.Match) -> int:
    """Where the spoken address of a match ends, or 0 if it is ordinary text.

    An at sign that is written or in brackets is certain, and so is a dot in brackets: the host may then end in any label of
    two or more letters. Otherwise one dot is spoken and the ending is one that exists."""
    certain = m["at"] == "@"
    spoken = m["at"].strip() == "@" != m["at"] or bool(certain and _SPOKEN_SIGN.search(m[0], 0, m.start("at") - m.start()))
    known = likely = 0
    first = _ENDING.match(m["host"])
    for part in _SPOKEN_HOST.finditer(m["host"]):
        label, at = _ENDING.match(part[2]), m.start("host") + part.start()
        if not label:
            break
        if part[1] == ".":  # one that was in brackets stands for more than one character
            folded = tape.end[at] - tape.start[at] > 1
            certain |= folded
            spoken |= folded
        else:
            spoken = True
        ending, end = label[0].lower(), m.start("host") + part.start(2) + label.end()
        if not spoken or len(ending) < 2:
            continue
        if ending in _USUAL_ENDINGS or ending in ENDINGS and (certain or not first or first[0].lower() not in _NOT_HOSTS):
            known = end
        elif certain and (ending.isalpha() or ending.startswith("xn--")):
            likely = end
    return known or likely


def fold_at_dot(tape: Tape) -> None:
    """Bracketed at and dot anywhere; bare words only in a whole address, with signs of either kind."""
    changes, last = [], 0
    for m in _AT_DOT.finditer(tape.text):
        start = m.start()
        while start > last and tape.text[start - 1] in " \t":
            start -= 1
        changes.append((start, m.end(), "@" if (m[1] or m[2]).lower() in ("at", "@", "arroba") else "."))
        last = m.end()
    tape.rewrite(changes)
    changes, last = [], 0
    while m := _SPOKEN.search(tape.text, last):
        last = address_end(tape, m)
        if last:
            changes += [(s.start(), s.end(), "." if s[1].lower() == "dot" else "@") for s in _SPOKEN_SIGN.finditer(tape.text, m.start(), last)]
        else:  # an address may begin within it
            last = m.end("at")
    tape.rewrite(changes)
    tape.rewrite([(s.start(), s.end(), ".") for m in _SPOKEN_IP.finditer(tape.text)
                  for s in _SPOKEN_SIGN.finditer(tape.text, m.start(), m.end())])


def fold_spelled_digits(tape: Tape) -> None:
    """Digit words of a long run become digits, without what stood between them."""
    changes = []
    for m in _SPELLED.finditer(tape.text):
        signs = list(_SPELLED_TERM.finditer(m[0]))
        if not any(s[0][0].isalpha() and s[0].lower() != "plus" for s in signs):
            continue
        last = 0
        for s in signs:
            if s.start() > last:
                changes.append((m.start() + last, m.start() + s.start(), ""))
            word = s[0].lower()
            changes.append((m.start() + s.start(), m.start() + s.end(),
                            "+" if word in ("plus", "+") else DIGIT_WORDS.get(word, word)))
            last = s.end()
    tape.rewrite(changes)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans found only after normalising; an unchanged text has none."""
    tape = Tape(text)
    low = text.encode(errors="replace").lower()
    if low.translate(None, _PLAIN_BYTES):
        fold_look_alikes(tape)
        low = tape.text.encode(errors="replace").lower()
    if b"&#" in low or b"&commat" in low or b"&period" in low:
        fold_entities(tape)
    if b"dot" in low or b" @" in low or b"\t@" in low or any(sign in low for sign in (b"[", b"(", b"{", b"<", b"-at-")):
        fold_at_dot(tape)
    words = low.translate(_SPACED).split()
    if _SPELLED_RUN in bytes(map(_SPELLED_SIGNS.__contains__, words)):
        fold_spelled_digits(tape)
    if tape.text == text:
        return []
    found = [(kind, tape.start[a], tape.end[b - 1]) for kind, a, b in detect(tape.text)]
    seen = common.Stretches([x[1:] for x in found])
    if isinstance(tape.start, list):  # digits spelled without a plus sign
        for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", tape.text):
            a, b = tape.start[m.start()], tape.end[m.end() - 1]
            # not written in digits, and not one word over and over
            if len(set(m[0])) > 2 and not _DIGITS_ONLY.match(text[a:b]) and not seen.touched(a, b):
                found.append(("phone", a, b))
    return found


# Words that can stand in a spelled number, and a run of them below which no long run can be: of seven signs, any
# that are glued to others ("555") count as one word here.
_SPELLED_SIGNS = frozenset(x.encode() for x in [*DIGIT_WORDS, *map(str, range(1000))])
_SPELLED_RUN = b"\x01" * 3
_SPACED = bytes.maketrans(b",.-()\t", b"      ")
# No look-alike is ASCII or has the UTF-8 lead byte 0xC3 (accented Latin letters).
_PLAIN_BYTES = bytes([*range(0xC0), 0xC3])
_DIGITS_ONLY = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]*\Z")


def scan_text(text: str | None) -> list[tuple]:
    """Base spans, then disguised ones that touch no base span or have those they touch inside: a look-alike within
    an address leaves its rest a base span, and the whole address is added."""
    if not text:
        return []
    base = detect(text)
    known = common.Stretches([x[1:] for x in base])
    added = {x for x in disguised(text) if all(x[1] <= a and b <= x[2] and (a, b) != x[1:] for a, b in known.touched(x[1], x[2]))}
    spans = [(*x, True) for x in base] + [(*x, False) for x in added]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its personal-data spans."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan_text(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), common.spans_array(found, SPANS)], ["doc_id", "spans"])

    return common.map_batches(common.documents(docs, id_col, text_col), work, SCHEMA, "text")


def redact_text(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by its kind in brackets."""
    if not text:
        return text
    out, last = [], 0
    for kind, start, end, _ in scan_text(text):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; all rows and columns stay.

    ``length_col`` names a column that is set to the new text's number of characters."""
    places = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact_text(x) for x in batch.column(places[0]).to_pylist()]
        columns = list(batch.columns)
        columns[places[0]] = pa.array(texts, batch.schema.field(places[0]).type)
        if places[1] is not None:
            old = columns[places[1]].to_pylist()
            columns[places[1]] = pa.array([n if t is None else len(t) for t, n in zip(texts, old, strict=True)],
                                          batch.schema.field(places[1]).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return common.map_batches(docs, work, docs.schema, text_col)


def personal_data_digests(spark, folder: str) -> DataFrame:
    """Query op7: counts and digests of the spans of every document."""
    spans = F.col("spans")
    return scan_personal_data(common.table(spark, folder, "documents")).select(
        "doc_id", *(common.base_count(spans, kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(common.span_text(spans, lambda s: s["base"]), 256).alias("base_sha256"),
        common.span_text(spans).alias("spans"))
