"""Vectorised words and shingle hashes of a column of texts.

One batch of texts is one byte array. Words are found with table look-ups over its UTF-8 bytes, so
that no Python object exists per word. Every separator used here is a single ASCII byte, and all bytes of
other characters are at least 0x80, so splitting bytes and splitting code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
#: Words of more bytes are hashed one at a time.
LONG_WORD = 64

_SPACE = [0x20, *range(0x09, 0x0E)]
_CODES = np.arange(256)
#: True for bytes of words: everything but the space and 0x09-0x0D.
NON_SPACE = ~np.isin(_CODES, _SPACE)
#: True for bytes of words: digits, a-z and every byte of a non-ASCII character.
LETTERS_DIGITS = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
# Odd multipliers of the splitmix64 and xxhash finalisers, and one pair per independent hash.
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(value: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    value = value ^ (value >> np.uint64(30))
    value = value * _MIX
    value = value ^ (value >> np.uint64(27))
    value = value * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. ``first[i]`` is the index of the first word of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; two seeds together make 128 bits."""
        length = self.end - self.start
        code = np.full(len(length), _SEEDS[seed], dtype=np.uint64) ^ length.astype(np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        chunks = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        rows, offset = np.flatnonzero(length <= LONG_WORD), 0
        while len(rows):
            left = np.minimum(length[rows] - offset, 8)
            code[rows] = mix((code[rows] ^ (chunks[self.start[rows] + offset] & _MASKS[left])) * _SEEDS[seed])
            offset += 8
            rows = rows[length[rows] > offset]
        for row in np.flatnonzero(length > LONG_WORD):
            code[row] = xxhash.xxh3_64_intdigest(self.data[self.start[row]:self.end[row]].tobytes(), seed=seed)
        return code

    def word(self, row: int) -> bytes:
        return self.data[self.start[row]:self.end[row]].tobytes()


def shingles(codes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive codes; the caller keeps those inside one text."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _SEEDS[seed]
        out += codes[k:k + n]
    return mix(out)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """For each start among the words: does a shingle of ``size`` words end in the same text?"""
    n = max(int(first[-1]) - size + 1, 0)
    if not n:
        return np.empty(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + size <= ends[:n]


def split_words(texts: pa.Array, is_word: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """Words of each text; a null has none."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inner = is_word[data]
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1]
    closes[:-1] &= ~inner[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inner[edges]
    closes[edges - 1] = inner[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), bounds)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text each, so that a task's memory stays bounded."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    _, bounds = text_bytes(texts)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
