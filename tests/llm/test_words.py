import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfcast.llm import packed
from shelfcast.llm.words import LETTERS_DIGITS, NON_SPACE, inside, pieces, shingles, split_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabZ09.-_é中", max_size=40)), max_size=8)
PATTERNS = [(NON_SPACE, r"[^\x20\x09-\x0D]+"), (LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_equal_the_pattern(texts):
    for table, pattern in PATTERNS:
        words = split_words(pa.array(texts, pa.string()), table, lower=True)
        expected = [[w.encode() for w in re.findall(pattern, lowered(t))] for t in texts]
        assert words.counts().tolist() == [len(x) for x in expected]
        assert [words.word(i) for i in range(len(words.start))] == [w for x in expected for w in x]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_equal_shingles_have_equal_hashes(texts, size):
    words = split_words(pa.array(texts, pa.string()))
    codes, allowed = shingles(words.hashes(), size), inside(words.first, size)
    seen = {}
    for text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(found) - size + 1):
            seen.setdefault(tuple(found[i:i + size]), len(seen))
    expected = [seen[tuple(x[i:i + size])] for t in texts for x in [re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i in range(len(x) - size + 1)]
    named = {}
    assert [named.setdefault(int(c), len(named)) for c in codes[allowed]] == expected


def test_long_words_and_pieces():
    texts = pa.array(["a" * 100 + " " + "a" * 99, "b" * 1000, None, ""] * 3)
    words = split_words(texts)
    assert words.counts().tolist() == [2, 1, 0, 0] * 3 and len(set(words.hashes().tolist())) == 3
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert sum(p.num_rows for p in pieces(batch, "text", 250)) == 12 and len(list(pieces(batch, "text", 250))) > 3
    assert list(pieces(batch.slice(0, 0), "text")) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-2**62, 2**62), min_size=1, max_size=50))
def test_packed_ids_come_back(ids):
    ids = np.sort(np.array(ids, np.int64))
    assert packed.unpack_ids(packed.pack_ids(ids)).tolist() == ids.tolist()
    codes = (ids.view(np.uint64) & np.uint64((1 << 48) - 1))
    assert packed.lengthened(np.ascontiguousarray(packed.short(codes)).ravel()).tolist() == codes.tolist()


def test_groups_agree_with_spark(spark):
    ids = [-5, 0, 1, 7, 2**40 + 3, -2**61, None]
    got = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").withColumn("g", packed.group_column("doc_id", "text", 13)).collect()
    known = [r["g"] for r in got if r["doc_id"] is not None]
    assert known == packed.group_of(np.array(ids[:-1], np.int64), 13).tolist()
    assert 0 <= got[-1]["g"] < 13
