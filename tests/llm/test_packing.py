"""Concatenate and cut against whole texts encoded by the other library."""
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import frame, prose  # noqa: F401
from tokenizers import Tokenizer

from shelfcast.llm import packing

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.fixture(scope="module")
def vocabulary():
    return packing.Vocabulary.read(packing.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet=" \n\tab'sß1é!<|endoftext|>　\x85", max_size=60))
def test_ids_are_those_of_the_vocabulary(plain, vocabulary, text):
    assert vocabulary.encode(text).tolist() == plain(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=" \n ab'é1!　", max_size=80), size=st.integers(1, 12))
def test_parts_are_encoded_as_the_whole(vocabulary, text, size):
    parts = list(packing.text_parts(text, size))
    assert "".join(parts) == text
    assert [i for x in parts for i in vocabulary.encode(x).tolist()] == vocabulary.encode(text).tolist()


TEXTS = [None, "", " ", "<|endoftext|>", "a " * 5000, "x" * 3000, "\n" * 3000, "naïve ça €", prose(1, 900), prose(1, 900)]


@pytest.mark.parametrize("length", [4, 64, 2048])
def test_pieces_tile_documents_and_sequences(frame, plain, length, monkeypatch):
    monkeypatch.setattr(packing, "ROW_TOKENS", 1000)  # also several rows of one document
    table = [(i, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[4]), (None, "no id"), (None, None)]
    got = packing.pack(frame(table).repartition(3), length=length).collect()
    want = sorted((i if i is not None else -1, plain(x)) for i, x in table)
    total = sum(len(x) for _, x in want)
    by_sequence = {}
    for x in got:
        assert len(x["ids"]) == 4 * x["length"] > 0 and x["offset"] + x["length"] <= length
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    for k, parts in by_sequence.items():
        at = 0
        for x in sorted(parts, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at == (length if k < (total - 1) // length else total - length * k)
    assert sorted(by_sequence) == list(range((total - 1) // length + 1))
    stream = [x for k in sorted(by_sequence) for x in sorted(by_sequence[k], key=lambda x: x["offset"])]
    docs, ids, expected = [], [], 0
    for x in stream:
        assert x["start"] == expected
        ids += np.frombuffer(x["ids"], "<u4").tolist()
        expected = x["start"] + x["length"]
        if expected == x["doc_tokens"]:
            docs.append((x["doc_id"] if x["doc_id"] is not None else -1, ids))
            ids, expected = [], 0
    assert expected == 0 and sorted(docs) == want


def test_sequences_hold_the_row_of_ids(frame, plain):
    table = [(i, prose(i, 300)) for i in range(20)]
    pieces = packing.pack(frame(table).coalesce(1), length=256)
    rows = packing.sequences(pieces, 256).orderBy("sequence_id").collect()
    assert np.frombuffer(b"".join(x["ids"] for x in rows), "<u4").tolist() == [i for _, x in table for i in plain(x)]
    for x in rows:
        n = len(x["ids"]) // 4
        assert sum(b["length"] for b in x["boundaries"]) == n and x["padding"] == (0 if n & (n - 1) == 0 else 256 - n)


def test_empty_table(frame):
    assert packing.pack(frame([])).collect() == []
    assert packing.sequences(packing.pack(frame([]))).collect() == []


def test_query_packs_every_document(spark, folder, plain):
    got = {}
    for x in packing.packed_pieces(spark, folder).collect():
        got.setdefault(x["doc_id"], []).append((x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {x["doc_id"] for x in docs}
    for x in docs:
        ids, at = plain(x["text"]), 0
        for start, n, crc, total in sorted(got[x["doc_id"]]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
