"""Merkle manifest against plain trees."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import frame, prose  # noqa: F401
from pyspark.sql import functions as F

from shelfcast.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(height=st.integers(0, 5), data=st.data())
def test_layout_is_a_tight_numbering_with_whole_subtrees(height, data):
    leaves = data.draw(st.integers(1, min(8 ** height, 3000)))
    places = manifest.level_addresses(leaves, height)
    every = np.sort(np.concatenate(places))
    assert np.array_equal(every, np.arange(manifest.size(leaves, height))) and places[height].tolist() == [0]
    low = (height + 1) // 2
    for root in range(len(places[low - 1])) if low else []:  # each lower subtree is one stretch with its root first
        under = np.concatenate([p[root * 8 ** (low - 1 - k):(root + 1) * 8 ** (low - 1 - k)] for k, p in enumerate(places[:low])])
        assert under.max() - under.min() + 1 == len(under) and under.min() == places[low - 1][root]
    one = data.draw(st.integers(0, leaves - 1))
    assert manifest.address(0, one, leaves, height) == places[0][one]


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain_path(levels, at):
    out = []
    for nodes in levels[:-1]:
        begin = at - at % 8
        out.append(("".join(nodes[begin:at]), "".join(nodes[at + 1:begin + 8])))
        at //= 8
    return out


def leaf(fields):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def lower(text):
    return None if text is None else "".join(c.lower() if c.isascii() else c for c in text)


def plain_rows(table):
    """(id, leaf, subroot, root, proof, folded) of rows (doc_id, text, lang, source, n_chars)."""
    langs, out = {}, []
    for doc_id, text, lang, source, n in table:
        checked = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        fields = lambda t: leaf([doc_id, source, lang, n, t])
        langs.setdefault(lang, []).append((doc_id is not None, doc_id, fields(text), fields(lower(text)) if checked else fields(text)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_levels([r[2] for r in sorted(langs[x], key=lambda r: (r[0], r[1] or 0, r[2]))]) for x in order}
    top = plain_levels([trees[x][-1][0] for x in order])
    for k, lang in enumerate(order):
        for at, (_, doc_id, digest, claim) in enumerate(sorted(langs[lang], key=lambda r: (r[0], r[1] or 0, r[2]))):
            path = plain_path(trees[lang], at) + plain_path(top, k)
            for a, b in path:
                claim = sha(a + claim + b)
            out.append((doc_id, digest, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), claim))
    return out


def proved(df):
    made = manifest.build(df, manifest.FIELDS, "lang", "doc_id", {"text": F.translate("text", manifest._UPPER, manifest._UPPER.lower())},
                          F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    rows = manifest.proofs(made, with_steps=True).collect()
    for x in rows:
        path = [(s["left"], s["right"]) for s in x["steps"]]
        assert manifest.folded(x["leaf"], path) == made.root and sha("".join(a + b for a, b in path)) == x["proof"]
    return sorted(((x["id"], x["leaf"], x["subroot"], made.root, x["proof"], x["folded"]) for x in rows), key=str)


@pytest.mark.parametrize("height", [1, 2, manifest.BLOCK_HEIGHT])
def test_trees_of_all_sizes(frame, monkeypatch, height):
    monkeypatch.setattr(manifest, "BLOCK_HEIGHT", height)
    monkeypatch.setattr(manifest, "BLOCK", 8 ** height)
    rng, table = random.Random(1), []
    for lang, n in [(None, 9), ("", 1), ("a", 8), ("b", 64), ("c", 65), ("é", 130), ("Z", 600), *[(f"lang{i}", 1 + i % 3) for i in range(70)]]:
        for _ in range(n):
            table.append((rng.randrange(5000), rng.choice([None, "", "ABC É", prose(rng.random(), 5)]), lang, rng.choice([None, "s"]), rng.choice([None, 7])))
    rng.shuffle(table)
    assert proved(frame(table, DOCS)) == sorted(plain_rows(table), key=str)


def test_ties_nulls_and_long_texts(frame):
    table = [(1, "Same", "x", "s", 4)] * 300 + [(None, "Same", None, None, None)] * 30 + [(None, None, None, None, None), (2, "W " * 200000, "x", "s", 1)]
    got = proved(frame(table, DOCS))
    assert got == sorted(plain_rows(table), key=str) and len(got) == len(table)


def test_one_row_and_none(frame):
    one = [(3, "Text", "en", "s", 4)]
    assert proved(frame(one, DOCS)) == plain_rows(one)
    assert manifest.build(frame([], DOCS), manifest.FIELDS, "lang", "doc_id").root is None
    assert proved(frame([], DOCS)) == []


def test_changed_rows_are_found(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for x in manifest.document_manifest(spark, folder).collect():
        text = docs[x["doc_id"]]["text"]
        changed = zlib.crc32(str(x["doc_id"]).encode()) % 3 == 0 and lower(text) != text
        assert x["verified"] == (not changed) == (x["folded_root"] == x["root"])
