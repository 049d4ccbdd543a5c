"""Prefix trie against plain tuples."""
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import frame  # noqa: F401

from shelfcast.llm import trie

ROWS = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_conversations(table):
    convs = {}
    for conv_id, turn, role, text in table:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, key, (role, text)))
    return {c: [x[3] for x in sorted(turns, key=lambda x: x[:3])] for c, turns in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = convs.get(c - rest, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, leaves, saved = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], set()).add(node)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + own
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node)))).encode()).hexdigest())
                  for node, m in members.items())


def rows(df):
    return sorted((tuple(r) for r in df.select(*OUT).collect()), key=lambda r: (r[0], r[1]))


def by_node(found):
    return sorted(found, key=lambda r: (r[0], r[1]))


def some(seed, n, depth=6, words=2):
    rng, table = random.Random(seed), []
    for c in range(n):
        for turn in range(rng.randrange(1, depth)):
            table.append((rng.randrange(-40, 40) if rng.random() < 0.1 else c * 3 - n, turn, rng.choice(["user", "assistant", None]), rng.choice(["é" * i for i in range(words)] + [None])))
    return table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=30))
def test_shard_is_a_trie(texts):
    found = list(trie.shard_nodes(list(range(10, 10 + len(texts))), [[x.encode() for x in t] for t in texts], [[len(x) for x in t] for t in texts]))
    want = plain_trie({10 + i: [("", x) for x in t] for i, t in enumerate(texts)})
    assert sorted((x[3], x[2], x[4], len(x[7])) for x in found) == sorted(
        (w[0], w[1], w[3], sum(len(t) == w[1] and t[:w[1]] == texts[w[0] - 10][:w[1]] for t in texts)) for w in want)
    depths = {x[0]: x for x in found}
    for x in found:
        assert [depths[a][2] for a in x[6]] == [x[2] - 2 ** k for k in range(x[2].bit_length())]
        assert x[1] == (x[6][0] if x[6] else None)


@pytest.mark.parametrize("shard", [3, trie.SHARD])
def test_trie_of_rebuilt_conversations(frame, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    table = some(1, 150) + some(1, 20)  # repeated rows are turns of their own
    table += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie b")]
    df = frame(table, ROWS)
    got = trie.prefix_trie(trie.rebuilt(trie.gathered(df)))
    assert rows(got) == by_node(plain_trie(plain_rebuilt(plain_conversations(table))))


def test_deep_wide_and_common_conversations(frame):
    table = [(c, t, "user", "same") for c in range(300) for t in range(3)]  # one conversation of many ids
    table += [(1000 + c, 0, "user", "same") for c in range(300)] + [(1000 + c, 1, "user", f"w{c}") for c in range(300)]  # very many children
    table += [(5000, t, "user", "x" * (t % 7)) for t in range(700)] + [(5001, t, "user", "x" * (t % 7)) for t in range(650)]
    table += [(None, t, "user", "nobody") for t in range(400)]
    got = trie.prefix_trie(trie.gathered(frame(table, ROWS)).repartition(3))
    assert rows(got) == by_node(plain_trie(plain_conversations(table)))


def test_turnless_conversations_and_empty_tables(frame):
    short = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # its family's first one is missing
    got = rows(trie.prefix_trie(trie.rebuilt(trie.gathered(frame([(short, 0, "user", "a")], ROWS)))))
    assert got == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    assert rows(trie.prefix_trie(trie.rebuilt(trie.gathered(frame([], ROWS))))) == []
    assert rows(trie.prefix_trie(trie.gathered(frame([(None, 0, "user", "a")], ROWS)))) == []


def test_long_texts_are_known_by_their_hash(frame):
    table = [(c, 0, "user", "long " * 200_000 + str(c % 2)) for c in range(4)]
    assert rows(trie.prefix_trie(trie.gathered(frame(table, ROWS)))) == by_node(plain_trie(plain_conversations(table)))
