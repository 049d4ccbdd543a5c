"""URL rules, chat formatting and top-k search against plain versions."""
import hashlib
import itertools
import random

import numpy as np
import pytest
from llm_tables import frame, prose  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfcast.llm import chat, topk, urls

# ---------------------------------------------------------------- urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.com", "", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/x/y", "block"),
         ("A.com", "/x/y/", "allow"), ("tie.org", "/", "allow"), ("tie.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("bad", "/", "what"), ("null", None, "block")]
URLS = [None, "", "no scheme", "http://", "http:///p", "http://NET", "http://net/", "https://x.net/en/1", "https://www.example.net/en/1", "https://example.net/en",
        "ftp://a.com", "http://a.com?x=/x", "http://b.a.com/x/yz#f", "http://c.b.a.com/x/y/z?q", "http://aa.com/x", "http://tie.org/q", "http://null/x",
        "x://a.com/xyz/../q", "http://" + "s." * 500 + "net/" + "d/" * 500, "http://a.com\n/x", "a://b.a.com/x/y://c"]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host):]))
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, action in RULES:
        h = (h or "").lower()
        if h and action in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            key = (len(h + (p or "")), len(h), h + (p or ""), action == "block")
            best = max(best or key, key)
    return host, path, best and best[2], "block" if best and best[3] else "allow"


def test_urls(frame):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(1, URLS[7])] * 3 + [(None, URLS[7])] * 2
    got = urls.judge_urls(frame(pages, "page_id long, url string"), frame(RULES, "host string, path string, action string"))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()), key=str) == sorted(
        ((i, *plain_verdict(u)) for i, u in pages), key=str)


def test_urls_of_empty_tables(frame):
    rules, pages = frame(RULES, "host string, path string, action string"), frame([(1, "http://net/")], "page_id long, url string")
    assert urls.judge_urls(frame([], "page_id long, url string"), rules).collect() == []
    none = frame([], "host string, path string, action string")
    assert [(r["rule"], r["verdict"]) for r in urls.judge_urls(pages, none, default="block").collect()] == [(None, "block")]


# ---------------------------------------------------------------- chat

TURN = "conv_id long, turn long, role string, text string"
PIECES = st.text(alphabet="\\#</turn> \nab", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join("".join(chat.turn_parts(r, t)) for r, t in turns)
    assert chat.parse(formatted) == turns
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def tree(seed):
    """Conversations that branch at all depths, with copies, prefixes of others and odd rows."""
    rng, rows = random.Random(seed), []
    openings = [("system", prose(1, 8)), ("user", prose(2, 5))]
    for conv in range(60):
        turns = openings[:rng.randrange(3)] + [(rng.choice(["user", "assistant"]), prose(rng.randrange(3), 4)) for _ in range(rng.randrange(5))]
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(90, 0, None, None), (90, 0, "assistant", ""), (91, 5, "assistant", "ties"), (91, 5, "assistant", "ties"), (None, 1, "user", "no id"),
             (None, 2, "assistant", "no id"), *[(None, 1, "assistant", "the same")] * 40, (94, 1, "assistant", "the same"), (None, None, None, None),
             (92, 1, "assistant", "word " * 30_000 + chat.HARD_TEXT), (93, 0, "us\ner", "### \\")]
    rng.shuffle(rows)
    return rows + [(-7, t, r, x) for _, t, r, x in chat.HARD]


def plain_turns(rows):
    """Conversations with their turns in order; each row without an id is one."""
    for conv in {r[0] for r in rows} - {None}:
        yield conv, sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
    yield from ((None, [(t, r or "", x or "")]) for c, t, r, x in rows if c is None)


def plain_chat(rows):
    out = []
    for conv, turns in plain_turns(rows):
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        formatted = "".join("".join(chat.turn_parts(r, x)) for _, r, x in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [None, chat.VOCABULARY])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_conversations_come_back(spark, frame, vocabulary, partitions):
    rows, before = tree(3), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments, members = chat.format_conversations(frame(rows, TURN), vocabulary)
        segments = chat.stored(segments, "test")
        got = members.join(chat.read_back(segments, vocabulary), "path").drop("path").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((tuple(r) for r in got), key=str) == plain_chat(rows)
    stock = sorted(segments.collect(), key=lambda r: r["stream"])
    # every initial part of a conversation is there once, in one gapless stream
    nodes, token = set(), chat.Tokenizer.read(vocabulary)
    for _, turns in plain_turns(rows):
        nodes |= {tuple(turns_[1:] for turns_ in turns[:i + 1]) for i in range(len(turns))}
    size = sum(len(token.encode(p)) for n in nodes for p in chat.turn_parts(*n[-1]))
    assert [r["stream"] for r in stock] == list(itertools.accumulate([0] + [len(r["tokens"]) for r in stock[:-1]])) and size == sum(len(r["tokens"]) for r in stock)
    by_segment = {r["segment"]: r for r in stock}
    for r in stock:  # the intervals cover exactly the positions before the segment
        at = 0
        for a in r["ancestors"]:
            source = by_segment[a["segment"]]
            assert a["start"] == at and a["stream"] == source["stream"] + a["start"] - source["position"] and a["stream"] < r["stream"]
            assert source["position"] <= a["start"] < a["end"] <= source["position"] + len(source["tokens"])
            at = a["end"]
        assert at == r["position"]


def test_no_conversations(frame):
    segments, members = chat.format_conversations(frame([], TURN), None)
    assert segments.collect() == [] and members.collect() == []


# ---------------------------------------------------------------- top k

VECTOR = "vec_id long, embedding array<float>"


def plain_top(rows, k, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in kept:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in kept if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(seed, n, dims, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, dims)]) for i in range(n)]


@pytest.mark.parametrize("rows,k,shard", [
    (vectors(1, 300, 8), 20, 50), (vectors(2, 120, 3), 5, 10_000), (vectors(3, 400, 2), 7, 64), (vectors(4, 15, 4), 20, 4), (vectors(5, 60, 4, 1e7), 5, 30),
    ([(0, [0.0, 0.0]), (20, [1.0, None]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]),
      (100, [2.0]), (None, [1.0, 1.0]), (120, []), (140, [1.0, 1.0]), (140, [1.0, 2.0])], 20, 3),
    ([], 20, 100)])
def test_top_k(frame, rows, k, shard):
    got = topk.top_k(frame(rows, VECTOR), F.col("vec_id") % 20 == 0, k, shard_rows=shard)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, k)


def test_walk_stops_early():
    rng = np.random.default_rng(7)
    values = rng.integers(-3, 4, (5000, 4))
    values[:40, 0] = 1000
    lists = topk.SortedLists(np.arange(5000), values)
    seen, scores = 0, lists.scores

    def counted(query, rows):
        nonlocal seen
        seen += len(rows)
        return scores(query, rows)

    lists.scores = counted
    ids, best = lists.top(-1, np.array([5, 1, -1, 0]), 20)
    assert seen < 1000 and set(ids) <= set(range(40)) and list(best) == sorted(best, reverse=True)
