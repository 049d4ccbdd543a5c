"""Decontamination, substring and near-duplicate operators against brute force."""
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F
from llm_tables import edited, frame, prose  # noqa: F401

from shelfcast.llm import common, decontaminate, near_duplicates, substrings
from shelfcast.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- decontamination

def plain_contamination(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, owners in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == window:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def found_contamination(df):
    rows = df.withColumn("n_hit", decontaminate.hit_words()).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=str)


ITEM = prose(1, 30)
DOCS = [
    (1, prose(2, 50) + " " + ITEM + " " + prose(3, 40)), (2, " ".join(ITEM.upper().split()[5:19])), (3, ITEM.replace(" ", ", ")), (4, "one two"),
    (4, "one two"), (5, ""), (6, None), (None, ITEM), (7, "two"), (8, "q " * 2000 + ITEM), (9, " ".join(ITEM.split()[:12])),
]
ITEMS = [(10, ITEM), (10, ITEM), (11, " ".join(ITEM.split()[3:20])), (12, "two"), (13, ""), (14, None), (None, "one"), (15, "w1 " * 20)]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_contamination(frame, block):
    items = frame(ITEMS, "item_id long, text string")
    assert found_contamination(decontaminate.find_contamination(frame(DOCS), items, block_bytes=block)) == plain_contamination(DOCS, ITEMS)


def test_contamination_of_empty_tables(frame):
    none = frame([], "item_id long, text string")
    assert found_contamination(decontaminate.find_contamination(frame(DOCS), none)) == plain_contamination(DOCS, [])
    assert found_contamination(decontaminate.find_contamination(frame([]), frame(ITEMS, "item_id long, text string"))) == []


def test_contaminated_rows_go(frame):
    items = frame([(10, ITEM)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(frame(DOCS), items)
    assert kept.columns == frame(DOCS).columns
    # document 8 holds the item in too few of its words; 9 has fewer words than a window
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6, 7, 8, 9]


def test_contaminated_rows_go_whatever_their_columns(frame):
    clashing = frame(DOCS).withColumns({x: F.lit("mine") for x in ("bad_digest", "digest", "row", "doc", "n_hit")})
    items = frame([(str(i), t) for i, t in DOCS[:3]], "item_id string, text string")
    got = decontaminate.drop_contaminated(clashing, items)
    plain = decontaminate.drop_contaminated(frame(DOCS), items)
    assert got.columns == clashing.columns and set(r["bad_digest"] for r in got.collect()) <= {"mine"}
    assert sorted(map(str, (tuple(r) for r in got.select("doc_id", "text").collect()))) == sorted(map(str, (tuple(r) for r in plain.select("doc_id", "text").collect())))


# ---------------------------------------------------------------- substrings

def plain_substrings(docs, size=13):
    words = [(d, re.findall(WORD, t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        for i in range(len(w) - size + 1 if d is not None else 0):
            key = tuple(w[i:i + size])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1 if d is not None else 0):
            if least[tuple(w[i:i + size])] < d:
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def found_substrings(df):
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["removed"]), r["kept"]) for r in df.collect()), key=str)


def shared_passages(seed):
    """Documents that share passages of 10 to 16 words at all alignments."""
    rng, pool = random.Random(seed), prose(seed, 300)
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            at = rng.randrange(280)
            parts += [prose(rng.randrange(10**6), rng.randrange(9)), " ".join(pool.split()[at:at + rng.randrange(10, 17)])]
        docs.append((rng.randrange(60), "\n".join(parts)))
    return docs


@pytest.mark.parametrize("docs", [
    shared_passages(1), shared_passages(2),
    [(3, ITEM), (1, ITEM), (1, ITEM), (2, None), (4, ""), (None, ITEM), (None, ITEM), (5, "a " * 40), (6, "a " * 15), (7, ITEM + " " + ITEM), (-2, "short"),
     (8, "y" * 50_000 + " " + ITEM)],
    []])
def test_substrings(frame, docs):
    assert found_substrings(substrings.remove_repeats(frame(docs))) == plain_substrings(docs)


def test_substrings_flushed_often(frame):
    docs = shared_passages(3)
    assert found_substrings(substrings.remove_repeats(frame(docs).repartition(3), most=20)) == plain_substrings(docs)


def test_cover():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD)) and substrings.PERIOD - 1 + substrings.ANCHOR == substrings.WINDOW


# ---------------------------------------------------------------- near duplicates

def plain_components(docs, size, percent=80):
    def shingle_set(text):
        w = re.findall(WORD, lower(text))
        return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()

    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return sorted(((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=str)


def found_components(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def families(seed, count=12):
    """Families of edited copies on both sides of the threshold, chains, copies and unrelated texts."""
    rng, docs, next_id = random.Random(seed), [], itertools.count(100)
    for f in range(count):
        base = prose(seed * 1000 + f, rng.randrange(20, 200), 5000)
        for _ in range(rng.randrange(1, 14)):
            docs.append((next(next_id), edited(base, rng.randrange(10**6), rng.choice([0, 0.01, 0.03, 0.05, 0.08, 0.12]))))
    rng.shuffle(docs)
    return docs


EDGES = [(1, "One TWO three"), (2, "one two three"), (3, "one"), (4, "ONE"), (5, ""), (6, None), (7, " \t"), (None, "one two three"), (None, None),
         (9, "one two three"), (9, "one two three"), (10, "four five"), (10, "one"), (11, prose(5, 20_000)), (12, prose(5, 20_000))]


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("docs", [families(1), families(2), EDGES, []])
def test_near_duplicates(frame, docs, size):
    assert found_components(near_duplicates.find_near_duplicates(frame(docs), size)) == plain_components(docs, size)


def test_near_duplicates_flushed_often(frame):
    docs = families(3)
    assert found_components(near_duplicates.find_near_duplicates(frame(docs).repartition(3), 2, most_docs=7)) == plain_components(docs, 2)


def test_one_family_around_the_threshold(frame):
    base = prose(77, 120, 5000)
    docs = [(i, "intro the same for all of them here " + edited(base, i, 0.01 + 0.05 * (i % 7) / 7)) for i in range(120)]
    assert found_components(near_duplicates.find_near_duplicates(frame(docs), 2)) == plain_components(docs, 2)


def test_first_of_each_group_stays(frame):
    docs = families(4)
    kept = {d for d, _, _, k in plain_components(docs, 5) if k}
    got = near_duplicates.keep_first(frame([*docs, (None, None)]))
    assert {r["doc_id"] for r in got.collect()} == kept | {None} and got.columns == frame(docs).columns


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)], [(i, i + 1) for i in range(70)], [(i + 1, i) for i in range(70)], [(0, i) for i in range(1, 50)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)]])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == sorted((x, root(x)) for x in parent)


def test_queries_over_the_smallest_tables(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, folder, "documents").collect()]
    got = substrings.substring_digests(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(
        (d, n, hashlib.sha256(t.encode()).hexdigest()) for d, _, n, t in plain_substrings(docs))
