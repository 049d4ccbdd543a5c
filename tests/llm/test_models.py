"""Quality, mixing and the pipeline: held-out accuracy, plain versions and edge cases."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import frame, prose  # noqa: F401

import corpus_pipeline
from shelfcast.llm import common, decontaminate, mixing, near_duplicates, pii, quality

LABELS = "doc_id long, quality int, toxic int"


def junk(seed, words):
    return " | ".join(f"{w}$$$" for w in prose(seed, words).split())


TEXTS = [(i, prose(i, 30 + i % 50)) if i % 3 else (i, junk(i, 30 + i % 50)) for i in range(240)]
MARKS = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(240)]


def test_held_out_quality(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in quality.quality_scores(spark, folder).collect()}
    marks = [r for r in common.table(spark, folder, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    good = [rows[m["doc_id"]]["score"] for m in marks if m["quality"] == 1]
    bad = [rows[m["doc_id"]]["score"] for m in marks if m["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([x >= 0.7 for x in good]) > 0.92


def test_scores_do_not_depend_on_held_out_labels(frame):
    docs = frame(TEXTS)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in MARKS]
    models = [quality.train(docs, frame(m, LABELS)) for m in (MARKS, flipped)]
    assert models[0].good == models[1].good and np.array_equal(models[0].weights, models[1].weights)


def test_quality_separates_and_keeps(frame):
    docs = frame(TEXTS)
    model = quality.train(docs, frame(MARKS, LABELS))
    scores = model.scores([t.encode() for _, t in TEXTS])
    assert np.mean([g > b for g in scores[[q == 1 for _, q, _ in MARKS]] for b in scores[[q == 0 for _, q, _ in MARKS]]]) > 0.85
    odd = frame([(1, None), (1, None), (2, ""), (None, TEXTS[1][1]), (3, prose(1, 40_000))])
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.keep_good(docs, model).columns == docs.columns


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, 0), (None, 1, 1)], [(1, 1, 0), (1, 0, 0), (3, 0, 0)]])
def test_few_labels(frame, labels):
    model = quality.train(frame(TEXTS), frame(labels, LABELS))
    got = quality.score(frame([*TEXTS[:5], (9, None)]), model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    mixed = mixing.mix(frame(TEXTS[:20]), frame(labels, LABELS)).collect()
    assert len(mixed) == 20 and all(r["rate"] >= 0 for r in mixed)


def test_empty_documents(frame):
    model = quality.train(frame([]), frame(MARKS, LABELS))
    assert quality.score(frame([]), model).collect() == [] and mixing.mix(frame([]), frame(MARKS, LABELS)).collect() == []


# ---------------------------------------------------------------- mixing

def plain_rates(p, n, targets, steps, ridge=mixing.RIDGE):
    """The same least squares on dense arrays."""
    x, total = np.ones(len(n)), n.sum()
    scale = np.maximum((p * n[:, None]).sum(axis=0) / total, 1e-6)
    for _ in range(steps):
        e = (p * (x * n)[:, None]).sum(axis=0) / total
        x = np.maximum(0, x - (p @ ((e - targets) / scale) + ridge * (x - 1)) / (1 + ridge))
    return x


def test_rates_meet_targets(frame):
    targets = {(1, 0): 0.8, (1, 1): 0.05, (0, 0): 0.13, (0, 1): 0.02}
    toxic = [(i, t + (" scum idiot worthless" * 3 if i % 7 == 0 else "")) for i, t in TEXTS]
    rows = mixing.mix(frame([*toxic, (500, None), (501, "")]), frame(MARKS, LABELS), targets, budget=2.0).collect()
    p, n, x = (np.array([r[c] for r in rows], float) for c in ("posterior", "n_tokens", "rate"))
    domains = sorted(targets)
    wanted = np.array([targets[d] for d in domains])
    shares = (p * (n * x)[:, None]).sum(axis=0) / (2 * n.sum())
    assert np.abs(shares - wanted).max() < 0.005 and (x >= 0).all()
    assert np.allclose(x / 2, plain_rates(p, n, wanted, 60), atol=0.02)
    by_id = {r["doc_id"]: r for r in rows}
    truth = np.array([domains.index((q, t)) for _, q, t in MARKS])
    assert np.mean([np.argmax(by_id[i]["posterior"]) == d for i, d in enumerate(truth)]) > 0.9
    assert by_id[500]["n_tokens"] == by_id[501]["n_tokens"] == 0 and all(abs(r["copies"] - r["rate"]) <= 1 for r in rows)


def test_rows_without_an_id_are_rounded_apart(frame):
    nobody = [(None, TEXTS[0][1])] * 400
    for carry in (False, True):
        rows = [r for r in mixing.mix(frame([*TEXTS, *nobody]), frame(MARKS, LABELS), carry=carry).collect() if r["doc_id"] is None]
        rate = rows[0]["rate"]
        assert len(rows) == 400 and len({r["rate"] for r in rows}) == 1 and {r["copies"] for r in rows} <= {int(rate), int(rate) + 1}
        assert abs(np.mean([r["copies"] for r in rows]) - rate) < 0.1


def test_targets_out_of_reach_are_reported(frame, caplog):
    poor = [(i, t) for i, t in TEXTS if (i, 0, 0) in MARKS]
    mixing.mix(frame(poor), frame(MARKS, LABELS), {(1, 0): 0.9, (0, 0): 0.1}).count()
    assert any("off their targets" in r.getMessage() for r in caplog.records)


def test_mixing_carries_columns(frame):
    docs = frame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, rate string")
    got = mixing.mix(docs, frame(MARKS, LABELS), carry=True)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(TEXTS) and dict(got.dtypes)["rate"] == "double"


def test_unreachable_domain(frame):
    texts = pa.array([t for _, t in TEXTS])
    model = mixing.fit([t for _, t in TEXTS], np.array([q for _, q, _ in MARKS]), np.array([80.0, 160.0]), [(0, 0), (1, 0)])
    assert model.posteriors(texts)[0].argmax(axis=1).tolist() == [q for _, q, _ in MARKS]
    rows = mixing.mix(frame([x for x in TEXTS if x[0] % 3]), frame(MARKS, LABELS), {(1, 0): 0.5, (0, 0): 0.5}).collect()
    assert all(np.isfinite(r["rate"]) for r in rows)


def test_labels_of_the_documents_given(frame, monkeypatch):
    """A stage that follows a filter learns from, and has the domain shares of, what the filter left."""
    texts = [(i, junk(i, 30) if i % 2 else prose(i, 30)) for i in range(600)]
    marks = [(i, 1 - i % 2, 0) for i in range(600)]
    left = [x for x in texts if x[0] % 2 == 0 or x[0] % 20 == 1]
    rows = mixing.mix(frame([*left, (601, ""), (603, "w1 " * 9000)]), frame([*marks, (601, 0, 0), (603, 0, 0)], LABELS)).collect()
    domains = sorted(mixing.TARGETS)
    mean = np.mean([r["posterior"] for r in rows if r["n_tokens"]], axis=0)
    assert abs(mean[domains.index((0, 0))] - 31 / 331) < 0.02 and abs(mean[domains.index((1, 0))] - 300 / 331) < 0.02
    monkeypatch.setattr(mixing, "SAMPLE_ROWS", 25)
    found, domain, totals = mixing.domain_sample(common.documents(frame([*left, (601, ""), (603, "w1 " * 9000)]), "doc_id", "text"),
                                                 frame([*marks, (601, 0, 0), (603, 0, 0)], LABELS), domains)
    assert np.bincount(domain, minlength=4).tolist() == [25, 0, 25, 0] and totals.tolist() == [31, 0, 300, 0]
    assert set(found) <= {t for _, t in left}


# ---------------------------------------------------------------- pipeline

def test_pipeline_is_its_stages_in_turn(spark, folder):
    """Each stage against a plain version of its decision, on all rows it was given."""
    docs = common.table(spark, folder, "documents")
    columns, labels, items = docs.columns, common.table(spark, folder, "labels"), common.table(spark, folder, "benchmark")
    before = docs
    after = []
    for name, stage in corpus_pipeline.STAGES:
        after.append(common.stored(stage(spark, before, folder), "stage-" + name.replace(" ", "-")))
        before = after[-1]
    assert all(x.columns == columns for x in after[:-1]) and set(columns) < set(after[-1].columns)
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, *after)]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    model = quality.train(docs, labels)
    assert ids[1] == {r["doc_id"] for r in docs.collect() if model.scores([(r["text"] or "").encode()])[0] >= 0.7}
    from test_joins import plain_components, plain_contamination
    rows = [(r["doc_id"], r["text"]) for r in after[0].collect()]
    assert ids[2] == {d for d, _, _, kept in plain_components(rows, 5) if kept}
    rows = [(r["doc_id"], r["text"]) for r in after[1].collect()]
    found = plain_contamination(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert ids[3] == {d for d, n, hit, _ in found if not (hit > 0 and 20 * hit >= n)}
    texts = {r["doc_id"]: r["text"] for r in after[2].collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after[3].collect()} == {
        d: (pii.redact_text(t), len(pii.redact_text(t))) for d, t in texts.items()}
    assert ids[5] == ids[4] == ids[3]
    whole = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r["doc_id"], r["text"], round(r["rate"], 9)) for r in df.select("doc_id", "text", "rate").collect())
    assert key(whole) == key(after[-1])


def test_stages_on_odd_rows(spark, frame, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (2, prose(1, 30), "en", "s", 5), (2, prose(1, 30), "en", "s", 5)]
    for docs in (frame(rows, schema), frame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, folder), "odd")
            docs.count()
    assert decontaminate.WINDOW == 13 and near_duplicates.HALVES ** 2 >= 100
