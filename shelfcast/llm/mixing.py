"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled table predicts for every document how likely each domain is. Document rates x >= 0 are
then fitted so that the expected tokens of each domain, the sum over documents of rate * tokens * posterior, match the
targets. This is least squares with a pull toward equal rates:

    1/2 sum_k (E_k(x) - t_k)^2 / c_k + ridge / 2 sum_d (n_d / N) (x_d - 1)^2,   E_k = sum_d n_d p_dk x_d / N

with t the target shares, c the shares before mixing, n tokens and N their total. It is minimised by projected gradient steps,
preconditioned by the tokens, so a step changes x_d by p_d . (E - t) / c + ridge (x_d - 1). A step needs only the domain totals:
each is one distributed sum of as many numbers as there are domains. Rates are a function of the posteriors and of the
residuals so far; tasks replay them, so there is no state to keep or to lose.

Domains are pairs of labels. The classifier takes a bounded sample of the documents given: at most ``SAMPLE_ROWS`` labelled
documents per domain in hash order of their id, of at most ``SAMPLE_CHARS`` characters. Its posteriors have the domain shares of
all labelled documents given that have text. All else covers all documents, read whole.

Null and empty texts have no tokens: their rate is as the posteriors say, and they add nothing to totals. Null labels are not
learned from; several labels of a document give one domain (the rounded means). A domain without documents cannot reach its
target, the others still do. Without labels all posteriors are equal. Repeated rows get equal rates. An empty table gives no rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shelfcast.llm import common
from shelfcast.llm.common import stored
from shelfcast.llm.words import LETTERS_DIGITS, NON_SPACE, Words, split_words

#: Share of tokens per domain (quality, toxic) after mixing, and tokens after mixing per token before.
TARGETS = {(1, 0): 0.90, (1, 1): 0.02, (0, 0): 0.07, (0, 1): 0.01}
BUDGET = 1.0
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 16_384
FEATURES, HASH_BITS = 768, 20
#: Columns that mixing adds.
ADDED = ["n_tokens", "posterior", "rate", "copies"]
RIDGE, MOST_STEPS, TOLERANCE = 1e-3, 40, 1e-5
#: Distance of an expected share from its target that is reported.
FAR = 0.01
_SYMBOLS = NON_SPACE & ~LETTERS_DIGITS & ~((np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A))
_WIDTH = np.uint64((1 << HASH_BITS) - 1)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats, and each text's tokens.

    Features are hashed words, hashed runs of symbols, and levels of length, of repetition and of symbols."""
    words = split_words(texts, NON_SPACE, lower=True)
    counts = words.counts()
    symbols = split_words(texts, _SYMBOLS)
    letters = split_words(texts, LETTERS_DIGITS, lower=True)
    codes = words.hashes()
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    inner = words.first[:-1][counts > 0]
    same[inner] = False
    repeated = sums(same, words)
    levels = np.stack([np.log2(counts + 1).astype(int), (10 * repeated / np.maximum(counts, 1)).astype(int) + 40,
                       np.minimum(10 * symbols.counts() / np.maximum(counts, 1), 40).astype(int) + 60], axis=1)
    text = np.concatenate([letters.text_of_word(), symbols.text_of_word(), np.repeat(np.arange(len(counts)), 3)])
    feature = np.concatenate([letters.hashes() & _WIDTH, symbols.hashes(1) & _WIDTH, (levels.ravel() * 7919 + 13).astype(np.uint64) & _WIDTH])
    keys = np.unique(text.astype(np.uint64) << np.uint64(HASH_BITS) | feature)
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), (keys & _WIDTH).astype(np.int64), counts


def sums(flags: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[words.first[1:]] - total[words.first[:-1]]


@dataclass
class DomainClassifier:
    """Softmax over the presence of chosen features."""

    domains: list[tuple[int, int]]
    columns: np.ndarray  # feature -> row of weights, or -1
    weights: np.ndarray
    intercept: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each domain per text, and the texts' tokens."""
        text, feature, tokens = text_features(texts)
        row = self.columns[feature]
        text, row = text[row >= 0], row[row >= 0]
        scores = np.tile(self.intercept, (len(tokens), 1))
        for k in range(len(self.domains)):
            scores[:, k] += np.bincount(text, self.weights[row, k], len(tokens))
        return softmax(scores), tokens


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, toxic and usable (short enough to learn from) of the labelled documents among ``docs`` that have text."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    given = docs.where(F.length("text") > 0).groupBy("doc_id").agg(F.max(F.length("text") <= SAMPLE_CHARS).alias("usable"))
    return known.join(given, "doc_id")


def domain_sample(docs: DataFrame, labels: DataFrame, domains: list[tuple[int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Bounded training texts with their domain, and the labelled documents of each domain among ``docs``."""
    known = stored(labelled(docs, labels), "labelled")  # read for the counts and for each domain
    counts = {(r["quality"], r["toxic"]): r["n"] for r in known.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [(r["doc_id"], i) for i, (q, t) in enumerate(domains) for r in known.where(
        F.col("usable") & (F.col("quality") == q) & (F.col("toxic") == t)).orderBy(*order).limit(SAMPLE_ROWS).select("doc_id").collect()]
    totals = np.array([counts.get(d, 0) for d in domains], float)
    if not chosen:
        return [], np.empty(0, int), totals
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, domain int")  # SAMPLE_ROWS per domain at most
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text").between(1, SAMPLE_CHARS)).dropDuplicates(
        ["doc_id"]).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([r["domain"] for r in rows], int), totals


def fit(texts: list[str], domain: np.ndarray, totals: np.ndarray, domains: list[tuple[int, int]], steps: int = 300) -> DomainClassifier:
    """Choose the features that tell domains apart best, then descend on the penalised likelihood."""
    k = len(domains)
    columns = np.full(1 << HASH_BITS, -1, np.int32)
    if not len(texts):
        return DomainClassifier(domains, columns, np.zeros((1, k)), np.zeros(k))
    text, feature, _ = text_features(pa.array(texts, pa.string()))
    size = np.bincount(domain, minlength=k).astype(float)
    found, place = np.unique(feature, return_inverse=True)
    have = np.zeros((len(found), k))
    np.add.at(have, (place, domain[text]), 1)
    share = (have.sum(axis=1) / len(texts))[:, None]
    expected = share * size
    worth = ((have - expected) ** 2 / (expected * (1 - share) + 1e-9)).sum(axis=1) * (have.sum(axis=1) >= 3)
    best = np.lexsort((found, -worth))[:FEATURES]
    columns[found[best]] = np.arange(len(best))
    row = columns[feature]
    x = np.zeros((len(texts), len(best)), np.float32)
    x[text[row >= 0], row[row >= 0]] = 1
    y = np.eye(k, dtype=np.float32)[domain]
    weights, intercept = np.zeros((len(best), k), np.float32), np.log((size + 1) / (size + 1).sum()).astype(np.float32)
    ahead_w, ahead_b, rate = weights, intercept, 4.0 / (1 + (x * x).sum(axis=1).mean())
    for step in range(steps):
        p = softmax(x @ ahead_w + ahead_b).astype(np.float32)
        new_w = ahead_w - rate * (x.T @ (p - y) / len(x) + 1e-4 * ahead_w)
        new_b = ahead_b - rate * (p - y).mean(axis=0)
        momentum = step / (step + 3)
        ahead_w, ahead_b = new_w + momentum * (new_w - weights), new_b + momentum * (new_b - intercept)
        weights, intercept = new_w, new_b
    shift = np.log((totals + 1) / (totals + 1).sum()) - np.log((size + 1) / (size + 1).sum())
    return DomainClassifier(domains, columns, weights.astype(float), intercept + shift)


def train(docs: DataFrame, labels: DataFrame, domains: list[tuple[int, int]]) -> DomainClassifier:
    return fit(*domain_sample(docs, labels, domains), domains)


def memberships(docs: DataFrame, model: DomainClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens and posterior (one share per domain)."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)  # a fixed table of features

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, tokens = shared.value.posteriors(batch.column(place))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens.astype(np.int64)), lists], [*batch.schema.names, *ADDED[:2]])

    schema = StructType(docs.schema.fields + [StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))])
    return common.map_batches(docs, work, schema, text_col)


def posterior_matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch["posterior"].flatten().to_numpy().reshape(-1, k)


def replay(p: np.ndarray, residuals: list[np.ndarray], ridge: float) -> np.ndarray:
    """Rates after one projected step per residual, from equal rates."""
    x = np.ones(len(p))
    for residual in residuals:
        x = np.maximum(0.0, x - (p @ residual + ridge * (x - 1)) / (1 + ridge))
    return x


def domain_totals(rows: DataFrame, residuals: list[np.ndarray], k: int, ridge: float) -> np.ndarray:
    """Expected tokens of each domain under the current rates: one sum over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                p = posterior_matrix(batch, k)
                total += (p * (replay(p, residuals, ridge) * batch["n_tokens"].to_numpy())[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], ["k", "total"])

    found = rows.select("n_tokens", "posterior").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total"))
    out = np.zeros(k)
    for r in found.collect():  # one row per domain
        out[r["k"]] = r["total"]
    return out


def fit_rates(rows: DataFrame, targets: np.ndarray, ridge: float = RIDGE, most: int = MOST_STEPS,
              tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Residuals of the projected gradient steps; ``replay`` turns them into rates.

    Shares that the steps could not bring within ``FAR`` of their targets are logged: the documents may not hold them."""
    k = len(targets)
    tokens = domain_totals(rows, [], k, ridge)
    if not tokens.sum():
        return []
    start = tokens / tokens.sum()
    scale = np.maximum(start, 1e-6)
    residuals, expected = [], start
    for _ in range(most):
        residuals.append((expected - targets) / scale)
        new = domain_totals(rows, residuals, k, ridge) / tokens.sum()
        moved = np.abs(new - expected).max()
        expected = new
        if moved < tolerance:
            break
    far = np.abs(expected - targets)
    if far.max() > FAR:
        logging.getLogger(__name__).warning("expected token shares %s are up to %.4f off their targets %s after %d steps",
                                            np.round(expected, 4).tolist(), far.max(), np.round(targets, 4).tolist(), len(residuals))
    return residuals


def mix(docs: DataFrame, labels: DataFrame, targets: dict[tuple[int, int], float] | None = None, budget: float = BUDGET,
        id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, posterior, rate (expected copies) and copies of every row: the rate rounded by a hash of id and text,
    and of the stored row's number where the id is null, so that rows without an id are not all rounded the same way.

    With ``carry`` all columns of ``docs`` come along; those named like the new ones give way."""
    targets = targets or TARGETS
    domains = sorted(targets)
    wanted = np.array([targets[d] for d in domains], float)
    model = train(common.documents(docs, id_col, text_col), labels, domains)
    key = lambda id_, text: F.xxhash64(id_, text, F.when(F.col(id_).isNull(), F.monotonically_increasing_id()))
    share = lambda id_, text: (F.pmod(key(id_, text), F.lit(1_000_000)) / 1_000_000).alias("copies")
    if carry:
        known = docs.drop(*(x for x in ADDED if x not in (id_col, text_col)))
        rows = memberships(known.select("*", share(f"`{id_col}`", f"`{text_col}`")), model, text_col)
    else:  # texts are read, but not kept
        known = common.documents(docs, id_col, text_col)
        rows = memberships(known.select("*", share("doc_id", "text")), model).drop("text")
    rows = stored(rows, "memberships")
    residuals = fit_rates(rows, wanted / wanted.sum())
    place = rows.columns.index("posterior")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = batch.column(place).flatten().to_numpy().reshape(-1, len(domains))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(budget * replay(p, residuals, RIDGE))], [*batch.schema.names, "rate"])

    rated = rows.mapInArrow(run, StructType(rows.schema.fields + [StructField("rate", DoubleType())]))
    rounded = (F.floor("rate") + (F.col("copies") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.select(*[c for c in rated.columns if c != "copies"], rounded.alias("copies"))


def mixture(spark, folder: str) -> DataFrame:
    """Query op10: rates of all documents toward the default domain shares."""
    return mix(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
