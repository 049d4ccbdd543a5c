"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into chunks and every chunk is compressed with both dictionaries, so that the dictionaries count over
the whole of a long text and not only at its beginning. The difference of the two compressed sizes, divided by
their sum, and the compressed share of the text (runs of one word fit both dictionaries) go through a logistic
calibration. Dictionaries and calibration are fitted on disjoint labelled texts.

The fit takes a bounded sample: at most ``SAMPLE_ROWS`` labelled documents per class, in an order given by a hash of
their id, of at most ``SAMPLE_CHARS`` characters each; longer ones are not trained on. Scoring reads all texts whole.

Null labels and ids are not learned from; a document with several labels counts as good if at least half are. With no
labels, or only one class, every score is that class's share (0.5 without labels). Null and empty texts compress to
nothing and get the score of a text without evidence. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

SAMPLE_ROWS, SAMPLE_CHARS = 3000, 16_384
DICTIONARY_BYTES, CHUNK_BYTES, LEVEL = 65_536, 512, 3
#: Predicted 1 from this score on.
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def chunks(data: bytes) -> list[bytes]:
    return [data[i:i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """Trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [c for x in texts for c in chunks(x)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[:DICTIONARY_BYTES]


@dataclass
class CompressionClassifier:
    """Two dictionaries and the weights of the calibration."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    share: float = 0.5  # of label 1: the score of an empty text

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_made"):
            made = []
            for content in (self.good, self.bad):
                kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
                d = zstandard.ZstdCompressionDict(content, dict_type=kind)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._made = made
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: normalised size difference, log share, log length and the difference weighed by length."""
        a, b = self._compressors()
        empty = len(a.compress(b""))
        rows = np.zeros((len(texts), 5))
        for i, x in enumerate(texts):
            parts = chunks(x)
            good = sum(len(a.compress(c)) - empty for c in parts)
            bad = sum(len(b.compress(c)) - empty for c in parts)
            if not parts or good + bad <= 0:
                continue
            d, share = (bad - good) / (good + bad), np.log(max(good, 1) / len(x))
            rows[i] = d, share, np.log(len(x)), d * np.log(len(x)), share * share
        return rows

    def scores(self, texts: list[bytes]) -> np.ndarray:
        values = logistic((self.features(texts) - self.center) / self.scale, self.weights)
        return np.where([bool(x) for x in texts], values, self.share) if texts else values


def logistic(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ weights[1:] + weights[0], -30, 30)))


def fit_logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps on the ridge-regularised likelihood."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """True for the documents that no label is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS,
                    most_chars: int = SAMPLE_CHARS) -> list[tuple[bytes, int]]:
    """Bounded training texts: per class the first ``rows`` labelled ids in hash order, found in ``docs``."""
    known = labels.select("doc_id", F.col(label).alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [x for value in (0, 1) for x in known.where(F.col("label") == value).orderBy(*order).limit(rows).collect()]
    if not chosen:
        return []
    chosen = docs.sparkSession.createDataFrame(chosen, known.schema)  # at most 2 * rows ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(
        F.length("text").between(1, most_chars)).dropDuplicates(["doc_id"]).select("text", "label", *order)
    return [(x["text"].encode(), x["label"]) for x in sorted(texts.collect(), key=lambda x: x[2:])]


def fit(sample: list[tuple[bytes, int]]) -> CompressionClassifier:
    """Three fifths of each class make the dictionaries, the rest calibrates."""
    by_class = {v: [x for x, label in sample if label == v] for v in (0, 1)}
    if not by_class[0] or not by_class[1]:
        share = len(by_class[1]) / len(sample) if sample else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionClassifier(b"", b"", np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]), np.zeros(5), np.ones(5), share)
    cut = {v: max(1, len(x) * 3 // 5) for v, x in by_class.items()}
    model = CompressionClassifier(train_dictionary(by_class[1][:cut[1]]), train_dictionary(by_class[0][:cut[0]]),
                                  np.zeros(6), np.zeros(5), np.ones(5))
    rest = {v: x[cut[v]:] or x for v, x in by_class.items()}
    rows = model.features(rest[0] + rest[1])
    labels = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    model.center, model.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    model.weights = fit_logistic((rows - model.center) / model.scale, labels)
    return model


def prior_shift(model: CompressionClassifier, sample: list[tuple[bytes, int]], good: int, bad: int) -> None:
    """Move the calibration from the sample's class shares to the labels' shares."""
    ones = sum(label for _, label in sample)
    if good and bad and 0 < ones < len(sample):
        model.share = good / (good + bad)
        model.weights[0] += np.log(good / bad) - np.log(ones / (len(sample) - ones))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> CompressionClassifier:
    """Classifier of the probability that ``label`` is 1."""
    sample = labelled_sample(docs, labels, label)
    model = fit(sample)
    counts = labels.where(~held_out(F.col("doc_id"))).agg(
        F.count_if(F.col(label) == 1).alias("good"), F.count_if(F.col(label) == 0).alias("bad")).first()
    prior_shift(model, sample, counts["good"], counts["bad"])
    return model


def score(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, probability of label 1 and the decision."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 64 KB

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = shared.value.scores([(x or "").encode() for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "score"])

    rows = common.map_batches(common.documents(docs, id_col, text_col), work, "doc_id long, score double", "text")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: CompressionClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = shared.value.scores([(x or "").encode() for x in batch.column(place).to_pylist()])
        return batch.filter(pa.array(values >= THRESHOLD))

    return common.map_batches(docs, work, docs.schema, text_col)


def quality_scores(spark, folder: str) -> DataFrame:
    """Query op1: score of every document; documents with crc32(doc_id) mod 4 = 2 are never learned from."""
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, folder, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
