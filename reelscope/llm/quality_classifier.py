"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import SPACES, byte_kinds, mix, table, text_slices, word_hashes

BITS = 18
SAMPLE_ROWS = 6000
EPOCHS = 3
THRESHOLD = 0.3
HELD_OUT = 5

_LETTERS = bytes([*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(128, 256)])
#: Words are runs of letters and digits, or runs of signs; white space is dropped.
_KINDS = byte_kinds(SPACES.encode(), _LETTERS)
_AGAIN = np.uint64(0xA076_1D64_78BD_642F)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``HELD_OUT``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT


def ngram_slots(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the word 1-grams and 2-grams of many texts, text after text, and the text of each slot.

    A 2-gram of a word and itself is one gram whatever the word, so stuttering texts look alike.
    """
    words, first = word_hashes(data, offsets, _KINDS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    mask = np.uint64((1 << bits) - 1)
    pair = owner[1:] == owner[:-1]
    left, right = words[:-1][pair], words[1:][pair]
    grams = np.where(left == right, _AGAIN, mix(left * np.uint64(3) + right))
    return (np.concatenate([words & mask, mix(grams) & mask]).astype(np.int64),
            np.concatenate([owner, owner[:-1][pair] if len(owner) else owner]))


def feature_rows(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct slots and their values (count over the root of the number of grams)."""
    slots, owner = ngram_slots(data, offsets, bits)
    out = []
    order = np.argsort(owner, kind="stable")
    slots, bounds = slots[order], np.searchsorted(owner[order], np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        which, count = np.unique(slots[a:b], return_counts=True)
        out.append((which, count / np.sqrt(max(b - a, 1))))
    return out


class Ftrl:
    """Follow the regularised leader (proximal) for logistic regression; slot ``size`` is the intercept."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled training texts (``doc_id, quality, text``), chosen by a hash of the id.

    Rows whose id falls in the held-out fifth, and rows without a label, are never chosen.  An id with two labels has
    the larger one.  The chosen ids are a bounded list, so the texts are found without moving the documents.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from a bounded sample: slots are counted on the executors, the updates run over at most ``rows`` texts.

    Without labelled rows all weights are 0, so every score is 0.5.
    """

    def featurize(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            found = feature_rows(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float32()))],
                names=["doc_id", "quality", "slots", "vals"],
            )

    sample = labelled_sample(docs, labels, rows).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"
    )
    got = sample.mapInArrow(featurize, "doc_id string, quality int, slots array<int>, vals array<float>").toArrow()
    model = Ftrl(1 << BITS)
    order = np.argsort(np.array([hash_text(x) for x in got.column("doc_id").to_pylist()], dtype=np.uint64), kind="stable")
    slots, vals = got.column("slots").combine_chunks(), got.column("vals").combine_chunks()
    quality = got.column("quality").to_pylist()
    for _ in range(epochs):
        for i in order.tolist():
            at = np.append(slots[i].values.to_numpy(), 1 << BITS)
            model.update(at, np.append(vals[i].values.to_numpy(), 1.0), float(quality[i] > 0))
    return model.weights()


def hash_text(text: str) -> int:
    """A fixed order for training rows, whatever the partitions."""
    import zlib

    return zlib.crc32(text[::-1].encode()) << 32 | zlib.crc32(text.encode())


def score_batches(weights):
    """A function for ``mapInArrow`` over (key, held_out, text): adds the score; ``weights`` is a broadcast."""

    def run(batches):
        w = weights.value
        for batch, data, offsets in text_slices(batches, "text"):
            slots, owner = ngram_slots(data, offsets)
            n = len(offsets) - 1
            total = np.bincount(owner, weights=w[slots], minlength=n)
            grams = np.bincount(owner, minlength=n)
            logit = total / np.sqrt(np.maximum(grams, 1)) + w[-1]
            score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(score)], names=[*[x for x in batch.schema.names if x != "text"], "score"]
            )

    return run


def quality_scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; null and empty texts get the intercept's score.

    Only the text enters a score.  Repeated rows are scored row by row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select("doc_id", (remainder() == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score_batches(shared), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents predicted to be of label 1, with their columns; only the texts go to the Python workers, and none comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    score = score_batches(shared)

    @F.arrow_udf("boolean")
    def good(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [x.column(0).to_numpy() for x in score([pa.RecordBatch.from_arrays([texts], names=["text"])])]
            yield pa.array(np.concatenate([np.empty(0), *found]) >= THRESHOLD)

    return docs.where(good(F.col("text").cast("string")))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
