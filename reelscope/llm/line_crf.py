"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

A line's observation is a handful of binned measures of its bytes.  The weights are trained here from
document labels: lines of good documents are content; which lines of bad documents are boilerplate is hidden and is
found by alternating decoding and training.  Viterbi decoding labels the lines of a document; the share of words in
content lines decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import table
from reelscope.llm.quality_classifier import hash_text, labelled_sample

SAMPLE_ROWS = 3000
SAMPLE_LINES = 200_000
ROUNDS = 3
EPOCHS = 4
MIN_WORDS = 50
#: Contract values of the base rule.
REPEAT_PERCENT = 50

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_SIGNS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"()-?!")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SHOUTS = b"!?"

#: Upper edges of the bins of each measure.
_SHARE = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4)
MEASURES = {
    "signs": _SHARE, "pipes": _SHARE, "shouts": _SHARE, "digits": _SHARE, "upper": (0.01, 0.05, 0.1, 0.2, 0.4, 0.7),
    "stutter": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4), "distinct": (0.2, 0.4, 0.6, 0.8, 0.9, 0.99),
    "words": (0, 1, 2, 4, 8, 16, 64, 256), "mean_word": (2, 3, 4, 5, 6, 8, 12, 20), "repeated": (0.5,),
}
_STARTS = np.cumsum([0, *[len(x) + 1 for x in MEASURES.values()]])
SIZE = int(_STARTS[-1])
_EDGES = [np.array(x, dtype=float) for x in MEASURES.values()]
CONTENT, BOILERPLATE = 0, 1


@dataclass
class Crf:
    """Weights: ``unary[state, bin]``, ``move[from, to]``, ``first[state]``; a document needs ``share`` of content."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((2, SIZE)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    share: float = 0.5

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Score of each state at each line."""
        return self.unary[:, bins].sum(axis=2).T

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """The most probable labels (Viterbi); of equal paths the one with content."""
        if len(bins) == 0:
            return np.zeros(0, np.int8)
        scores = self.scores(bins).tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        c, b = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for sc, sb in scores[1:]:
            from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
            back.append((from_c, from_b))
            c, b = (c + cc if from_c else b + bc) + sc, (c + cb if from_b else b + bb) + sb
        state = CONTENT if c >= b else BOILERPLATE
        labels = [state]
        for step in reversed(back):
            state = CONTENT if step[state] else BOILERPLATE
            labels.append(state)
        return np.array(labels[::-1], np.int8)

    def gradient_step(self, bins: np.ndarray, labels: np.ndarray, rate: float) -> None:
        """One step up the log-likelihood of a document's labels (forward and backward sums in log space)."""
        s = self.scores(bins)
        n = len(s)
        ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
        ahead[0] = self.first + s[0]
        for i in range(1, n):
            ahead[i] = s[i] + np.logaddexp(ahead[i - 1, 0] + self.move[0], ahead[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            x = s[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(self.move[:, 0] + x[0], self.move[:, 1] + x[1])
        total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
        error = -np.exp(ahead + behind - total)
        first = error[0].copy()
        error[np.arange(n), labels] += 1
        first[labels[0]] += 1
        for state in (0, 1):
            np.add.at(self.unary[state], bins.ravel(), np.repeat(rate * error[:, state], bins.shape[1]))
        self.first += rate * first
        if n > 1:
            joint = ahead[:-1, :, None] + self.move[None] + (s[1:] + behind[1:])[:, None, :] - total
            move = -np.exp(joint).sum(axis=0)
            np.add.at(move, (labels[:-1], labels[1:]), 1.0)
            self.move += rate * move


def measure(text: bytes) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The base counts of a text, the bins of its lines with words (one row each), and their word counts."""
    words = text.split()
    n = len(words)
    base = {
        "n_words": n,
        "word_chars": len(text.translate(None, SPACES).decode("utf-8", "replace")),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": 0,
        "n_repeat_words": _repeated_words(words),
    }
    values, counts, seen, at = [], [], set(), 0
    for line in text.split(b"\n"):
        own = line.split()
        k = len(own)
        if not k:
            continue
        again = line in seen
        seen.add(line)
        base["n_dup_lines"] += again
        size = len(line)
        letters = size - line.count(b" ")
        values.append((
            (size - len(line.translate(None, _SIGNS))) / size, line.count(b"|") / k,
            (size - len(line.translate(None, _SHOUTS))) / size, (size - len(line.translate(None, _DIGITS))) / size,
            (size - len(line.translate(None, _UPPER))) / size,
            sum(map(bytes.__eq__, own, own[1:])) / k, len(set(own)) / k, k, letters / k, float(again),
        ))
        counts.append(k)
        at += k
    if not values:
        return base, np.zeros((0, len(_EDGES)), np.int64), np.zeros(0, np.int64)
    table_ = np.array(values)
    bins = np.stack([np.searchsorted(e, table_[:, i]) + _STARTS[i] for i, e in enumerate(_EDGES)], axis=1)
    return base, bins, np.array(counts, np.int64)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand twice or more in the text, the first place included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    m = len(numbers)
    if m < 2_000_000:
        keys = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    else:  # beyond 63 bits: number the pairs first
        _, pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
        keys = pairs[:-1] * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift: shift + n - 2] |= hit
    return int(inside.sum())


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> Crf:
    """Fit the field on at most ``rows`` labelled texts (the training fifths only) and ``lines`` of their lines.

    Lines are measured on the executors.  Without texts of both labels nothing is learnt and every line is content.
    """

    def featurize(batches):
        for batch in batches:
            found = [measure((x or "").encode())[1:] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.ravel().tolist() for b, _ in found], pa.list_(pa.int16())),
                 pa.array([c.tolist() for _, c in found], pa.list_(pa.int32()))],
                names=["doc_id", "quality", "bins", "counts"],
            )

    sample = labelled_sample(docs, labels, rows).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"
    )
    got = sample.mapInArrow(featurize, "doc_id string, quality int, bins array<short>, counts array<int>").toArrow()
    examples, held = [], 0
    for row in sorted(got.to_pylist(), key=lambda r: (hash_text(r["doc_id"]), r["bins"])):
        if row["counts"] and held < lines:
            held += len(row["counts"])
            examples.append((
                np.array(row["bins"], np.int64).reshape(len(row["counts"]), -1), np.array(row["counts"]), row["quality"] > 0
            ))
    return fit(examples)


def fit(examples: list[tuple[np.ndarray, np.ndarray, bool]]) -> Crf:
    """Alternate training and decoding; then the content share that parts good from bad documents best."""
    crf = Crf()
    if len({good for *_, good in examples}) < 2:
        return crf
    labels = [np.full(len(bins), CONTENT if good else BOILERPLATE) for bins, _, good in examples]
    for _ in range(ROUNDS):
        share, move, first = crf.share, np.zeros((2, 2)), np.zeros(2)
        crf = Crf(np.zeros((2, SIZE)), move, first, share)
        for epoch in range(EPOCHS):
            for (bins, *_), marks in zip(examples, labels):
                crf.gradient_step(bins, marks, 0.1 / (1 + epoch))
        for i, (bins, _, good) in enumerate(examples):
            if not good:
                found = crf.decode(bins)
                labels[i] = found if found.any() else np.full(len(bins), BOILERPLATE)
    shares = np.array([content_share(crf.decode(bins), counts) for bins, counts, _ in examples])
    good = np.array([g for *_, g in examples])
    edges = np.round(np.arange(0.05, 1.0, 0.05), 2)
    gain = [(shares[good] >= e).mean() * 2 + (shares[~good] < e).mean() for e in edges]
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-9)
    crf.share = float(edges[best[len(best) // 2]])
    return crf


def content_share(labels: np.ndarray, counts: np.ndarray) -> float:
    total = int(counts.sum())
    return float(counts[labels == CONTENT].sum()) / total if total else 0.0


def judge(crf: Crf, text: bytes) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    base, bins, counts = measure(text)
    share = content_share(crf.decode(bins), counts)
    failed = base["n_words"] < MIN_WORDS or 100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"]
    return (*base.values(), failed, not failed and share >= crf.share, share)


_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, content_share double"
)


def quality_rules(docs: DataFrame, crf: Crf) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``content_share`` of every whole text.

    Words are runs of anything but the six ASCII white-space characters.  A null or empty text has no words: it fails the
    base rule.  Lines without a word belong to no label.  Repeated rows are judged row by row; an empty table gives
    an empty result; columns other than the id and the text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch in batches:
            rows = [judge(shared.value, (x or "").encode()) for x in batch.column(1).to_pylist()]
            names = [x.split()[0] for x in _RESULT.split(", ")]
            columns = list(zip(*rows)) or [[] for _ in names]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", *names]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_RESULT}")


def keep_content(docs: DataFrame, crf: Crf) -> DataFrame:
    """The documents that the rules keep, with their columns; only the texts go to the Python workers, and none comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    @F.arrow_udf("boolean")
    def content(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([judge(shared.value, (x.as_py() or "").encode())[6] for x in texts], pa.bool_())

    return docs.where(content(F.col("text").cast("string")))


def line_labels(docs: DataFrame, crf: Crf) -> DataFrame:
    """``doc_id, line, label`` (0 content, 1 boilerplate) of each line with a word; ``line`` counts from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                at = [k for k, line in enumerate(raw.split(b"\n")) if line.split()]
                if at:
                    labels = shared.value.decode(measure(raw)[1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i] * len(at))), pa.array(at, pa.int64()),
                         pa.array(labels.tolist(), pa.int32())], names=["doc_id", "line", "label"],
                    )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line long, label int")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))
