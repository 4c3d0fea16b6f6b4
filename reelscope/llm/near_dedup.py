"""Near-duplicate documents by BagMinHash: weighted Jaccard of 5-word shingle multisets, banded and verified.

The weights (how often a shingle occurs) are cut into unit levels, and the levels into intervals [0, 1), [1, 2), [2, 4),
[4, 8) …  For each interval that reaches below an element's weight, a Poisson process of that interval's rate yields points in
ascending order; each point falls to one signature component and, by halving the interval, to one level.  A point
counts if its level lies below the weight.  A component keeps its smallest point, so two multisets agree in a
component with a probability of exactly their weighted Jaccard similarity.  A document stops drawing points
once they lie beyond its largest component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.buckets import linked_classes, read_sets
from reelscope.llm.common import (
    BLANK_WORDS, lookup, materialize, measured_joins, mix, single_spaced, small_batches, table, text_slices, word_hashes,
)

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
BAND_ROWS = 5
#: Pairs whose marks (8 bits a component, 1280 in all) differ in more bits are not verified.  At a similarity of 0.8, 128 bits
#: differ on average with a standard deviation of 22, so this is five deviations off.
MOST_BITS = 240
#: Bytes of text whose shingles a worker holds at once: at its peak it has nearly 30 times as much.
SLICE = 1 << 20

_STEP = np.uint64(0xD1B54A32D192ED03)
_PIECE = np.uint64(0x8CB92BA72F3D8DD7)
_ALL = (1 << 64) - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of many texts and the text of each.

    A text of fewer words is one shingle; a text without words has none.
    """
    words, first = word_hashes(data, offsets, BLANK_WORDS)
    counts = np.diff(first)
    n = len(words)
    found, owners = [], []
    whole = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        whole = mix(whole * np.uint64(31) + words[k: k + len(whole)])
    owner = np.repeat(np.arange(len(counts)), counts)
    if n >= size:
        inside = owner[size - 1:] == owner[: n - size + 1]
        found.append(whole[inside])
        owners.append(owner[: n - size + 1][inside])
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            own = np.full(len(short), np.uint64(length))
            for k in range(length):
                own = mix(own * np.uint64(31) + words[first[short] + k])
            found.append(own)
            owners.append(short)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def bags(elements: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, element) with their counts, in order; elements keep 53 bits, owners must be below 2048."""
    keys = np.sort((owners.astype(np.uint64) << np.uint64(53)) | (elements >> np.uint64(11)))
    if len(keys) == 0:
        return owners, keys, np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    weights = np.diff(np.append(starts, len(keys)))
    keys = keys[starts]
    return (keys >> np.uint64(53)).astype(np.int64), keys & np.uint64((1 << 53) - 1), weights


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n rows of ``size`` components) of n multisets with positive integer weights."""
    least = np.full(n * size, np.inf)
    if len(owner) == 0:
        return least.reshape(n, size)
    owners, seeds, lows, lengths, tops = [], [], [], [], []
    low, length, piece = 0, 1, 0
    while True:
        has = np.flatnonzero(weight > low)
        if len(has) == 0:
            break
        owners.append(owner[has])
        seeds.append(mix(element[has] + np.uint64(int(_PIECE) * piece & _ALL)))
        lows.append(np.full(len(has), low, np.int64))
        lengths.append(np.full(len(has), length, np.int64))
        tops.append(weight[has])
        low, length, piece = low + length, max(length, low + length), piece + 1
    owner, seed, low_ = np.concatenate(owners), np.concatenate(seeds), np.concatenate(lows)
    length_, top = np.concatenate(lengths), np.concatenate(tops)
    point = np.zeros(len(owner))
    limit = np.full(n, np.inf)
    step = 0
    while len(owner):
        step += 1
        draw = mix(seed + np.uint64(int(_STEP) * step & _ALL))
        point = point - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / length_
        draw = mix(draw)
        part = (((draw >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        level = low_ + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % length_
        below = (level < top) & (point < limit[owner])
        np.minimum.at(least, owner[below] * size + part[below], point[below])
        if len(owner) > n:
            limit = least.reshape(n, size).max(axis=1)
        else:
            left = np.unique(owner)
            limit[left] = least.reshape(n, size)[left].max(axis=1)
        on = point < limit[owner]
        owner, seed, low_, length_, top, point = owner[on], seed[on], low_[on], length_[on], top[on], point[on]
    return least.reshape(n, size)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band, different from band to band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _PIECE, bits.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(31) + bits[:, :, k])
    return keys.view(np.int64)


def as_set(elements: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: the k-th occurrence of an element is an element of its own.  Sorted by owner."""
    order = np.lexsort((elements, owners))
    elements, owners = elements[order], owners[order]
    n = len(elements)
    if n == 0:
        return elements, owners
    fresh = np.append(True, (elements[1:] != elements[:-1]) | (owners[1:] != owners[:-1]))
    starts = np.flatnonzero(fresh)
    turn = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return np.where(turn == 0, elements, mix(elements + turn.astype(np.uint64) * _PIECE)), owners


def _word_key(text: bytes) -> bytes:
    """128-bit hash of the words of a text."""
    return hashlib.md5(b" ".join(text.split()), usedforsecurity=False).digest()


WORDS = BANDS * BAND_ROWS // 8
_MARKS = [f"m{i}" for i in range(WORDS)]


def _sign(batches):
    """(doc_id, text) to (doc_id, key, bands, m0 …): eight bits of each component, packed into longs."""
    for batch, data, offsets in text_slices(batches, "text", SLICE):
        n = len(offsets) - 1
        found, owners = shingles(data, offsets)
        owner, element, weight = bags(found, owners)
        signatures = bag_minhash(owner, element, weight, n, BANDS * BAND_ROWS)
        full = np.bincount(owner, minlength=n) > 0
        keys = band_keys(signatures)
        marks = (mix(signatures.view(np.uint64)) >> np.uint64(56)).astype(np.uint8).view(np.int64)
        raw = data.tobytes()
        texts = [_word_key(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()),
             pa.array([k if f else [] for k, f in zip(list(keys), full)], pa.list_(pa.int64())),
             *[pa.array(np.ascontiguousarray(marks[:, i])) for i in range(WORDS)]],
            names=["doc_id", "key", "bands", *_MARKS],
        )


def _texts_to_sets(batches):
    """(unit, key, text) to (unit, bag): the shingles as a set, where the text is the one that has the key."""
    for batch, data, offsets in text_slices(batches, "text", SLICE):
        found, owners = as_set(*shingles(data, offsets))
        cuts = np.searchsorted(owners, np.arange(len(offsets)))
        raw = data.tobytes()
        rows = [
            (unit, found[cuts[i]: cuts[i + 1]].view(np.int64))
            for i, (unit, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if _word_key(raw[offsets[i]: offsets[i + 1]]) == key
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))],
            names=["unit", "bag"],
        )


def _fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the packed marks of two sides differ in at most ``MOST_BITS`` bits."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= MOST_BITS


def _linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the exact multiset similarity is at least 0.8: nine overlaps against four sums of sizes."""
    return shared * 9 >= (a + b) * 4


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    Documents are linked if the weighted Jaccard similarity of their multisets of 5-word shingles (words: anything
    but the six ASCII white-space characters) is at least 0.8; a class is a connected component, named by its smallest
    id, whose document stays.  Texts with the same words are one unit from the start: copies are never compared.  A
    text of one to four words is one shingle.  Texts without words (null, empty, blank) are copies of each other.
    Repeated rows are copies; each row of the smallest id says ``kept``.  A text without any id is linked to
    copies only.  An empty table gives an empty result; only the id and the text are read.

    Two linked texts miss each other in all 32 bands of 5 components with a probability below 4e-6.
    """
    return _judged(docs).select("doc_id", "class_id", "class_size", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """:func:`near_duplicates` with the key of the words, and the one key among those of the class's smallest id that stays."""
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession), measured_joins(docs.sparkSession):
        kind = given.schema["doc_id"].dataType.simpleString()
        signed = materialize(
            given.mapInArrow(
                _sign, f"doc_id {kind}, key binary, bands array<bigint>, " + ", ".join(f"{m} long" for m in _MARKS)
            ), "near-signed",
        )
        units = materialize(
            signed.groupBy("key").agg(
                F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"),
                *[F.first(m).alias(m) for m in _MARKS],
            ).withColumn("unit", F.monotonically_increasing_id()),
            "near-units",
        )
        classes = linked_classes(
            units.select("unit", F.explode("bands").alias("filed")), units.select("unit", F.array(*_MARKS).alias("sign")),
            _fits, lambda asked: read_sets(given, units, asked, _texts_to_sets), _linked,
        )
        whole = units.select("unit", "key", "n", "rep").join(classes, "unit", "left").withColumn(
            "class", F.coalesce("class", "unit")
        )
        whole = materialize(whole, "near-whole")
        names = whole.groupBy("class").agg(
            F.min("rep").alias("class_id"), F.sum("n").alias("class_size"),
            F.min_by("key", F.struct(F.col("rep").isNull(), "rep", "key")).alias("kept_key"),
        )
        answers = materialize(
            whole.join(names, "class").select("key", "n", "class_id", "class_size", "kept_key"), "near-answers"
        )
    found = lookup(signed.select("doc_id", "key"), answers, "key", "n")
    return found.select(
        "doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "key", "kept_key"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: one row of each class, also where an id has several rows.

    Rows are told apart by id and words, so different texts under one id are judged each by its own class.  Of documents
    without an id, one row of each text stays.
    """
    found = _judged(docs)
    stays = F.col("kept") & (F.col("key") == F.col("kept_key"))
    ids = materialize(found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(stays.cast("int")).alias("stay")
    ).where("rows > 1 or stay = 0 or doc_id is null"), "near-ids")
    gone = ids.where("stay = 0").select("doc_id")
    named = docs.where("doc_id is not null")
    left = named.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")  # one plan at every size
    often = ids.where("stay > 0 and doc_id is not null").where("rows > 1").select("doc_id").hint("merge")
    nameless = ids.where("doc_id is null and stay > 0")
    key = "_key"
    while key in docs.columns:
        key += "_"
    words = F.unhex(F.md5(F.trim(single_spaced())))  # as _word_key
    if not often.isEmpty():
        once = left.join(often, "doc_id", "left_anti")
        several = named.join(often, "doc_id", "left_semi").withColumn(key, words)
        kept = found.where(stays).join(often, "doc_id", "left_semi").select("doc_id", F.col("key").alias(key)).distinct()
        several = several.join(kept.hint("merge"), ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        left = once.unionByName(several.drop(key))
    if not nameless.isEmpty():
        kept = found.where(stays).where("doc_id is null").select(F.col("key").alias(key)).distinct()
        several = docs.where("doc_id is null").withColumn(key, words).join(kept.hint("merge"), key, "left_semi").dropDuplicates([key])
        left = left.unionByName(several.drop(key))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
