"""Helpers shared by the corpus operators: tables, byte-level words, heavy-key lookups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.sources.tables import materialize

__all__ = [
    "materialize", "table", "plain_text", "single_spaced", "lookup", "small_batches", "measured_joins", "text_slices", "word_hashes",
    "mix",
]

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_CHUNK = 1 << 20
#: A table of answers of up to so many rows, counted, is broadcast.
FEW = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def single_spaced(column: str = "text") -> Column:
    return F.regexp_replace(plain_text(column), SPACE_CLASS, " ")


def lookup(rows: DataFrame, answers: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``answers`` (unique ``key``), safe for a key that most rows have.

    ``size`` says how many rows have the key.  Keys with at least 1/``share`` of all rows, so at most
    ``share`` of them, are broadcast and their rows don't move; the others go through a shuffle join in which no key
    has more than 1/``share`` of the rows, unless ``answers`` has at most ``FEW`` rows.  ``rows`` and ``answers`` are read
    twice: pass written tables.
    """
    total, n = answers.agg(F.sum(size), F.count(F.lit(1))).first()
    total = total or 0
    hot = answers.where(F.col(size) * share >= F.lit(total))
    near = rows.join(F.broadcast(hot), key)
    rest = answers.where(F.col(size) * share < F.lit(total))
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        F.broadcast(rest) if n <= FEW else rest.hint("merge"), key, "left"
    )
    return near.unionByName(far)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs that run inside hand their Python workers about ``size`` at once, not Spark's 64 MB; then the setting is put back.

    A batch lies in the executor outside its heap, up to twice while it grows, and again in the worker.
    """
    with _settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size}):
        yield


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside broadcast a side of a join only by its size in a shuffle, as it is measured there.

    Spark's guess from files takes compressed bytes for rows and an array for one element, so what is exploded from a small
    file passes for small.  A frame that is read after the block needs hints of its own.
    """
    size = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    most = spark.conf.get(size[1], None) or spark.conf.get(size[0])
    with _settings(spark, {size[0]: "-1", size[1]: most}):
        yield


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 2048
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices of about ``max_bytes`` of text: (rows, bytes, offsets).

    A null text is empty.  A text longer than ``max_bytes`` is a slice of its own.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), start + max_rows, len(texts))
            offsets = ends[start: stop + 1]
            yield batch.slice(start, stop - start), data[offsets[0]: offsets[-1]], offsets - offsets[0]
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to whole arrays."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept per worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, and the number of the first word of each text (n + 1 values).

    ``kinds`` gives each byte a class; a word is a longest run of one class other than 0 within a text.
    The hash of a word is a polynomial over its bytes, read off running sums, so there is no loop over words.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = kinds[data]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    runs = np.flatnonzero(fresh)
    stops = np.append(runs[1:], n)
    real = kind[runs] != 0
    starts, stops = runs[real], stops[real]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(int(np.searchsorted(stops, base + _CHUNK, side="right")), at + 1)
        end = int(stops[upto - 1])
        up, down = _power_tables(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = starts[at:upto] - base, stops[at:upto] - base
        hashes[at:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _GOLDEN)
        at = upto
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def byte_kinds(*classes: bytes | range) -> np.ndarray:
    """A class number for each byte value: 0 for the first argument, 1 for the second …; the last for all others."""
    kinds = np.full(256, len(classes), np.uint8)
    for number, members in reversed(list(enumerate(classes))):
        kinds[list(members)] = number
    return kinds


#: Words as longest runs of anything but white space.
BLANK_WORDS = byte_kinds(SPACES.encode())
