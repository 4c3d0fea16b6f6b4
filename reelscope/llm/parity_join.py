"""N-gram Jaccard join by parity sketches: sets of 3-word shingles with a similarity of at least 0.9.

A parity sketch has a bit for each hash value; every shingle flips its bit.  Two sketches differ in at most as many bits as the
sets have different shingles, so their Hamming distance is a lower bound of the symmetric difference, and folding a sketch by
XOR keeps it one.  Sizes are cut into bands.  Linked sets with sizes a and b differ in at most (a + b) / 19 shingles; within a
band that is at most some d, so of d + 1 segments of the sketches at least one is equal (pigeonhole).  A set files its
segments in its own band and, if a larger partner may be there, in the next.  Sets that share a segment are candidates; folded sketches
sort out most, and the sets themselves decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.buckets import components
from reelscope.llm.common import lookup, materialize, mix, table, text_slices
from reelscope.llm.near_dedup import shingles

SHINGLE = 3
#: The least similarity, as a fraction: linked sets share LEAST of OF of their union.
LEAST, OF = 9, 10
#: The sizes of a band reach up to this times its smallest.
BAND = 4 / 3
#: 64-bit words of a folded sketch.
FOLDED = 16
#: Members of a bucket that are compared with as many others in one block.
PART = 256

_FOLDS = [f"f{i}" for i in range(FOLDED)]
_STEP = np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def most_different(sizes: int | np.ndarray) -> int | np.ndarray:
    """The largest symmetric difference of two linked sets whose sizes add up to ``sizes``.

    Sharing s of a union u = a + b - s with OF * s >= LEAST * u leaves a + b - 2 * s.
    """
    return (OF - LEAST) * sizes // (OF + LEAST)


def band_starts(most: int) -> np.ndarray:
    """The smallest size of each band, two bands beyond that of ``most``."""
    starts = [1]
    while len(starts) < 3 or starts[-3] <= most:
        starts.append(max(starts[-1] + 1, int(starts[-1] * BAND)))
    return np.array(starts)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of many texts, sorted text by text, and where each text's begin (n + 1 values)."""
    found, owners = shingles(_LOWER[data], offsets, SHINGLE)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
    found, owners = found[fresh], owners[fresh]
    return found, np.searchsorted(owners, np.arange(len(offsets)))


def parity(tokens: np.ndarray, owners: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Sketches of many sets, one after the other, ``segments[i]`` 64-bit words for set i: every token flips a bit."""
    firsts = np.concatenate([[0], np.cumsum(segments)])
    spot = mix(tokens)
    segment = ((spot >> np.uint64(32)) * segments[owners].astype(np.uint64)) >> np.uint64(32)
    bit = (firsts[owners] + segment.astype(np.int64)) * 64 + (spot & np.uint64(63)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(firsts[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def set_keys(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 bits a set (n x 2 words), from its tokens in any order and its size."""
    sizes = np.diff(starts)
    keys = np.zeros((len(sizes), 2), np.uint64)
    full = sizes > 0
    if full.any():
        firsts = starts[:-1][full]
        keys[full, 0] = np.add.reduceat(mix(tokens ^ _STEP), firsts)
        keys[full, 1] = np.bitwise_xor.reduceat(mix(tokens + _STEP), firsts)
    keys[:, 1] ^= mix(sizes.astype(np.uint64))
    return keys


def filed_segments(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which each set is filed, and where each set's begin: a hash of (band, segment, its 64 bits).

    An empty segment says little, and most sets have none.  Of p segments at most d differ, so if fewer than p - d
    segments of one of two linked sets are empty, they share one that isn't.  p is d + 2, so only sets
    with two empty segments or more file those.
    """
    sizes = np.diff(starts)
    bands = band_starts(int(sizes.max(initial=0)))
    ends = bands[1:] - 1
    own = np.searchsorted(bands, sizes, side="right") - 1
    full = sizes > 0
    up = full & (sizes * OF // LEAST > ends[own])  # a larger partner may be in the next band
    sets = np.concatenate([np.flatnonzero(full), np.flatnonzero(up)])
    if len(sets) == 0:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    band = np.concatenate([own[full], own[up] + 1])
    allowed = most_different(2 * ends[band])  # neither of two sets filed in a band is larger than its end
    segments = np.where(allowed == 0, 1, allowed + 2)
    counts = sizes[sets]
    owners = np.repeat(np.arange(len(sets)), counts)
    places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[sets], counts)
    sketch = parity(tokens[places], owners, segments)
    holder = np.repeat(np.arange(len(sets)), segments)
    number = np.arange(len(holder)) - np.repeat(np.cumsum(segments) - segments, segments)
    empty = sketch == 0
    empties = np.bincount(holder, weights=empty, minlength=len(sets))
    kept = ~empty | (empties >= segments - allowed)[holder]
    holder, number, sketch = holder[kept], number[kept], sketch[kept]
    keys = mix(sketch ^ mix((band[holder].astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64)))
    order = np.argsort(sets[holder], kind="stable")
    return keys[order], np.searchsorted(sets[holder][order], np.arange(len(starts)))


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of two 64-bit words as binary values of 16 bytes."""
    ends = np.arange(len(words) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(
        pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(words))]
    )


def _longs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(batches):
    """(doc_id, text) to (doc_id, key, size, filed, f0 …)."""
    for batch, data, offsets in text_slices(batches, "text"):
        tokens, starts = shingle_sets(data, offsets)
        sizes = np.diff(starts)
        filed, firsts = filed_segments(tokens, starts)
        owners = np.repeat(np.arange(len(sizes)), sizes)
        folded = parity(tokens, owners, np.full(len(sizes), FOLDED)).view(np.int64).reshape(-1, FOLDED)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), _binary(set_keys(tokens, starts)), pa.array(sizes, pa.int64()), _longs(filed, firsts),
             *[pa.array(np.ascontiguousarray(folded[:, i])) for i in range(FOLDED)]],
            names=["doc_id", "key", "size", "filed", *_FOLDS],
        )


def _read_sets(batches):
    """(unit, key, text) to (unit, bag): the sets of the texts that have the key."""
    for batch, data, offsets in text_slices(batches, "text"):
        tokens, starts = shingle_sets(data, offsets)
        keys = np.ascontiguousarray(set_keys(tokens, starts))
        wanted = [i for i, key in enumerate(batch.column(1).to_pylist()) if keys[i].tobytes() == key]
        bags = [tokens[starts[i]: starts[i + 1]].view(np.int64) for i in wanted]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(wanted, pa.int64())), pa.array(bags, pa.list_(pa.int64()))], names=["unit", "bag"]
        )


def _likely(x: str, y: str) -> Column:
    """Whether sizes and folded sketches of two sides leave a link possible."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    bits = sum(F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}"))) for f in _FOLDS)
    return (F.least(a, b) * OF >= F.greatest(a, b) * LEAST) & (bits * (OF + LEAST) <= (a + b) * (OF - LEAST))


def _verified(docs: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``u, v``) whose sets are linked; the sets are read again from the texts of these units only.

    The texts meet the units in a shuffle at every size, so nothing that grows with the data is broadcast.
    """
    ends = pairs.select(F.col("u").alias("unit")).unionByName(pairs.select(F.col("v").alias("unit"))).distinct()
    asked = units.join(ends.hint("shuffle_hash"), "unit", "left_semi").select("unit", "key", F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", "text").hint("merge").join(asked, "doc_id").select("unit", "key", "text")
    sets = materialize(
        texts.mapInArrow(_read_sets, "unit long, bag array<bigint>").dropDuplicates(["unit"]), "parity-sets"
    )
    left = sets.select(F.col("unit").alias("u"), F.col("bag").alias("x"))
    right = sets.select(F.col("unit").alias("v"), F.col("bag").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    linked = shared * OF >= (F.size("x") + F.size("y") - shared) * LEAST
    return pairs.hint("merge").join(left, "u").hint("merge").join(right, "v").where(linked).select("u", "v")


def _compare(batches):
    """Pairs of parts of a bucket (same, and both parts' unit, class, size and sketch arrays) to likely pairs ``u, v``."""
    for batch in batches:
        for row in range(batch.num_rows):
            sides = []
            for at in (1, 5):
                unit, kind, size, words = (batch.column(c)[row].values.to_numpy() for c in range(at, at + 4))
                sides.append((unit, kind, size, words.view(np.uint64).reshape(-1, FOLDED)))
            (u, c, a, x), (v, d, b, y) = sides
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(len(u)):
                bits = np.bitwise_count(y ^ x[i]).sum(axis=1, dtype=np.int64)
                fits = (bits * (OF + LEAST) <= (a[i] + b) * (OF - LEAST)) & (d != c[i])
                fits &= np.minimum(a[i], b) * OF >= np.maximum(a[i], b) * LEAST
                if batch.column(0)[row].as_py():
                    fits[: i + 1] = False
                near = np.flatnonzero(fits)
                found.append((np.full(len(near), u[i]), v[near]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                names=["u", "v"],
            )


def _open_pairs(held: DataFrame, classes: DataFrame, folded: DataFrame) -> DataFrame:
    """Likely pairs of different classes in the buckets that hold several: every such pair of members meets once.

    A bucket is dealt into parts of about 256 members by a hash, and each pair of parts is a row of its own, so the
    comparisons within a large bucket are spread over the tasks; only likely pairs come out.
    """
    known = held.join(classes, "unit", "left").select("filed", "unit", F.coalesce("class", "unit").alias("class"))
    several = known.groupBy("filed").agg(
        F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("n")
    ).where("least != most").select("filed", F.ceil(F.col("n") / PART).alias("parts"))
    member = F.struct("unit", "class", "size", F.array(*_FOLDS).alias("words"))
    parts = materialize(
        known.join(several, "filed").join(folded, "unit")
        .withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")))
        .groupBy("filed", "part").agg(F.collect_list(member).alias("held"))
        .select("filed", "part", F.col("held.unit").alias("unit"), F.col("held.class").alias("class"),
                F.col("held.size").alias("size"), F.flatten("held.words").alias("words")), "parity-parts",
    )
    heads = parts.select("filed", "part")
    pairs = heads.join(heads.select("filed", F.col("part").alias("other")), "filed").where("part <= other")
    columns = ["unit", "class", "size", "words"]
    left = parts.select("filed", "part", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = parts.select("filed", F.col("part").alias("other"), *[F.col(c).alias(f"{c}_b") for c in columns])
    met = pairs.join(left, ["filed", "part"]).join(right, ["filed", "other"])
    shown = [f"{c}_a" for c in columns] + [f"{c}_b" for c in columns]
    return met.select(F.col("part") == F.col("other"), *shown).mapInArrow(_compare, "u long, v long").distinct()


def _links(docs: DataFrame, units: DataFrame) -> DataFrame:
    """The classes (``unit, class``) of all units that are linked with another.

    In every bucket all members first meet one pivot, the member whose buckets are the fullest, which is the likely
    original of copies; links merge classes.  Then all members of different classes meet in the buckets that still hold
    several.  So every two members of a bucket have been compared or are in one class already.
    """
    spread = units.select("unit", F.explode("filed").alias("filed"))
    fullness = spread.groupBy("filed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(spread.join(fullness, "filed"), "parity-held")
    weights = held.groupBy("unit").agg(F.sum("n").alias("weight"))
    pivots = held.join(weights, "unit").groupBy("filed").agg(F.max_by("unit", "weight").alias("pivot"))
    asked = held.join(pivots, "filed").where("unit != pivot").select(
        F.least("unit", "pivot").alias("u"), F.greatest("unit", "pivot").alias("v")
    ).distinct()
    folded = units.select("unit", "size", *_FOLDS)
    sides = [folded.select(F.col("unit").alias(name), F.struct("size", *_FOLDS).alias(f"_{name}")) for name in "uv"]
    likely = materialize(
        asked.join(sides[0], "u").join(sides[1], "v").where(_likely("_u", "_v")).select("u", "v"), "parity-pairs"
    )
    links = _verified(docs, units, likely)
    classes = materialize(components(links), "parity-classes")
    more = materialize(_open_pairs(held, classes, folded), "parity-pairs")
    if more.isEmpty():
        return classes
    links = _verified(docs, units, more)
    stars = classes.select(F.col("unit").alias("u"), F.col("class").alias("v"))
    return materialize(components(stars.unionByName(links)), "parity-classes")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set is that of its distinct 3-word shingles, A-Z lower-cased, words being anything but the six ASCII
    white-space characters; one or two words are one shingle.  Two documents are linked if their sets share at least
    nine tenths of the union; ``component_id`` is the smallest id that links lead to.  A text without words (null,
    empty, blank) has no shingle and no link, so its component is itself.  Copies, also repeated rows, are linked and never compared.  A
    text of which no copy has an id is linked to its copies only, and has no component id.  Rows of one id with
    different texts are documents of their own.  An empty table gives an empty result; other columns aren't read.
    No link is lost: the sketches only sort out pairs that can't be linked.
    """
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    folds = ", ".join(f"{f} long" for f in _FOLDS)
    signed = materialize(
        given.mapInArrow(_sign, f"doc_id {kind}, key binary, size long, filed array<bigint>, {folds}"), "parity-signed"
    )
    units = materialize(
        signed.where("size > 0").groupBy("key", "size").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("filed").alias("filed"),
            *[F.first(f).alias(f) for f in _FOLDS],
        ).withColumn("unit", F.monotonically_increasing_id()), "parity-units",
    )
    whole = materialize(
        units.select("unit", "key", "n", "rep").join(_links(given, units), "unit", "left")
        .select("key", "n", "rep", F.coalesce("class", "unit").alias("class")), "parity-whole",
    )
    names = whole.groupBy("class").agg(F.min("rep").alias("component_id"))
    answers = materialize(whole.join(names, "class").select("key", "n", "component_id"), "parity-answers")
    ids = signed.select("doc_id", "key", F.col("size").alias("n_shingles"))
    full = lookup(ids.where("n_shingles > 0"), answers, "key", "n").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(
        ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def op12_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM given
), units AS (
  SELECT row_number() OVER () AS u, s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
), parts AS (SELECT u, n, unnest(s) AS t FROM units),
links AS (
  SELECT a.u AS a, b.u AS b FROM parts a JOIN parts b ON a.t = b.t AND a.u <> b.u
   AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.u, b.u HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT u AS a, u AS b FROM units UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), named AS (SELECT r.a AS u, min(x.rep) AS component_id FROM reach r JOIN units x ON x.u = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE n.component_id END AS component_id
FROM sets s LEFT JOIN units x ON x.s = s.s LEFT JOIN named n ON n.u = x.u
"""
