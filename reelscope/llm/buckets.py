"""Units that share a bucket, and the classes that their links make: no bucket is gathered, no group becomes all its pairs.

A unit is filed under several keys; two units are candidates if they share one.  In every bucket all members first meet one
pivot, the member whose buckets are the fullest: in a group of copies that is the likely original.  Links merge classes.  Then
the members of different classes meet in those buckets that still hold several, dealt into parts of bounded size, so that
every two members of a bucket have been compared or are in one class already.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import materialize

#: Members of a bucket that are compared with as many others in one block, and elements of their sets together.
PART = 256
PART_ELEMENTS = 1 << 18
#: Elements that are compared in one product of matrices.
COLUMNS = 1 << 13

#: Whether signatures (arrays whose last axis is a signature of 64-bit words) leave a link possible.
Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Whether sets are linked, from the numbers of shared elements and of each set's own.
Linked = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _short_cuts(batches):
    """Edges (u, v) of a batch to edges from each node to the smallest node of its component within the batch."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        ends = [(x, find(x)) for x in root]
        ends = [(x, r) for x, r in ends if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["u", "v"]
        )


def components(edges: DataFrame) -> DataFrame:
    """``unit, class`` for the nodes of ``u, v`` edges: the smallest node of each connected component.

    Batches of edges become stars first; then alternating large-star and small-star steps, each written, so nothing is
    gathered and no lineage grows, until every node has one edge and no centre has one.
    """
    now = materialize(edges.where("u != v").mapInArrow(_short_cuts, "u long, v long").distinct(), "stars")
    while True:
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("centre"))
        )
        open_ = roles.groupBy("x").agg(F.sum("out").alias("out"), F.max("centre").alias("centre")).where(
            "out > 1 or out = 1 and centre = 1"
        )
        if open_.isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.where("u != v").distinct(), "stars")
    roots = now.select(F.col("v").alias("unit"), F.col("v").alias("class"))
    return now.select(F.col("u").alias("unit"), F.col("v").alias("class")).unionByName(roots).distinct()


def _signatures(lists: pa.Array) -> np.ndarray:
    """Lists of equally many words as rows of a matrix."""
    return lists.flatten().to_numpy().view(np.uint64).reshape(len(lists), -1)


def _compare_pairs(fits: Fits):
    """(u, v, both signatures) to the pairs that fit."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                likely = fits(_signatures(batch.column(2)), _signatures(batch.column(3)))
                yield batch.select([0, 1]).filter(pa.array(likely))

    return run


def _sides(batch: pa.RecordBatch, row: int, at: int) -> list | None:
    """Unit, class and a third array of a part; None where a part meets itself."""
    if not batch.column(at)[row].is_valid:
        return None
    return [batch.column(at)[row].values.to_numpy(), batch.column(at + 1)[row].values.to_numpy(), batch.column(at + 2)[row].values]


def _likely_members(fits: Fits):
    """Pairs of parts of a bucket to ``filed, unit``: the members that fit a member of another class."""
    def run(batches):
        for batch in batches:
            keys, units = [], []
            filed = batch.column(0).to_pylist()
            for row in range(batch.num_rows):
                left, right = _sides(batch, row, 1), _sides(batch, row, 4)
                (u, c, x), (v, d, y) = left, right or left
                x, y = (z.to_numpy().view(np.uint64).reshape(n, -1) for z, n in ((x, len(u)), (y, len(v))))
                likely = (c[:, None] != d[None, :]) & fits(x[:, None, :], y[None, :, :])
                units += [u[likely.any(axis=1)], *([v[likely.any(axis=0)]] if right else [])]
                keys += [np.full(len(found), filed[row]) for found in units[len(keys):]]
            if keys:
                found = np.unique(np.stack([np.concatenate(keys), np.concatenate(units)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(found[:, i]), pa.int64()) for i in (0, 1)], names=["filed", "unit"]
                )

    return run


def shared_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one list shares with each of the other.

    Products of 0/1 matrices over the elements that both lists have, a bounded number of them at a time.
    """
    places = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in (left, right)]
    found = [np.concatenate(sets) if sets else np.empty(0, np.int64) for sets in (left, right)]
    common = np.intersect1d(*found)
    total = np.zeros((len(left), len(right)), np.float32)
    if len(common) == 0:
        return total.astype(np.int64)
    cells = []
    for owner, elements in zip(places, found):
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        has = common[at] == elements
        order = np.argsort(at[has], kind="stable")
        cells.append((at[has][order], owner[has][order]))
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        sides = []
        for (column, owner), n in zip(cells, (len(left), len(right))):
            a, b = np.searchsorted(column, (first, first + width))
            matrix = np.zeros((n, width), np.float32)
            matrix[owner[a:b], column[a:b] - first] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def _linked_parts(linked: Linked):
    """Pairs of parts (unit, class, bag arrays of both) to links ``u, v`` of different classes: a spanning forest of each pair."""
    def run(batches):
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                left, right = _sides(batch, row, 0), _sides(batch, row, 3)
                (u, c, x), (v, d, y) = left, right or left
                x, y = ([z.values.to_numpy() for z in sets] for sets in (x, y))
                shared = shared_elements(x, y)
                a, b = (np.array([len(z) for z in sets]) for sets in (x, y))
                near = (c[:, None] != d[None, :]) & linked(shared, a[:, None], b[None, :])
                edges += zip(u[np.nonzero(near)[0]].tolist(), v[np.nonzero(near)[1]].tolist())
            yield from _short_cuts([pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"]
            )])

    return run


def _linked_pairs(linked: Linked):
    """(u, v, both sets) to the pairs that are linked."""
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            shared = np.array([
                len(np.intersect1d(x[i].values.to_numpy(), y[i].values.to_numpy(), assume_unique=True))
                for i in range(batch.num_rows)
            ], np.int64)
            a, b = (pc.list_value_length(z).to_numpy().astype(np.int64) for z in (x, y))
            yield batch.select([0, 1]).filter(pa.array(linked(shared, a, b), pa.bool_()))

    return run


def _part_pairs(members: DataFrame, columns: list[str], weight: Column, name: str) -> DataFrame:
    """Members (``filed`` and ``columns``) in parts of bounded weight, each pair of parts of a bucket as one row.

    A bucket is dealt into parts by a hash, so the comparisons within a large bucket are spread over the tasks.
    """
    needed = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum(weight) / PART_ELEMENTS))
    sizes = materialize(members.groupBy("filed").agg(needed.alias("parts")), f"{name}-sizes")
    parts = materialize(
        members.join(sizes, "filed").withColumn("part", F.pmod(F.xxhash64("unit"), F.col("parts")))
        .groupBy("filed", "part").agg(F.collect_list(F.struct(*columns)).alias("held"))
        .select("filed", "part", *[F.col(f"held.{c}").alias(c) for c in columns]), name,
    )
    # a part meets itself where it lies; only buckets of several parts are joined
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    alone = parts.select(
        "filed", *[F.col(c).alias(f"{c}_a") for c in columns], *[F.lit(None).cast(kinds[c]).alias(f"{c}_b") for c in columns]
    )
    several = parts.join(sizes.where("parts > 1").select("filed"), "filed", "left_semi")
    heads = several.select("filed", "part")
    pairs = heads.join(heads.select("filed", F.col("part").alias("other")), "filed").where("part < other")
    left = several.select("filed", "part", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = several.select("filed", F.col("part").alias("other"), *[F.col(c).alias(f"{c}_b") for c in columns])
    met = pairs.join(left, ["filed", "part"]).join(right, ["filed", "other"])
    return alone.unionByName(met.select(alone.columns))


def _open_links(
    held: DataFrame, classes: DataFrame, signed: DataFrame, fits: Fits, read: Callable[[DataFrame], DataFrame], linked: Linked
) -> DataFrame:
    """Links (``u, v``) between different classes in the buckets that hold several: every such pair of members meets there.

    Signatures first: only members that fit one of another class go on, with their sets.  No pair leaves a block but the
    links that join classes, so a large group of alike but unlinked texts makes work, not rows.
    """
    known = held.join(classes, "unit", "left").select("filed", "unit", F.coalesce("class", "unit").alias("class"))
    several = known.groupBy("filed").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least != most")
    members = known.join(several.select("filed"), "filed").join(signed, "unit")
    met = _part_pairs(members, ["unit", "class", "sign"], F.lit(0), "bucket-parts")
    shown = [f"{c}_{side}" for side in "ab" for c in ("unit", "class")]
    flat = [F.flatten(f"sign_{side}").alias(f"sign_{side}") for side in "ab"]
    likely = materialize(
        met.select("filed", shown[0], shown[1], flat[0], shown[2], shown[3], flat[1])
        .mapInArrow(_likely_members(fits), "filed long, unit long").distinct().join(known, ["filed", "unit"]), "bucket-likely",
    )
    sets = read(likely.select("unit").distinct())
    met = _part_pairs(likely.join(sets, "unit"), ["unit", "class", "bag"], F.size("bag"), "bucket-set-parts")
    return met.select(*[f"{c}_{side}" for side in "ab" for c in ("unit", "class", "bag")]).mapInArrow(
        _linked_parts(linked), "u long, v long"
    ).distinct()


def linked_classes(
    filed: DataFrame, signed: DataFrame, fits: Fits, read: Callable[[DataFrame], DataFrame], linked: Linked
) -> DataFrame:
    """The classes (``unit, class``) of all units that are linked with another.

    ``filed`` is ``unit, filed``, one row a key, ``signed`` is ``unit, sign`` with an array of longs; ``read`` gives the written
    ``unit, bag`` of some units.  ``filed`` and ``signed`` are read several times: pass written tables.
    """
    fullness = filed.groupBy("filed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(filed.join(fullness, "filed"), "bucket-members")
    weights = held.groupBy("unit").agg(F.sum("n").alias("weight"))
    pivots = held.join(weights, "unit").groupBy("filed").agg(F.max_by("unit", "weight").alias("pivot"))
    asked = held.join(pivots, "filed").where("unit != pivot").select(
        F.least("unit", "pivot").alias("u"), F.greatest("unit", "pivot").alias("v")
    ).distinct()
    sides = [signed.select(F.col("unit").alias(name), F.col("sign").alias(f"sign_{name}")) for name in "uv"]
    met = asked.join(sides[0], "u").join(sides[1], "v").select("u", "v", "sign_u", "sign_v")
    likely = materialize(met.mapInArrow(_compare_pairs(fits), "u long, v long"), "bucket-pairs")
    ends = likely.select(F.col("u").alias("unit")).unionByName(likely.select(F.col("v").alias("unit"))).distinct()
    sets = read(ends)
    both = [sets.select(F.col("unit").alias(name), F.col("bag").alias(f"bag_{name}")) for name in "uv"]
    met = likely.hint("merge").join(both[0], "u").hint("merge").join(both[1], "v").select("u", "v", "bag_u", "bag_v")
    classes = materialize(components(met.mapInArrow(_linked_pairs(linked), "u long, v long")), "bucket-classes")
    more = materialize(_open_links(held, classes, signed, fits, read, linked), "bucket-links")
    if more.isEmpty():
        return classes
    stars = classes.select(F.col("unit").alias("u"), F.col("class").alias("v"))
    return materialize(components(stars.unionByName(more)), "bucket-classes")


def read_sets(docs: DataFrame, units: DataFrame, asked: DataFrame, to_sets) -> DataFrame:
    """``unit, bag`` of the asked units, read again from their texts, written.

    ``units`` has ``unit, key, rep`` (the id of a text).  The texts meet the units in a shuffle at every size, so nothing that grows
    with the data is broadcast; ``to_sets`` turns (unit, key, text) into (unit, bag) where the text is the one of the key.
    """
    wanted = units.select("unit", "key", "rep").join(asked.hint("shuffle_hash"), "unit", "left_semi")
    named = wanted.select("unit", "key", F.col("rep").alias("doc_id")).hint("shuffle_hash")
    texts = docs.select("doc_id", "text").join(named, "doc_id").select("unit", "key", "text")
    return materialize(texts.mapInArrow(to_sets, "unit long, bag array<bigint>").dropDuplicates(["unit"]), "bucket-sets")
