"""Random forests whose rows move once a tree, however many nodes the trees have.

The inputs are put into bins.  Nodes of more than ``local_rows`` rows are split level by level from histograms that tasks
add up; the rows of every smaller node then go to one task, which grows all that is below it.  Bootstrap weights come from a
hash of the row and the inputs a node may use from a hash of its place, so no result depends on partitions or on ``local_rows``.
The driver holds the trees: at most 2^(depth + 1) nodes each, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.sources.tables import materialize, shuffles_removed

#: A node of up to so many bootstrapped rows is finished by one task.
LOCAL_ROWS = 250_000
#: Bytes of rows that are handed out at once: the trees take turns, and a turn's shuffle is gone before the next.
MOVED_BYTES = 1 << 31
#: Rows that a task gathers before it hands them out to the nodes.
HANDED_ROWS = 40_000
#: Nodes whose histograms a task holds at once while it grows a subtree.
NODES_AT_ONCE = 1024
#: Shares of rows that a bootstrap takes at most 0, 1, 2, … times.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))
NODE = np.dtype([
    ("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("value", "<f8"), ("gain", "<f8"), ("size", "<f8"),
])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bag_weights(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the bootstrap of a tree takes each row: Poisson with mean 1."""
    own = _mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    drawn = (_mixed(hashes.view(np.uint64) ^ own) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON, drawn, side="right").astype(np.uint8)


def inputs_of(paths: np.ndarray, tree: int, seed: int, inputs: int, used: int) -> np.ndarray:
    """The inputs that nodes may be split by, a row a node; ``paths`` are places, 1 the root, 2p and 2p + 1 the children of p."""
    if used == inputs:
        return np.tile(np.arange(inputs), (len(paths), 1))
    own = _mixed(paths.astype(np.uint64) ^ _mixed(np.array([seed * 7_000_003 + tree], np.uint64)))
    keys = _mixed(own[:, None] ^ _mixed(np.arange(1, inputs + 1))[None, :])
    return np.sort(np.argsort(keys, axis=1)[:, :used], axis=1)


def histograms(bins, weights, sums, node, chosen, width) -> np.ndarray:
    """``[2, node, used input, bin]``: weights and weighted targets of rows that lie in nodes 0, 1, 2, …"""
    nodes, used = chosen.shape
    out = np.empty((2, nodes, used, width))
    rows, base = np.arange(len(node)), node.astype(np.int64) * width
    for j in range(used):
        cell = base + bins[rows, chosen[node, j]]
        out[0, :, j] = np.bincount(cell, weights, nodes * width).reshape(nodes, width)
        out[1, :, j] = np.bincount(cell, sums, nodes * width).reshape(nodes, width)
    return out


def best_splits(found: np.ndarray, chosen: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """For every node its size, mean, best input, cut (bins up to it go left) and gain; input -1 where no cut is allowed."""
    size, total = found[0, :, 0].sum(axis=1), found[1, :, 0].sum(axis=1)
    left, below = (np.cumsum(x, axis=2)[:, :, :-1] for x in found)
    right, above = size[:, None, None] - left, total[:, None, None] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = below**2 / left + above**2 / right - (total**2 / size)[:, None, None]
    gain = np.where((left >= least) & (right >= least) & (left > 0) & (right > 0), gain, -np.inf).reshape(len(size), -1)
    at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(size), int)
    nodes = np.arange(len(size))
    best = gain[nodes, at] if gain.shape[1] else np.full(len(size), -np.inf)
    place, cut = np.divmod(at, found.shape[3] - 1) if gain.shape[1] else (at, at)
    some = best > 1e-9 * np.maximum(1.0, np.abs(total))
    lower = left.reshape(len(size), -1)[nodes, at] if gain.shape[1] else size
    return {
        "size": size, "value": total / np.maximum(size, 1e-300), "feature": np.where(some, chosen[nodes, place], -1),
        "cut": cut, "gain": np.where(some, best, 0.0), "left_size": lower,
    }


def grow(bins, y, weights, path, levels, tree, shape: dict) -> np.ndarray:
    """All nodes below and with the one at ``path``, level by level, the root first; ``left`` is the place of the first child."""
    center = float(np.average(y, weights=weights))
    sums, weights = (y - center) * weights, weights.astype(np.float64)
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    paths, done, held = np.array([path], np.uint64), [], 0
    while len(paths):
        size, total = np.bincount(node, weights[rows], len(paths)), np.bincount(node, sums[rows], len(paths))
        wide = np.flatnonzero(size >= 2 * shape["least"]) if levels > 0 else np.empty(0, np.int64)
        made = np.zeros(len(paths), NODE)
        made["feature"], made["size"], made["value"] = -1, size, total / np.maximum(size, 1e-300) + center
        slot = np.full(len(paths), -1)
        slot[wide] = np.arange(len(wide))
        stay = slot[node] >= 0
        rows, node = rows[stay], slot[node[stay]]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        for a in range(0, len(wide), NODES_AT_ONCE):
            at, part = wide[a: a + NODES_AT_ONCE], slice(*np.searchsorted(node, [a, a + NODES_AT_ONCE]))
            chosen = inputs_of(paths[at], tree, shape["seed"], bins.shape[1], shape["used"])
            own = rows[part]
            best = best_splits(
                histograms(bins[own], weights[own], sums[own], node[part] - a, chosen, shape["width"]), chosen, shape["least"])
            for c in ("feature", "cut", "gain"):
                made[c][at] = best[c]
        split = made["feature"] >= 0
        made["cut"][~split] = 0
        first = 2 * (np.cumsum(split) - split)  # place of the left child in the next level
        held += len(paths)
        made["left"] = np.where(split, held + first, -1)
        done.append(made)
        node = wide[node]
        go = split[node]
        rows, node = rows[go], node[go]
        node = first[node] + (bins[rows, made["feature"][node]] > made["cut"][node])
        with np.errstate(over="ignore"):
            paths = (paths[split, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)[None, :]).ravel()
        levels -= 1
    return np.concatenate(done)


def walk(nodes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of the node in which each row ends."""
    feature, cut, left = (np.ascontiguousarray(nodes[c]) for c in ("feature", "cut", "left"))
    at = np.zeros(len(bins), np.int32)
    rows = np.arange(len(bins)) if len(nodes) and feature[0] >= 0 else np.empty(0, np.int64)
    while len(rows):
        here = at[rows]
        here = left[here] + (bins[rows, feature[here]] > cut[here])
        at[rows] = here
        rows = rows[feature[here] >= 0]
    return at


def binned(columns: list, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (column, cuts) in enumerate(zip(columns, edges)):
        values = np.asarray(column, np.float64)
        if np.isnan(values).any():
            raise ValueError("an input of the forest is null or not a number")
        out[:, i] = np.searchsorted(cuts, values, side="left")
    return out


def bin_edges(df: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cuts of every input, at equal shares of the rows; a value up to a cut lies below it."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    found = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10000).alias(str(i)) for i, c in enumerate(inputs)])
    return [np.unique(np.array(x if x is not None else [], np.float64)) for x in found.first()]


@dataclass
class Forest:
    """Fitted trees: an array of nodes a tree, the root first; a leaf is called by its place in its tree."""

    inputs: list[str]
    edges: list[np.ndarray]
    trees: list[np.ndarray]
    asked_leaves: bool = False

    def __post_init__(self) -> None:
        self._sent = None

    def sent(self, spark):
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast((self.edges, self.trees))
        return self._sent

    def _doubles(self, df: DataFrame) -> list:
        return [F.col(f"`{c}`").cast("double") for c in self.inputs]

    def leaf_places(self, df: DataFrame):
        """A column: the leaf of each tree, as 32-bit numbers one after the other."""
        sent = self.sent(df.sparkSession)

        @F.pandas_udf("binary")
        def places(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            edges, trees = sent.value
            for columns in parts:
                at = all_places(binned(columns, edges), trees)
                yield pd.Series([row.tobytes() for row in at])

        return places(*self._doubles(df))

    def row_bins(self, df: DataFrame):
        """A column: the bins of the inputs, a byte each; rows with the same bins lie in the same leaf of every tree."""
        sent = self.sent(df.sparkSession)

        @F.pandas_udf("binary")
        def packed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series([row.tobytes() for row in binned(columns, sent.value[0])])

        return packed(*self._doubles(df))

    def bin_places(self, df: DataFrame, bins: str):
        """A column as :meth:`leaf_places` gives it, from a column as :meth:`row_bins` gives it."""
        sent = self.sent(df.sparkSession)

        @F.pandas_udf("binary")
        def places(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for held in parts:
                at = all_places(bin_rows(held, sent.value[0]), sent.value[1])
                yield pd.Series([row.tobytes() for row in at])

        return places(F.col(bins))

    def nearness(self, bins: str):
        """A column: a number for a column as :meth:`row_bins` gives it; rows whose numbers are close share many leaves.

        The bits of the bins of the eight inputs with the largest gains, the highest bits first.
        """
        leading, inputs = np.argsort(-self.importances, kind="stable")[:8], self.inputs

        @F.pandas_udf("long")
        def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for held in parts:
                own = bin_rows(held, inputs)[:, leading]
                bits = np.unpackbits(own[:, :, None], axis=2).transpose(0, 2, 1).reshape(len(held), -1)
                packed = np.packbits(bits, axis=1)
                padded = np.zeros((len(held), 8), np.uint8)
                padded[:, : packed.shape[1]] = packed
                yield pd.Series(padded.view(">u8").ravel().astype(np.uint64).view(np.int64) ^ np.int64(-1 << 63))

        return near(F.col(bins))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``yhat``, the mean over the trees, and with ``leaf`` if the forest was asked for it."""
        sent = self.sent(df.sparkSession)

        @F.pandas_udf("double")
        def mean(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            edges, trees = sent.value
            for columns in parts:
                bins, total = binned(columns, edges), np.zeros(len(columns[0]))
                for nodes in trees:
                    total += nodes["value"][walk(nodes, bins)]
                yield pd.Series(total / len(trees))

        found = df.withColumn("yhat", mean(*self._doubles(df)))
        if not self.asked_leaves:
            return found

        @F.pandas_udf("array<double>")
        def leaves(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            edges, trees = sent.value
            for columns in parts:
                yield pd.Series(list(all_places(binned(columns, edges), trees).astype(np.float64)))

        return found.withColumn("leaf", array_to_vector(leaves(*self._doubles(df))))

    @property
    def importances(self) -> np.ndarray:
        """Share of each input in the gains, a tree counting as much as any other."""
        found = np.zeros(len(self.inputs))
        for nodes in self.trees:
            inner = nodes[nodes["feature"] >= 0]
            own = np.bincount(inner["feature"], inner["gain"], len(self.inputs))
            found += own / own.sum() if own.sum() else 0.0
        return found / found.sum() if found.sum() else found

    def table(self, spark) -> DataFrame:
        """The forest as a table, a row a tree (-1: names and cuts of the inputs)."""
        heads = [(-1, c, e.astype("<f8").tobytes()) for c, e in zip(self.inputs, self.edges)]
        rows = heads + [(i, "", nodes.tobytes()) for i, nodes in enumerate(self.trees)]
        slots = list(range(len(rows)))
        found = pa.table({
            "slot": pa.array(slots, pa.int64()), "tree": pa.array([r[0] for r in rows], pa.int64()),
            "name": [r[1] for r in rows], "content": pa.array([r[2] for r in rows], pa.binary()),
        })
        return spark.createDataFrame(found)

    @classmethod
    def read(cls, rows: DataFrame, asked_leaves: bool = False) -> Forest:
        rows = sorted(rows.collect(), key=lambda r: r.slot)
        heads = [r for r in rows if r.tree < 0]
        trees = [np.frombuffer(r.content, NODE) for r in rows if r.tree >= 0]
        return cls([r.name for r in heads], [np.frombuffer(r.content, "<f8") for r in heads], trees, asked_leaves)


def bin_rows(packed, inputs) -> np.ndarray:
    """A matrix from a column as :meth:`Forest.row_bins` gives it; ``inputs`` has an entry an input."""
    return np.frombuffer(b"".join(packed.to_pylist() if hasattr(packed, "to_pylist") else packed), np.uint8).reshape(-1, len(inputs))


def all_places(bins: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    at = np.empty((len(bins), len(trees)), np.int32)
    for i, nodes in enumerate(trees):
        at[:, i] = walk(nodes, bins)
    return at


def _unpacked(batch: pa.RecordBatch, inputs: int):
    """Hashes, targets and bins of a batch of ``h, y, bins``."""
    held = batch.column(2)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset: held.offset + len(held) + 1]
    bins = np.frombuffer(held.buffers()[2], np.uint8)[ends[0]: ends[-1]].reshape(len(held), inputs)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), bins


def _row_table(df: DataFrame, inputs: list[str], edges: list[np.ndarray]) -> DataFrame:
    """``h, y, bins``: a hash of the row, the target and one byte an input; spread evenly, since every row meets every tree."""
    @F.pandas_udf("binary")
    def packed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([row.tobytes() for row in binned(columns, edges)])

    rows = df.where(F.col("y").isNotNull()).select(
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"), F.col("y").cast("double").alias("y"),
        packed(*[F.col(f"`{c}`").cast("double") for c in inputs]).alias("bins"),
    )
    return materialize(rows.repartition(df.sparkSession.sparkContext.defaultParallelism), "forest-rows")


def _weights(hashes, tree, shape):
    return bag_weights(hashes, tree, shape["seed"]) if shape["trees"] > 1 else np.ones(len(hashes), np.uint8)


def _gathered(batches: Iterable[pa.RecordBatch], inputs: int):
    """Batches put together to about ``HANDED_ROWS`` rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(_unpacked(batch, inputs))
        n += len(waiting[-1][0])
        if n >= HANDED_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*waiting))
            waiting, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*waiting))


def _level(rows: DataFrame, trees: list[np.ndarray], open_: dict, shape: dict) -> list:
    """Best splits of the open nodes, ``{tree: [(place, path), …]}``, from histograms of all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((trees, open_))

    def partial(batches):
        trees, open_ = sent.value
        found = {}
        for hashes, y, bins in _gathered(batches, shape["inputs"]):
            for tree, nodes in open_.items():
                weights = _weights(hashes, tree, shape)
                slot = np.full(len(trees[tree]), -1)
                slot[[place for place, _ in nodes]] = np.arange(len(nodes))
                node = slot[walk(trees[tree], bins)]
                take = (node >= 0) & (weights > 0)
                chosen = inputs_of(
                    np.array([p for _, p in nodes], np.uint64), tree, shape["seed"], shape["inputs"], shape["used"])
                w = weights[take].astype(np.float64)
                sums = (y[take] - shape["center"]) * w
                part = histograms(bins[take], w, sums, node[take], chosen, shape["width"])
                found[tree] = found[tree] + part if tree in found else part
        for tree, part in found.items():
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * part.shape[1], pa.int32()), "slot": pa.array(range(part.shape[1]), pa.int32()),
                "found": pa.array([part[:, i].tobytes() for i in range(part.shape[1])], pa.binary()),
            })

    def choose(table: pa.Table) -> pa.Table:
        tree, slot = table.column("tree")[0].as_py(), table.column("slot")[0].as_py()
        added = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("found"))
        path = sent.value[1][tree][slot][1]
        chosen = inputs_of(np.array([path], np.uint64), tree, shape["seed"], shape["inputs"], shape["used"])
        best = best_splits(added.reshape(2, 1, shape["used"], shape["width"]), chosen, shape["least"])
        return pa.table({"tree": pa.array([tree], pa.int32()), "slot": pa.array([slot], pa.int32()), **{
            c: pa.array(best[c].astype(np.float64)) for c in ("size", "value", "feature", "cut", "gain", "left_size")}})

    parts = rows.mapInArrow(partial, "tree int, slot int, found binary")
    with shuffles_removed(rows.sparkSession):
        return parts.groupBy("tree", "slot").applyInArrow(
            choose, "tree int, slot int, size double, value double, feature double, cut double, gain double, left_size double"
        ).collect()


def _turns(trees: Iterable[int], tree_bytes: float) -> list[list[int]]:
    """The trees in groups that move at most ``MOVED_BYTES`` together, or a single tree."""
    trees, n = list(trees), max(1, int(MOVED_BYTES // max(tree_bytes, 1)))
    return [trees[a: a + n] for a in range(0, len(trees), n)]


def _finish(rows: DataFrame, trees: list[np.ndarray], small: dict, shape: dict) -> list:
    """Subtrees of the small nodes, ``{tree: {place: path}}``; their rows go to one task each."""
    sent = rows.sparkSession.sparkContext.broadcast((trees, small))

    def hand_out(batches):
        trees, small = sent.value
        for hashes, y, bins in _gathered(batches, shape["inputs"]):
            for tree, nodes in small.items():
                weights = _weights(hashes, tree, shape)
                taken = np.flatnonzero(weights)
                place = walk(trees[tree], bins[taken])
                order = np.argsort(place, kind="stable")
                place, taken = place[order], taken[order]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1]) if len(place) else np.empty(0, int)
                parts = [(place[a], taken[a:b]) for a, b in zip(starts, [*starts[1:], len(place)]) if place[a] in nodes]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(parts), pa.int32()),
                    "place": pa.array([int(p) for p, _ in parts], pa.int32()),
                    "w": pa.array([weights[r].tobytes() for _, r in parts], pa.binary()),
                    "y": pa.array([y[r].tobytes() for _, r in parts], pa.binary()),
                    "bins": pa.array([bins[r].tobytes() for _, r in parts], pa.binary()),
                })

    def finish(table: pa.Table) -> pa.Table:
        tree, place = table.column("tree")[0].as_py(), table.column("place")[0].as_py()
        weights, y, bins = (
            np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
            for c, kind in (("w", np.uint8), ("y", np.float64), ("bins", np.uint8))
        )
        path = sent.value[1][tree][place]
        levels = shape["depth"] - (int(path).bit_length() - 1)
        made = grow(bins.reshape(len(y), -1), y, weights, path, levels, tree, shape)
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "place": pa.array([place], pa.int32()), "nodes": [made.tobytes()]})

    parts = rows.mapInArrow(hand_out, "tree int, place int, w binary, y binary, bins binary")
    with shuffles_removed(rows.sparkSession):
        return parts.groupBy("tree", "place").applyInArrow(finish, "tree int, place int, nodes binary").collect()


def kept_steps(leaf: np.ndarray, y: np.ndarray, steps: int):
    """Leaves, and for each the targets and shares it keeps: the mean of each of ``steps`` equal steps of its targets."""
    order = np.lexsort((y, leaf))
    leaf, y = leaf[order], y[order]
    fresh = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (y[1:] != y[:-1])]))
    ends = np.concatenate([fresh[1:], [len(y)]])
    begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    total = np.diff(np.concatenate([begin, [len(y)]]))
    of = np.searchsorted(begin, fresh, side="right") - 1  # the leaf of each distinct target
    rank = (fresh - begin[of] + ends - begin[of] + 1) / 2  # mean rank of equal targets, from 1
    step = np.floor((rank - 0.5) / total[of] * steps).astype(np.int64)
    n, v = (ends - fresh).astype(np.float64), y[fresh]
    heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (step[1:] != step[:-1])]))
    alone = np.diff(np.concatenate([heads, [len(v)]])) == 1
    held = np.add.reduceat(n, heads)
    value = np.where(alone, v[heads], np.add.reduceat(v * n, heads) / held)
    lists = np.concatenate([np.searchsorted(of[heads], np.arange(len(begin))), [len(heads)]])
    return leaf[begin], lists, value, held / total[of[heads]]


def leaf_targets(forest: Forest, train: DataFrame, steps: int) -> DataFrame:
    """``tree, leaf, targets, shares`` of all leaves that hold rows of ``train``, written.

    The trees take turns, so that a shuffle holds the targets of some of them.  The leaves below a node of few rows lie in one task, which sorts their targets.  A leaf of more rows than that is not
    gathered: its targets are counted and cut into steps by ranks in written ranges.
    """
    from reelscope.operators.distribution import rank_counts, with_ranges

    sent = forest.sent(train.sparkSession)
    inputs = len(forest.inputs)
    # the highest nodes of at most LOCAL_ROWS bootstrapped rows, and the larger leaves
    parts, large = [], []
    for tree, nodes in enumerate(forest.trees):
        part, waiting = np.arange(len(nodes), dtype=np.int32), [(0, -1)]
        while waiting:
            at, top = waiting.pop()
            if top < 0 and nodes["size"][at] <= LOCAL_ROWS:
                top = at
            part[at] = top if top >= 0 else at
            if nodes["feature"][at] >= 0:
                waiting += [(int(nodes["left"][at]), top), (int(nodes["left"][at]) + 1, top)]
            elif top < 0:
                large.append((tree, at))
        parts.append(part)
    places = train.sparkSession.sparkContext.broadcast((parts, set(large)))

    def members(wanted: bool, turn: list[int]):
        def run(batches):
            (_, trees), (parts, large) = sent.value, places.value
            asked = [t for t in turn if any(t == own for own, _ in large)] if wanted else turn
            for _, y, bins in _gathered(batches, inputs):
                for tree in asked:
                    leaf = walk(trees[tree], bins)
                    far = np.isin(leaf, [at for t, at in large if t == tree])
                    if wanted:
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array(np.full(far.sum(), tree), pa.int32()), "leaf": pa.array(leaf[far], pa.int32()),
                            "v": pa.array(y[far])})
                        continue
                    near = np.flatnonzero(~far)
                    top = parts[tree][leaf[near]]
                    order = np.argsort(top, kind="stable")
                    near, top = near[order], top[order]
                    starts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.empty(0, int)
                    cut = [near[a:b] for a, b in zip(starts, [*starts[1:], len(near)])]
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree] * len(cut), pa.int32()), "part": pa.array(top[starts], pa.int32()),
                        "leaf": pa.array([leaf[r].tobytes() for r in cut], pa.binary()),
                        "y": pa.array([y[r].tobytes() for r in cut], pa.binary())})
        return run

    def keep(table: pa.Table) -> pa.Table:
        leaf, y = (
            np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
            for c, kind in (("leaf", np.int32), ("y", np.float64))
        )
        leaves, lists, values, shares = kept_steps(leaf, y, steps)
        lists = pa.array(lists, pa.int32())
        return pa.table({
            "tree": pa.array(np.full(len(leaves), table.column("tree")[0].as_py()), pa.int32()), "leaf": pa.array(leaves, pa.int32()),
            "targets": pa.ListArray.from_arrays(lists, pa.array(values)), "shares": pa.ListArray.from_arrays(lists, pa.array(shares)),
        })

    rows = _row_table(train, forest.inputs, forest.edges)
    kinds = "tree int, leaf int, targets array<double>, shares array<double>"
    leaf = ["tree", "leaf"]
    # neighbours in a leaf of up to that many rows lie at least one step apart
    step = F.floor((F.col("avg_rank") - 0.5) / F.col("total") * steps)
    value = F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.sum(F.col("v") * F.col("n")) / F.sum("n"))

    def kept(turn: list[int]) -> DataFrame:
        near = rows.mapInArrow(members(False, turn), "tree int, part int, leaf binary, y binary")
        found = near.groupBy("tree", "part").applyInArrow(keep, kinds)
        if not any(t in turn for t, _ in large):
            return found
        far = rows.mapInArrow(members(True, turn), "tree int, leaf int, v double")
        counted = with_ranges(far.groupBy(*leaf, "v").agg(F.count(F.lit(1)).alias("n")), leaf)
        cut = rank_counts(counted, leaf).groupBy(*leaf, step.alias("step")).agg(
            value.alias("v"), (F.sum("n") / F.max("total")).alias("share"))
        held = cut.groupBy(*leaf).agg(F.collect_list(F.struct("v", "share")).alias("held"))
        return found.unionByName(held.select(*leaf, F.col("held.v").alias("targets"), F.col("held.share").alias("shares")))

    turns = _turns(range(len(forest.trees)), rows.count() * 12)  # the number of a leaf and a target
    return reduce(DataFrame.unionByName, [materialize(kept(turn), "leaves") for turn in turns])


def fit_forest(
    train: DataFrame, inputs: list[str], trees: int = 200, depth: int = 15, least: int = 20, bins: int = 64, seed: int = 42,
    local_rows: int | None = None,
) -> Forest:
    """A regression forest on ``y``: a bootstrap a tree, a third of the inputs a node, at least ``least`` rows a leaf."""
    if not 2 <= bins <= 256:
        raise ValueError("2 to 256 bins")
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    edges = bin_edges(train.where(F.col("y").isNotNull()), inputs, bins)
    rows = _row_table(train, inputs, edges)
    count, center = rows.agg(F.count(F.lit(1)), F.avg("y")).first()
    if not count:
        raise ValueError("no rows to fit a forest on")
    shape = {
        "trees": trees, "depth": depth, "least": least, "seed": seed, "inputs": len(inputs), "center": center,
        "used": -(-len(inputs) // 3) if trees > 1 else len(inputs), "width": max(len(e) for e in edges) + 1,
    }
    empty = np.zeros(1, NODE)
    empty["feature"], empty["left"], empty["value"] = -1, -1, center
    built = [empty.copy() for _ in range(trees)]
    small: dict[int, dict[int, int]] = {t: {} for t in range(trees)}
    open_: dict[int, list] = {}
    for t in range(trees):
        if count <= local_rows:
            small[t][0] = 1
        else:
            open_[t] = [(0, 1)]
    while open_:
        following: dict[int, list] = {}
        for r in sorted(_level(rows, built, open_, shape), key=lambda r: (r.tree, r.slot)):
            place, path = open_[r.tree][r.slot]
            nodes = built[r.tree]
            nodes[place]["value"], nodes[place]["size"] = r.value + center, r.size
            if r.feature < 0 or path.bit_length() > depth:
                continue
            first = len(nodes)
            nodes[place]["feature"], nodes[place]["cut"], nodes[place]["left"] = int(r.feature), int(r.cut), first
            nodes[place]["gain"] = r.gain
            built[r.tree] = np.concatenate([nodes, empty, empty])
            for side, size in ((0, r.left_size), (1, r.size - r.left_size)):
                if size <= local_rows:
                    small[r.tree][first + side] = 2 * path + side
                else:
                    following.setdefault(r.tree, []).append((first + side, 2 * path + side))
        open_ = following
    turns = _turns([t for t, s in small.items() if s], count * (1 - np.exp(-1.0)) * (len(inputs) + 9))
    ends = [r for turn in turns for r in _finish(rows, built, {t: small[t] for t in turn}, shape)]
    for r in sorted(ends, key=lambda r: (r.tree, r.place)):
        made, nodes = np.frombuffer(r.nodes, NODE).copy(), built[r.tree]
        made["left"] = np.where(made["left"] >= 0, made["left"] + len(nodes) - 1, -1)  # its root takes the waiting place
        nodes[r.place] = made[0]
        built[r.tree] = np.concatenate([nodes, made[1:]])
    return Forest(list(inputs), edges, built)
