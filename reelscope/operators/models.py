"""Regression models on MLlib: a registry, fitting, prediction, search and time-ordered validation.

Training data stays distributed; the driver sees fitted models, one metric per trial and one row per
fold.  ``y`` is on the log scale.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions import fixed_values as fixed
from reelscope.functions.columns import attach_scalars, num
from reelscope.operators import encoding, splits
from reelscope.operators.distribution import lookup_join
from reelscope.operators.features import features
from reelscope.operators.forest import Forest, all_places, bin_rows, fit_forest, leaf_targets
from reelscope.operators.metrics import bounded_log, log_scale_metrics, symmetric_error
from reelscope.sources.tables import materialize

SEED = 42
#: Share of the training rows, in time order, that boosted trees are grown on; the later rows say when to stop.
GROWN_ON = 0.85
#: A leaf of a quantile forest keeps its training targets in so many steps at most: all of them up to so many rows.
LEAF_STEPS = 1024
#: Up to so many kept targets of all leaves together are broadcast; more meet the rows in a shuffle.
BROADCAST_TARGETS = 4_000_000
#: Rows that then ask for each leaf they share only once, and whose leaves a task holds together.
ASKING_ROWS = 16_384
#: Bytes of kept targets that the parts of a turn ask for.
ASKED_BYTES = 1 << 33
#: Values at which the targets of a part are cut into cells, and rows that look into their cells at once.
CELL_CUTS = 64
CELL_ROWS = 1024
#: The lower half of a number that holds a place and a rank.
_RANK = (1 << 32) - 1
ENCODED = ("author_id_te", "topic_te")
NOT_INPUTS = ("video_id", "author_id", "topic", "create_date", "incr_plays_3_30", "y", "is_train", "is_head")


def side_by_side(spark: SparkSession, run: Callable, items: Iterable, threads: int = 4) -> list:
    """``run`` of every item, in their order, up to ``threads`` at once: fits of small jobs leave most cores idle."""
    items = list(items)
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)


def input_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in NOT_INPUTS and isinstance(f.dataType, T.NumericType)]


def _boosted(loss: str, **fixed):
    def make(p: dict):
        return GBTRegressor(
            featuresCol="features", labelCol="y", predictionCol="yhat", lossType=loss, seed=SEED,
            maxIter=p.get("trees", 500), stepSize=p.get("rate", 0.05), maxDepth=p.get("depth", 6),
            minInstancesPerNode=p.get("leaf", 50), subsamplingRate=p.get("rows", 0.8),
            featureSubsetStrategy=str(p.get("columns", 0.8)), maxBins=p.get("bins", 64),
            cacheNodeIds=False,  # walking a shallow tree again is cheaper than a table of node ids a tree
            checkpointInterval=p.get("checkpoint", 10), validationTol=p.get("tolerance", 0.0),
            **({"validationIndicatorCol": "late"} if p.get("late") else {}), **fixed,
        )
    return make


def _forest(train: DataFrame, inputs: list[str], p: dict) -> Forest:
    found = fit_forest(train, inputs, p.get("trees", 200), p.get("depth", 15), p.get("leaf", 20), p.get("bins", 64), SEED)
    found.asked_leaves = bool(p.get("leaves"))
    return found


def _linear(loss: str, penalty: float, mix: float, per_row: bool = False):
    def make(p: dict):
        strength = p.get("penalty", penalty)
        if per_row:  # a penalty stated for the sum of squares; the objective here averages over rows
            strength = strength / max(p.get("n", 1), 1)
        return LinearRegression(
            featuresCol="features", labelCol="y", predictionCol="yhat", loss=loss, regParam=strength,
            elasticNetParam=p.get("mix", mix), maxIter=p.get("iterations", 100), solver="auto",
        )
    return make


@dataclass(frozen=True)
class ModelSpec:
    name: str
    make: object
    scaled: bool = False
    weighted: bool = False
    boosted: bool = False
    defaults: dict = field(default_factory=dict)


MODELS = {
    s.name: s for s in (
        ModelSpec("gbt_mape", _boosted("absolute", weightCol="weight"), weighted=True, boosted=True),
        ModelSpec("gbt_mae", _boosted("absolute"), boosted=True, defaults={"leaf": 1}),
        ModelSpec("gbt_mse", _boosted("squared"), boosted=True),
        ModelSpec("random_forest", None),
        ModelSpec("elastic_net", _linear("squaredError", 0.01, 0.5), scaled=True),
        ModelSpec("ridge", _linear("squaredError", 1.0, 0.0, per_row=True)),
        ModelSpec("robust_huber", _linear("huber", 0.01, 0.0), scaled=True),
    )
}
# other names under which a model may be asked for
ALIASES = {
    "best": "gbt_mape", "lgbm_mape": "gbt_mape",
    "xgboost": "gbt_mae", "xgb": "gbt_mae", "xgb_mape": "gbt_mae",
    "lgbm_mse": "gbt_mse", "xgb_mse": "gbt_mse", "elasticnet": "elastic_net", "rf": "random_forest",
    "lgbm_quantile": "quantile_forest", "xgb_huber": "robust_huber",
}
ALL_MODELS = (*MODELS, "quantile_forest")


def model_registry(selection="best") -> list[str]:
    """Model names of a selection: a name, an alias, ``all`` or a list; unknown → the best model."""
    if selection == "all":
        return list(ALL_MODELS)
    if isinstance(selection, (list, set, tuple)):
        return sorted({name for s in selection for name in model_registry(s)})
    name = ALIASES.get(selection, selection)
    if name not in ALL_MODELS:
        import warnings
        warnings.warn(f"unknown model {selection!r}, using the best one")
        name = ALIASES["best"]
    return [name]


def training_frame(v: DataFrame, q: float = 0.8, **options) -> DataFrame:
    """Features, ``is_train`` and the encodings fitted on the training part, as a written table.

    Features come from ranks and medians of the whole table and every later step reads them several
    times, so they are written before and after the encodings.
    """
    rows = splits.time_split(materialize(features(v, **options), "features"), q)
    return materialize(encoding.with_encodings(rows, rows.where("is_train")), "training")


def _pipeline(spec: ModelSpec, inputs: list[str], params: dict) -> Pipeline:
    target = "raw_features" if spec.scaled else "features"
    stages = [VectorAssembler(inputCols=inputs, outputCol=target, handleInvalid="error")]
    if spec.scaled:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, spec.make({**spec.defaults, **params})])


def _fit_rows(spec: ModelSpec, train: DataFrame, inputs: list[str], late: Column | None) -> DataFrame:
    """What a model is fitted on: ``y``, the inputs, ``late`` for boosted trees and the weight of a weighted model."""
    rows = train.select("y", *inputs, *([late.alias("late")] if spec.boosted and late is not None else []))
    if spec.weighted:  # absolute error relative to the size of the target
        rows = rows.withColumn("weight", F.lit(1.0) / F.greatest(F.abs("y"), F.lit(1.0)))
    return rows


def fit(
    name: str, train: DataFrame, params: dict | None = None, inputs: list[str] | None = None, late: Column | None = None
) -> PipelineModel | Forest:
    """Fit one model on rows with ``y``.

    Boosted trees stop by themselves: they are grown on the rows that aren't ``late`` until the error on those that are
    falls by less than ``tolerance`` of itself from one tree to the next; ``trees`` is the most.  Without ``late``
    these are the last 15 % by ``create_date``, and without that column all rows are grown on and no tree is saved.
    """
    spec, params = MODELS[name], dict(params or {})
    inputs = inputs or input_columns(train)
    if name == "random_forest":
        return _forest(train, inputs, params)
    if spec.boosted and late is None and "create_date" in train.columns:
        marked = splits.time_split(train.drop("is_train"), GROWN_ON)
        train, late = marked, F.coalesce(~F.col("is_train"), F.lit(False))
    params |= {"late": True} if spec.boosted and late is not None else {}
    rows = _fit_rows(spec, train, inputs, late)
    if name == "ridge":
        params.setdefault("n", rows.count())
    return _pipeline(spec, inputs, params).fit(rows)


def predict(model: PipelineModel, df: DataFrame, keep=("video_id", "y")) -> DataFrame:
    """``keep`` columns and the bounded log prediction ``yhat``."""
    return model.transform(df).select(*keep, bounded_log("yhat").alias("yhat"))


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``feature, importance`` of a fitted model, largest first (one row per input column)."""
    if isinstance(model, Forest):
        inputs, weights = model.inputs, model.importances
    else:
        last = model.stages[-1]
        inputs = model.stages[0].getInputCols()
        weights = last.featureImportances if hasattr(last, "featureImportances") else [abs(c) for c in last.coefficients]
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(float(weights[i])).alias("importance")) for i, c in enumerate(inputs)
    ])
    return df.sparkSession.range(1).select(F.inline(rows)).orderBy(F.desc("importance"), "feature")


@dataclass
class QuantileForest:
    """A forest whose leaves keep their training targets: each row gets quantiles of a weighted distribution.

    A training row weighs, for a row to predict, the mean over the trees of 1 / (rows in the leaf) where both share the leaf.
    A quantile is the smallest target at which the weights add up to the probability, so quantiles never cross.
    """

    model: Forest
    leaves: DataFrame
    probs: dict[str, float]

    def predict(self, df: DataFrame, row_id: str = "video_id", keep=("y",)) -> DataFrame:
        """``row_id, keep…`` and one log prediction per quantile; ``row_id`` must be unique.

        Rows whose inputs lie in the same bins share all leaves, so each such kind of row is predicted once.
        Up to ``BROADCAST_TARGETS`` kept targets are broadcast, and then the leaves of a kind meet them where it lies
        and are merged as they come.  With more, the kinds are put into parts of ``ASKING_ROWS``, in an order in which
        neighbours share leaves; a part asks for each of its leaves once, and its kinds meet what it found in one task.
        The parts take turns, so that a shuffle holds about ``ASKED_BYTES`` of what they ask for.
        """
        spark = df.sparkSession
        rows = materialize(df.select(row_id, *keep, self.model.row_bins(df).alias("_bins")), "binned")
        kinds = rows.select("_bins").distinct().withColumn("_near", self.model.nearness("_bins"))
        order = ("_near", "_bins")
        sorted_ = kinds.repartitionByRange(spark.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
        leaves, held = self.leaves.agg(F.count(F.lit(1)), F.sum(F.size("targets"))).first()
        names = sorted(self.probs, key=self.probs.get)
        out = ", ".join(["_bins binary"] + [f"`{n}` double" for n in names])
        probs = [self.probs[n] for n in names]
        if (held or 0) <= BROADCAST_TARGETS:
            placed = sorted_.select("_bins", self.model.bin_places(sorted_, "_bins").alias("_leaves"))
            spread = placed.mapInArrow(_leaf_rows(1), "_bins binary, tree int, leaf int")
            met = spread.join(F.broadcast(self.leaves), ["tree", "leaf"], "left")  # keeps the order of the rows
            found = met.select("_bins", "targets", "shares").mapInArrow(_merge_leaves(probs, 1, names), out)
            answers = materialize(found, "quantiles")
        else:
            part = F.floor(F.monotonically_increasing_id() / F.lit(ASKING_ROWS))  # of neighbours in a task
            answers = self._asked_in_turns(
                materialize(sorted_.select("_bins", part.alias("_part")), "placed"), held * 16 / leaves, probs, names, out)
        return lookup_join(rows, answers, ["_bins"]).select(row_id, *keep, *names)

    def _asked_in_turns(self, kinds: DataFrame, leaf_bytes: float, probs: list[float], names: list[str], out: str) -> DataFrame:
        """``out`` of all ``kinds`` (``_bins, _part``); each turn takes as many parts as the last one's asking allows for."""
        spark = kinds.sparkSession
        parts = sorted(r[0] for r in kinds.select("_part").distinct().collect())  # one number a part
        sent, take, done = self.model.sent(spark), spark.sparkContext.defaultParallelism, []
        while parts or not done:
            own, parts = parts[:take], parts[take:]
            rows = kinds.where(F.col("_part").between(own[0], own[-1])) if own else kinds
            tasks = 2 * max(1, len(own))  # a number, since a part is little to read and much to do
            rows = rows.repartition(tasks, "_part")
            asked = materialize(rows.groupBy("_part").applyInArrow(_asked_leaves_of(sent), "_part long, tree int, leaf int"), "asked")
            answers = asked.hint("merge").join(self.leaves, ["tree", "leaf"]).repartition(tasks, "_part")
            found = rows.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(_meet_leaves(sent, probs, names), out)
            done.append(materialize(found, "quantiles"))
            take = max(1, int(len(own) * ASKED_BYTES // max(1, asked.count() * leaf_bytes)))
        return reduce(DataFrame.unionByName, done)


def _places(column) -> np.ndarray:
    """The leaves of rows, a row of numbers each, from :meth:`Forest.leaf_places`."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1)


def _leaf_rows(kept: int):
    """(id, …, leaves) to (id, …, tree, leaf), the leaves of an id one after the other."""
    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):  # a row becomes as many as there are trees
                few = batch.slice(a, 500)
                at = _places(few.column(kept))
                again = pa.array(np.repeat(np.arange(len(few)), at.shape[1]))
                columns = [few.column(c).take(again) for c in range(kept)]
                trees = pa.array(np.tile(np.arange(at.shape[1], dtype=np.int32), len(few)))
                yield pa.RecordBatch.from_arrays(
                    [*columns, trees, pa.array(at.ravel())], names=[*few.schema.names[:kept], "tree", "leaf"])

    return spread


def _asked_leaves(rows: pa.Table) -> pa.Table:
    at = _places(rows.column("_leaves"))
    asked = [np.unique(at[:, t]) for t in range(at.shape[1])]
    leaves = np.concatenate(asked)
    return pa.table({
        "_part": pa.array(np.full(len(leaves), rows.column("_part")[0].as_py()), pa.int64()),
        "tree": pa.array(np.repeat(np.arange(len(asked)), [len(x) for x in asked]), pa.int32()),
        "leaf": pa.array(leaves, pa.int32()),
    })


def _asked_leaves_of(sent):
    """The leaves that the kinds of a part ask for, each once."""
    def run(rows: pa.Table) -> pa.Table:
        at = all_places(bin_rows(rows.column("_bins"), sent.value[0]), sent.value[1])
        return _asked_leaves(rows.select(["_part"]).append_column("_leaves", pa.array([x.tobytes() for x in at], pa.binary())))

    return run


def _meet_leaves(sent, probs: list[float], names: list[str]):
    """The quantiles of a part's kinds, from its leaves."""
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        at = all_places(bin_rows(rows.column("_bins"), sent.value[0]), sent.value[1])
        found = found.combine_chunks()
        lists = [x if isinstance(x, pa.Array) else x.combine_chunks() for x in (found.column("targets"), found.column("shares"))]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        values, weights = (x.flatten().to_numpy() for x in lists)
        lengths = pc.list_value_length(lists[0]).to_numpy()
        out = leaf_quantiles(
            at, found.column("tree").to_numpy(), found.column("leaf").to_numpy(), lengths, values, weights, probs)
        return pa.table({"_bins": rows.column("_bins"), **{n: pa.array(out[:, i]) for i, n in enumerate(names)}})

    return run


def leaf_quantiles(
    at: np.ndarray, tree: np.ndarray, leaf: np.ndarray, lengths: np.ndarray, values: np.ndarray, weights: np.ndarray,
    probs: list[float],
) -> np.ndarray:
    """:func:`weighted_quantiles` of rows, ``at`` their leaves, tree by tree: no row gathers its targets.

    First the weights of every row are added up in cells: cuts, and what lies between two of them.  A quantile at a cut is
    known then; for the others only the targets of the row's own cell are gathered.  No result depends on where the cuts lie.
    """
    n, out = len(at), np.full((len(at), len(probs)), np.nan)
    if n == 0 or len(values) == 0:
        return out
    order = np.argsort(values)
    values, weights, rank = values[order], weights[order], np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))  # from here on a target is its rank, of equal ones in any order
    cuts = np.unique(values[np.linspace(0, len(values) - 1, CELL_CUTS).astype(np.int64)])
    width = 2 * len(cuts) + 1  # odd cells are the cuts themselves
    cell = (np.searchsorted(cuts, values, "left") + np.searchsorted(cuts, values, "right")).astype(np.int32)
    starts = np.cumsum(lengths) - lengths
    total, few = np.zeros((n, width)), np.empty((CELL_ROWS, width))
    leaves = []  # of each tree: its leaves in order, and their targets by leaf and rank
    for t in range(at.shape[1]):
        own = np.flatnonzero(tree == t)
        own = own[np.argsort(leaf[own])]
        size = lengths[own]
        ranks = rank[_ranges(starts[own], size)]
        ranks = np.sort(np.repeat(np.arange(len(own)), size) << 32 | ranks) & _RANK
        key = np.repeat(np.arange(len(own)) * width, size) + cell[ranks]
        leaves.append((leaf[own], key, ranks))
        held = np.bincount(key, weights[ranks], (len(own) + 1) * width).reshape(-1, width)
        place = _numbered(leaf[own], at[:, t])  # a leaf without training rows has nothing kept
        for a in range(0, n, CELL_ROWS):
            some = place[a: a + CELL_ROWS]
            total[a: a + CELL_ROWS] += np.take(held, some, axis=0, out=few[: len(some)], mode="clip")
    np.cumsum(total, axis=1, out=total)
    known = np.flatnonzero(total[:, -1] > 0)
    for i, p in enumerate(probs):
        wanted = (p - 1e-9) * total[:, -1]
        place = np.minimum((total < wanted[:, None]).sum(axis=1), width - 1)
        sure = known[place[known] % 2 == 1]
        out[sure, i] = cuts[place[sure] // 2]
        open_ = known[place[known] % 2 == 0]
        for a in range(0, len(open_), CELL_ROWS):
            rows = open_[a: a + CELL_ROWS]
            below = np.where(place[rows] > 0, total[rows, place[rows] - 1], 0.0)
            found = []
            for t, (numbers, key, ranks) in enumerate(leaves):
                asked = _numbered(numbers, at[rows, t]) * width + place[rows]
                first = np.searchsorted(key, asked, "left")
                size = np.searchsorted(key, asked, "right") - first
                found.append(np.repeat(np.arange(len(rows)) << 32, size) | ranks[_ranges(first, size)])
            found = np.sort(np.concatenate(found))
            owner, ranks = found >> 32, found & _RANK
            upto = np.cumsum(weights[ranks])
            head = np.searchsorted(owner, np.arange(len(rows)))
            tail = np.searchsorted(owner, np.arange(len(rows)), "right") - 1
            upto -= np.repeat(np.where(head > 0, upto[head - 1], 0.0), tail - head + 1)
            enough = np.flatnonzero(upto + below[owner] >= wanted[rows][owner])
            hit = np.append(enough, len(found))[np.searchsorted(enough, head)]
            out[rows, i] = values[ranks[np.minimum(hit, tail)]]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _numbered(numbers: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """The places of leaves among the sorted ``numbers``; one beyond the last for those that aren't there."""
    if len(numbers) == 0:
        return np.zeros(len(leaf), np.int64)
    place = np.minimum(np.searchsorted(numbers, leaf), len(numbers) - 1)
    return np.where(numbers[place] == leaf, place, len(numbers))


def weighted_quantiles(values: np.ndarray, weights: np.ndarray, probs: list[float]) -> np.ndarray:
    """The smallest value at which the weights add up to each share of their sum."""
    if len(values) == 0:
        return np.full(len(probs), np.nan)
    order = np.argsort(values)  # of equal values any order will do
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, (np.array(probs) - 1e-9) * upto[-1])
    return values[order][np.minimum(at, len(values) - 1)]


def _merge_leaves(probs: list[float], kept: int, names: list[str]):
    """(id, …, targets, shares), the leaves of an id one after the other, to (id, …, quantiles)."""
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            ids = waiting.column(0).combine_chunks()
            fresh = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(fresh) + 1])
            if len(starts) > 1:  # the last id may go on in the next batch
                yield quantiles(waiting.slice(0, starts[-1]), starts)
                waiting = waiting.slice(starts[-1])
        if waiting is not None and waiting.num_rows:
            yield quantiles(waiting, np.array([0, waiting.num_rows]))

    def quantiles(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        lists = [table.column(c).combine_chunks() for c in (kept, kept + 1)]
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy())])
        values, weights = (x.flatten().to_numpy() for x in lists)
        found = np.array([
            weighted_quantiles(values[ends[a]: ends[b]], weights[ends[a]: ends[b]], probs)
            for a, b in zip(starts[:-1], starts[1:])
        ])
        first = table.select(list(range(kept))).take(pa.array(starts[:-1])).combine_chunks()
        columns = [first.column(c).combine_chunks() for c in range(kept)]
        return pa.RecordBatch.from_arrays(
            columns + [pa.array(found[:, i]) for i in range(len(probs))], names=[*first.column_names, *names]
        )

    return merge


def fit_quantile_forest(
    train: DataFrame, params: dict | None = None, probs: dict[str, float] | None = None,
    inputs: list[str] | None = None,
) -> QuantileForest:
    """Forest + the training targets of each leaf (``tree, leaf, targets, shares``).

    A leaf of more than ``LEAF_STEPS`` rows keeps the mean of each of so many equal steps of its distribution.
    """
    probs = probs or {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    model = fit("random_forest", train, {"leaves": True, **(params or {})}, inputs)
    return QuantileForest(model, leaf_targets(model, train, LEAF_STEPS), probs)


def _median(forest: QuantileForest, test: DataFrame) -> DataFrame:
    return forest.predict(test).select("video_id", "y", bounded_log("p50").alias("yhat"))


def fit_predict(name: str, train: DataFrame, test: DataFrame, params: dict | None = None) -> DataFrame:
    """``video_id, y, yhat`` on the test rows for any registered model."""
    if name == "quantile_forest":
        return _median(fit_quantile_forest(train, params), test)
    return predict(fit(name, train, params), test)


def run_models(frame: DataFrame, selection="best", params: dict | None = None, threads: int = 4) -> DataFrame:
    """Hold-out metrics of every selected model; ``frame`` comes from :func:`training_frame`.

    Up to ``threads`` models are fitted side by side.  The quantile forest is the random forest with its leaves kept, so
    where both are selected one forest is fitted for them.
    """
    train, test = frame.where("is_train"), frame.where(~F.col("is_train"))
    names = model_registry(selection)
    shared = {"random_forest", "quantile_forest"} <= set(names)

    def run(name: str) -> DataFrame:
        found = {}
        if shared and name == "quantile_forest":
            forest = fit_quantile_forest(train, params)
            found = {name: _median(forest, test), "random_forest": predict(forest.model, test)}
        else:
            found = {name: fit_predict(name, train, test, params)}
        parts = [rows.select(F.lit(n).alias("model"), "y", "yhat") for n, rows in found.items()]
        return materialize(reduce(DataFrame.unionByName, parts), "predictions")

    asked = [n for n in names if not (shared and n == "random_forest")]
    asked.sort(key=lambda n: n != "quantile_forest")  # the longest first
    return log_scale_metrics(reduce(DataFrame.unionByName, side_by_side(frame.sparkSession, run, asked, threads)))


GBT_SPACE = {
    "trees": ("int", 200, 1000), "rate": ("log", 0.01, 0.15), "depth": ("int", 5, 7), "leaf": ("int", 20, 100),
    "rows": ("float", 0.6, 1.0), "columns": ("float", 0.6, 1.0),
}
MAE_SPACE = {
    "trees": ("int", 200, 800), "rate": ("log", 0.01, 0.15), "depth": ("int", 4, 10), "leaf": ("int", 1, 15),
    "rows": ("float", 0.6, 1.0), "columns": ("float", 0.6, 1.0),
}

LINEAR_SPACE = {"penalty": ("log", 1e-4, 1.0), "mix": ("float", 0.0, 1.0)}
SPACES = {"gbt_mae": MAE_SPACE, "elastic_net": LINEAR_SPACE, "ridge": {"penalty": ("log", 1e-2, 1e4)},
          "robust_huber": {"penalty": ("log", 1e-4, 1.0)}}


def draw_trials(space: dict, trials: int, seed: int = SEED) -> list[dict]:
    """Seeded random parameter sets."""
    from math import exp, log

    rng = random.Random(seed)
    draw = {
        "int": lambda a, b: rng.randint(a, b),
        "float": lambda a, b: rng.uniform(a, b),
        "log": lambda a, b: exp(rng.uniform(log(a), log(b))),
    }
    return [{n: draw[kind](a, b) for n, (kind, a, b) in space.items()} for _ in range(trials)]


class SmapeEvaluator(Evaluator):
    """Symmetric percentage error of log-scale predictions on the original scale, for MLlib's own tuning too."""

    def __init__(self, label: str = "y", prediction: str = "yhat") -> None:
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col(self.label).alias("y"), F.col(self.prediction).alias("yhat"))
        found = symmetric_error(rows).first()[0]
        return float("nan") if found is None else float(found)

    def isLargerBetter(self) -> bool:
        return False


def hyper_search(
    train: DataFrame, name: str = "gbt_mape", space: dict | None = None, trials: int = 30, seed: int = SEED,
    head: float = 0.85, threads: int = 4, held: dict | None = None,
) -> DataFrame:
    """``trial, smape`` and the parameters of each trial, best first; ``held`` parameters hold in all trials.

    The later part of the training rows (in time order) is the validation set, by which boosted trees also stop.
    Up to ``threads`` trials run side by side over one written table, for boosted trees over its vectors, kept by the
    executors in memory or on their disks; they share nothing else, so their number changes no result.  The driver holds one number a trial.
    """
    spark = train.sparkSession
    marked = materialize(splits.positional_split(train, head), "search")
    early, late = marked.where("is_head"), marked.where(~F.col("is_head"))
    inputs = [c for c in input_columns(train) if c != "is_head"]
    measure = SmapeEvaluator()

    boosted = name in MODELS and MODELS[name].boosted
    if boosted:  # a fit reads its rows several times, and so does every trial: they are put into vectors once
        rows = _fit_rows(MODELS[name], marked, inputs, ~F.col("is_head"))
        ready = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error").transform(rows).drop(*inputs).persist()

    def run(drawn: dict) -> float:
        params = {**(held or {}), **drawn}
        if name == "quantile_forest":
            return measure.evaluate(fit_predict(name, early, late, params))
        if boosted:
            model = MODELS[name].make({**MODELS[name].defaults, **params, "late": True}).fit(ready)
            return measure.evaluate(predict(model, ready.where("late"), ("y",)))
        return measure.evaluate(predict(fit(name, early, params, inputs), late))

    drawn = draw_trials(space or SPACES.get(name, GBT_SPACE), trials, seed)
    try:
        found = side_by_side(spark, run, drawn, threads)
    finally:
        if boosted:
            ready.unpersist()
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("trial"), F.nanvl(F.lit(s), F.lit(None).cast("double")).alias("smape"),
            *[F.lit(float(p[k])).alias(k) for k in p],
        )
        for i, (s, p) in enumerate(zip(found, drawn))
    ])
    return spark.range(1).select(F.inline(rows)).orderBy(F.asc_nulls_last("smape"), "trial")


def refit_best(frame: DataFrame, trials: DataFrame, name: str = "gbt_mape") -> tuple[PipelineModel, DataFrame]:
    """The best trial's model, fitted again on all training rows, and its leaderboard row on the others.

    ``frame`` comes from :func:`training_frame`, ``trials`` from :func:`hyper_search` over its training rows.
    """
    best = trials.first().asDict()  # trials are ordered; one row per trial
    whole = {k: a for k, (a, *_) in SPACES.get(name, GBT_SPACE).items() if a == "int"}
    params = {k: int(x) if k in whole else x for k, x in best.items() if k not in ("trial", "smape")}
    model = fit(name, frame.where("is_train"), params)
    scored = predict(model, frame.where(~F.col("is_train"))).select(F.lit(f"{name}_tuned").alias("model"), "y", "yhat")
    return model, log_scale_metrics(scored)


def _fold_encodings(rows: DataFrame, folds: list, column: str) -> tuple[DataFrame, DataFrame]:
    """``(map, means)``: ``column, {column}_all`` with the encoding of a value in every fold, and one row with the means.

    Totals per value and date first, so a frequent value shrinks before anything else; a fold's totals are those
    up to its last training date.  A value that a fold hasn't seen is null there.
    """
    target = num(fixed.TARGET)
    daily = rows.groupBy(column, "create_date").agg(F.count(target).alias("k"), F.sum(target).alias("s"))
    seen = [F.col("create_date") <= F.lit(f.train_end) for f in folds]
    totals = materialize(
        daily.groupBy(column).agg(
            *[F.sum(F.when(w, F.col("k"))).alias(f"k{i}") for i, w in enumerate(seen)],
            *[F.sum(F.when(w, F.col("s"))).alias(f"s{i}") for i, w in enumerate(seen)],
        ), "fold-totals",
    )
    means = totals.agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"k{i}")).alias(f"m{i}") for i in range(len(folds))])
    beside = attach_scalars(totals.where(F.col(column).isNotNull()), means, "_m")
    known = beside.select(column, F.array(*[
        F.when(F.col(f"k{i}").isNotNull(), encoding.blend(F.col(f"s{i}"), F.col(f"k{i}"), F.col(f"_m.m{i}")))
        for i in range(len(folds))
    ]).alias(f"{column}_all"))
    return known, means.select(F.array(*[f"m{i}" for i in range(len(folds))]).alias("means"))


def with_fold_encodings(rows: DataFrame, folds: list, columns=("author_id", "topic")) -> DataFrame:
    """Add ``{column}_all``: an array with the encoding of the row's value in every fold."""
    for column in columns:
        known, means = _fold_encodings(rows, folds, column)
        found = attach_scalars(lookup_join(rows, known, [column]), means, "_g")
        rows = found.withColumn(f"{column}_all", F.transform(
            F.col("_g.means"), lambda m, i: F.coalesce(F.get(F.col(f"{column}_all"), i), m)
        )).drop("_g")
    return rows


def expanding_cv(
    v: DataFrame, name: str = "gbt_mape", k: int = 5, embargo_days: int = 0, params: dict | None = None,
    min_train: int = 100, min_test: int = 50, **options,
) -> DataFrame:
    """Metrics per expanding fold; the encodings are those of each fold's training rows.

    The features are written once, with an array of every fold's encodings; a fold only filters that table.
    """
    rows = materialize(features(v, **options), "features")
    folds = splits.expanding_folds(rows, k, embargo_days, min_train, min_test).orderBy("fold").collect()  # at most k
    nothing = rows.limit(0).select(
        F.lit(0).alias("fold"), F.lit(0).cast("long").alias("train_rows"), F.lit(0).cast("long").alias("test_rows"), "y",
        F.col("y").alias("yhat"),
    )
    columns = ("author_id", "topic")
    table = materialize(with_fold_encodings(rows, folds, columns), "folds") if folds else rows

    def run(placed: tuple) -> DataFrame:
        place, f = placed
        fold = table.withColumns({f"{c}_te": F.get(f"{c}_all", F.lit(place)) for c in columns}).drop(
            *[f"{c}_all" for c in columns])
        early = fold.where(F.col("create_date") <= F.lit(f.train_end))
        late = fold.where(F.col("create_date").between(F.lit(f.test_start), F.lit(f.test_end)))
        scored = fit_predict(name, early, late, params)
        return materialize(scored.select(
            F.lit(f.fold + 1).alias("fold"), F.lit(f.train_rows).alias("train_rows"),
            F.lit(f.test_rows).alias("test_rows"), "y", "yhat",
        ), "predictions")

    # no fold with enough rows: an empty result
    parts = [nothing, *(side_by_side(v.sparkSession, run, enumerate(folds)) if folds else [])]
    return log_scale_metrics(reduce(DataFrame.unionByName, parts), by=("fold", "train_rows", "test_rows"))
