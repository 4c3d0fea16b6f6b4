"""Smoothed target encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.columns import attach_scalars, num
from reelscope.functions.fixed_values import ENCODING_SMOOTHING, TARGET
from reelscope.operators.distribution import lookup_join
from reelscope.sources.tables import materialize


def _totals(train: DataFrame, keys: list[str], target: str) -> DataFrame:
    return train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(target).alias("_k"), F.sum(num(target)).alias("_s")
    )


def blend(s: Column, k: Column, mean: Column, smoothing: float = ENCODING_SMOOTHING) -> Column:
    """The mean of ``k`` targets with the sum ``s``, drawn towards the overall mean."""
    return (F.coalesce(s, F.lit(0.0)) + F.lit(smoothing) * mean) / (k + F.lit(smoothing))


def target_encode_fit(
    train: DataFrame, column: str, target: str = TARGET, smoothing: float = ENCODING_SMOOTHING
) -> tuple[DataFrame, DataFrame]:
    """``(map, global)``: ``column, rows, encoding`` per known value, and one row ``global_mean``.

    A value whose targets are all null gets the global mean.  The totals per value are written once: the
    mean, the encodings and both sides of the later lookup read them.
    """
    totals = materialize(_totals(train, [column], target), "encoding")
    overall = totals.agg(F.try_divide(F.sum("_s"), F.sum("_k")).alias("global_mean"))
    known = attach_scalars(totals.where(F.col(column).isNotNull()), overall, "_g")
    fitted = known.select(column, "rows", blend(F.col("_s"), F.col("_k"), F.col("_g.global_mean"), smoothing).alias("encoding"))
    return fitted, overall


def te_lookup(df: DataFrame, fitted: DataFrame, overall: DataFrame, column: str) -> DataFrame:
    """Add ``{column}_te``; unseen and null values get the global mean."""
    found = lookup_join(df, fitted.drop("rows"), [column])
    out = attach_scalars(found, overall, "_g")
    return out.withColumn(f"{column}_te", F.coalesce("encoding", F.col("_g.global_mean"))).drop("_g", "encoding")


def target_encode_oof(
    train: DataFrame, column: str, target: str = TARGET, smoothing: float = ENCODING_SMOOTHING, folds: int = 5,
    row_id: str = "video_id", fold: Column | None = None,
) -> DataFrame:
    """Add ``{column}_te`` to training rows from the other folds only (by default folds by a hash of the id)."""
    fold = fold if fold is not None else F.pmod(F.xxhash64(row_id), F.lit(folds))
    placed = train.withColumn("_fold", fold.cast("int"))
    cells = materialize(_totals(placed, [column, "_fold"], target), "encoding")
    whole = cells.groupBy(column).agg(F.sum("_k").alias("_all_k"), F.sum("_s").alias("_all_s"))
    overall = cells.agg(F.try_divide(F.sum("_s"), F.sum("_k")).alias("global_mean"))
    others = attach_scalars(cells.join(whole, column), overall, "_g")
    left_k = F.col("_all_k") - F.col("_k")
    left_s = F.coalesce("_all_s", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0))
    fitted = others.select(
        column, "_fold", "rows", blend(left_s, left_k, F.col("_g.global_mean"), smoothing).alias("encoding")
    )
    found = attach_scalars(lookup_join(placed, fitted.drop("rows"), [column, "_fold"]), overall, "_g")
    encoded = F.coalesce("encoding", F.col("_g.global_mean"))
    return found.withColumn(f"{column}_te", encoded).drop("_g", "encoding", "_fold")


def with_encodings(df: DataFrame, train: DataFrame, columns=("author_id", "topic"), target: str = TARGET) -> DataFrame:
    """Fit on ``train``, add the encodings to ``df``."""
    for column in columns:
        fitted, overall = target_encode_fit(train, column, target)
        df = te_lookup(df, fitted, overall, column)
    return df
