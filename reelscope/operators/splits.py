"""Time-ordered splits.  All cut points come from counts per date or per value bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.columns import attach_scalars
from reelscope.operators.distribution import number_rows


def time_cutoff(v: DataFrame, q: float = 0.8, date: str = "create_date") -> DataFrame:
    """One row ``cutoff_day``: the ``q`` quantile of the date, in days since 1970, interpolated.

    Sorts the counts per date only, so the sorted table is bounded by the calendar.
    """
    per_day = v.where(F.col(date).isNotNull()).groupBy(F.unix_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    calendar = Window.partitionBy(F.lit(1))
    upto = calendar.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_day.withColumns({
        "stop": F.sum("n").over(upto), "position": F.lit(q) * (F.sum("n").over(calendar) - 1),
    })
    low = F.min(F.when(F.floor("position") < F.col("stop"), F.col("d")))
    high = F.min(F.when(F.ceil("position") < F.col("stop"), F.col("d")))
    part = F.max(F.col("position") - F.floor("position"))
    return placed.agg((low + (high - low) * part).alias("cutoff_day"))


def time_split(v: DataFrame, q: float = 0.8, date: str = "create_date", row_id: str = "video_id") -> DataFrame:
    """Add ``is_train`` (on or before the cutoff); null for rows without a date.

    Without any date, the first share ``q`` of the rows in the order of ``row_id`` is for training.
    """
    if v.where(F.col(date).isNotNull()).limit(1).count() == 0:
        return positional_split(v, q, (date, row_id)).withColumnRenamed("is_head", "is_train")
    marked = attach_scalars(v, time_cutoff(v, q, date), "_cut")
    return marked.withColumn("is_train", F.unix_date(date) <= F.col("_cut.cutoff_day")).drop("_cut")


def expanding_folds(
    v: DataFrame, k: int = 5, embargo_days: int = 0, min_train: int = 100, min_test: int = 50,
    date: str = "create_date",
) -> DataFrame:
    """``fold, train_end, test_start, test_end, train_rows, test_rows``.

    The first half of the distinct dates is always training data; the rest is cut into ``k`` blocks of
    equally many dates, each tested after training on everything earlier.  Works on the table of
    distinct dates, which is bounded by the calendar.
    """
    dates = v.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    calendar = Window.partitionBy(F.lit(1))
    by_day = calendar.orderBy(F.unix_date("d"))
    earlier = by_day.rangeBetween(Window.unboundedPreceding, -1 - embargo_days)
    numbered = (
        dates.withColumn("total", F.count(F.lit(1)).over(calendar))
        .withColumn("place", F.row_number().over(by_day) - 1)
        .withColumn("train_rows", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("train_end", F.max("d").over(earlier))
    )
    size = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(0.5) / F.lit(float(k))))
    start = F.floor(F.col("total") * F.lit(0.5))
    blocks = numbered.withColumn("fold", F.floor((F.col("place") - start) / size.cast("double")).cast("int"))
    folds = blocks.where((F.col("place") >= start) & (F.col("fold") < k)).groupBy("fold").agg(
        F.min_by("train_end", "d").alias("train_end"),
        F.min("d").alias("test_start"),
        F.max("d").alias("test_end"),
        F.min("train_rows").alias("train_rows"),
        F.sum("n").alias("test_rows"),
    )
    return folds.where((F.col("train_rows") >= min_train) & (F.col("test_rows") >= min_test))


def positional_split(df: DataFrame, frac: float, order: tuple[str, str] = ("create_date", "video_id")) -> DataFrame:
    """Add ``is_head``: the first ``int(n * frac)`` rows in the given order (a value, then a numeric id)."""
    numbered = number_rows(df, order[0], order[1], "_row")
    sized = attach_scalars(numbered, df.agg(F.count(F.lit(1)).alias("n")), "_size")
    head: Column = F.col("_row") <= F.floor(F.col("_size.n") * F.lit(frac))
    return sized.withColumn("is_head", head).drop("_row", "_size")
