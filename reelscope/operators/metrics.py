"""Error measures of predictions, for many models at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.columns import num
from reelscope.operators.distribution import profile


def long_predictions(df: DataFrame, y: str, predictions: dict[str, str], extra=()) -> DataFrame:
    """``model, y, yhat`` from one prediction column per model."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), num(c).alias("yhat")) for m, c in predictions.items()])
    return df.select(*extra, num(y).alias("y"), F.inline(cells))


def error_metrics(df: DataFrame, by=("model",), clip_prediction: bool = False, extra=None) -> DataFrame:
    """``by, n, mae, medae, rmse, wape, smape, r2`` of the columns ``y`` and ``yhat``.

    Rows with a null on either side are left out.  sMAPE has +1 in its denominator; ``clip_prediction``
    counts negative predictions as 0 in it.  Constant ``y``: R² is 1 for perfect predictions, else 0.
    ``extra`` holds more aggregates of the same rows.
    """
    by = list(by)
    rows = df.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    miss = F.abs(F.col("y") - F.col("yhat"))
    seen = F.greatest("yhat", F.lit(0.0)) if clip_prediction else F.col("yhat")
    symmetric = F.lit(2.0) * F.abs(F.col("y") - seen) / (F.abs("y") + F.abs(seen) + F.lit(1.0))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(miss).alias("mae"),
        F.avg(miss * miss).alias("mse"),
        F.sum(miss).alias("sum_miss"),
        F.sum(F.abs("y")).alias("sum_y"),
        F.avg(symmetric).alias("sym"),
        F.var_pop("y").alias("spread"),
        *[aggregate.alias(name) for name, aggregate in (extra or {}).items()],
    )
    middle = profile(rows, by, {"miss": miss}, {"medae": ("quantile", "miss", 0.5)})
    joined = sums.join(middle, by) if by else sums.withColumn("medae", middle.scalar())
    r2 = F.when(F.col("n") >= 2, _explained("mse", "spread"))
    wape = F.when(F.col("sum_y") > 0, F.try_divide("sum_miss", "sum_y") * F.lit(100.0))
    return joined.select(
        *by, "n", "mae", "medae", F.sqrt("mse").alias("rmse"), wape.alias("wape"),
        (F.col("sym") * F.lit(100.0)).alias("smape"), r2.alias("r2"), *(extra or {}),
    )


def _explained(mse: str, spread: str):
    """R²; without any spread 1 for no error and 0 otherwise."""
    flat = F.when(F.col(mse) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.col(spread) > 0, F.lit(1.0) - F.col(mse) / F.col(spread)).otherwise(flat)


def bounded_log(c: str):
    """Log prediction kept in [-1, 25] before it is exponentiated."""
    return F.greatest(F.least(num(c), F.lit(25.0)), F.lit(-1.0))


def log_scale_metrics(df: DataFrame, by=("model",)) -> DataFrame:
    """Metrics of log-scale ``y`` and ``yhat`` on the original scale, plus ``r2_log``."""
    by = list(by)
    rows = df.where(F.col("y").isNotNull() & F.col("yhat").isNotNull()).withColumn("yhat", bounded_log("yhat"))
    both = rows.select(
        *by, F.col("y").alias("log_y"), F.col("yhat").alias("log_yhat"),
        F.expm1("y").alias("y"), F.greatest(F.expm1("yhat"), F.lit(0.0)).alias("yhat"),
    )
    miss = F.col("log_y") - F.col("log_yhat")
    logs = {"_log_mse": F.avg(miss * miss), "_log_spread": F.var_pop("log_y")}
    scored = error_metrics(both, by, clip_prediction=True, extra=logs)
    return (
        scored.withColumnRenamed("r2", "r2_raw").withColumn("r2_log", _explained("_log_mse", "_log_spread"))
        .drop(*logs)
    )


def symmetric_error(df: DataFrame) -> DataFrame:
    """One row ``smape`` of log-scale ``y`` and ``yhat`` on the original scale, as in :func:`log_scale_metrics`."""
    rows = df.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    y, seen = F.expm1("y"), F.greatest(F.expm1(bounded_log("yhat")), F.lit(0.0))
    return rows.agg((F.avg(F.lit(2.0) * F.abs(y - seen) / (F.abs(y) + seen + F.lit(1.0))) * F.lit(100.0)).alias("smape"))


def cv_summary(folds: DataFrame, columns=("smape", "r2_log", "medae")) -> DataFrame:
    """``metric, mean, std`` over the folds (sample standard deviation)."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), num(c).alias("x")) for c in columns])
    return folds.select(F.inline(cells)).groupBy("metric").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")
    )
