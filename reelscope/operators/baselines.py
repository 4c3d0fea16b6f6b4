"""Reference predictions without a model; each returns ``video_id, y, yhat``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.columns import attach_scalars, num, zero
from reelscope.functions.fixed_values import TARGET
from reelscope.operators.distribution import medians
from reelscope.operators.metrics import error_metrics, long_predictions

DAYS_LEFT = 27.0


def _target(null_target: str):
    return zero(TARGET) if null_target == "zero" else num(TARGET)


def baseline_zero(v: DataFrame, null_target: str = "zero") -> DataFrame:
    """Predict no gain at all: the yardstick for a target that is mostly 0."""
    return v.select("video_id", _target(null_target).alias("y"), F.lit(0.0).alias("yhat"))


def baseline_mean(v: DataFrame, null_target: str = "zero") -> DataFrame:
    mean = v.agg(F.avg(_target(null_target)).alias("mean"))
    return attach_scalars(v, mean, "_s").select(
        "video_id", _target(null_target).alias("y"), F.col("_s.mean").alias("yhat")
    )


def baseline_day3_ratio(v: DataFrame, null_target: str = "zero") -> DataFrame:
    """Day-3 plays times the median gain per day-3 play."""
    y, plays = _target(null_target), zero("plays_day3")
    ratio = medians(v, {"ratio": y / (plays + F.lit(1.0))})
    return attach_scalars(v, ratio, "_s").select(
        "video_id", y.alias("y"), (plays * F.col("_s.ratio")).alias("yhat")
    )


def baseline_velocity(v: DataFrame, null_target: str = "zero") -> DataFrame:
    """The day 1-3 speed kept up for the remaining days."""
    ahead = F.greatest(zero("velocity_1_3") * F.lit(DAYS_LEFT), F.lit(0.0))
    return v.select("video_id", _target(null_target).alias("y"), ahead.alias("yhat"))


def baseline_naive_scale(v: DataFrame, day: int) -> DataFrame:
    """Total day-30 plays from the plays of one early day; null where that day is missing."""
    early = num(f"plays_day{day}")
    scale = medians(v, {"scale": num("plays_day30") / (early + F.lit(1.0))})
    return attach_scalars(v, scale, "_s").select(
        "video_id", zero("plays_day30").alias("y"), (early * F.col("_s.scale")).alias("yhat")
    )


def baseline_total_mean(v: DataFrame) -> DataFrame:
    mean = v.agg(F.avg(zero("plays_day30")).alias("mean"))
    return attach_scalars(v, mean, "_s").select("video_id", zero("plays_day30").alias("y"), F.col("_s.mean").alias("yhat"))


INCREMENT_BASELINES = {
    "All Zero": baseline_zero,
    "Mean Baseline": baseline_mean,
    "Day-3 Proportional": baseline_day3_ratio,
    "Velocity Extrapolation (Day 1->3)": baseline_velocity,
}


def baseline_predictions(v: DataFrame, null_target: str = "zero") -> DataFrame:
    """``video_id, model, y, yhat`` of all baselines from one scan."""
    y, plays = _target(null_target), zero("plays_day3")
    center = medians(v, {"ratio": y / (plays + F.lit(1.0))})
    mean = v.agg(F.avg(y).alias("mean"))
    beside = attach_scalars(attach_scalars(v, center, "_r"), mean, "_g")
    wide = beside.select(
        "video_id", y.alias("y"), F.lit(0.0).alias("p0"), F.col("_g.mean").alias("p1"),
        (plays * F.col("_r.ratio")).alias("p2"),
        F.greatest(zero("velocity_1_3") * F.lit(DAYS_LEFT), F.lit(0.0)).alias("p3"),
    )
    names = {name: f"p{i}" for i, name in enumerate(INCREMENT_BASELINES)}
    return long_predictions(wide, "y", names, ("video_id",))


def run_baselines(v: DataFrame, null_target: str = "zero") -> DataFrame:
    """Metrics of every baseline on the increment target."""
    return error_metrics(baseline_predictions(v, null_target))
