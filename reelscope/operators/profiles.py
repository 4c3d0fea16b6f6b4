"""Topic profiles, exploratory tables, library search and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.fixed_values import LIBRARY_LABELS
from reelscope.operators.distribution import ROWS, profile


def topic_profile(v: DataFrame) -> DataFrame:
    """Per topic: medians of reach, gain, length and followers, length quartiles, videos."""
    return profile(
        v, ["topic"],
        {
            "plays": "plays_day30", "gain": "incr_plays_3_30", "duration": "duration", "followers": "follower_count",
        },
        {
            "avg_plays_30": ("quantile", "plays", 0.5), "avg_incr": ("quantile", "gain", 0.5),
            "median_duration": ("quantile", "duration", 0.5), "p25_duration": ("quantile", "duration", 0.25),
            "p75_duration": ("quantile", "duration", 0.75), "avg_follower_count": ("quantile", "followers", 0.5),
            "video_count": ("count", ROWS),
        },
    )


def topic_counts(v: DataFrame) -> DataFrame:
    """Videos per topic, largest first."""
    counted = v.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("video_count"))
    return counted.orderBy(F.desc("video_count"), "topic")


def topic_trajectory_medians(v: DataFrame, days=(0, 1, 3, 30)) -> DataFrame:
    """Median cumulative plays per topic at each day."""
    names = {f"plays_day{d}": f"plays_day{d}" for d in days}
    return profile(v, ["topic"], names, {f"median_{n}": ("quantile", n, 0.5) for n in names})


def deterministic_sample(df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``n`` rows picked by a hash of the key: the same rows on every run, a top-n per task."""
    shuffled = order if order is not None else F.xxhash64(F.col(key), F.lit(seed))
    return df.withColumn("_order", shuffled).orderBy("_order", key).limit(n).drop("_order")


def library_search(
    v: DataFrame, duration_range: tuple[float, float], min_views: int, topics=None, n: int = 50, labels: bool = True
) -> DataFrame:
    """Past videos by length, reach and topic; the first ``n`` by id under display names."""
    low, high = duration_range
    hits = v.where((F.col("duration") >= low) & (F.col("duration") <= high) & (F.col("plays_day30") >= min_views))
    if topics:
        hits = hits.where(F.col("topic").isin(*topics))
    first = hits.orderBy("video_id").limit(n)
    return first.select(*[F.col(c).alias(name if labels else c) for c, name in LIBRARY_LABELS.items()])

