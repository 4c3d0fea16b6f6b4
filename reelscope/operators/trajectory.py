"""Windows over each video's daily counters.  A video has one row per day, so windows are bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.fixed_values import PANEL_DAYS


def trajectory_features(daily: DataFrame) -> DataFrame:
    """Lag-1 plays, mean of the three rows before, gain of the day, day of week (Sunday = 1)."""
    by_day = Window.partitionBy("video_id").orderBy("days_since_post", "date")
    lag = F.lag("play_count", 1).over(by_day)
    return daily.select(
        "video_id", "date", "days_since_post", "play_count",
        lag.alias("play_lag1"),
        F.avg("play_count").over(by_day.rowsBetween(-3, -1)).alias("play_roll3_avg"),
        (F.col("play_count") - F.coalesce(lag, F.lit(0))).alias("daily_play_inc"),
        F.dayofweek("date").alias("day_of_week"),
    )


def panel_trajectory(engagement: DataFrame, steps=PANEL_DAYS) -> DataFrame:
    """``video_id, step, day, plays``: plays at fixed days, linear between the observed neighbours.

    Before the first or after the last observation the nearest observed value is used.
    """
    point = F.struct(F.col("days_since_post").cast("int").alias("day"), F.col("play_count").cast("double").alias("plays"))
    known = F.when(F.col("days_since_post").isNotNull() & F.col("play_count").isNotNull(), point)
    # a set per video: its days are few, and copies of a row collapse before the shuffle
    seen = engagement.groupBy("video_id").agg(F.collect_set(known).alias("_seen"))
    wanted = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(d).alias("day")) for i, d in enumerate(steps)])
    points = seen.select("video_id", "_seen", F.inline(wanted))
    later = F.filter("_seen", lambda x: x["day"] >= F.col("day"))
    near = points.withColumn(
        "_a", F.array_max(F.filter("_seen", lambda x: x["day"] <= F.col("day")))
    ).withColumn("_next", F.array_min(F.transform(later, lambda x: x["day"]))).withColumn(
        "_b", F.array_max(F.filter("_seen", lambda x: x["day"] == F.col("_next")))
    )
    gap = (F.col("_b.day") - F.col("_a.day")).cast("double")
    share = F.try_divide((F.col("day") - F.col("_a.day")).cast("double"), gap)
    between = F.col("_a.plays") + (F.col("_b.plays") - F.col("_a.plays")) * F.coalesce(share, F.lit(0.0))
    return near.select(
        "video_id", "step", "day", F.coalesce(between, F.col("_a.plays"), F.col("_b.plays")).alias("plays")
    )


def trajectory_matrix(engagement: DataFrame, days) -> DataFrame:
    """Wide ``video_id, day_0, day_1, …``: the highest play count of each day; one aggregate."""
    picks = [F.max(F.when(F.col("days_since_post") == d, F.col("play_count"))).alias(f"day_{d}") for d in days]
    return engagement.where(F.col("days_since_post").isin(*days)).groupBy("video_id").agg(*picks)
