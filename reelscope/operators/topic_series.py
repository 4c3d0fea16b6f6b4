"""Daily series per topic: totals, dense calendars, top topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_daily(daily: DataFrame) -> DataFrame:
    """``daily`` holds one row per video and day with its topic."""
    return daily.groupBy("date", "topic").agg(
        F.count("video_id").alias("active_videos"),
        F.sum("play_count").alias("total_plays"),
        F.sum("like_count").alias("total_likes"),
        F.sum("comment_count").alias("total_comments"),
        F.sum("share_count").alias("total_shares"),
        F.avg("play_count").alias("avg_plays_per_video"),
    )


def sorted_topic_daily(series: DataFrame) -> DataFrame:
    return series.orderBy("topic", "date")


def arg_max_topic(series: DataFrame, value: str = "total_plays") -> DataFrame:
    """The topic with the largest total (the first by name on ties): one row ``topic, total``."""
    totals = series.where(F.col("topic").isNotNull()).groupBy("topic").agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), "topic").limit(1)


def top_topic_filter(series: DataFrame, value: str = "total_plays") -> DataFrame:
    """Rows of the top topic only (one broadcast row)."""
    return series.join(F.broadcast(arg_max_topic(series, value).select("topic")), "topic", "left_semi")


def calendar(series: DataFrame) -> DataFrame:
    """Every ``topic, date`` between a topic's first and last date."""
    span = series.groupBy("topic").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    return span.select("topic", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))


def calendar_join(series: DataFrame, value: str) -> DataFrame:
    """Reindex each topic onto its full calendar; absent days are null."""
    known = series.where(F.col(value).isNotNull() & F.col("topic").isNotNull()).select("topic", "date", value)
    return calendar(known).join(known, ["topic", "date"], "left")


def ffill_bfill(dense: DataFrame, value: str, out: str = "value") -> DataFrame:
    """Fill forward, then backward, inside each topic (one row per day, so a bounded group)."""
    by_day = Window.partitionBy("topic").orderBy("date")
    back = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_day.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.last(value, True).over(back), F.first(value, True).over(ahead))
    return dense.select("topic", "date", filled.cast("double").alias(out))


def daily_series(series: DataFrame, value: str) -> DataFrame:
    """``topic, date, value`` without gaps."""
    return ffill_bfill(calendar_join(series, value), value)


def number_series(series: DataFrame, frac: float = 0.8) -> DataFrame:
    """Add position, length and the leading-share flag of each point of a dense series."""
    topic = Window.partitionBy("topic")
    return (
        series.withColumn("position", F.row_number().over(topic.orderBy("date")))
        .withColumn("length", F.count(F.lit(1)).over(topic))
        .withColumn("is_train", F.col("position") <= F.floor(F.col("length") * F.lit(frac)))
    )


def recent_history(series: DataFrame, n: int = 30, frac: float = 0.8) -> DataFrame:
    """The last ``n`` training points of each topic."""
    train = number_series(series, frac).where("is_train")
    newest = Window.partitionBy("topic").orderBy(F.desc("date"))
    return (
        train.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
        .select("topic", "date", "value")
    )
