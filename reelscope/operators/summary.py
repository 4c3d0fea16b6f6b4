"""Per-video 30-day summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.columns import zero
from reelscope.functions.fixed_values import EMOTIONS, SNAPSHOT_DAYS
from reelscope.operators import cleaning
from reelscope.operators.distribution import lookup_join
from reelscope.sources.tables import materialize

COUNTERS = {
    "plays": "play_count", "likes": "like_count", "comments": "comment_count", "shares": "share_count",
}
META = (
    "video_id", "author_id", "create_date", "topic", "duration", "is_english", *EMOTIONS,
    "word_count", "speaking_rate", "hashtag_count",
)


def snapshot_filter(engagement: DataFrame, days=SNAPSHOT_DAYS) -> DataFrame:
    return engagement.where(F.col("days_since_post").isin(*days))


def pivot_snapshots(engagement: DataFrame, days=SNAPSHOT_DAYS, counters=("plays", "likes", "comments", "shares")):
    """One row per video: ``{counter}_day{d}`` and ``date_day0``.

    ``engagement`` has one row per video and date (:func:`cleaning.clean_engagement`).  One hash aggregate over the
    snapshot rows; if several dates of a video say the same day, the largest counter and the first date count.
    """
    cells = [
        F.max(F.when(F.col("days_since_post") == d, F.col(COUNTERS[c]))).alias(f"{c}_day{d}") for d in days for c in counters
    ]
    started = F.min(F.when(F.col("days_since_post") == 0, F.col("date"))).alias("date_day0")
    return snapshot_filter(engagement, days).groupBy("video_id").agg(started, *cells)


def day0_meta(videos: DataFrame, snapshots: DataFrame, creator: DataFrame) -> DataFrame:
    """Static columns of each video with a day-0 row, with the followers of that day."""
    started = snapshots.where(F.col("date_day0").isNotNull())
    joined = started.join(videos.select(*META), "video_id", "inner")
    day = creator.select("author_id", F.col("date").alias("date_day0"), "follower_count")
    return joined.join(day, ["author_id", "date_day0"], "left")


def incr_targets(v: DataFrame) -> DataFrame:
    """Gain from day 3 to day 30 of every counter; null when an end is missing."""
    return v.withColumns({f"incr_{c}_3_30": F.col(f"{c}_day30") - F.col(f"{c}_day3") for c in COUNTERS})


def growth_factor(v: DataFrame) -> DataFrame:
    return v.withColumn("growth_factor_plays", F.log1p("plays_day30") - F.log1p("plays_day3"))


def first_velocity() -> Column:
    return zero("plays_day1") - zero("plays_day0")


def second_velocity() -> Column:
    return (zero("plays_day3") - zero("plays_day1")) / F.lit(2.0)


def velocity_accel(v: DataFrame) -> DataFrame:
    return v.withColumns({
        "velocity_0_1": first_velocity().cast("long"),
        "velocity_1_3": second_velocity(),
        "acceleration": second_velocity() - first_velocity(),
    })


def decay_ratio(v: DataFrame) -> DataFrame:
    """Later speed per earlier speed + 1; 0 where that denominator vanishes."""
    below = first_velocity() + F.lit(1.0)
    ratio = F.when(F.abs(below) < F.lit(0.001), F.lit(0.0)).otherwise(F.try_divide(second_velocity(), below))
    return v.withColumn("decay_ratio", ratio)


def quality_rates(v: DataFrame) -> DataFrame:
    """Likes, comments and shares per play at day 3."""
    plays = F.greatest(zero("plays_day3") + F.lit(1.0), F.lit(1.0))
    return v.withColumns({
        f"{name}_rate_day3": zero(f"{counter}_day3") / plays
        for name, counter in (("like", "likes"), ("comment", "comments"), ("share", "shares"))
    })


def penetration_rate(v: DataFrame) -> DataFrame:
    return v.withColumn(
        "penetration_rate",
        F.try_divide(F.col("plays_day3").cast("double"), F.col("follower_count").cast("double") + F.lit(1.0)),
    )


def creator_stats(v: DataFrame) -> DataFrame:
    """Per author: approximate median, count and mean of day-30 plays (all mergeable, map-side)."""
    return v.groupBy("author_id").agg(
        F.percentile_approx("plays_day30", 0.5, 10000).alias("creator_median_plays30"),
        F.count("video_id").alias("creator_video_count"),
        F.avg("plays_day30").alias("creator_avg_plays30"),
    )


def join_creator_stats(v: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the author's statistics; an author with a large share of all videos stays spread out."""
    return lookup_join(v, stats, ["author_id"])


def creator_stats_prior(v: DataFrame) -> DataFrame:
    """Leak-free variant: mean and count of day-30 plays over the author's earlier create dates only.

    Works on (author, date) totals, so an author contributes at most one row per calendar day.
    """
    per_day = v.groupBy("author_id", "create_date").agg(
        F.count("video_id").alias("_n"), F.count("plays_day30").alias("_k"), F.sum("plays_day30").alias("_s")
    )
    earlier = Window.partitionBy("author_id").orderBy("create_date").rowsBetween(Window.unboundedPreceding, -1)
    prior = per_day.select(
        "author_id", "create_date",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("prior_video_count"),
        F.try_divide(F.sum("_s").over(earlier).cast("double"), F.sum("_k").over(earlier)).alias("prior_avg_plays30"),
        F.col("_n").alias("_weight"),
    )
    return lookup_join(v, prior, ["author_id", "create_date"], "_weight")


def derive(v: DataFrame) -> DataFrame:
    """All row-level columns of the summary except those that need the creator."""
    for step in (incr_targets, growth_factor, velocity_accel, decay_ratio, quality_rates):
        v = step(v)
    return v


def video_base(videos: DataFrame, engagement: DataFrame, creator: DataFrame) -> DataFrame:
    """Summary before the creator statistics; takes raw tables."""
    snapshots = pivot_snapshots(cleaning.clean_engagement(engagement))
    meta = day0_meta(cleaning.clean_videos(videos), snapshots, cleaning.clean_creator(creator))
    return penetration_rate(derive(meta)).drop("date_day0")


def with_creator_stats(base: DataFrame) -> DataFrame:
    return join_creator_stats(base, creator_stats(base))


def video_summary(videos: DataFrame, engagement: DataFrame, creator: DataFrame) -> DataFrame:
    """Raw tables → one row per video.

    The base feeds both the author statistics and the result; it is written once, so that the raw tables
    are read and joined once.
    """
    return with_creator_stats(materialize(video_base(videos, engagement, creator), "video_base"))


def drop_null_target(v: DataFrame, columns=("incr_plays_3_30",)) -> DataFrame:
    return v.dropna(subset=list(columns))


def min_views_filter(v: DataFrame, low: int, column: str = "plays_day30") -> DataFrame:
    return v.where(F.col(column) >= low)
