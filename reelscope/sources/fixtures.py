"""Raw media tables derived by Spark from the TPC-H style test tables (rules in FIXTURES.md).

A "video" is a part, its daily counters come from the part's order lines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelscope.functions.fixed_values import EMOTIONS

EMOTION_FACTORS = dict(zip(EMOTIONS, (37, 41, 43, 47, 53, 59)))
BUCKET_DAYS = 73.0


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (video, date, quantity) with counts: equal order lines collapse before any shuffle."""
    raw = spark.read.parquet(os.path.join(folder, "lineitem.parquet"))
    return (
        raw.select(
            F.col("l_partkey").alias("video_id"),
            F.to_date("l_shipdate").alias("d"),
            F.col("l_quantity").cast("long").alias("q"),
        )
        .groupBy("video_id", "d", "q").agg(F.count(F.lit(1)).alias("n"))
    )


def author_of(video: str = "video_id"):
    return F.floor(F.sqrt(F.col(video).cast("double"))).cast("long")


def engagement_daily(spark: SparkSession, folder: str) -> DataFrame:
    video = Window.partitionBy("video_id")
    vid = F.col("video_id")
    k = F.col("days_since_post")
    scale = F.when(vid % 50 == 0, F.lit(40.0)).otherwise(F.lit(1.0))
    slow = F.when(vid % 3 == 0, F.lit(0.0)).when(vid % 3 == 1, F.lit(0.25)).otherwise(F.lit(1.0))
    step = F.floor(F.col("q") * F.lit(100.0) * scale / (F.lit(1.0) + k.cast("double") * k.cast("double") * slow))
    daily = (
        _lines(spark, folder)
        .withColumn("first_day", F.min("d").over(video))
        .withColumn(
            "days_since_post",
            F.floor(F.datediff("d", "first_day").cast("double") / F.lit(BUCKET_DAYS)).cast("int"),
        )
        .groupBy("video_id", "days_since_post")
        .agg(F.max("d").alias("date"), F.sum(step * F.col("n")).cast("long").alias("inc"))
    )
    upto = video.orderBy("days_since_post").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def running(value):
        return F.sum(F.floor(value).cast("long")).over(upto)

    inc = F.col("inc").cast("double")
    counters = daily.select(
        "video_id", "date", "days_since_post",
        running(inc).alias("play_count"),
        running(inc * (vid % 13) / F.lit(100.0)).alias("like_count"),
        running(inc / F.lit(200.0)).alias("comment_count"),
        running(inc * (vid % 7) / F.lit(500.0)).alias("share_count"),
    )
    # each row once, plus an exact copy of some, plus a row dated before the post for some
    early = F.array(F.struct(F.lit(-400).alias("shift"), F.lit(-1).alias("day")))
    same = F.array(F.struct(F.lit(0).alias("shift"), k.alias("day")))
    copies = F.concat(
        same,
        F.when(vid % 17 == 0, same).otherwise(F.slice(same, 1, 0)),
        F.when((vid % 19 == 0) & (k == 0), early).otherwise(F.slice(same, 1, 0)),
    )
    return counters.select("*", F.inline(copies)).select(
        "video_id",
        F.date_format(F.date_add("date", F.col("shift")), "yyyy-MM-dd").alias("date"),
        F.col("day").alias("days_since_post"),
        "play_count", "like_count", "comment_count", "share_count",
    )


def creator_daily(spark: SparkSession, folder: str) -> DataFrame:
    per_day = (
        _lines(spark, folder).withColumn("author_id", author_of())
        .groupBy("author_id", F.col("d").alias("date"))
        .agg(F.sum((F.col("q") * 10 - 200) * F.col("n")).alias("change"))
    )
    author = Window.partitionBy("author_id")
    upto = author.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    followers = F.lit(1000) + F.col("author_id") * 100 + F.sum("change").over(upto)
    return (
        per_day.withColumn("follower_count", followers)
        .withColumn("first_day", F.min("date").over(author))
        .where(F.datediff("date", "first_day") <= 180)
        .select(
            "author_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "follower_count",
            (F.col("author_id") % 200 + 50).alias("following_count"),
            (F.col("follower_count") * 10).alias("total_favorited"),
            (F.col("author_id") % 2).cast("int").alias("enterprise_verified"),
        )
    )


def videos(spark: SparkSession, folder: str) -> DataFrame:
    part = spark.read.parquet(os.path.join(folder, "part.parquet")).withColumnRenamed("p_partkey", "video_id")
    lines = spark.read.parquet(os.path.join(folder, "lineitem.parquet"))
    first = lines.groupBy(F.col("l_partkey").alias("video_id")).agg(F.min(F.to_date("l_shipdate")).alias("first_day"))
    vid = F.col("video_id")

    def unless(every: int, value):
        return F.when(vid % every != 0, value)

    sounds = ("original_sound", "single_song", "recommend_list", "search_result", "effect")
    music = F.coalesce(*[F.when(vid % 6 == i, F.lit(x)) for i, x in enumerate(sounds)])
    return part.join(first, "video_id").select(
        "video_id",
        author_of().alias("author_id"),
        F.date_format("first_day", "yyyy-MM-dd").alias("create_date"),
        unless(41, F.col("p_type")).alias("topic"),
        unless(29, F.col("p_size").cast("double") * 3).alias("duration"),
        (vid % 2).cast("int").alias("is_english"),
        unless(23, (F.col("p_size") % 18).cast("double")).alias("hashtag_count"),
        unless(10, (vid * 31 % 200).cast("double")).alias("word_count"),
        unless(10, (vid * 7 % 50).cast("double") / F.lit(10.0)).alias("speaking_rate"),
        *[unless(11, (vid * m % 101).cast("double") / F.lit(100.0)).alias(e) for e, m in EMOTION_FACTORS.items()],
        music.alias("music_selected_from"),
    )
