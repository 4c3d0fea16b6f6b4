"""Creator strategy reports: follower conversion, cadence, hashtag and audio payoff, archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions import fixed_values as fixed
from reelscope.functions.columns import archetype, bucket_label, clean_label, half_even, label_table, music_category
from reelscope.operators.distribution import ROWS, profile
from reelscope.operators.trajectory import trajectory_matrix
from reelscope.sources.tables import materialize


def creator_span(creator: DataFrame) -> DataFrame:
    """Per author: first and last date, followers at both ends, gain and active weeks."""
    followers = F.col("follower_count")
    # the counts of a date first, so that each end is one number a date and hash aggregates do
    daily = creator.withColumn("date", F.to_date("date")).groupBy("author_id", "date").agg(
        F.min(followers).alias("_low"), F.max(followers).alias("_high")
    )
    known = F.when(F.col("_low").isNotNull(), F.col("date"))
    span = daily.groupBy("author_id").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.min_by("_low", known).alias("start_followers"),
        F.max_by("_high", known).alias("end_followers"),
    )
    days = F.datediff("end_date", "start_date")
    return span.select(
        "author_id", "start_date", "end_date", "start_followers", "end_followers",
        (F.col("end_followers") - F.col("start_followers")).alias("follower_gain"),
        days.alias("total_days"),
        F.greatest(F.lit(1.0), days / F.lit(7.0).cast("double")).alias("active_weeks"),
    )


def primary_topic(v: DataFrame) -> DataFrame:
    """Most frequent topic per author, the first by name on ties."""
    counted = v.where(F.col("topic").isNotNull()).groupBy("author_id", "topic").agg(F.count(F.lit(1)).alias("_n"))
    most = counted.groupBy("author_id").agg(F.max("_n").alias("_most"))
    level = counted.join(most, "author_id").where("_n = _most")
    return level.groupBy("author_id").agg(F.min("topic").alias("primary_topic"))


def author_video_stats(v: DataFrame) -> DataFrame:
    numbers = profile(
        v, ["author_id"], {"plays": "plays_day30", "duration": "duration"},
        {
            "total_plays": ("sum", "plays"), "videos_posted": ("count", ROWS),
            "median_plays": ("quantile", "plays", 0.5), "mean_plays": ("mean", "plays"),
            "avg_duration": ("mean", "duration"),
        },
    )
    numbers = numbers.withColumn("total_plays", F.coalesce("total_plays", F.lit(0.0)))
    return numbers.join(primary_topic(v), "author_id", "left")


def join_author_span_videos(creator: DataFrame, v: DataFrame) -> DataFrame:
    """Creators seen in both tables, with their conversion and cadence measures."""
    both = creator_span(creator).join(author_video_stats(v), "author_id", "inner")
    return both.withColumns({
        "followers_per_10k_views":
            F.col("follower_gain") / F.greatest(F.lit(1000.0), F.col("total_plays")) * F.lit(10000.0),
        "videos_per_week": F.col("videos_posted") / F.col("active_weeks"),
    })


def follower_conversion_topic(authors: DataFrame, display: bool = False) -> DataFrame:
    out = profile(
        authors, ["primary_topic"],
        {"conversion": "followers_per_10k_views", "gain": "follower_gain", "views": "total_plays"},
        {
            "median_conversion": ("quantile", "conversion", 0.5), "median_creator_gain": ("quantile", "gain", 0.5),
            "median_views_per_creator": ("quantile", "views", 0.5), "creator_count": ("count", ROWS),
        },
    ).withColumn("clean_topic", clean_label("primary_topic"))
    if display:
        out = out.withColumn("median_conversion", half_even("median_conversion", 1))
    return out.orderBy(F.desc("median_conversion"), "primary_topic")


def _per_bucket(df: DataFrame, column: str, bucket, buckets, metrics, outputs) -> DataFrame:
    """Profile by labelled bucket; buckets without rows are kept."""
    names = label_table(df.sparkSession, column, [b[0] for b in buckets])
    found = profile(df.withColumn(column, bucket), [column], metrics, outputs)
    counts = {o: F.coalesce(F.col(o), F.lit(0)) for o, s in outputs.items() if s[0] == "count"}
    return F.broadcast(names).join(found, column, "left").withColumns(counts)


def follower_conversion_duration(authors: DataFrame) -> DataFrame:
    return _per_bucket(
        authors, "duration_bucket", bucket_label("avg_duration", fixed.DURATION_BUCKETS), fixed.DURATION_BUCKETS,
        {"conversion": "followers_per_10k_views", "views": "total_plays"},
        {"median_conversion": ("quantile", "conversion", 0.5), "median_views": ("quantile", "views", 0.5)},
    ).orderBy("bucket_no").drop("bucket_no")


def posting_cadence(authors: DataFrame, display: bool = False) -> DataFrame:
    out = _per_bucket(
        authors, "cadence_bucket", bucket_label("videos_per_week", fixed.CADENCE_BUCKETS), fixed.CADENCE_BUCKETS,
        {"median": "median_plays", "mean": "mean_plays", "gain": "follower_gain", "views": "total_plays"},
        {
            "creators_count": ("count", ROWS), "median_views_per_video": ("quantile", "median", 0.5),
            "mean_views_per_video": ("quantile", "mean", 0.5), "median_follower_gain": ("quantile", "gain", 0.5),
            "median_total_views": ("quantile", "views", 0.5),
        },
    ).orderBy("bucket_no").drop("bucket_no")
    if display:
        shown = ("median_views_per_video", "mean_views_per_video", "median_follower_gain")
        out = out.withColumns({c: half_even(c, 0) for c in shown})
    return out


def join_raw_processed(videos: DataFrame, v: DataFrame) -> DataFrame:
    """Audio source and hashtags of the raw videos beside the outcome columns of the summary."""
    raw = videos.where(F.col("video_id").isNotNull()).select("video_id", "music_selected_from", "hashtag_count")
    return raw.join(v.select("video_id", "plays_day30", "like_rate_day3"), "video_id", "inner")


PAYOFF_METRICS = {"views": "plays_day30", "rate": "like_rate_day3"}
PAYOFF_OUTPUTS = {
    "video_count": ("count", "views"), "median_views": ("quantile", "views", 0.5),
    "mean_views": ("mean", "views"), "avg_like_rate": ("mean", "rate"),
}


def _payoff_display(df: DataFrame, display: bool) -> DataFrame:
    percent = F.col("avg_like_rate") * F.lit(100.0)
    if not display:
        return df.withColumn("like_rate_pct", percent)
    return df.withColumns({
        "median_views": half_even("median_views", 0), "mean_views": half_even("mean_views", 0),
        "like_rate_pct": half_even(percent, 2),
    })


def hashtag_payoff(joined: DataFrame, display: bool = False) -> DataFrame:
    tags = F.coalesce(F.col("hashtag_count").cast("double"), F.lit(0.0))
    out = _per_bucket(
        joined, "hashtag_bucket", bucket_label(tags, fixed.HASHTAG_BUCKETS), fixed.HASHTAG_BUCKETS,
        PAYOFF_METRICS, PAYOFF_OUTPUTS,
    ).orderBy("bucket_no").drop("bucket_no")
    return _payoff_display(out, display)


def music_payoff(joined: DataFrame, display: bool = False) -> DataFrame:
    named = joined.withColumn("music_category", music_category("music_selected_from"))
    out = profile(named, ["music_category"], PAYOFF_METRICS, PAYOFF_OUTPUTS)
    return _payoff_display(out.orderBy(F.desc("median_views"), "music_category"), display)


def semi_join_sample(engagement: DataFrame, sample: DataFrame) -> DataFrame:
    return engagement.join(sample.select("video_id"), "video_id", "left_semi")


def archetype_assign(engagement: DataFrame, sample: DataFrame | None = None, days=fixed.CURVE_DAYS) -> DataFrame:
    """``video_id, day_d…, archetype`` of videos with day 3, day 30 and enough views.

    The class needs only the curve days, so one aggregate with a fixed set of maxima is enough.
    """
    if sample is not None:
        engagement = semi_join_sample(engagement, sample)
    wide = trajectory_matrix(engagement, sorted({*days, 3, 30}))
    kept = wide.where(
        F.col("day_3").isNotNull() & F.col("day_30").isNotNull() & (F.col("day_30") >= fixed.MIN_CURVE_VIEWS)
    )
    return kept.withColumn("archetype", archetype("day_3", "day_30"))


def archetype_shares(assigned: DataFrame, display: bool = False) -> DataFrame:
    counted = assigned.groupBy("archetype").agg(F.count(F.lit(1)).alias("video_count"))
    everything = Window.partitionBy(F.lit(1))  # three rows
    out = counted.withColumn("sample_size", F.sum("video_count").over(everything)).withColumn(
        "share_pct", F.col("video_count") * F.lit(100.0) / F.col("sample_size")
    )
    return out.withColumn("share_pct", half_even("share_pct", 1)) if display else out


def archetype_curves(assigned: DataFrame, days=fixed.CURVE_DAYS, display: bool = False) -> DataFrame:
    """``archetype, day, median_norm``: median share of the day-30 plays reached by each day."""
    metrics = {str(d): F.col(f"day_{d}") / F.col("day_30").cast("double") for d in days}
    wide = profile(assigned, ["archetype"], metrics, {f"m{d}": ("quantile", str(d), 0.5) for d in days})
    cells = F.array(*[F.struct(F.lit(d).alias("day"), F.col(f"m{d}").alias("median_norm")) for d in days])
    out = wide.select("archetype", F.inline(cells)).where(F.col("median_norm").isNotNull())
    return out.withColumn("median_norm", half_even("median_norm", 3)) if display else out


def topic_lookup(assigned: DataFrame, v: DataFrame) -> DataFrame:
    """Add the topic of each video (unique ids on both sides)."""
    return assigned.join(v.select("video_id", "topic"), "video_id", "left")


def topic_archetype_crosstab(assigned: DataFrame, v: DataFrame, display: bool = False) -> DataFrame:
    """Per topic, the percentage of each archetype."""
    named = topic_lookup(assigned, v).where(F.col("topic").isNotNull())
    counted = named.groupBy("topic").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col("archetype") == a, 1)).alias(a) for a in fixed.ARCHETYPES],
    )

    def share(a):
        pct = F.col(f"`{a}`") * F.lit(100.0) / F.col("_n")
        return (half_even(pct, 1) if display else pct).alias(a)

    return counted.select("topic", *[share(a) for a in fixed.ARCHETYPES])


def conversion_extremes(topic_report: DataFrame) -> DataFrame:
    """First, third and last category of the conversion ranking.

    Works on the finished report: one row per topic.
    """
    scope = Window.partitionBy(F.lit(1))
    ranked = topic_report.withColumns({
        "place": F.row_number().over(scope.orderBy(F.desc("median_conversion"), "primary_topic")),
        "places": F.count(F.lit(1)).over(scope),
    })
    return (
        ranked.where(F.col("place").isin(1, 3) | (F.col("place") == F.col("places")))
        .select("place", "clean_topic", "median_conversion")
    )


def strategy_bundle(creator: DataFrame, v: DataFrame, videos: DataFrame, engagement: DataFrame) -> dict[str, DataFrame]:
    """All reports as DataFrames; the three tables they share are written once."""
    authors = materialize(join_author_span_videos(creator, v), "authors")
    joined = materialize(join_raw_processed(videos, v), "payoff")
    assigned = materialize(archetype_assign(engagement), "archetypes")
    return {
        "topic_conversion": follower_conversion_topic(authors),
        "duration_conversion": follower_conversion_duration(authors),
        "cadence_summary": posting_cadence(authors),
        "hashtag_summary": hashtag_payoff(joined),
        "music_summary": music_payoff(joined),
        "archetype_shares": archetype_shares(assigned),
        "archetype_curves": archetype_curves(assigned),
        "topic_archetypes": topic_archetype_crosstab(assigned, v),
    }
