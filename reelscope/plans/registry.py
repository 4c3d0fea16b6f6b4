"""Every registered query: a name and a function of a :class:`Workspace`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions import columns as C
from reelscope.functions import fixed_values as fixed
from reelscope.operators import (
    baselines, cleaning, decisions, distribution, encoding, features, forecast, leaderboard, metrics, models,
    profiles, splits, stats, strategy, summary, topic_series, trajectory,
)
from reelscope.plans import scoring
from reelscope.plans.pipeline import Workspace
from reelscope.sources import tables

IMPUTED = ("duration", *fixed.TEXT_COLUMNS, *fixed.EMOTIONS)


def stable(df: DataFrame) -> DataFrame:
    """Same types and rounding on both sides of a comparison: whole numbers as long, doubles to 6 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- scans, sinks, profiling -------------------------------------------------------------------------

def scan_raw_videos(ws: Workspace):
    return ws.videos


def scan_raw_creator(ws: Workspace):
    return ws.creator


def sink_processed(ws: Workspace, name: str = "topics"):
    tables.write_table(getattr(ws, name), ws.folder, f"sink_check_{name}")
    return tables.read_table(ws.spark, ws.folder, f"sink_check_{name}")


def scan_strategy_inputs(ws: Workspace):
    ws.processed()
    return tables.column_totals(tables.scan_strategy_inputs(ws.spark, ws.folder, ws.folder))


def row_counts(ws: Workspace):
    return tables.row_counts(dict(zip(tables.RAW_TABLES, ws.raw())))


def sink_bundle(ws: Workspace, name: str = "topic_counts"):
    import os

    v = ws.summary
    reports = {"topic_counts": profiles.topic_counts(v), "topic_profile": profiles.topic_profile(v)}
    folder = os.path.join(ws.folder, "report_bundle")
    return tables.reuse_bundle(ws.spark, folder, list(reports), lambda: reports)[name]


# --- cleaning and summary ----------------------------------------------------------------------------

def cleaned(ws: Workspace):
    return cleaning.clean(*ws.raw())


def base(ws: Workspace) -> DataFrame:
    ws.processed()
    return tables.read_table(ws.spark, ws.folder, "video_base")


def snapshots(ws: Workspace, days=fixed.SNAPSHOT_DAYS, counters=("plays", "likes", "comments", "shares")):
    return summary.pivot_snapshots(cleaning.clean_engagement(ws.engagement), days, counters)


def rename_pivot(ws: Workspace):
    old = snapshots(ws, fixed.NOTEBOOK_SNAPSHOT_DAYS, ("plays", "likes"))
    return old.select(
        "video_id", "plays_day0", "plays_day1", "plays_day3", F.col("plays_day30").alias("target_plays_30d"),
        "likes_day0", "likes_day1", "likes_day3",
    )


def meta(ws: Workspace):
    videos, _, creator = ws.raw()
    return summary.day0_meta(cleaning.clean_videos(videos), snapshots(ws), cleaning.clean_creator(creator))


def day0_meta(ws: Workspace):
    return meta(ws).select(
        "video_id", "author_id", "create_date", "topic", "is_english", "follower_count", "duration",
        *fixed.EMOTIONS, *fixed.TEXT_COLUMNS,
    )


def join_meta_pivot(ws: Workspace):
    cells = [f"{c}_day{d}" for d in fixed.SNAPSHOT_DAYS for c in summary.COUNTERS]
    return meta(ws).select("video_id", "author_id", "topic", "follower_count", *cells)


def daily(ws: Workspace):
    return cleaning.full_daily(*cleaned(ws))


def topic_rows(ws: Workspace):
    videos, engagement, _ = ws.raw()
    joined = cleaning.join_engagement_video(cleaning.clean_engagement(engagement), cleaning.clean_videos(videos))
    return topic_series.topic_daily(joined)


# --- series ------------------------------------------------------------------------------------------

def series(ws: Workspace):
    return topic_series.daily_series(ws.topics, "avg_plays_per_video")


def play_series(ws: Workspace):
    return ws.topics.where(F.col("topic").isNotNull()).select("topic", "date", F.col("total_plays").alias("value"))


# --- strategy ----------------------------------------------------------------------------------------

def authors(ws: Workspace):
    return ws.cached("authors", lambda: strategy.join_author_span_videos(ws.creator, ws.summary))


def payoff_rows(ws: Workspace):
    return strategy.join_raw_processed(ws.videos, ws.summary)


def assigned(ws: Workspace):
    return strategy.archetype_assign(ws.engagement)


def sample_order():
    return (F.col("video_id") % F.lit(1 << 31) * F.lit(2654435761)) % F.lit(1 << 31)


def semi_join_sample(ws: Workspace):
    started = cleaning.valid_days(ws.engagement).where("days_since_post = 0").select("video_id").distinct()
    sample = profiles.deterministic_sample(started, 1500, "video_id", order=sample_order())
    rows = cleaning.cast_dates(ws.engagement, "date")
    return strategy.semi_join_sample(rows, sample)


def strategy_bundle(ws: Workspace):
    videos, engagement, creator = ws.raw()
    return tables.long_contents(strategy.strategy_bundle(creator, ws.summary, videos, engagement))


# --- features ----------------------------------------------------------------------------------------

def pick(ws: Workspace, expressions: dict) -> DataFrame:
    return ws.summary.select("video_id", *[e.alias(n) for n, e in expressions.items()])


def feat_calendar(ws: Workspace):
    v = ws.summary
    beside = C.attach_scalars(v, v.agg(F.min("create_date").alias("d")), "_f")
    return beside.select("video_id", *[e.alias(n) for n, e in features.feat_calendar(F.col("_f.d")).items()])


def feat_impute(ws: Workspace):
    v = ws.summary
    beside = C.attach_scalars(v, features.feature_medians(v, IMPUTED), "_m")
    parts = features.feat_impute(lambda c: F.col(f"_m.{c}"))
    return beside.select("video_id", *[e.alias(n) for n, e in parts.items()])


def feat_v1(ws: Workspace):
    rows = features.feat_v1(ws.summary)
    return rows.select(*[c for c in rows.columns if c != "topic_vec"], *features.hot_place())


def one_hot_topic(ws: Workspace):
    return features.one_hot_topic(ws.summary).select("video_id", *features.hot_place())


def coerce_numeric(ws: Workspace):
    rows = ws.videos.select(
        "video_id", F.col("music_selected_from").alias("music_number"),
        F.col("duration").cast("string").alias("duration_number"),
    )
    return features.coerce_numeric(rows, ["music_number", "duration_number"])


def rank_columns(ws: Workspace, by_topic: bool):
    ranks = features.rank_features(ws.summary)
    names = [c for c in ranks.columns if ("topic_rank" in c) == by_topic and c != "video_id"]
    return ws.summary.select("video_id").join(ranks, "video_id", "left").select("video_id", *names)


# --- encodings and splits ----------------------------------------------------------------------------

def split(ws: Workspace):
    return ws.cached("split", lambda: splits.time_split(ws.summary))


def target_encode_fit(ws: Workspace):
    return encoding.target_encode_fit(split(ws).where("is_train"), "topic")[0]


def te_lookup(ws: Workspace):
    rows = split(ws)
    return encoding.with_encodings(rows, rows.where("is_train")).select("video_id", "author_id_te", "topic_te")


def target_encode_oof(ws: Workspace):
    fold = F.col("video_id") % 5
    return encoding.target_encode_oof(split(ws).where("is_train"), "author_id", fold=fold).select("video_id", "author_id_te")


# --- metrics -----------------------------------------------------------------------------------------

def naive_scale(ws: Workspace):
    parts = [baselines.baseline_naive_scale(ws.summary, d).select(F.lit(d).alias("day"), "*") for d in (1, 3)]
    return parts[0].unionByName(parts[1])


def log_scale_metrics(ws: Workspace):
    level = F.log1p(C.zero("plays_day3"))
    v = ws.summary.select(features.log_target().alias("y"), level.alias("up"), (-level).alias("down"))
    return metrics.log_scale_metrics(metrics.long_predictions(v, "y", {"day 3 level": "up", "negative": "down"}))


def seasonal_forecast(ws: Workspace):
    """The paths may grow without bound, so they are shown to nine digits, not to decimals."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("forecast"))))
    shown = F.when(F.col("forecast") == 0, F.lit(0.0)).otherwise(F.round(F.col("forecast") / size, 8) * size)
    return forecast.forecast_seasonal_ar(series(ws)).withColumn("forecast", shown)


def trend_metrics(ws: Workspace):
    rows = forecast.forecast_trend_weekly(series(ws)).select(F.col("actual").alias("y"), F.col("forecast").alias("yhat"))
    return metrics.error_metrics(rows, by=()).select(F.lit("Trend + weekday").alias("model"), "*")


def board(ws: Workspace):
    return leaderboard.leaderboard_union({
        leaderboard.TRACK_A: [baselines.run_baselines(ws.summary)], leaderboard.TRACK_B: [trend_metrics(ws)],
    })


def leaderboard_sort(ws: Workspace):
    from pyspark.sql import Window

    ranked = leaderboard.leaderboard_sort(board(ws))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy("smape", "model")))


def track_leaderboards(ws: Workspace):
    tracks = leaderboard.track_leaderboards(baselines.run_baselines(ws.summary), None, trend_metrics(ws))
    return leaderboard.leaderboard_union({t: [b.drop("track")] for t, b in tracks.items()})


def track_leaderboards_models(ws: Workspace):
    board_ = models.run_models(training(ws), ["elastic_net", "ridge"])
    tracks = leaderboard.track_leaderboards(baselines.run_baselines(ws.summary), board_, trend_metrics(ws))
    return leaderboard.leaderboard_union({t: [b.drop("track")] for t, b in tracks.items()})


# --- models ------------------------------------------------------------------------------------------

def training(ws: Workspace) -> DataFrame:
    return ws.cached("training", lambda: models.training_frame(ws.summary), frame=False)


def model_run(name: str):
    def run(ws: Workspace):
        frame = training(ws)
        return models.fit_predict(name, frame.where("is_train"), frame.where(~F.col("is_train")))
    return run


def quantile_forest(ws: Workspace):
    frame = training(ws)
    forest = models.fit_quantile_forest(frame.where("is_train"))
    return forest.predict(frame.where(~F.col("is_train")))


def hyper_search(ws: Workspace):
    found = ws.cached("trials", lambda: models.hyper_search(training(ws).where("is_train"), "gbt_mape"))
    return found.orderBy(F.asc_nulls_last("smape"), "trial")


def expanding_cv(ws: Workspace):
    return ws.cached("expanding_cv", lambda: models.expanding_cv(ws.summary, "gbt_mape", params={"trees": 300}))


def feature_importance(ws: Workspace):
    train = training(ws).where("is_train")
    return models.feature_importance(models.fit("gbt_mse", train), train)


def model_registry(ws: Workspace):
    return models.run_models(training(ws), "all")


# --- decisions ---------------------------------------------------------------------------------------

def with_gain(ws: Workspace):
    return ws.summary.withColumn("pred_incr", C.num(fixed.TARGET))


def virality_tier(ws: Workspace):
    tiers = decisions.virality_tier(with_gain(ws))
    return tiers.groupBy("tier", "tier_desc").agg(F.count(F.lit(1)).alias("video_count"))


def triage_score(ws: Workspace):
    scored = decisions.triage_score(decisions.observed_scores(ws.summary), digits=False)
    return scored.select(
        "video_id", "score", "status", "color", "recommendation", "decay_ratio", "velocity_1_3", "acceleration",
        "like_rate_pct",
    )


def forecast_curve(ws: Workspace):
    gain = F.greatest(C.zero(fixed.TARGET), F.lit(0.0))
    rows = ws.summary.select(
        "video_id", C.zero("plays_day3").alias("plays_day3"), gain.alias("pred_median"),
        (gain * F.lit(0.5)).alias("pred_p10"), (gain * F.lit(2.0)).alias("pred_p90"),
    )
    return decisions.forecast_curve(rows)


def drafts(ws: Workspace):
    hook = (
        F.when(F.col("surprise") > 0.66, F.lit("High")).when(F.col("surprise") < 0.33, F.lit("Low"))
        .when(F.col("surprise").isNotNull(), F.lit("Medium"))
    )
    return ws.summary.select(
        F.col("video_id").alias("draft_id"), "topic", "duration", "follower_count", "creator_median_plays30",
        "speaking_rate", "hashtag_count", "plays_day0", "plays_day1", "plays_day3", hook.alias("hook"),
    )


def draft_defaults(ws: Workspace):
    return decisions.draft_defaults(drafts(ws)).drop("hook")


def topic_profiles(ws: Workspace):
    return ws.cached("topic_profiles", lambda: profiles.topic_profile(ws.summary))


def profile_lookup(ws: Workspace):
    found = decisions.profile_lookup(drafts(ws).select("draft_id", "topic"), topic_profiles(ws))
    return found.select("draft_id", "topic", "median_duration", "p25_duration", "p75_duration")


def draft_tips(ws: Workspace):
    filled = decisions.draft_defaults(drafts(ws)).select("draft_id", "topic", "duration", "hook", "speaking_rate")
    placed = decisions.profile_lookup(filled, topic_profiles(ws), fallback=None)
    return decisions.draft_tips(placed)


def priority_rank(ws: Workspace):
    rows = ws.summary.select("video_id", (C.zero("plays_day3") + C.zero(fixed.TARGET)).alias("total_expected"))
    return decisions.priority_rank(rows, "total_expected", "video_id")


def level_maps(ws: Workspace):
    return drafts(ws).select(
        "draft_id", C.level_value("hook", fixed.PLANNER_LEVELS).alias("planner_level"),
        C.level_value("hook", fixed.IDEA_HOOKS, 0.45).alias("idea_level"),
    )


def bundle(ws: Workspace) -> dict:
    import os

    def load():
        folder = os.path.join(ws.folder, "scoring_bundle")
        return tables.reuse_bundle(
            ws.spark, folder, scoring.BUNDLE_TABLES,
            lambda: scoring.train_bundle(ws.summary), scoring.BUNDLE_MODELS,
        )

    return ws.cached("bundle", load, frame=False)


def score_drafts(ws: Workspace):
    rows = drafts(ws).drop("hook")
    return scoring.score_drafts(rows, bundle(ws)).select(
        "draft_id", "pred_median", "pred_p10", "pred_p90", "total_expected", "tier"
    )


def live_posts(ws: Workspace):
    return ws.summary.select("video_id", "topic", *scoring.LIVE_COUNTERS)


def live_check(ws: Workspace):
    decided, _ = scoring.live_check(live_posts(ws), bundle(ws))
    return decided.select("video_id", "pred_median", "score", "status", "recommendation")


def live_curve(ws: Workspace):
    return scoring.live_check(live_posts(ws), bundle(ws))[1]


def hyper_search_refit(ws: Workspace):
    return models.refit_best(training(ws), hyper_search(ws), "gbt_mape")[1]


def rank_ideas(ws: Workspace):
    ideas = drafts(ws).select(
        "draft_id", "topic", F.col("duration").alias("length"), "hook", F.col("follower_count").alias("followers")
    )
    return scoring.rank_ideas(ideas, bundle(ws))


# --- scalar families ---------------------------------------------------------------------------------

def math_functions(ws: Workspace):
    return ws.summary.select(
        "video_id", F.log1p("plays_day30").alias("log1p_plays"), F.expm1("joy").alias("expm1_joy"),
        F.abs("acceleration").alias("abs_accel"), F.pow("joy", F.lit(0.7)).alias("powered"),
        C.clip("decay_ratio", -10, 10).alias("clipped"), C.half_even("creator_avg_plays30", 1).alias("rounded"),
        F.greatest("velocity_1_3", F.lit(0.0)).alias("positive"),
    )


def date_functions(ws: Workspace):
    v = ws.summary
    beside = C.attach_scalars(v, v.agg(F.min("create_date").alias("d")), "_f")
    return beside.select(
        "video_id", F.dayofweek("create_date").alias("sunday_first"), F.weekday("create_date").alias("monday_zero"),
        F.month("create_date").alias("month_no"), (F.weekday("create_date") >= 5).alias("is_weekend"),
        F.datediff("create_date", F.col("_f.d")).alias("since_start"),
    )


def string_functions(ws: Workspace):
    return payoff_rows(ws).select(
        "video_id", C.music_category("music_selected_from").alias("music_category"),
        C.clean_label(F.coalesce("music_selected_from", F.lit(""))).alias("music_label"),
        C.thousands("plays_day30").alias("shown_views"),
        F.concat(F.col("plays_day30").cast("string"), F.lit("s")).alias("suffixed"),
    )


def null_functions(ws: Workspace):
    return ws.summary.select(
        "video_id", F.coalesce("duration", F.lit(15.0)).alias("duration_filled"),
        F.coalesce("is_english", F.lit(1)).alias("english_filled"),
        F.col("word_count").isNull().cast("long").alias("word_count_missing"),
    )


def bucket_functions(ws: Workspace):
    return ws.summary.select(
        "video_id", C.bucket_label("duration", fixed.DURATION_BUCKETS).alias("duration_bucket"),
        C.bucket_label(F.coalesce("hashtag_count", F.lit(0.0)), fixed.HASHTAG_BUCKETS).alias("hashtag_bucket"),
    )


QUERIES = {
    "scan_raw": lambda ws: ws.engagement,
    "scan_raw_videos": scan_raw_videos,
    "scan_raw_creator": scan_raw_creator,
    "scan_processed": lambda ws: ws.topics,
    "scan_processed_summary": lambda ws: ws.summary,
    "sink_processed": sink_processed,
    "sink_processed_summary": lambda ws: sink_processed(ws, "summary"),
    "scan_strategy_inputs": scan_strategy_inputs,
    "row_counts": row_counts,
    "dataset_profile": lambda ws: tables.dataset_profile(ws.summary, fixed.TARGET),
    "sink_bundle": sink_bundle,
    "sink_bundle_profile": lambda ws: sink_bundle(ws, "topic_profile"),
    "cast_dates": lambda ws: cleaning.cast_dates(ws.creator, "date").select("author_id", "date", "follower_count"),
    "valid_days": lambda ws: cleaning.cast_dates(cleaning.valid_days(ws.engagement), "date"),
    "dedup_keys": lambda ws: cleaning.clean_engagement(ws.engagement),
    "prune_optional": lambda ws: cleaning.prune_videos(cleaning.cast_dates(ws.videos, "create_date")),
    "join_engagement_video": lambda ws: cleaning.join_engagement_video(
        cleaning.clean_engagement(ws.engagement),
        cleaning.clean_videos(ws.videos).select("video_id", "author_id", "create_date", "topic", "duration"),
    ),
    "join_creator_day": lambda ws: daily(ws).select(
        "video_id", "date", "days_since_post", "play_count", "like_count", "comment_count", "share_count",
        "author_id", "topic", "follower_count",
    ),
    "snapshot_filter": lambda ws: summary.snapshot_filter(cleaning.clean_engagement(ws.engagement)),
    "pivot_snapshots": lambda ws: snapshots(ws).drop("date_day0"),
    "rename_pivot": rename_pivot,
    "day0_meta": day0_meta,
    "join_meta_pivot": join_meta_pivot,
    "incr_targets": lambda ws: summary.incr_targets(snapshots(ws)).join(
        meta(ws).select("video_id"), "video_id", "left_semi"
    ).select("video_id", *[f"incr_{c}_3_30" for c in summary.COUNTERS]),
    "growth_factor": lambda ws: summary.growth_factor(base(ws)).select("video_id", "growth_factor_plays"),
    "velocity_accel": lambda ws: summary.velocity_accel(base(ws)).select(
        "video_id", "velocity_0_1", "velocity_1_3", "acceleration"
    ),
    "decay_ratio": lambda ws: summary.decay_ratio(base(ws)).select("video_id", "decay_ratio"),
    "quality_rates": lambda ws: summary.quality_rates(base(ws)).select(
        "video_id", "like_rate_day3", "comment_rate_day3", "share_rate_day3"
    ),
    "penetration_rate": lambda ws: summary.penetration_rate(base(ws)).select("video_id", "penetration_rate"),
    "creator_stats": lambda ws: summary.creator_stats(base(ws)),
    "creator_stats_prior": lambda ws: summary.creator_stats_prior(base(ws)).select(
        "video_id", "prior_video_count", "prior_avg_plays30"
    ),
    "join_creator_stats": lambda ws: summary.with_creator_stats(base(ws)).select(
        "video_id", "author_id", "creator_median_plays30", "creator_video_count", "creator_avg_plays30"
    ),
    "video_summary": lambda ws: summary.video_summary(*ws.raw()),
    "drop_null_target": lambda ws: summary.drop_null_target(ws.summary).select("video_id", fixed.TARGET),
    "min_views_filter": lambda ws: summary.min_views_filter(ws.summary, 50).select("video_id", "plays_day30"),
    "topic_daily": topic_rows,
    "sorted_topic_daily": lambda ws: topic_series.sorted_topic_daily(ws.topics).select("date", "topic", "total_plays"),
    "arg_max_topic": lambda ws: topic_series.arg_max_topic(ws.topics),
    "top_topic_filter": lambda ws: topic_series.top_topic_filter(ws.topics).select("date", "topic", "total_plays"),
    "calendar_join": lambda ws: topic_series.calendar_join(ws.topics, "avg_plays_per_video"),
    "ffill_bfill": series,
    "recent_history": lambda ws: topic_series.recent_history(series(ws)),
    "play_lag1": lambda ws: trajectory.trajectory_features(cleaning.clean_engagement(ws.engagement)).select(
        "video_id", "date", "play_lag1"
    ),
    "play_roll3_avg": lambda ws: trajectory.trajectory_features(cleaning.clean_engagement(ws.engagement)).select(
        "video_id", "date", "play_roll3_avg"
    ),
    "daily_play_inc": lambda ws: trajectory.trajectory_features(cleaning.clean_engagement(ws.engagement)).select(
        "video_id", "date", "daily_play_inc", "day_of_week"
    ),
    "panel_trajectory": lambda ws: trajectory.panel_trajectory(cleaning.clean_engagement(ws.engagement)),
    "trajectory_matrix": lambda ws: trajectory.trajectory_matrix(ws.engagement, range(31)),
    "creator_span": lambda ws: strategy.creator_span(ws.creator),
    "author_video_stats": lambda ws: strategy.author_video_stats(ws.summary),
    "join_author_span_videos": lambda ws: strategy.join_author_span_videos(ws.creator, ws.summary).select(
        "author_id", "follower_gain", "videos_posted", "total_plays", "followers_per_10k_views", "videos_per_week"
    ),
    "follower_conversion_topic": lambda ws: strategy.follower_conversion_topic(authors(ws)),
    "clean_labels": lambda ws: tables.distinct_values(ws.summary, "topic").withColumn(
        "clean_topic", C.clean_label("topic")
    ),
    "follower_conversion_duration": lambda ws: strategy.follower_conversion_duration(authors(ws)),
    "posting_cadence": lambda ws: strategy.posting_cadence(authors(ws)),
    "join_raw_processed": payoff_rows,
    "hashtag_payoff": lambda ws: strategy.hashtag_payoff(payoff_rows(ws)),
    "music_payoff": lambda ws: strategy.music_payoff(payoff_rows(ws)),
    "semi_join_sample": semi_join_sample,
    "archetype_assign": assigned,
    "archetype_shares": lambda ws: strategy.archetype_shares(assigned(ws)),
    "archetype_curves": lambda ws: strategy.archetype_curves(assigned(ws)),
    "topic_lookup": lambda ws: strategy.topic_lookup(assigned(ws), ws.summary).select("video_id", "archetype", "topic"),
    "topic_archetype_crosstab": lambda ws: strategy.topic_archetype_crosstab(assigned(ws), ws.summary),
    "conversion_extremes": lambda ws: strategy.conversion_extremes(strategy.follower_conversion_topic(authors(ws))),
    "strategy_bundle": strategy_bundle,
    "topic_profile": lambda ws: profiles.topic_profile(ws.summary),
    "topic_counts": lambda ws: profiles.topic_counts(ws.summary),
    "topic_trajectory_medians": lambda ws: profiles.topic_trajectory_medians(ws.summary),
    "distinct_values": lambda ws: tables.distinct_values(ws.summary, "topic"),
    "deterministic_sample": lambda ws: profiles.deterministic_sample(
        ws.summary, 500, "video_id", order=sample_order()
    ).select("video_id", "topic", "plays_day30"),
    "library_search": lambda ws: profiles.library_search(ws.summary, (5, 60), 1000, labels=False),
    "head_n": lambda ws: tables.head_rows(ws.summary, ["video_id"], 4).select(
        "video_id", "topic", "plays_day0", "plays_day1", "plays_day3", "plays_day7", "plays_day30", fixed.TARGET
    ),
    "pearson_matrix": lambda ws: stats.pearson_matrix(ws.summary),
    "spearman_report": lambda ws: stats.spearman_rho(ws.summary, features.numeric_columns(ws.summary)),
    "spearman_p_values": lambda ws: stats.spearman_report(ws.summary, features.numeric_columns(ws.summary)),
    "top_k_features": lambda ws: stats.top_k_features(
        stats.spearman_rho(ws.summary, features.numeric_columns(ws.summary)).where(F.col("rho").isNotNull())
    ),
    "acf": lambda ws: stats.acf(play_series(ws)),
    "pacf": lambda ws: stats.pacf(play_series(ws)),
    "pacf_first_lags": lambda ws: stats.pacf(play_series(ws)).where("lag <= 3"),
    "adf_test": lambda ws: stats.adf_test(play_series(ws)),
    "adf_zero_lags": lambda ws: stats.adf_test(play_series(ws), max_lags=0).where("n_used > 0").select(
        "topic", "statistic", "n_used"
    ),
    "global_rank_pct": lambda ws: rank_columns(ws, False),
    "topic_rank_pct": lambda ws: rank_columns(ws, True),
    "time_split_cutoff": lambda ws: splits.time_split(ws.summary).select("video_id", "is_train"),
    "target_encode_fit": target_encode_fit,
    "te_lookup": te_lookup,
    "target_encode_oof": target_encode_oof,
    "expanding_folds": lambda ws: splits.expanding_folds(ws.summary),
    "positional_split": lambda ws: splits.positional_split(ws.summary.select("video_id", "create_date"), 0.85).select(
        "video_id", "is_head"
    ),
    "feature_medians": lambda ws: features.feature_medians(ws.summary, IMPUTED),
    "feat_log_levels": lambda ws: pick(ws, features.feat_log_levels()),
    "feat_dynamics": lambda ws: pick(ws, features.feat_dynamics()),
    "feat_quality": lambda ws: pick(ws, features.feat_quality()),
    "feat_creator": lambda ws: pick(ws, features.feat_creator()),
    "feat_calendar": feat_calendar,
    "feat_impute": feat_impute,
    "features_v3": lambda ws: features.features(ws.summary),
    "features_gpu_variant": lambda ws: features.features(ws.summary, "gpu"),
    "feat_v1": feat_v1,
    "one_hot_topic": one_hot_topic,
    "coerce_numeric": coerce_numeric,
    "baseline_mean": lambda ws: baselines.baseline_mean(ws.summary),
    "baseline_day3_ratio": lambda ws: baselines.baseline_day3_ratio(ws.summary),
    "baseline_velocity": lambda ws: baselines.baseline_velocity(ws.summary),
    "baseline_naive_scale": naive_scale,
    "error_metrics": lambda ws: baselines.run_baselines(ws.summary),
    "log_scale_metrics": log_scale_metrics,
    "cv_summary": lambda ws: metrics.cv_summary(baselines.run_baselines(ws.summary), ("rmse", "smape")),
    "cv_summary_folds": lambda ws: metrics.cv_summary(expanding_cv(ws)),
    "leaderboard_union": board,
    "leaderboard_sort": leaderboard_sort,
    "track_leaderboards": track_leaderboards,
    "track_leaderboards_models": track_leaderboards_models,
    "forecast_trend_weekly": lambda ws: forecast.forecast_trend_weekly(series(ws)),
    "forecast_seasonal_ar": seasonal_forecast,
    "forecast_metrics": lambda ws: forecast.forecast_metrics(series(ws)),
    "gbt_mape": model_run("gbt_mape"),
    "gbt_mae": model_run("gbt_mae"),
    "gbt_mse": model_run("gbt_mse"),
    "random_forest": model_run("random_forest"),
    "elastic_net": model_run("elastic_net"),
    "ridge": model_run("ridge"),
    "robust_huber": model_run("robust_huber"),
    "quantile_forest": quantile_forest,
    "hyper_search": hyper_search,
    "expanding_cv": expanding_cv,
    "feature_importance": feature_importance,
    "model_registry": model_registry,
    "tier_lookup": lambda ws: decisions.virality_tier(with_gain(ws)).select("video_id", "tier", "tier_badge"),
    "virality_tier": virality_tier,
    "triage_score": triage_score,
    "momentum_trend": lambda ws: decisions.momentum_trend(ws.summary).select("video_id", "trend"),
    "forecast_curve": forecast_curve,
    "draft_defaults": draft_defaults,
    "profile_lookup": profile_lookup,
    "draft_tips": draft_tips,
    "priority_rank": priority_rank,
    "level_maps": level_maps,
    "score_drafts": score_drafts,
    "rank_ideas": rank_ideas,
    "live_check": live_check,
    "live_curve": live_curve,
    "hyper_search_refit": hyper_search_refit,
    "math_functions": math_functions,
    "date_functions": date_functions,
    "string_functions": string_functions,
    "null_functions": null_functions,
    "bucket_functions": bucket_functions,
}
