"""The scoring bundle: trained models with the tables that score drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions import fixed_values as fixed
from reelscope.functions.columns import num
from reelscope.operators import decisions, encoding, models, profiles
from reelscope.operators.features import feature_medians
from reelscope.operators.metrics import log_scale_metrics
from reelscope.sources.tables import materialize

BUNDLE_TABLES = ("centers", "topic_encoding", "topic_profiles", "importances", "leaves", "holdout", "forest_trees")
BUNDLE_MODELS = ("point_model",)
LIVE_COUNTERS = ("plays_day0", "plays_day1", "plays_day3", "likes_day3")


def train_bundle(v: DataFrame, params: dict | None = None, forest: dict | None = None) -> dict:
    """Point model, quantile forest, training medians, topic encodings and topic profiles."""
    frame = models.training_frame(v)
    train = frame.where("is_train")
    inputs = models.input_columns(frame)
    point, spread = models.side_by_side(v.sparkSession, lambda fit: fit(), [
        lambda: models.fit("gbt_mape", train, params, inputs),
        lambda: models.fit_quantile_forest(train, forest, {"p10": 0.1, "p90": 0.9}, inputs),
    ])
    fitted, overall = encoding.target_encode_fit(train, "topic")
    _, author_mean = encoding.target_encode_fit(train, "author_id")
    medians = feature_medians(train, [c for c in inputs if c not in models.ENCODED])
    centers = medians.withColumns({
        "topic_te": overall.scalar(), "author_id_te": author_mean.scalar(),
    })
    return {
        "point_model": point, "forest_trees": spread.model.table(v.sparkSession), "leaves": spread.leaves, "centers": centers,
        "topic_encoding": fitted, "topic_profiles": profiles.topic_profile(v),
        "importances": models.feature_importance(point, v),
        "holdout": log_scale_metrics(models.predict(point, frame.where(~F.col("is_train"))), by=()),
    }


def score_drafts(drafts: DataFrame, bundle: dict, row_id: str = "draft_id") -> DataFrame:
    """Fill the drafts, build model inputs, predict median, floor and ceiling, add total and tier."""
    from reelscope.operators.distribution import lookup_join

    point, forest = bundle["point_model"], models.Forest.read(bundle["forest_trees"])
    inputs = point.stages[0].getInputCols()
    filled = decisions.draft_defaults(drafts)
    known = lookup_join(filled, bundle["topic_encoding"].drop("rows"), ["topic"]).withColumnRenamed(
        "encoding", "topic_te"
    )
    if "author_te" in known.columns:
        known = known.withColumnRenamed("author_te", "author_id_te")
    wide = decisions.draft_features(known, bundle["centers"], inputs)
    renamed = wide.select(row_id, *[F.col(f"f_{c}").alias(c) for c in inputs])
    median = point.transform(renamed).select(row_id, F.col("yhat").alias("_median"))
    band = models.QuantileForest(forest, bundle["leaves"], {"p10": 0.1, "p90": 0.9}).predict(renamed, row_id, ())
    kept = [c for c in filled.columns]
    rows = filled.select(*kept).join(median, row_id).join(band, row_id)
    return decisions.bounded_forecast(rows, "_median", "p10", "p90").drop("_median", "p10", "p90")


def live_check(posts: DataFrame, bundle: dict, row_id: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """Decisions and forecast curves of running posts (``row_id, topic, plays_day0/1/3, likes_day3``).

    A post is scored as a draft with a creator median of 0.8 of its day-3 plays and 25,000 followers; the predicted
    gain, not the observed one, decides the triage and draws the curve.
    """
    drafts = posts.select(
        row_id, "topic", *[F.coalesce(num(c), F.lit(0.0)).alias(c) for c in LIVE_COUNTERS]
    ).withColumns({
        "creator_median_plays30": F.col("plays_day3") * F.lit(fixed.LIVE_MEDIAN_OF_DAY3),
        "follower_count": F.lit(fixed.LIVE_FOLLOWERS),
    })
    scored = materialize(score_drafts(drafts, bundle, row_id), "live")
    return decisions.triage_score(scored, "pred_median"), decisions.forecast_curve(scored, (row_id,))


def rank_ideas(ideas: DataFrame, bundle: dict, row_id: str = "draft_id") -> DataFrame:
    """Score a backlog of ideas and put it in order of expected views."""
    drafts = decisions.idea_inputs(ideas)
    placed = decisions.profile_lookup(drafts, bundle["topic_profiles"].select("topic", "video_count"))
    scored = score_drafts(placed.drop("video_count"), bundle, row_id)
    return decisions.idea_table(scored, row_id)
