"""Model features per video.

Each ``feat_*`` function returns ``{name: expression}``; :func:`features` selects them together so that
everything row-level is one projection.  Ranks and medians are the only parts that look at other rows.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.columns import attach_scalars, clip, num, zero
from reelscope.functions.fixed_values import EMOTIONS, FEATURES_V3, NOT_FEATURES, TARGET, TEXT_COLUMNS
from reelscope.operators.distribution import lookup_join, medians, number_rows, rank_percent
from reelscope.sources.tables import materialize

GLOBAL_RANKS = ("velocity_1_3", "plays_day3", "creator_median_plays30", "follower_count")
TOPIC_RANKS = ("plays_day3", "velocity_1_3")
DAY7_FEATURES = ("plays_day7_log", "likes_day7_log", "shares_day7_log", "velocity_3_7", "like_rate_day7")
VARIANTS = ("v3", "gpu")


def log_target(target: str = TARGET) -> Column:
    return F.log1p(F.greatest(zero(target), F.lit(0.0)))


def _log_positive(c: Column | str) -> Column:
    return F.log1p(F.greatest(zero(c), F.lit(0.0)))


def feat_log_levels() -> dict[str, Column]:
    levels = ("plays_day0", "plays_day1", "plays_day3", "plays_day7", "likes_day3", "likes_day7", "shares_day7")
    return {f"{c}_log": F.log1p(zero(c)) for c in levels}


def feat_dynamics() -> dict[str, Column]:
    later = (zero("plays_day7") - zero("plays_day3")) / F.lit(4.0)
    return {
        "velocity_0_1_log": _log_positive("velocity_0_1"),
        "velocity_1_3_log": _log_positive("velocity_1_3"),
        "acceleration_val": zero("acceleration"),
        "decay_ratio_val": zero(clip("decay_ratio", -10, 10)),
        "velocity_3_7": _log_positive(later),
    }


def feat_quality() -> dict[str, Column]:
    return {
        "like_rate": zero("like_rate_day3"),
        "comment_rate": zero("comment_rate_day3"),
        "share_rate": zero("share_rate_day3"),
        "like_rate_day7": zero("likes_day7") / (zero("plays_day7") + F.lit(1.0)),
    }


def feat_creator() -> dict[str, Column]:
    return {
        "creator_median_log": F.log1p(zero("creator_median_plays30")),
        "creator_video_count_val": F.coalesce(num("creator_video_count"), F.lit(1.0)),
        "penetration_rate_val": zero(clip("penetration_rate", 0, 100)),
        "follower_count_log": F.log1p(zero("follower_count")),
    }


def feat_calendar(first_date: Column) -> dict[str, Column]:
    """Monday = 0; rows without a date get 0."""
    day = F.weekday("create_date")
    return {
        "post_day_of_week": zero(day),
        "post_month": zero(F.month("create_date")),
        "post_is_weekend": F.coalesce((day >= 5).cast("double"), F.lit(0.0)),
        "days_since_start": zero(F.datediff("create_date", first_date)),
    }


def feat_impute(center, variant: str = "v3") -> dict[str, Column]:
    """Content columns with medians (``center(name)``) or constants for absent values, plus flags."""
    duration = F.lit(15.0) if variant == "gpu" else center("duration")
    english = F.lit(1.0) if variant == "gpu" else F.lit(0.0)
    out = {
        "duration": F.coalesce(num("duration"), duration),
        "is_english": F.coalesce(num("is_english"), english),
    }
    for c in TEXT_COLUMNS:
        out[c] = F.coalesce(num(c), center(c))
        out[f"{c}_missing"] = F.col(c).isNull().cast("double")
    out.update({c: F.coalesce(num(c), center(c)) for c in EMOTIONS})
    return out


IMPUTED = ("duration", *TEXT_COLUMNS, *EMOTIONS)


def feature_medians(df: DataFrame, columns) -> DataFrame:
    """One row: the median of each column."""
    return medians(df, {c: c for c in columns})


def rank_features(v: DataFrame, variant: str = "v3") -> DataFrame:
    """``video_id`` and the rank shares, all ranked in one pass."""
    metrics = {f"{c}_rank_pct": zero(c) for c in GLOBAL_RANKS}
    inside = TOPIC_RANKS if variant == "v3" else TOPIC_RANKS[:1]
    metrics.update({f"{c}_topic_rank_pct": F.col(c) for c in inside})
    return rank_percent(v, "video_id", metrics, {f"{c}_topic_rank_pct": "topic" for c in inside})


def feature_names(variant: str = "v3", max_feature_day: int = 7) -> list[str]:
    dropped = set() if variant == "v3" else {"velocity_1_3_topic_rank_pct"}
    if max_feature_day < 7:
        dropped |= set(DAY7_FEATURES)
    return [c for c in FEATURES_V3 if c not in dropped]


def features(v: DataFrame, variant: str = "v3", null_target: str | None = None, max_feature_day: int = 7) -> DataFrame:
    """``video_id, author_id, topic, create_date, target, y`` and the feature columns.

    ``v3`` counts a missing target as 0, ``gpu`` drops such rows (override with ``null_target``);
    ``max_feature_day=3`` leaves out everything observed after day 3.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    policy = null_target or ("drop" if variant == "gpu" else "zero")
    if policy == "drop":
        v = v.where(F.col(TARGET).isNotNull())
    constants = medians(v, {**{c: c for c in IMPUTED}, "_first": F.unix_date("create_date")})
    first = v.agg(F.min("create_date").alias("first_date"))
    beside = attach_scalars(attach_scalars(v, constants, "_m"), first, "_f")
    wide = {
        **feat_log_levels(), **feat_dynamics(), **feat_quality(), **feat_creator(),
        **feat_calendar(F.col("_f.first_date")), **feat_impute(lambda c: F.col(f"_m.{c}"), variant),
    }
    names = feature_names(variant, max_feature_day)
    ranks = rank_features(v, variant)
    keys = ["video_id", "author_id", "topic", "create_date", TARGET]
    rows = beside.select(*keys, log_target().alias("y"), *[wide[c].alias(c) for c in names if c in wide])
    joined = rows.join(ranks, "video_id", "left")
    return joined.select(*keys, "y", *[zero(c).alias(c) for c in names])


NOTEBOOK_NUMBERS = ("duration", "speaking_rate", "joy", "sadness", "anger")


def topic_places(v: DataFrame) -> DataFrame:
    """``topic, topic_index``: the distinct topics numbered from the last name to the first, from 0."""
    names = v.select("topic").where(F.col("topic").isNotNull()).distinct()
    numbered = number_rows(names, "topic", F.lit(0), "_place", descending=True)
    return materialize(numbered.select("topic", (F.col("_place") - 1).cast("double").alias("topic_index")), "topic-places")


def one_hot_topic(v: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Add ``topic_vec``: a sparse 0/1 vector with a place for every topic but the first by name.

    The first topic, a null and a topic that ``places`` (of :func:`topic_places`) doesn't know are all zeros.  The
    vector is as long as there are topics; a row holds one place of it, however many there are.
    """
    places = topic_places(v) if places is None else places
    size = places.count()  # one number: the length of the vectors
    # the last place, that of the first name, is the one the encoder leaves out
    index = F.coalesce("topic_index", F.lit(float(max(size - 1, 0))))
    found = lookup_join(v, places, ["topic"]).withColumn("topic_index", index)
    encoder = OneHotEncoder(inputCols=["topic_index"], outputCols=["topic_vec"], dropLast=True)
    fitted = encoder.fit(v.sparkSession.range(max(size, 1)).select(F.col("id").cast("double").alias("topic_index")))
    return fitted.transform(found).drop("topic_index")


def hot_place(vector: str = "topic_vec") -> list[Column]:
    """``topic_size, topic_place``: the length of a one-hot vector and the place that is 1, null for none."""
    inside = F.unwrap_udt(vector)
    return [
        inside["size"].cast("long").alias("topic_size"), F.get(inside["indices"], F.lit(0)).cast("long").alias("topic_place"),
    ]


def feat_v1(v: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """First-generation features: log levels, a few raw numbers, ``topic_vec``; target is total day-30 plays."""
    logs = {f"{c}_log": F.log1p(zero(c)) for c in ("plays_day0", "plays_day1", "plays_day3", "likes_day3", "follower_count")}
    return one_hot_topic(v, places).select(
        "video_id", "create_date", _log_positive("plays_day30").alias("y"),
        *[e.alias(n) for n, e in logs.items()],
        *[zero(c).alias(c) for c in NOTEBOOK_NUMBERS],
        "topic_vec",
    )


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Text that is not a number → null → 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


def numeric_columns(df: DataFrame, excluded=NOT_FEATURES) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]
