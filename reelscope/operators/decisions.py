"""Scoring, tiers, triage and planning tips for whole tables of videos or drafts.

Except for :func:`rank_ideas` (a total order) and lookups, everything is a row-level expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions import fixed_values as fixed
from reelscope.functions.columns import (
    attach_scalars, clean_label, fill_template, half_even, level_value, num, thousands, tier_struct, zero,
)
from reelscope.operators.distribution import lookup_join, number_rows


def virality_tier(df: DataFrame, increment: str = "pred_incr") -> DataFrame:
    """Add ``tier, tier_badge, tier_desc``."""
    t = tier_struct(increment)
    return df.withColumns({
        "tier": t["tier"], "tier_badge": t["badge"], "tier_desc": t["description"],
    })


def tier_table(spark) -> DataFrame:
    """The tier definitions as a table (the last tier has no upper edge)."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("tier"), F.lit(low).alias("min_incr"),
            (F.lit(None).cast("double") if high == float("inf") else F.lit(high)).alias("max_incr"),
            F.lit(badge).alias("badge"), F.lit(text).alias("description"),
        )
        for name, low, high, badge, text in fixed.TIERS
    ])
    return spark.range(1).select(F.inline(rows))


def _points(cases: list[tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for condition, points in reversed(cases):
        out = F.when(condition, F.lit(float(points))).otherwise(out)
    return out


def live_signals() -> dict[str, Column]:
    first = F.greatest(num("plays_day1") - num("plays_day0"), F.lit(0.0))
    second = F.greatest((num("plays_day3") - num("plays_day1")) / F.lit(2.0), F.lit(0.0))
    return {
        "velocity_1_3": second,
        "acceleration": second - first,
        "decay_level_ratio": F.try_divide(num("plays_day3"), num("plays_day1") + F.lit(1.0)),
        "like_rate": F.try_divide(num("likes_day3"), num("plays_day3") + F.lit(1.0)),
    }


def triage_points(increment: str = "pred_incr") -> Column:
    """Score from 5 to 99 of a video at day 3."""
    signals = {**live_signals(), "increment": num(increment)}
    total = F.lit(fixed.TRIAGE_START)
    for name, steps in fixed.TRIAGE_POINTS.items():
        x = signals[name]
        total = total + _points([(x > edge if side == "above" else x < edge, points) for side, edge, points in steps])
    return F.least(F.greatest(total, F.lit(fixed.TRIAGE_LEAST)), F.lit(fixed.TRIAGE_MOST))


def triage_score(df: DataFrame, increment: str = "pred_incr", digits: bool = True) -> DataFrame:
    """Add ``score, status, color, recommendation`` and the diagnostics behind them.

    Works on batch and streaming DataFrames.  ``digits`` rounds for display.
    """
    s = live_signals()
    score = F.col("score")

    def choose(i: int) -> Column:
        out = F.lit(fixed.TRIAGE_STATUSES[-1][i])
        for entry in reversed(fixed.TRIAGE_STATUSES[:-1]):
            out = F.when(score >= entry[0], F.lit(entry[i])).otherwise(out)
        return out

    def show(c: Column, n: int) -> Column:
        return half_even(c, n) if digits else c

    scored = df.withColumns({
        "_decay": s["decay_level_ratio"], "_speed": s["velocity_1_3"], "_accel": s["acceleration"],
        "_likes": s["like_rate"], "score": triage_points(increment),
    })
    return scored.withColumns({
        "status": choose(1), "color": choose(2), "recommendation": choose(3),
        "decay_ratio": show(F.col("_decay"), 2), "velocity_1_3": show(F.col("_speed"), 1),
        "acceleration": show(F.col("_accel"), 1), "like_rate_pct": show(F.col("_likes") * F.lit(100.0), 2),
    }).drop("_decay", "_speed", "_accel", "_likes")


def momentum_trend(df: DataFrame, acceleration: str = "acceleration") -> DataFrame:
    up = F.col(acceleration) > 0
    return df.withColumn("trend", F.when(up, F.lit(fixed.TREND_UP)).otherwise(F.lit(fixed.TREND_DOWN)))


def forecast_curve(
    df: DataFrame, keys=("video_id",), start: str = "plays_day3", median: str = "pred_median",
    low: str = "pred_p10", high: str = "pred_p90",
) -> DataFrame:
    """``keys, day, median, low, high``: how the predicted gain spreads over the coming days."""
    shares = [w ** fixed.FORECAST_POWER for w in fixed.FORECAST_WEIGHTS]
    rows = F.array(*[
        F.struct(
            F.lit(day).alias("day"),
            *[(num(start) + num(c) * F.lit(w)).alias(n) for n, c in (("median", median), ("low", low), ("high", high))],
        )
        for day, w in zip(fixed.FORECAST_DAYS, shares)
    ])
    return df.select(*keys, F.inline(rows))


def draft_defaults(drafts: DataFrame) -> DataFrame:
    """Fill every absent or null input of a draft from the fixed defaults and from its own other inputs."""
    def given(name: str, default: Column) -> Column:
        return F.coalesce(num(name), default) if name in drafts.columns else default

    d = fixed.DRAFT_DEFAULTS
    topic = F.lit(d["topic"])
    out = drafts.withColumn("topic", F.coalesce(F.col("topic"), topic) if "topic" in drafts.columns else topic)
    plain = [n for n in d if n != "topic"]
    out = out.withColumns({n: given(n, F.lit(d[n])) for n in plain})
    out = out.withColumns({
        n: given(n, F.col("creator_median_plays30") * F.lit(share)) for n, share in fixed.DRAFT_PLAY_SHARES.items()
    })
    return out.withColumns({
        "plays_day7": given("plays_day7", F.col("plays_day3") * F.lit(fixed.DRAFT_DAY7_OF_DAY3)),
        "likes_day3": given("likes_day3", F.col("plays_day3") * F.lit(fixed.DRAFT_LIKES_OF_DAY3)),
    })


def draft_features(filled: DataFrame, centers: DataFrame, feature_columns: list[str]) -> DataFrame:
    """Model inputs of filled drafts.

    ``centers`` is one row with the training median of every feature plus ``topic_te`` / ``author_id_te``
    defaults; a draft column of the same name as a feature (emotions, encodings) wins over its median.
    """
    first = F.greatest(num("plays_day1") - num("plays_day0"), F.lit(0.0))
    second = F.greatest((num("plays_day3") - num("plays_day1")) / F.lit(2.0), F.lit(0.0))
    week = F.greatest((num("plays_day7") - num("plays_day3")) / F.lit(4.0), F.lit(0.0))
    own = {
        **{f"{c}_log": F.log1p(num(c)) for c in ("plays_day0", "plays_day1", "plays_day3", "plays_day7", "likes_day3", "follower_count")},
        "creator_median_log": F.log1p(num("creator_median_plays30")),
        "velocity_0_1_log": F.log1p(first), "velocity_1_3_log": F.log1p(second), "velocity_3_7": F.log1p(week),
        "acceleration_val": second - first,
        "decay_ratio_val": num("plays_day3") / (num("plays_day1") + F.lit(1.0)),
        "like_rate": num("likes_day3") / (num("plays_day3") + F.lit(1.0)),
        **{c: num(c) for c in ("duration", "is_english", "speaking_rate", "word_count", "hashtag_count", "comment_rate", "share_rate")},
    }
    beside = attach_scalars(filled, centers, "_c")

    def value(name: str) -> Column:
        center = F.col(f"_c.{name}") if name in centers.columns else F.lit(0.0)
        if name in own:
            return own[name]
        if name in filled.columns:
            return F.coalesce(num(name), center)
        return F.coalesce(center, F.lit(0.0))

    return beside.withColumns({f"f_{c}": value(c) for c in feature_columns}).drop("_c")


def bounded_forecast(df: DataFrame, median_log: str, low_log: str, high_log: str, start: str = "plays_day3") -> DataFrame:
    """Log predictions → plays: never negative, floor <= median <= ceiling, plus the expected total and tier."""
    def plays(c: str) -> Column:
        return F.greatest(F.expm1(num(c)), F.lit(0.0))

    out = df.withColumns({"_m": plays(median_log), "_l": plays(low_log), "_h": plays(high_log)})
    out = out.withColumns({
        "pred_median": F.col("_m"), "pred_p10": F.least("_l", "_m"), "pred_p90": F.greatest("_h", "_m"),
        "total_expected": num(start) + F.col("_m"),
    }).drop("_m", "_l", "_h")
    return virality_tier(out, "pred_median")


def profile_lookup(df: DataFrame, profiles: DataFrame, fallback: str | None = fixed.FALLBACK_TOPIC) -> DataFrame:
    """Add the topic profile.

    An unknown topic becomes ``fallback`` and gets that profile (``None`` keeps the topic, without a
    profile).  One lookup: the fallback profile is a single row beside all others.
    """
    values = [c for c in profiles.columns if c != "topic"]
    found = lookup_join(df, profiles.withColumn("_known", F.lit(True)), ["topic"])
    if fallback is None:
        return found.drop("_known")
    other = profiles.where(F.col("topic") == fallback).select(*values).limit(1)
    beside = attach_scalars(found, other, "_other")
    known = F.coalesce(F.col("_known"), F.lit(False))
    named = {c: F.when(known, F.col(c)).otherwise(F.col(f"_other.{c}")) for c in values}
    named["topic"] = F.when(known, F.col("topic")).otherwise(F.lit(fallback))
    return beside.withColumns(named).drop("_known", "_other")


def draft_tips(df: DataFrame, keys=("draft_id",)) -> DataFrame:
    """``keys, tip_no, tip``; needs ``topic, duration, hook, speaking_rate, p25_duration, p75_duration``."""
    low = F.coalesce(num("p25_duration"), F.lit(15.0))
    high = F.coalesce(num("p75_duration"), F.lit(30.0))
    length = num("duration")
    parts = {
        "topic": clean_label("topic"), "p25": thousands(low), "p75": thousands(high),
        "duration": F.format_string("%s", F.bround(length, 0).cast("long").cast("string")),
    }
    size_tip = (
        F.when(length > high, fill_template(fixed.TIP_TOO_LONG, **parts))
        .when(length < low, fill_template(fixed.TIP_VERY_SHORT, **parts))
        .otherwise(fill_template(fixed.TIP_GOOD_LENGTH, **parts))
    )
    hook_tip = (
        F.when(F.col("hook") == "High", F.lit(fixed.TIP_STRONG_HOOK))
        .when(F.col("hook") == "Low", F.lit(fixed.TIP_WEAK_HOOK))
    )
    pace_tip = F.when(num("speaking_rate") < fixed.SLOW_SPEECH_BELOW, F.lit(fixed.TIP_SLOW_SPEECH))
    tips = F.filter(F.array(size_tip, hook_tip, pace_tip), lambda t: t.isNotNull())
    return df.select(*keys, F.posexplode(tips).alias("_no", "tip")).select(
        *keys, (F.col("_no") + 1).alias("tip_no"), "tip"
    )


def priority_rank(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Add ``priority`` ``#1…#n``, highest value first, lowest id first on ties."""
    numbered = number_rows(df, value, row_id, "_place", descending=True)
    return numbered.withColumn("priority", F.concat(F.lit("#"), F.col("_place").cast("string"))).drop("_place")


def idea_inputs(ideas: DataFrame) -> DataFrame:
    """Ideas (``topic, length, hook, followers``) as draft rows."""
    return ideas.withColumns({
        "duration": F.coalesce(num("length"), F.lit(25.0)),
        "surprise": level_value("hook", fixed.IDEA_HOOKS, 0.45),
        "joy": F.lit(0.5),
        "follower_count": F.coalesce(num("followers"), F.lit(20000.0)),
        "creator_median_plays30": F.lit(1500.0),
    })


def idea_table(scored: DataFrame, row_id: str) -> DataFrame:
    """Display columns of scored ideas in priority order."""
    expected = F.bround(num("total_expected"), 0)
    ranked = priority_rank(scored.withColumn("expected_views", expected.cast("long")), "expected_views", row_id)
    span = F.concat(thousands("pred_p10"), F.lit(" to "), thousands("pred_p90"))
    title = ["concept"] if "concept" in scored.columns else []
    return ranked.select(
        "priority", row_id, *title, clean_label("topic").alias("category"),
        F.concat(F.bround(num("duration"), 0).cast("long").cast("string"), F.lit("s")).alias("length"),
        "expected_views", F.col("tier").alias("performance_level"), span.alias("view_range"),
    )


def planner_levels(drafts: DataFrame, columns=("surprise", "joy", "sadness", "fear")) -> DataFrame:
    """Low / Medium / High words of the planner as numbers; the two emotions it does not ask for are fixed."""
    words = {c: level_value(f"{c}_level", fixed.PLANNER_LEVELS) for c in columns}
    return drafts.withColumns({**words, "anger": F.lit(0.02), "disgust": F.lit(0.01)})


def observed_scores(v: DataFrame) -> DataFrame:
    """Videos with their observed gain in the place of a prediction: day-3 inputs for triage."""
    return v.select(
        "video_id", zero("plays_day0").alias("plays_day0"), zero("plays_day1").alias("plays_day1"),
        zero("plays_day3").alias("plays_day3"), zero("likes_day3").alias("likes_day3"),
        num(fixed.TARGET).alias("pred_incr"),
    )
