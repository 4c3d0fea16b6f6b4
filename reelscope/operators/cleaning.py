"""Cleaning the raw tables and joining them at daily grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.columns import optional
from reelscope.functions.fixed_values import CREATOR_COLUMNS, VIDEO_COLUMNS


def cast_dates(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_date(column))


def valid_days(engagement: DataFrame) -> DataFrame:
    """Drop rows dated before the post."""
    return engagement.where(F.col("days_since_post") >= 0)


#: Types that a hash aggregate can keep a minimum of.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def dedup_keys(df: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """One row per key: the smallest row in column order, nulls first.

    The choice doesn't depend on arrival order.  It is a minimum of the rest of the row, which combines before the shuffle, so copies
    cost one row a task (a sort aggregate: Spark has no hash aggregate for a minimum of structs).

    ``by`` (one of the keys, of a table of numbers and dates) has two phases instead.  The rows are dealt out by that key alone, once, and
    what follows lies as it needs it, also a join or an aggregate on that key afterwards.  A key whose columns all have one value,
    as copies have, is done after one hash aggregate; only the others take the ordered choice.  Rows without the key
    ``by`` are dropped.  A value of ``by`` with a large share of all rows is one task, in which copies collapse as they come.
    """
    rest = [c for c in df.columns if c not in keys]
    if by is None or not rest or not all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in rest):
        return _smallest(df, keys, rest).select(*df.columns) if rest else df.distinct()
    rows = df.where(F.col(by).isNotNull()).repartition(by)
    n = F.count(F.lit(1))
    one_value = F.lit(True)
    for c in rest:
        one_value = one_value & ((F.count(c) == 0) | ((F.count(c) == n) & (F.min(c) == F.max(c))))
    told = rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest], one_value.alias("_one"))

    def same_key(left: str, right: str) -> Column:
        """Equal on ``by``, by which both sides lie together; the other keys are compared there, null with null."""
        found = F.col(f"{left}.{by}") == F.col(f"{right}.{by}")
        for c in keys:
            if c != by:
                x, y = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
                found = found & (((x <= y) & (x >= y)) | (x.isNull() & y.isNull()))
        return found

    # behind the same shuffle (a semi join would be moved before it); copies collapse once only such keys are left
    differing = rows.alias("r").join(
        told.where("not _one").select(*keys).hint("shuffle_hash").alias("k"), same_key("r", "k")
    ).select("r.*").distinct()
    chosen = _smallest(differing, keys, rest).select(*keys, F.struct(*rest).alias("_row")).hint("shuffle_hash")
    joined = told.alias("t").join(chosen.alias("c"), same_key("t", "c"), "left")
    values = {c: F.when(F.col("_row").isNull(), F.col(f"t.{c}")).otherwise(F.col(f"_row.{c}")).alias(c) for c in rest}
    return joined.select(*[values.get(c, F.col(f"t.{c}")) for c in df.columns])


def _smallest(df: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def prune_videos(videos: DataFrame) -> DataFrame:
    return videos.select(*optional(videos, VIDEO_COLUMNS))


def prune_creator(creator: DataFrame) -> DataFrame:
    return creator.select(*optional(creator, CREATOR_COLUMNS))


def clean_videos(videos: DataFrame) -> DataFrame:
    return dedup_keys(prune_videos(cast_dates(videos, "create_date")), ["video_id"])


def clean_engagement(engagement: DataFrame) -> DataFrame:
    """One row per video and date, dealt out by video: the pivot and the join with videos take it as it lies."""
    return dedup_keys(cast_dates(valid_days(engagement), "date"), ["video_id", "date"], "video_id")


def clean_creator(creator: DataFrame) -> DataFrame:
    return dedup_keys(prune_creator(cast_dates(creator, "date")), ["author_id", "date"])


def clean(videos: DataFrame, engagement: DataFrame, creator: DataFrame):
    """Typed dates, valid days, unique keys, wanted columns."""
    return clean_videos(videos), clean_engagement(engagement), clean_creator(creator)


def join_engagement_video(engagement: DataFrame, videos: DataFrame) -> DataFrame:
    return engagement.join(videos, "video_id", "inner")


def join_creator_day(daily: DataFrame, creator: DataFrame) -> DataFrame:
    """Add the creator's counters of the same day; absent days stay null.

    A very active author spreads over its dates, so the key is not hot.
    """
    return daily.join(creator, ["author_id", "date"], "left")


def full_daily(videos: DataFrame, engagement: DataFrame, creator: DataFrame) -> DataFrame:
    """Cleaned tables → one row per video and day with video and creator columns."""
    return join_creator_day(join_engagement_video(engagement, videos), creator)
