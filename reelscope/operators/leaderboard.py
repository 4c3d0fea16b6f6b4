"""Leaderboards over metric tables (one row per model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACK_A = "A: per-video increment"
TRACK_B = "B: topic series"


def leaderboard_union(boards: dict[str, list[DataFrame]]) -> DataFrame:
    """Stack metric tables with different columns; ``track`` keeps the tasks apart."""
    tagged = [b.withColumn("track", F.lit(track)) for track, group in boards.items() for b in group]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def leaderboard_sort(board: DataFrame, by: str = "smape", descending: bool = False) -> DataFrame:
    """Sort by a metric; rows without it are removed."""
    order = F.desc(by) if descending else F.asc(by)
    return board.where(F.col(by).isNotNull()).orderBy(order, "model")


def track_leaderboards(baselines: DataFrame, models: DataFrame | None, series: DataFrame | None) -> dict[str, DataFrame]:
    """Track A (baselines and models) and track B (forecasts), each sorted by sMAPE."""
    track_a = [b for b in (baselines, models) if b is not None]
    out = {TRACK_A: leaderboard_sort(leaderboard_union({TRACK_A: track_a}))}
    if series is not None:
        out[TRACK_B] = leaderboard_sort(leaderboard_union({TRACK_B: [series]}))
    return out
