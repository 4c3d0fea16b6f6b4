"""End-to-end jobs: ETL to processed tables, and the folder in which a session keeps shared tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from reelscope.operators import cleaning, summary, topic_series
from reelscope.sources import fixtures, tables


def run_etl(spark: SparkSession, raw: str, processed: str) -> None:
    """Raw parquet tables → ``processed_video_30d`` and ``processed_topic_daily``.

    The per-video base is written once and read back, so that the author statistics and the final
    join do not read the raw tables again, and a lost executor re-reads files instead of re-joining.
    """
    videos, engagement, creator = tables.scan_raw(spark, raw)
    tables.write_table(summary.video_base(videos, engagement, creator), processed, "video_base")
    base = tables.read_table(spark, processed, "video_base")
    tables.write_table(summary.with_creator_stats(base), processed, tables.SUMMARY_TABLE)
    daily = cleaning.join_engagement_video(cleaning.clean_engagement(engagement), cleaning.clean_videos(videos))
    tables.write_table(topic_series.topic_daily(daily), processed, tables.TOPIC_TABLE)


class Workspace:
    """Raw and processed tables for one source folder, written once per session and then scanned."""

    def __init__(self, spark: SparkSession, source: str):
        self.spark = spark
        self.source = source
        self.folder = os.path.join(tables.shared_folder(spark), f"reelscope-{uuid.uuid4().hex}")
        self._raw_ready = False
        self._processed_ready = False
        self._kept: dict = {}

    def _raw(self) -> None:
        if not self._raw_ready:
            build = {
                "videos": fixtures.videos, "engagement_daily": fixtures.engagement_daily,
                "creator_daily": fixtures.creator_daily,
            }
            for name, make in build.items():
                tables.write_table(make(self.spark, self.source), self.folder, name)
            self._raw_ready = True

    def _processed(self) -> None:
        self._raw()
        if not self._processed_ready:
            run_etl(self.spark, self.folder, self.folder)
            self._processed_ready = True

    def raw(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        self._raw()
        return tables.scan_raw(self.spark, self.folder)

    def processed(self) -> tuple[DataFrame, DataFrame]:
        self._processed()
        return tables.scan_processed(self.spark, self.folder)

    def cached(self, name: str, build, frame: bool = True):
        """Build once per session: a DataFrame becomes a written table, anything else is kept as is."""
        if name not in self._kept:
            made = build()
            if frame:
                tables.write_table(made, self.folder, name)
                made = tables.read_table(self.spark, self.folder, name)
            self._kept[name] = made
        return self._kept[name]

    @property
    def videos(self) -> DataFrame:
        return self.raw()[0]

    @property
    def engagement(self) -> DataFrame:
        return self.raw()[1]

    @property
    def creator(self) -> DataFrame:
        return self.raw()[2]

    @property
    def summary(self) -> DataFrame:
        return self.processed()[0]

    @property
    def topics(self) -> DataFrame:
        return self.processed()[1]


_workspaces: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, source: str) -> Workspace:
    key = (spark.sparkContext.applicationId, os.path.abspath(source) if "://" not in source else source)
    if key not in _workspaces:
        _workspaces[key] = Workspace(spark, source)
    return _workspaces[key]
