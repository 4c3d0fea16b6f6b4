"""Reading, profiling and writing the parquet tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_TABLES = ("videos", "engagement_daily", "creator_daily")
SUMMARY_TABLE = "processed_video_30d"
TOPIC_TABLE = "processed_topic_daily"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def scan_raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``videos``, ``engagement_daily`` and ``creator_daily`` of a folder."""
    videos, engagement, creator = (read_table(spark, folder, name) for name in RAW_TABLES)
    return videos, engagement, creator


def scan_processed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The per-video summary and the per-topic daily series."""
    return read_table(spark, folder, SUMMARY_TABLE), read_table(spark, folder, TOPIC_TABLE)


def scan_strategy_inputs(spark: SparkSession, raw: str, processed: str) -> dict[str, DataFrame]:
    videos, engagement, creator = scan_raw(spark, raw)
    summary, _ = scan_processed(spark, processed)
    return {"creator": creator, "summary": summary, "videos": videos, "engagement": engagement}


def write_table(df: DataFrame, folder: str, name: str, cluster_by: str | None = None) -> None:
    """Replace a parquet table.  ``cluster_by`` sorts inside tasks, so row groups can be skipped on it."""
    if cluster_by:
        df = df.sortWithinPartitions(cluster_by)
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))


#: Folders of sessions on a local master that name none, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor can reach: the one the session names in ``spark.checkpoint.dir``.

    Only a local master may do without; it gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="reelscope-")
    return _local_folders[context.applicationId]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and scan it from there.

    Cuts the lineage before a result is read many times: later plans stay small, and a lost executor
    costs a re-read of files.
    """
    spark = df.sparkSession
    target = os.path.join(shared_folder(spark), "reelscope-tables", f"{name}-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        df.write.mode("error").parquet(target)
    return spark.read.parquet(target)


_removing = {"open": 0, "before": None}
_removing_lock = threading.Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files; else these stay until the driver happens to collect its garbage.

    Several threads may be inside at once; the setting is put back when the last one leaves.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _removing_lock:
        if not _removing["open"]:
            _removing["before"] = spark.conf.get(name, None)
            spark.conf.set(name, "true")
        _removing["open"] += 1
    try:
        yield
    finally:
        with _removing_lock:
            _removing["open"] -= 1
            if not _removing["open"]:
                spark.conf.unset(name) if _removing["before"] is None else spark.conf.set(name, _removing["before"])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` of several tables in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, measure, known, total``: for every column the number of known values, and the sum of numbers.

    One aggregate over each table.
    """
    parts = []
    for name, df in tables.items():
        numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
        cells = [
            F.struct(
                F.lit(c).alias("measure"), F.count(c).alias("known"),
                (F.sum(F.col(c).cast("double")) if c in numbers else F.lit(None).cast("double")).alias("total"),
            )
            for c in df.columns
        ]
        parts.append(df.agg(F.array(*cells).alias("_cells")).select(F.lit(name).alias("table_name"), F.inline("_cells")))
    return reduce(DataFrame.unionByName, parts)


def long_contents(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, label, measure, value``: every known number of reports that have different columns.

    The label of a row puts its text columns together, in the order of their names.
    """
    parts = []
    for name, df in tables.items():
        kinds = {f.name: f.dataType for f in df.schema.fields}
        texts = sorted(c for c, kind in kinds.items() if isinstance(kind, T.StringType))
        cells = [
            F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").cast("double").alias("value"))
            for c, kind in kinds.items() if isinstance(kind, T.NumericType)
        ]
        label = F.concat_ws(" | ", *[F.col(f"`{c}`") for c in texts])
        parts.append(df.select(F.lit(name).alias("table_name"), label.alias("label"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts).where("value is not null")


def dataset_profile(df: DataFrame, target: str) -> DataFrame:
    """Rows, columns and rows with a target."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.count(target).alias("target_count"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


#: Written after everything else, so a bundle that broke off is built again.
BUNDLE_MARK = "complete"


def head_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows of a total order (a per-task top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def sink_bundle(parts: dict, folder: str) -> None:
    """Write a bundle of DataFrames (parquet) and fitted pipelines (model folders), and a marker last."""
    spark = SparkSession.getActiveSession()
    for name, part in parts.items():
        target = os.path.join(folder, name)
        if isinstance(part, DataFrame):
            part.write.mode("overwrite").parquet(target)
        else:
            part.write().overwrite().save(target)
        spark = part.sparkSession if isinstance(part, DataFrame) else spark
    spark.range(1).write.mode("overwrite").parquet(os.path.join(folder, BUNDLE_MARK))


def load_bundle(spark: SparkSession, folder: str, names, models=()) -> dict:
    loaded = {name: spark.read.parquet(os.path.join(folder, name)) for name in names}
    loaded.update({name: PipelineModel.load(os.path.join(folder, name)) for name in models})
    return loaded


def reuse_bundle(spark: SparkSession, folder: str, names, build, models=(), force: bool = False) -> dict:
    """Load a bundle if it is there; otherwise (or with ``force``) build and write it first."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, BUNDLE_MARK, "_SUCCESS"))
    if force or not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        sink_bundle(build(), folder)
    return load_bundle(spark, folder, names, models)
