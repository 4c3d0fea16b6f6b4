"""Exact order statistics without an unbounded task.

Medians, quantiles, average ranks and row numbers all need sorted data.  A plain window (or the
built-in exact ``percentile``) brings a whole group to one task, which fails when one group holds a
third of the table.  Here rows collapse to distinct values with counts first (map-side combined, so ties cost
one row); the distinct values are range-partitioned by (group, value) and written once with their *range*, the
number of the partition.  Ranges of a group follow its values, hold about as many values each however narrow the
values lie, and their totals and running sums are small (groups x ranges).  Sorting only ever happens
inside one (group, range).

Where the ranges are cut depends on a sample, but no result depends on where they are cut, and a written
range never changes, so a task that runs again after an executor loss gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.columns import col, num
from reelscope.sources.tables import materialize

HOT_KEYS = 1000

ROWS = "__rows"


def _long_values(df: DataFrame, keep: list, metrics: dict[str, Column | str]) -> DataFrame:
    """One narrow row per value; ``metric`` is the position of the metric in the dict."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("metric"), num(value).alias("v")) for i, value in enumerate(metrics.values())
    ])
    long = df.select(*keep, F.inline(cells))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _count_values(long: DataFrame, keys: list[str]) -> DataFrame:
    return with_ranges(long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), keys)


def with_ranges(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``counted`` (``keys, v, n``) written with the range of each value in ``bucket``."""
    return materialize(
        counted.repartitionByRange(*keys, "v").withColumn("bucket", F.spark_partition_id()), "counted-values"
    )


def _bucket_offsets(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Per (group, bucket): rows in it, rows before it, rows of the whole group."""
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.groupBy(*keys, "bucket")
        .agg(F.sum("n").alias("bucket_n"))
        .withColumn("before", F.coalesce(F.sum("bucket_n").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("bucket_n").over(group))
    )


def profile(
    df: DataFrame, by: list[str], metrics: dict[str, Column | str], outputs: dict[str, tuple]
) -> DataFrame:
    """Exact quantiles, counts, sums and means per group, groups of any number and size.

    ``outputs`` maps a result column to ``("quantile", metric, p)`` (linear interpolation),
    ``("count", metric)``, ``("sum", metric)`` or ``("mean", metric)``.  The metric ``ROWS`` counts all
    rows of a group.  Null values are skipped; rows with a null group key are dropped.  ``by=[]`` gives
    one row.

    Counts, sums and means are one map-side combined aggregate; only the metrics of quantiles are sorted.
    """
    kept = df.select(*by, *[num(v).alias(f"_m{i}") for i, v in enumerate(metrics.values())])
    for key in by:
        kept = kept.where(F.col(key).isNotNull())
    columns = {name: f"_m{i}" for i, name in enumerate(metrics)}
    simple = {o: s for o, s in outputs.items() if s[0] != "quantile"}
    sorted_ = {o: s for o, s in outputs.items() if s[0] == "quantile"}

    def one(spec: tuple) -> Column:
        if spec[1] == ROWS:
            return F.count(F.lit(1))
        value = F.when(~F.isnan(columns[spec[1]]), F.col(columns[spec[1]]))
        return {"count": F.count, "sum": F.sum, "mean": F.avg}[spec[0]](value)

    def cells(names: list[str]) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(o).alias("out"), F.col(o).cast("double").alias("value")) for o in names]))

    parts = []
    if simple or not sorted_:
        totals = kept.groupBy(*by).agg(*[one(s).alias(o) for o, s in simple.items()], F.count(F.lit(1)).alias(ROWS))
        parts.append(totals.select(*by, cells([*simple, ROWS])))
    if sorted_:
        parts.append(_quantiles(kept, by, columns, sorted_))
        # a group whose values are all null keeps its row
        parts.append(kept.select(*by).groupBy(*by).agg(F.count(F.lit(1)).alias(ROWS)).select(*by, cells([ROWS])))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    wide = long.groupBy(*by).agg(*[F.max(F.when(F.col("out") == o, F.col("value"))).alias(o) for o in outputs])
    casts = [
        (F.coalesce(F.col(o), F.lit(0.0)).cast("long") if s[0] == "count" else F.col(o)).alias(o)
        for o, s in outputs.items()
    ]
    return wide.select(*by, *casts)


def _quantiles(df: DataFrame, by: list[str], metrics: dict[str, str], outputs: dict[str, tuple]) -> DataFrame:
    """``by, out, value``: interpolated order statistics from counted values in ranges."""
    used = {name: c for name, c in metrics.items() if any(o[1] == name for o in outputs.values())}
    code = {name: i for i, name in enumerate(used)}
    keys = [*by, "metric"]
    counted = _count_values(_long_values(df, by, used), keys)
    offsets = _bucket_offsets(counted, keys)
    cells = F.array(*[
        F.struct(F.lit(code[s[1]]).alias("of"), F.lit(o).alias("out"), F.lit(float(s[2])).alias("p"))
        for o, s in outputs.items()
    ])
    last = F.col("before") + F.col("bucket_n")
    targets = (
        offsets.select(*keys, "bucket", "bucket_n", "before", "total", F.inline(cells))
        .where("of = metric")
        .withColumn("position", F.col("p") * (F.col("total") - 1))
        .withColumn("low", F.floor("position"))
        .withColumn("high", F.ceil("position"))
        .where(
            ((F.col("low") >= F.col("before")) & (F.col("low") < last))
            | ((F.col("high") >= F.col("before")) & (F.col("high") < last))
        )
        .select(*keys, "bucket", "before", "out", "position", "low", "high")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        counted.withColumn("ahead", F.sum("n").over(inside)).join(targets, [*keys, "bucket"])
        .withColumn("stop", F.col("before") + F.col("ahead"))
        .withColumn("start", F.col("stop") - F.col("n"))
    )

    def holds(p: str) -> Column:
        return (F.col(p) >= F.col("start")) & (F.col(p) < F.col("stop"))

    ends = (
        located.where(holds("low") | holds("high"))
        .groupBy(*by, "out")
        .agg(
            F.max(F.when(holds("low"), F.col("v"))).alias("v_low"),
            F.max(F.when(holds("high"), F.col("v"))).alias("v_high"),
            F.max(F.col("position") - F.col("low")).alias("part"),
        )
    )
    return ends.select(
        *by, "out", (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")).alias("value")
    )


def medians(df: DataFrame, metrics: dict[str, Column | str]) -> DataFrame:
    """One row with the exact median of every metric."""
    return profile(df, [], metrics, {name: ("quantile", name, 0.5) for name in metrics})


def rank_counts(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Average ranks from counted values (``keys, bucket, v, n``)."""
    inside = Window.partitionBy(*keys, "bucket").orderBy("v")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    offsets = _bucket_offsets(counted, keys).select(*keys, "bucket", "before", "total")
    return (
        counted.join(offsets, [*keys, "bucket"])
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .select(*keys, "v", "n", (F.col("ahead") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"), "total")
    )


def lookup_join(
    df: DataFrame, table: DataFrame, keys: list[str], weight: str | None = None, hot: int = HOT_KEYS
) -> DataFrame:
    """Left join to a table with unique keys that survives hot keys, known or not, and null keys.

    A table of at most ``hot`` rows is broadcast and that is all.  Otherwise the ``hot`` most frequent keys of ``df``
    (a top-k, so bounded) are looked up first and broadcast with their answers; their rows and the rows with a null
    key stay where they are.  The other rows, no key with more than 1/``hot`` of all, meet the table in a shuffle.

    ``weight`` is for tables made from ``df`` that have all of its keys: their column with the number of rows of a key.
    ``df`` is read more than once when the table is large: pass a written table.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    answers = table.select(*keys, F.struct(*values).alias("_found"))

    def picked(joined: DataFrame) -> DataFrame:
        return joined.select(*df.columns, *[F.col("_found")[v].alias(v) for v in values])

    if table.select(*keys).limit(hot + 1).count() <= hot:
        return picked(df.join(F.broadcast(answers), keys, "left"))
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    counted = (
        table.select(*keys, F.col(weight).alias("_n")) if weight
        else df.where(~has_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    )
    heavy = materialize(counted.orderBy(F.desc("_n"), *keys).limit(hot).select(*keys), "heavy-keys")
    known = heavy.join(answers, keys, "left").withColumn("_hot", F.lit(True))
    near = df.join(F.broadcast(known), keys, "left").where(F.col("_hot") | has_null)
    far = df.where(~has_null).join(F.broadcast(heavy), keys, "left_anti").join(answers, keys, "left")
    return picked(near).unionByName(picked(far))


def rank_percent(
    df: DataFrame, row_id: str, metrics: dict[str, Column | str], by: dict[str, str] | None = None
) -> DataFrame:
    """``row_id`` plus, for each metric, its average-rank share in (0, 1]; ``row_id`` must be unique.

    ``by`` names, per metric, a grouping column to rank within (null group → null result).
    All metrics travel together as one long narrow table: one ranking, one way back.
    """
    by = by or {}
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("metric"),
            (F.col(by[name]).cast("string") if name in by else F.lit("")).alias("part"),
            num(value).alias("v"),
        )
        for i, (name, value) in enumerate(metrics.items())
    ])
    long = materialize(df.select(row_id, F.inline(cells)).where(
        F.col("part").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")
    ), "long-values")  # the ranking and the lookup read it several times
    keys = ["part", "metric"]
    ranks = rank_counts(_count_values(long, keys), keys).select(
        *keys, "v", "n", (F.col("avg_rank") / F.col("total")).alias("pct")
    )
    ranked = lookup_join(long, ranks, [*keys, "v"], "n")
    return ranked.groupBy(row_id).agg(
        *[F.max(F.when(F.col("metric") == i, F.col("pct"))).alias(name) for i, name in enumerate(metrics)]
    )


def with_rank_percent(df, row_id, metrics, by=None):
    """``df`` with the columns of :func:`rank_percent` added."""
    return df.join(rank_percent(df, row_id, metrics, by), row_id, "left")


def number_rows(
    df: DataFrame, value: Column | str, tie: Column | str, out: str, descending: bool = False
) -> DataFrame:
    """Add the 1-based position of each row in the order ``(value, tie)``, both of any orderable type.

    Nulls come last.  Rows are range-partitioned by both and written with the number of their partition, so neither a
    popular value nor the whole table meets in one task.  Rows equal in both are numbered in any order.
    """
    keyed = df.withColumns({"_v": col(value), "_t": col(tie)})
    order = [F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v"), F.asc_nulls_last("_t")]
    placed = materialize(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered-rows")
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # bounded: one row per partition
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = placed.join(F.broadcast(before), "_part")  # one row per partition
    return numbered.withColumn(out, (F.col("_before") + local).cast("long")).select(*df.columns, out)
