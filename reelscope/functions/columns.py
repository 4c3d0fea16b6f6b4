"""Small column builders shared by the operators.  Everything stays a built-in Spark expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions import fixed_values as fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c: Column | str) -> Column:
    return col(c).cast("double")


def zero(c: Column | str) -> Column:
    """Null as 0, as a double."""
    return F.coalesce(num(c), F.lit(0.0))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value but keep nulls (``greatest``/``least`` alone would skip them)."""
    value = col(c)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def bucket_label(c: Column | str, buckets) -> Column:
    """Label of the ``(low, high]`` bucket that holds the value; null when none does."""
    value = num(c)
    hits = [F.when((value > low) & (value <= high), F.lit(label)) for label, low, high in buckets]
    return F.coalesce(*hits)


def label_table(spark: SparkSession, column: str, labels, order: str = "bucket_no") -> DataFrame:
    """A small dimension of labels, so that empty buckets can be kept."""
    rows = F.array(*[F.struct(F.lit(i).alias(order), F.lit(x).alias(column)) for i, x in enumerate(labels)])
    return spark.range(1).select(F.inline(rows))


def music_category(c: Column | str) -> Column:
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    rules = [F.when(text.contains(part), F.lit(name)) for part, name in fixed.MUSIC_RULES]
    return F.coalesce(*rules, F.lit(fixed.MUSIC_OTHER))


def archetype(day3: Column | str, day30: Column | str) -> Column:
    """Trajectory class of a video that has both counters; ``day30`` must not be 0."""
    ratio = num(day3) / num(day30)
    return (
        F.when(ratio >= fixed.FLASH_FLOOR, F.lit(fixed.FLASH))
        .when(ratio >= fixed.STEADY_FLOOR, F.lit(fixed.STEADY))
        .when(ratio.isNotNull(), F.lit(fixed.EVERGREEN))
    )


def tier_struct(increment: Column | str) -> Column:
    """Tier of a predicted increment.  A value below every range gets the last tier; null stays null."""
    value = num(increment)

    def entry(t):
        return F.struct(F.lit(t[0]).alias("tier"), F.lit(t[3]).alias("badge"), F.lit(t[4]).alias("description"))

    hits = [F.when((value >= low) & (value < high), entry((name, low, high, badge, text)))
            for name, low, high, badge, text in fixed.TIERS]
    return F.when(value.isNotNull(), F.coalesce(*hits, entry(fixed.TIERS[-1])))


def clean_label(c: Column | str) -> Column:
    return F.translate(col(c), "_", " ")


def level_value(c: Column | str, levels: dict, default: float | None = None) -> Column:
    known = F.coalesce(*[F.when(col(c) == name, F.lit(x)) for name, x in levels.items()])
    return known if default is None else F.coalesce(known, F.lit(default))


def thousands(c: Column | str) -> Column:
    """Whole number with thousands separators (half-even rounding first)."""
    return F.format_number(F.bround(num(c), 0), 0)


def half_even(c: Column | str, digits: int) -> Column:
    return F.bround(num(c), digits)


def fill_template(template: str, **parts: Column) -> Column:
    """``"a {x} b"`` → ``concat('a ', x, ' b')``."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        pieces += [F.lit(head), parts[name].cast("string")]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def optional(df: DataFrame, wanted) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def attach_scalars(df: DataFrame, one_row: DataFrame, name: str = "_scalars") -> DataFrame:
    """Put the single row of ``one_row`` beside every row as a struct (a scalar subquery, no join)."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())
