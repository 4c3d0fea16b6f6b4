"""Correlation reports and time-series diagnostics."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.columns import num
from reelscope.functions.fixed_values import EMOTIONS, TARGET
from reelscope.operators.distribution import lookup_join, rank_counts, with_ranges
from reelscope.operators.least_squares import coefficient, counting, let, moment_matrix, sweep
from reelscope.sources.tables import materialize

HEATMAP_COLUMNS = (*EMOTIONS, "duration", "speaking_rate", "follower_count", "plays_day30")


def pearson_matrix(v: DataFrame, columns=HEATMAP_COLUMNS) -> DataFrame:
    """``a, b, corr`` for every pair, each over the rows that have both.

    Pairs become rows so that one small aggregate serves them all; it combines before the shuffle, which
    carries one row per pair and task.
    """
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), num(a).alias("x"), num(b).alias("y"))
        for a, b in combinations(columns, 2)
    ])
    return v.select(F.inline(cells)).groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))


#: Steps of a continued fraction; it settles to 1e-12 in far fewer for the arguments of a correlation.
FRACTION_STEPS = 400
#: Terms of the series of the error function, enough up to six standard deviations.
ERROR_TERMS = 120


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series eight steps up."""
    z = a + F.lit(8.0)
    series = (
        (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi))
        + F.lit(1 / 12) / z - F.lit(1 / 360) / F.pow(z, F.lit(3.0)) + F.lit(1 / 1260) / F.pow(z, F.lit(5.0))
        - F.lit(1 / 1680) / F.pow(z, F.lit(7.0))
    )
    steps = F.log(a)
    for i in range(1, 8):
        steps = steps + F.log(a + F.lit(float(i)))
    return series - steps


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function left of its mean, by a fixed number of steps of its continued fraction."""
    front = F.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)
    ) / a

    def safe(value: Column) -> Column:
        return F.when(F.abs(value) < 1e-300, F.lit(1e-300)).otherwise(value)

    def step(held: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i % 2 == 0, even).otherwise(odd)
        d = F.lit(1.0) / safe(F.lit(1.0) + term * held["d"])
        c = safe(F.lit(1.0) + term / held["c"])
        return F.struct(c.alias("c"), d.alias("d"), (held["total"] * c * d).alias("total"))

    # the first step has the numerator 1
    start = F.struct(F.lit(2.0).alias("c"), F.lit(1.0).alias("d"), F.lit(2.0).alias("total"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step)
    return front * (walked["total"] - F.lit(1.0))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, from the side where the fraction settles fast."""
    right = x > (a + 1.0) / (a + b + 2.0)
    return (
        F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
        .when(right, F.lit(1.0) - _beta_fraction(b, a, F.lit(1.0) - x)).otherwise(_beta_fraction(a, b, x))
    )


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from its t statistic; null below three rows or without a correlation."""
    free = n - 2.0
    # free / (free + t^2) with t^2 = rho^2 free / (1 - rho^2)
    tail = incomplete_beta(free / 2.0, F.lit(0.5), F.lit(1.0) - rho * rho)
    return F.when(rho.isNull() | F.isnan(rho) | (n < 3), F.lit(None).cast("double")).when(
        F.abs(rho) >= 1.0, F.lit(0.0)).otherwise(tail)


def normal_share(z: Column) -> Column:
    """Share of the standard normal distribution below ``z``: the series of the error function, all terms of one sign."""
    x = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(held: Column, i: Column) -> Column:
        term = held["term"] * x * x / (F.lit(2.0) * i + 1.0)
        return F.struct(term.alias("term"), (held["total"] + term).alias("total"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(ERROR_TERMS)), start, step)
    return F.lit(0.5) + walked["total"] * F.exp(-x * x / 2.0) * F.lit(1 / math.sqrt(2 * math.pi))


def spearman_rho(v: DataFrame, columns: list[str], target: str = TARGET, min_rows: int = 100) -> DataFrame:
    """``feature, rho, n``: rank correlation of each column with the target over rows that have both.

    All features share one long table, in which a feature is a number.  Ranks come from counted values.  Those of the target
    return to the pairs by a lookup that spreads heavy ties; they are added up per value of a feature, so only these sums
    meet the ranks of the feature, one row a value.  The squares of the ranks need no pairs.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), num(c).alias("x")) for i, c in enumerate(columns)])
    pairs = materialize(
        v.where(F.col(target).isNotNull())
        .select(num(target).alias("y"), F.inline(cells))
        .where(F.col("x").isNotNull() & ~F.isnan("x")),
        "spearman-pairs",
    )

    def ranks(axis: str) -> DataFrame:
        counted = with_ranges(
            pairs.groupBy("feature", F.col(axis).alias("v")).agg(F.count(F.lit(1)).alias("n")), ["feature"]
        )
        table = rank_counts(counted, ["feature"])
        return table.select(
            "feature", F.col("v").alias(axis), F.col("n").alias(f"n_{axis}"),
            ((F.col("avg_rank") - F.lit(0.5)) / F.col("total") - F.lit(0.5)).alias(f"r_{axis}"),
        )

    of_x, of_y = ranks("x"), materialize(ranks("y"), "spearman-ranks")  # the lookup reads it several times
    at_x = lookup_join(pairs, of_y, ["feature", "y"], "n_y").groupBy("feature", "x").agg(F.sum("r_y").alias("s_y"))
    sums = at_x.join(of_x, ["feature", "x"]).groupBy("feature").agg(
        F.sum("n_x").alias("n"),
        F.sum(F.col("s_y") * F.col("r_x")).alias("xy"),
        F.sum(F.col("n_x") * F.col("r_x") * F.col("r_x")).alias("xx"),
    )
    squares = of_y.groupBy("feature").agg(F.sum(F.col("n_y") * F.col("r_y") * F.col("r_y")).alias("yy"))
    # ranks are centred: their mean is (n + 1) / 2, so the mean of r is 0
    rho = F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.join(squares, "feature").where(F.col("n") >= min_rows).select(
        F.get(names, F.col("feature")).alias("feature"), rho.alias("rho"), "n"
    )


def spearman_report(v: DataFrame, columns: list[str], target: str = TARGET, min_rows: int = 100) -> DataFrame:
    """Correlations with p-values, strongest first."""
    found = spearman_rho(v, columns, target, min_rows)
    p_value = correlation_p_value(F.col("rho"), F.col("n").cast("double"))
    return found.withColumn("p_value", p_value).orderBy(
        F.desc(F.abs("rho")), "feature"
    )


def top_k_features(report: DataFrame, k: int = 20, value: str = "rho") -> DataFrame:
    return report.orderBy(F.desc(F.abs(value)), "feature").limit(k)


def acf(series: DataFrame, value: str = "value", nlags: int = 20) -> DataFrame:
    """``topic, lag, acf`` of every topic at once; a topic has one row per day."""
    by_day = Window.partitionBy("topic").orderBy("date")
    topic = Window.partitionBy("topic")
    away = series.where(F.col(value).isNotNull()).select(
        "topic", "date", (num(value) - F.avg(num(value)).over(topic)).alias("d")
    )
    shifted = away.select(
        "topic", "d", *[(F.col("d") * F.lead("d", k).over(by_day)).alias(f"p{k}") for k in range(nlags + 1)]
    )
    sums = shifted.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(nlags + 1)]
    )
    cells = F.array(*[
        F.struct(F.lit(k).alias("lag"), F.try_divide(f"p{k}", "p0").alias("acf")) for k in range(nlags + 1)
    ])
    return sums.select("topic", "n", F.inline(cells)).where(F.col("lag") < F.col("n")).select("topic", "lag", "acf")


def pacf(series: DataFrame, value: str = "value", nlags: int = 20) -> DataFrame:
    """``topic, lag, pacf`` (Yule-Walker with sample-size adjusted autocovariances), null where undefined.

    The recursion of Durbin and Levinson is a fold over a topic's autocorrelations, an array of at most ``nlags`` + 1.
    """
    sizes = series.where(F.col(value).isNotNull()).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    table = acf(series, value, nlags).join(sizes, "topic").where(F.col("lag") <= F.col("n") / 2)
    adjusted = F.col("acf") * F.col("n") / (F.col("n") - F.col("lag"))
    arrays = table.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("lag", adjusted.alias("r")))).alias("_r"))
    r = F.col("_r.r")
    one = F.nullif(F.lit(1.0), F.lit(0.0))  # of a type that may become null on the way
    start = F.struct(F.array().cast("array<double>").alias("phi"), one.alias("error"), F.array(one).alias("out"))

    def step(held: Column, k: Column) -> Column:
        known = F.zip_with(held["phi"], F.reverse(F.slice(r, F.lit(2), k - 1)), lambda a, b: a * b)
        carried = F.aggregate(known, F.lit(0.0), lambda total, x: total + x)
        last = F.try_divide(F.get(r, k) - carried, held["error"])
        turned = F.zip_with(held["phi"], F.reverse(held["phi"]), lambda a, b: a - last * b)
        return F.struct(
            F.concat(turned, F.array(last)).alias("phi"), (held["error"] * (F.lit(1.0) - last * last)).alias("error"),
            F.concat(held["out"], F.array(last)).alias("out"),
        )

    lags = F.when(F.size("_r") > 1, F.sequence(F.lit(1), F.size("_r") - 1)).otherwise(F.array().cast("array<int>"))
    folded = arrays.select("topic", F.aggregate(lags, start, step, lambda held: held["out"]).alias("_out"))
    return folded.select("topic", F.posexplode("_out").alias("lag", "pacf"))


# Published response-surface coefficients (MacKinnon 1994, constant only, one series)
UNIT_ROOT_MAX, UNIT_ROOT_MIN, UNIT_ROOT_STAR = 2.74, -18.83, -1.61
UNIT_ROOT_SMALL = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


#: The squared error counts as at least this share of the steps' own, so that a perfect fit has a defined lag count.
PERFECT = 1e-10


def _lag_limit(days: Column) -> Column:
    return F.least(F.ceil(F.lit(12.0) * F.pow(days / 100.0, F.lit(0.25))), F.floor(days / 2) - 2).cast("int")


def unit_root_p_value(statistic: Column) -> Column:
    def surface(terms: tuple) -> Column:
        return sum((F.lit(c) * F.pow(statistic, F.lit(float(i))) for i, c in enumerate(terms[1:], 1)), F.lit(terms[0]))

    z = F.when(statistic <= UNIT_ROOT_STAR, surface(UNIT_ROOT_SMALL)).otherwise(surface(UNIT_ROOT_LARGE))
    outside = F.when(statistic > UNIT_ROOT_MAX, F.lit(1.0)).when(statistic < UNIT_ROOT_MIN, F.lit(0.0))
    return F.when(statistic.isNotNull(), outside.otherwise(normal_share(z)))


def adf_test(series: DataFrame, value: str = "value", max_lags: int | None = None) -> DataFrame:
    """``topic, statistic, p_value, lags, n_used`` of the augmented Dickey-Fuller regression, lag count by AIC.

    The days of a topic, an array bounded by the calendar, give one moment matrix of the constant, the level, the lagged
    steps and the step.  Sweeping it on one lag after the other gives the error of every lag count; then the matrix over the days
    that the best count leaves is swept once.  Up to ``12 (n / 100) ** 0.25`` lags, or ``max_lags``.  A topic that never
    changes or has too few days has null results, 0 lags and 0 days.
    """
    rows = series.where(F.col(value).isNotNull()).select("topic", "date", num(value).alias("v"))
    days = rows.groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("date", "v"))).alias("_days"), F.avg("v").alias("_mean"),
        F.count(F.lit(1)).alias("n"), (F.max("v") > F.min("v")).alias("moves"),
    )
    # a level shifted by its mean changes nothing beside a constant and keeps the sums small
    levels = F.transform("_days.v", lambda v: v - F.col("_mean"))
    limit = _lag_limit(F.col("n"))
    placed = days.select("topic", "n", "moves", (limit if max_lags is None else F.least(limit, F.lit(max_lags))).alias("most"), levels.alias("y"))
    n = F.col("n").cast("int")

    def columns(step: Column, skip: Column, lags: Column) -> Column:
        """Constant, level before, lagged steps and step of the days from step ``skip`` on."""
        used = n - 1 - skip
        lagged = F.transform(counting(F.lit(1), lags), lambda k: F.slice(step, skip + 1 - k, used))
        return F.concat(
            F.array(F.array_repeat(F.lit(1.0), used), F.slice("y", skip + 1, used)), lagged, F.array(F.slice(step, skip + 1, used))
        )

    def judge(step: Column) -> Column:
        most = F.col("most")
        tried = sweep(moment_matrix(columns(step, most, most)), most + 3, most + 2)["errors"]
        used = n - 1 - most
        floor = F.aggregate(F.slice(step, most + 1, used), F.lit(0.0), lambda total, x: total + x * x) * PERFECT
        scores = let(floor, lambda least: F.transform(
            F.slice(tried, F.lit(2), most + 1),
            lambda sse, lags: used * F.log(F.greatest(sse, least) / used) + 2 * (lags + 2),
        ))
        return let(let(scores, lambda x: F.array_position(x, F.array_min(x)).cast("int") - 1), lambda lags: fitted(step, lags))

    def fitted(step: Column, lags: Column) -> Column:
        size, used = lags + 3, n - 1 - lags

        def statistic(matrix: Column) -> Column:
            return let(sweep(matrix, size, lags + 2)["m"], lambda m: F.struct(
                F.when(F.get(m, size + 1) < 0, F.try_divide(coefficient(m, size, 1), F.sqrt(
                    -F.get(m, size + 1) * F.greatest(F.element_at(m, -1), F.element_at(matrix, -1) * PERFECT)
                    / F.greatest(used - lags - 2, F.lit(1))
                ))).alias("statistic"), lags.alias("lags"), used.alias("n_used"),
            ))

        return let(moment_matrix(columns(step, lags, lags)), statistic)

    steps = F.zip_with(F.slice("y", F.lit(2), n - 1), F.slice("y", F.lit(1), n - 1), lambda b, a: b - a)
    found = F.when(F.col("moves") & (F.col("most") >= 0), let(steps, judge)).alias("_t")
    return placed.select("topic", found).select(
        "topic", "_t.statistic", unit_root_p_value(F.col("_t.statistic")).alias("p_value"),
        F.coalesce("_t.lags", F.lit(0)).alias("lags"), F.coalesce("_t.n_used", F.lit(0)).alias("n_used"),
    )
