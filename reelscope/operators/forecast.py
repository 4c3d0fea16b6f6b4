"""Forecasts of the dense daily series, every topic in parallel.

A topic holds one row per calendar day, so the per-topic step is bounded by the calendar, not by the
number of videos.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.columns import num
from reelscope.operators.least_squares import counting, let, solve
from reelscope.operators.metrics import error_metrics
from reelscope.operators.topic_series import number_series
from reelscope.sources.tables import materialize

SEASON = 7
#: Order of the long autoregression of the first stage.
LONG_AR = 7
#: Shorter training series have no forecast (null).
MIN_DAYS = 4 * SEASON


def _changes(y: Column) -> Column:
    """The change since the day before of the change since the week before, from the ninth day on."""
    return F.transform(counting(F.lit(SEASON + 1), F.size(y) - 1), lambda t: (
        F.get(y, t) - F.get(y, t - SEASON) - F.get(y, t - 1) + F.get(y, t - 1 - SEASON)
    ))


def _seasonal_fit(w: Column) -> Column:
    """``first, beta, shock``: two-stage least squares for ``w_t ~ w_(t-1), w_(t-7), w_(t-8), e_(t-1)``.

    First a long autoregression, whose errors stand for the shocks (none in its first days); then the four coefficients.
    """
    def back(x: Column, lag: int, start: int) -> Column:
        """``x`` of ``lag`` days before, from day ``start`` on."""
        return F.slice(x, F.lit(start - lag + 1), F.size(x) - start)

    long = F.array(*[back(w, k, LONG_AR) for k in range(1, LONG_AR + 1)], back(w, 0, LONG_AR))

    def shocks(first: Column) -> Column:
        return F.transform(w, lambda now, t: F.when(t < LONG_AR, F.lit(0.0)).otherwise(
            now - sum((F.get(first, F.lit(k - 1)) * F.get(w, t - k) for k in range(1, LONG_AR + 1)), F.lit(0.0))
        ))

    def second(e: Column) -> Column:
        start = SEASON + 2
        short = F.array(
            back(w, 1, start), back(w, SEASON, start), back(w, SEASON + 1, start), back(e, 1, start), back(w, 0, start))
        return F.struct(solve(short, 4).alias("beta"), F.element_at(e, -1).alias("shock"))

    return let(let(solve(long, LONG_AR), shocks), second)


def _seasonal_path(y: Column, days: Column) -> Column:
    """The levels of the next days after ``y``: a fold that carries the last eight steps and levels."""
    kinds = "array<double>"

    def walked(w: Column) -> Column:
        def roll(fit: Column) -> Column:
            start = F.struct(
                F.slice(w, F.lit(-SEASON - 1), F.lit(SEASON + 1)).cast(kinds).alias("w"),
                F.slice(y, F.lit(-SEASON - 1), F.lit(SEASON + 1)).cast(kinds).alias("y"),
                fit["shock"].alias("shock"), F.array().cast(kinds).alias("path"),
            )

            def step(held: Column, day: Column) -> Column:
                a, b, c, m = (F.get(fit["beta"], F.lit(i)) for i in range(4))
                w_, y_ = held["w"], held["y"]
                now = a * F.get(w_, F.lit(SEASON)) + b * F.get(w_, F.lit(1)) + c * F.get(w_, F.lit(0)) + m * held["shock"]
                level = F.get(y_, F.lit(SEASON)) + F.get(y_, F.lit(1)) - F.get(y_, F.lit(0))
                return let(now, lambda x: F.struct(
                    F.concat(F.slice(w_, 2, SEASON), F.array(x)).alias("w"),
                    F.concat(F.slice(y_, 2, SEASON), F.array(x + level)).alias("y"), F.lit(0.0).alias("shock"),
                    F.concat(held["path"], F.array(x + level)).alias("path"),
                ))

            return F.aggregate(days, start, step, lambda held: held["path"])

        return let(_seasonal_fit(w), roll)

    return let(_changes(y), walked)


def forecast_seasonal_ar(series: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """``topic, date, actual, forecast`` of the hold-out days: seasonal AR with one moving-average term.

    Fitted on lag-1 and lag-7 differences by least squares, then rolled out without looking at the
    hold-out values, all in one expression over a topic's days, an array bounded by the calendar.  Fewer than
    ``MIN_DAYS`` training days give null.
    """
    points = F.array_sort(F.collect_list(F.struct("date", num("value").alias("value"))))
    topics = series.groupBy("topic").agg(points.alias("days"))
    known = F.floor(F.size("days") * F.lit(train_frac)).cast("int")
    parted = topics.select(
        "topic", F.slice("days.value", F.lit(1), known).alias("y"), F.slice("days", known + 1, F.size("days")).alias("test")
    )
    path = F.when(F.size("y") >= MIN_DAYS, _seasonal_path(F.col("y"), F.col("test")))
    return parted.select("topic", "test", path.alias("path")).select(
        "topic", F.posexplode("test").alias("_i", "_day"), "path"
    ).select(
        "topic", F.col("_day.date").alias("date"), F.col("_day.value").alias("actual"),
        F.get("path", F.col("_i")).alias("forecast"),
    )


def forecast_trend_weekly(series: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """Linear trend plus a level per weekday, in closed form.

    Centring time and value inside each weekday removes the levels; what is left gives the slope.
    """
    marked = number_series(series, train_frac).withColumns({
        "t": F.unix_date("date").cast("double"), "weekday": F.weekday("date"),
    })
    train = marked.where("is_train")
    days = train.groupBy("topic", "weekday").agg(
        F.count(F.lit(1)).alias("n"), F.avg("t").alias("t_mean"), F.avg("value").alias("y_mean"),
        (F.covar_pop("t", "value") * F.count(F.lit(1))).alias("txy"),
        (F.var_pop("t") * F.count(F.lit(1))).alias("txx"),
    )
    slopes = days.groupBy("topic").agg(
        F.coalesce(F.try_divide(F.sum("txy"), F.sum("txx")), F.lit(0.0)).alias("slope"),
        (F.sum(F.col("y_mean") * F.col("n")) / F.sum("n")).alias("y_all"),
        (F.sum(F.col("t_mean") * F.col("n")) / F.sum("n")).alias("t_all"),
    )
    test = marked.where(~F.col("is_train"))
    fitted = test.join(slopes, "topic").join(days.select("topic", "weekday", "t_mean", "y_mean"), ["topic", "weekday"], "left")
    level = F.coalesce("y_mean", "y_all")
    center = F.coalesce("t_mean", "t_all")
    return fitted.select(
        "topic", "date", F.col("value").alias("actual"),
        (level + F.col("slope") * (F.col("t") - center)).alias("forecast"),
    )


FORECASTS = {
    "SeasonalAR(1,1,1)x(1,1,0,7)": forecast_seasonal_ar,
    "Trend + weekday": forecast_trend_weekly,
}


def forecast_metrics(series: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """Hold-out metrics per model and topic."""
    parts = [
        make(series, train_frac).select(F.lit(name).alias("model"), "topic", num("actual").alias("y"), num("forecast").alias("yhat"))
        for name, make in FORECASTS.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return error_metrics(materialize(rows, "forecasts"), by=("model", "topic"))
