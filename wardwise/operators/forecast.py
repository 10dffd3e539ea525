"""Seeded volume projections per key (nation, state, district) in one job.

The history is first summed to days, so whatever runs after that works on
(key, day) rows. Windows are partitioned by key; the national series has as
many rows as the calendar has days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wardwise.functions import messages
from wardwise.functions.draws import standard_normal
from wardwise.operators.ranking import recent_history
from wardwise.schema import ENROL_MEASURE

# Fixed values of the projection and of capacity planning.
DEFAULT_VOLATILITY = 0.05
MIN_DAYS_FOR_VOLATILITY = 5
THIN_DAY = 10
LINEAR_DRIFT, OTHER_DRIFT = 0.002, 0.005
UPPER_BAND, LOWER_BAND = 1.2, 0.8
ENROLMENTS_PER_OPERATOR = 40
PACKET_MB = 5
HIGH_LOAD_OPERATORS = 100
DEFAULT_SEED = 42
DEFAULT_HORIZON = 30
DEFAULT_PATHS, SKETCH_SIZE = 200, 256

# Names of the two series.
PAST_SERIES, FUTURE_SERIES = "Historical Data", "AI Projection"


def daily_change(
    daily: DataFrame, keys: Sequence[str] = (), measure: str = ENROL_MEASURE
) -> DataFrame:
    """Change against the previous *present* day.

    ``from_zero`` marks a day that grew from 0, where the change is infinite;
    0 after 0 has no change at all.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    previous = F.lag(measure).over(w)
    return (
        daily.withColumn("previous", previous)
        .withColumn("change", F.try_divide(F.col(measure), F.col("previous")) - 1)
        .withColumn(
            "from_zero",
            F.coalesce((F.col("previous") == 0) & (F.col(measure) != 0), F.lit(False)),
        )
    )


def series_state(
    daily: DataFrame, keys: Sequence[str] = (), measure: str = ENROL_MEASURE
) -> DataFrame:
    """Per key: days, last date, start value and volatility, from one pass."""
    changes = daily_change(daily, keys, measure)
    stats = changes.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.max("date").alias("last_date"),
        F.max_by(measure, "date").alias("last_value"),
        F.max_by("previous", "date").alias("value_before"),
        F.stddev_samp("change").alias("deviation"),
        F.bool_or("from_zero").alias("any_from_zero"),
    )
    thin = (F.col("last_value") < THIN_DAY) & (F.col("days") > 1)
    usable = (
        (F.col("days") > MIN_DAYS_FOR_VOLATILITY)
        & ~F.col("any_from_zero")
        & (F.col("deviation") > 0)
    )
    return stats.where(F.col("days") > 0).select(
        *keys,
        "days",
        "last_date",
        F.when(thin, F.col("value_before")).otherwise(F.col("last_value")).alias("start_value"),
        F.when(usable, F.col("deviation")).otherwise(F.lit(DEFAULT_VOLATILITY)).alias("volatility"),
    )


def drift_of(model):
    return F.when(model == "Linear", F.lit(LINEAR_DRIFT)).otherwise(F.lit(OTHER_DRIFT))


def project(
    state: DataFrame,
    keys: Sequence[str] = (),
    scenarios: Sequence[tuple[str, float, int, str]] = (("base", 0.0, DEFAULT_HORIZON, "Linear"),),
    seed: int = DEFAULT_SEED,
    volatility: float | None = None,
) -> DataFrame:
    """Project every key under every scenario ``(name, growth, horizon, model)``.

    Day i: ``start * prod(1 + shock) * (1 + growth/horizon)^i``, cut at 0 in the
    output only. Shocks depend on (seed, key, day), so all scenarios of a key
    share one path and differ only by growth and drift.
    """
    grid = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(float(growth)).alias("growth"),
                F.lit(int(horizon)).alias("horizon"),
                F.lit(model).alias("model"),
            )
            for name, growth, horizon, model in scenarios
        ]
    )
    spread = F.col("volatility") if volatility is None else F.lit(float(volatility))
    steps = (
        state.withColumn("_s", F.explode(grid))
        .select(*keys, "last_date", "start_value", "volatility", "_s.*")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
        .withColumn(
            "_factor",
            F.lit(1.0)
            + drift_of(F.col("model"))
            + spread * standard_normal(seed, *[F.col(k) for k in keys], F.col("step")),
        )
    )
    path = (
        Window.partitionBy(*keys, "scenario")
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    lift = F.pow(F.lit(1.0) + F.col("growth") / F.col("horizon"), F.col("step"))
    value = F.col("start_value") * F.product("_factor").over(path) * lift
    return (
        steps.withColumn("predicted", F.greatest(F.lit(0.0), value))
        .select(
            *keys,
            "scenario",
            "model",
            F.date_add("last_date", F.col("step")).alias("date"),
            "predicted",
            (F.col("predicted") * UPPER_BAND).alias("upper"),
            (F.col("predicted") * LOWER_BAND).alias("lower"),
        )
    )


def forecast(
    daily: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = DEFAULT_HORIZON,
    growth: float = 0.0,
    model: str = "Linear",
    seed: int = DEFAULT_SEED,
    volatility: float | None = None,
    measure: str = ENROL_MEASURE,
) -> DataFrame:
    """``(keys, date, predicted, upper, lower)`` for one scenario."""
    state = series_state(daily, keys, measure)
    projected = project(state, keys, [("base", growth, horizon, model)], seed, volatility)
    return projected.drop("scenario", "model")


def path_values(
    state: DataFrame, keys: Sequence[str], paths: int, horizon: int, growth: float, model: str, seed: int,
    volatility: float | None = None,
) -> DataFrame:
    """``(keys, date, value)`` of ``paths`` seeded paths a key; narrow, a path is one row until it is unfolded."""
    spread = F.col("volatility") if volatility is None else F.lit(float(volatility))
    shock = lambda step: standard_normal(seed, *[F.col(k) for k in keys], F.col("path"), step)
    factors = F.transform(
        F.sequence(F.lit(1), F.lit(int(horizon))), lambda step: F.lit(1.0) + drift_of(F.lit(model)) + spread * shock(step)
    )
    start = F.struct(F.lit(1.0).alias("last"), F.array().cast("array<double>").alias("all"))
    grown = F.aggregate(
        factors, start,
        lambda a, f: F.struct((a["last"] * f).alias("last"), F.concat(a["all"], F.array(a["last"] * f)).alias("all")),
        lambda a: a["all"],
    )
    lift = F.pow(F.lit(1.0) + F.lit(float(growth)) / F.lit(int(horizon)), F.col("step"))
    return (
        state.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(int(paths)))))
        .select(*keys, "last_date", "start_value", F.posexplode(grown).alias("_at", "_grown"))
        .withColumn("step", F.col("_at") + 1)
        .select(
            *keys, F.date_add("last_date", F.col("step")).alias("date"),
            F.greatest(F.lit(0.0), F.col("start_value") * F.col("_grown") * lift).alias("value"),
        )
    )


def quantile_bands(
    daily: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = DEFAULT_HORIZON,
    growth: float = 0.0,
    model: str = "Linear",
    seed: int = DEFAULT_SEED,
    volatility: float | None = None,
    measure: str = ENROL_MEASURE,
    paths: int = DEFAULT_PATHS,
    low: float = 0.1,
    high: float = 0.9,
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """``(keys, date, lower, middle, upper)``: quantiles of many seeded paths, in place of a fixed band.

    Every task folds its paths into one quantile sketch per (key, day); only sketches
    are shuffled and merged, so paths times keys never meet in a sort. The sketch is
    exact while a day has fewer paths than ``size``; beyond, its rank error is about
    ``2.3 / size ** 0.9`` whatever the number of paths.
    """
    values = path_values(series_state(daily, keys, measure), keys, paths, horizon, growth, model, seed, volatility)
    sketches = values.groupBy(*keys, "date").agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("_s"))
    at = lambda rank: F.kll_sketch_get_quantile_double("_s", F.lit(float(rank)))
    return sketches.select(*keys, "date", at(low).alias("lower"), at(0.5).alias("middle"), at(high).alias("upper"))


def first_and_last(projected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return projected.groupBy(*keys).agg(
        F.min_by("predicted", "date").alias("first_predicted"),
        F.max_by("predicted", "date").alias("last_predicted"),
    )


def growth_kpi(projected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percent growth first to last projected day; 0 unless the first is positive."""
    first, last = F.col("first_predicted"), F.col("last_predicted")
    return first_and_last(projected, keys).select(
        *keys, F.coalesce(messages.growth_percent(first, last), F.lit(0.0)).alias("growth_pct")
    )


def insight(projected: DataFrame, model: str = "Linear", keys: Sequence[str] = ()) -> DataFrame:
    """Change of the projection and its message; no data gives the neutral text."""
    first, last = F.col("first_predicted"), F.col("last_predicted")
    change = (F.try_divide(last, first) - 1) * 100
    return (
        first_and_last(projected, keys)
        .withColumn("change_pct", change)
        .select(
            *keys,
            "change_pct",
            messages.projection_insight(F.col("change_pct"), F.lit(model)).alias("insight"),
        )
    )


def summary(projected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Peak, floor and mean of the projection."""
    return projected.groupBy(*keys).agg(
        F.max("predicted").alias("peak"),
        F.min("predicted").alias("floor"),
        F.avg("predicted").alias("mean"),
    )


def whole(value):
    """Truncated to bigint; NULL when a runaway projection does not fit one."""
    return (value - value % 1).try_cast("bigint")


def capacity_plan(projected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Operators, bandwidth and load message for the projected peak."""
    staff = F.col("peak") / ENROLMENTS_PER_OPERATOR
    # ceil() saturates silently at the largest bigint, so it is spelled out
    operators = whole(staff) + F.when(staff % 1 > 0, 1).otherwise(0)
    peak_day = whole(F.col("peak"))
    high_load = staff > HIGH_LOAD_OPERATORS
    message = F.when(
        high_load,
        F.format_string(messages.HIGH_LOAD, peak_day, F.col("operators")),
    ).otherwise(F.format_string(messages.STABLE_LOAD, peak_day))
    return (
        summary(projected, keys)
        .withColumn("operators", operators)
        .select(
            *keys,
            "operators",
            (F.col("peak") * PACKET_MB / 1024).alias("peak_gb_per_day"),
            whole(F.col("mean")).alias("mean_daily_volume"),
            high_load.alias("high_load"),
            message.alias("status"),
        )
    )


def display_table(projected: DataFrame) -> DataFrame:
    """The table shown and exported: whole numbers, reader-friendly headings."""
    return projected.select(
        F.col("date").alias("Date"),
        whole(F.col("predicted")).alias("Predicted (N)"),
        whole(F.col("upper")).alias("Upper Bound"),
        whole(F.col("lower")).alias("Lower Bound"),
    )


def envelope(history: DataFrame, projected: DataFrame, daily: bool = False,
             measure: str = ENROL_MEASURE) -> DataFrame:
    """One series for plotting: recent history, then projection with its band.

    History is the last 60 rows of the feed; ``daily=True`` sums to days first.
    """
    if daily:
        days = history.groupBy("date").agg(F.sum(measure).alias(measure))
        tail = days.where(F.col("date").isNotNull()).orderBy(F.desc("date")).limit(60)
    else:
        tail = recent_history(history, measure=measure)
    past = tail.select(
        F.lit(PAST_SERIES).alias("series"),
        "date",
        F.col(measure).cast("double").alias("value"),
        F.lit(None).cast("double").alias("upper"),
        F.lit(None).cast("double").alias("lower"),
    )
    future = projected.select(
        F.lit(FUTURE_SERIES).alias("series"), "date", F.col("predicted").alias("value"),
        "upper", "lower",
    )
    return past.unionByName(future)
