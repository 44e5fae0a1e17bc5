"""Running models, choosing between them, batches by tier, and back-testing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.config import COMPARED_MODELS, ENSEMBLE_MEMBERS, GRID, SAMPLE_SEED, STRATEGIES, GridConfig
from tallycast.functions.dates import horizon_periods, step_date
from tallycast.functions.scale import kept
from tallycast.operators.models import additive, arima, smoothing, theta
from tallycast.operators.models.base import accuracy, mae, mape, with_moments
from tallycast.operators.models.batch import Model, fit_models
from tallycast.operators.models.boosted import PRESETS, fit_boosted, learnable
from tallycast.operators.models.naive import add_naive, add_seasonal_naive
from tallycast.operators.sampling import random_items
from tallycast.operators.series import pack

BATCHED = {
    "exponential_smoothing": smoothing.model,
    "arima": arima.model,
    "theta": theta.model,
    "additive": additive.model,
}
FALLBACK = {
    "exponential_smoothing": "naive",
    "arima": "exponential_smoothing",
    "theta": "exponential_smoothing",
    "additive": "exponential_smoothing",
    "gbt_leaf": "exponential_smoothing",
    "gbt_depth": "exponential_smoothing",
}
NEEDS = {**{name: (spare,) for name, spare in FALLBACK.items()}, "ensemble": ENSEMBLE_MEMBERS}
RUN_ORDER = (
    "naive", "seasonal_naive", "exponential_smoothing", "arima", "theta", "additive", "ensemble", "gbt_leaf", "gbt_depth",
)


def with_needs(models: Sequence[str]) -> tuple[str, ...]:
    """The models and those they fall back to or combine, in running order."""
    wanted: set[str] = set()
    queue = list(models)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue.extend(NEEDS.get(name, ()))
    return tuple(name for name in RUN_ORDER if name in wanted)


def _add_ensemble(df: DataFrame) -> DataFrame:
    """Mean of the members' forecasts, bounds and errors."""
    def mean_of(part: str) -> Column:
        columns = [F.col(f"{name}.{part}") for name in ENSEMBLE_MEMBERS]
        return F.transform(F.arrays_zip(*[c.alias(f"m{i}") for i, c in enumerate(columns)]), lambda z: (
            sum((z[f"m{i}"] for i in range(1, len(columns))), z["m0"]) / len(columns)
        ))

    def mean_error(part: str) -> Column:
        first, *rest = [F.col(f"{name}.{part}") for name in ENSEMBLE_MEMBERS]
        return sum(rest, first) / len(ENSEMBLE_MEMBERS)

    ready = df.withColumns({f"_{part}": mean_of(part) for part in ("forecast", "lower", "upper")})
    whole = F.struct(
        F.lit("ensemble").alias("model"),
        *[F.col(f"_{part}").alias(part) for part in ("forecast", "lower", "upper")],
        *[mean_error(part).alias(part) for part in ("mape", "mae", "rmse")],
    )
    usable = F.col(ENSEMBLE_MEMBERS[1]).isNotNull()
    return ready.withColumn("ensemble", F.when(usable, whole)).drop("_forecast", "_lower", "_upper")


def _cannot_run(name: str, freq: str, grid: GridConfig) -> Column:
    """Series that a model leaves to its fallback; the pooled ones need ``mean``."""
    if name in PRESETS:
        return F.col("sku").isNull() | ~learnable()
    model = BATCHED[name](freq, grid)
    return F.col("n") < model.shortest() if isinstance(model, Model) else F.lit(True)


def _where_it_stands_in(models: Sequence[str], wanted: dict[str, Column], freq: str, grid: GridConfig) -> dict[str, Column]:
    """``wanted`` with models that only stand in for others limited to the series these can't run on."""
    needed = with_needs(models)
    asked = {*models, *(ENSEMBLE_MEMBERS if "ensemble" in needed else ())}
    limited = dict(wanted)
    for name in needed:
        if name in BATCHED and name not in asked:
            users = [user for user in needed if FALLBACK.get(user) == name]
            left = [wanted.get(user, F.lit(True)) & _cannot_run(user, freq, grid) for user in users]
            limited[name] = wanted.get(name, F.lit(True)) & reduce(lambda a, b: a | b, left)
    return limited


def run_models(
    packed: DataFrame,
    models: Sequence[str],
    periods: int,
    freq: str,
    grid: GridConfig = GRID,
    wanted: dict[str, Column] | None = None,
) -> DataFrame:
    """One struct column per model beside the packed series.

    ``wanted`` limits a model to some items; it is not fitted on the others. A model that only stands in for
    another is fitted where that one can't run.
    """
    wanted = wanted or {}
    needed = with_needs(tuple(models) + ("naive",))
    packed = with_moments(packed)
    if any(name in PRESETS for name in needed):
        packed = kept(packed)  # read by training, scoring and forecasting
    batched = [BATCHED[name](freq, grid) for name in needed if name in BATCHED]
    fitted_on = _where_it_stands_in(tuple(models), wanted, freq, grid)
    out = fit_models(packed, batched, periods, grid, fitted_on) if batched else packed
    for name in needed:
        asked = wanted.get(name, F.lit(True))
        if name == "naive":
            out = add_naive(out, periods, freq)
        elif name == "seasonal_naive":
            out = add_seasonal_naive(out, periods, freq)
        elif name == "ensemble":
            out = _add_ensemble(out)
        elif name in PRESETS:
            out = out.join(fit_boosted(packed.filter(asked), periods, freq, name), "sku", "left")
        if name in FALLBACK:  # M15: the label stays that of the model that ran
            out = out.withColumn(name, F.coalesce(F.col(name), F.when(asked, F.col(FALLBACK[name]))))
    return out


def choose(candidates: Column) -> Column:
    """The least in-sample MAPE; the earlier in the list on a tie."""
    ranked = F.transform(
        F.array_compact(candidates), lambda r, i: F.struct(r["mape"].alias("mape"), i.alias("i"), r.alias("r"))
    )
    return F.array_min(ranked)["r"]


def _results(chosen: DataFrame, freq: str) -> DataFrame:
    # a generator, so that later filters on the result are not copied into the model expressions
    best = F.array(F.coalesce(F.col("_best"), F.col("naive")))
    return chosen.select("sku", F.lit(freq).alias("frequency"), "last_period", F.inline(best))


def forecast(
    df: DataFrame, strategy: str | Sequence[str] = "simple", horizon_days: int = 30, freq: str = "D", grid: GridConfig = GRID
) -> DataFrame:
    """One row per item in nested form, with the model that ran and won."""
    models = STRATEGIES[strategy] if isinstance(strategy, str) else tuple(strategy)
    periods = horizon_periods(horizon_days, freq)
    fitted = run_models(pack(df, freq), tuple(models) + ("naive",), periods, freq, grid)
    return _results(fitted.withColumn("_best", choose(F.array(*[F.col(m) for m in models]))), freq)


def with_strategy(packed: DataFrame, tiers: DataFrame, strategy: str) -> DataFrame:
    """Under "balanced", C items (and items without a tier) use "simple"."""
    tier = tiers.select("sku", F.col("volume_tier").alias("_tier"))
    joined = packed.join(tier, "sku", "left")
    simple = F.lit(strategy == "balanced") & (F.coalesce(F.col("_tier"), F.lit("C")) == "C")
    return joined.withColumn("strategy", F.when(simple, "simple").otherwise(strategy)).drop("_tier")


def forecast_batch(
    df: DataFrame,
    tiers: DataFrame | None = None,
    strategy: str = "simple",
    horizon_days: int = 30,
    freq: str = "D",
    grid: GridConfig = GRID,
) -> DataFrame:
    """The strategy is settled per item before fitting, so a model is fitted only where it is asked."""
    if tiers is None or strategy != "balanced":
        return forecast(df, strategy, horizon_days, freq, grid)
    periods = horizon_periods(horizon_days, freq)
    packed = with_strategy(pack(df, freq), tiers, strategy)
    used = ("simple", strategy)
    models = tuple(dict.fromkeys(name for s in used for name in STRATEGIES[s]))
    wanted = {
        name: F.col("strategy").isin(*[s for s in used if name in with_needs(STRATEGIES[s])]) for name in with_needs(models)
    }
    fitted = run_models(packed, models, periods, freq, grid, wanted)
    per_strategy = F.lit(None)
    for s in used:
        per_strategy = F.when(F.col("strategy") == s, choose(F.array(*[F.col(m) for m in STRATEGIES[s]]))).otherwise(per_strategy)
    return _results(fitted.withColumn("_best", per_strategy), freq)


def items_for_advanced(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """Rows of the A items, or all rows when there is no A item."""
    top = tiers.filter(F.col("volume_tier") == "A").select("sku")
    return df if top.isEmpty() else df.join(top, "sku", "left_semi")


def backtest(
    df: DataFrame,
    horizon: int = 30,
    freq: str = "D",
    sample_size: int | None = 50,
    models: Sequence[str] = COMPARED_MODELS,
    grid: GridConfig = GRID,
    seed: int = SAMPLE_SEED,
) -> DataFrame:
    """Out-of-sample error per item and model; the last ``horizon`` points are held out.

    ``sample_size=None`` tests every item. ``won`` marks the item's best model.
    """
    if sample_size is not None:
        sample = random_items(df.select("sku").distinct(), sample_size, seed)
        df = df.join(F.broadcast(sample), "sku", "left_semi")  # sample_size rows
    held = F.when(F.col("n") > horizon, F.lit(horizon)).otherwise(F.lit(1))
    split = pack(df, freq).filter("n >= 14").withColumn("_held", held).select(
        "sku",
        (F.col("n") - F.col("_held")).alias("n"),
        step_date(F.col("last_period"), -F.col("_held"), freq).alias("last_period"),
        F.slice("ys", 1, F.col("n") - F.col("_held")).alias("ys"),
        F.slice("ys", F.col("n") - F.col("_held") + 1, F.col("_held")).alias("_test"),
    )
    fitted = run_models(split, models, horizon, freq, grid)
    # generators after fitting and after scoring, so that neither is copied into what reads it
    rows = F.array(*[
        F.struct(F.lit(i).alias("model_rank"), F.lit(name).alias("model"), F.col(f"{name}.forecast").alias("forecast"))
        for i, name in enumerate(models)
    ])
    long = fitted.select("sku", "_test", F.inline(rows))
    sums = accuracy(F.col("_test"), F.slice("forecast", 1, F.size("_test")))
    scored = long.select("sku", "model", "model_rank", F.explode(F.array(sums)).alias("_acc"))
    scored = scored.withColumns({"mape": mape(F.col("_acc")), "mae": mae(F.col("_acc"))}).drop("_acc")
    best = F.min(F.struct("mape", "model_rank")).over(Window.partitionBy("sku"))  # one row per model
    return scored.withColumn("won", F.col("model_rank") == best["model_rank"])


def compare_models(
    df: DataFrame,
    horizon: int = 30,
    freq: str = "D",
    sample_size: int | None = 50,
    models: Sequence[str] = COMPARED_MODELS,
    grid: GridConfig = GRID,
) -> DataFrame:
    """Mean errors and win rate per model, best first. Skipped items count in the rate.

    ``sample_size`` is the number of items asked for, ``best_overall`` the model of the least mean error.
    """
    tested = backtest(df, horizon, freq, sample_size, models, grid)
    size = df.select("sku").distinct().agg(F.count(F.lit(1)).alias("_all"))
    taken = F.col("_all") if sample_size is None else F.least(F.col("_all"), F.lit(sample_size))
    stats = tested.groupBy("model").agg(
        F.avg("mape").alias("avg_mape"), F.avg("mae").alias("avg_mae"), F.sum(F.col("won").cast("int")).alias("wins"))
    first = F.first("model").over(Window.partitionBy(F.lit(0)).orderBy("avg_mape", "model"))  # one row per model
    return (
        stats.crossJoin(F.broadcast(size))  # one row
        .withColumns({"win_rate": F.col("wins") / taken, "sample_size": taken, "best_overall": first})
        .select("model", "avg_mape", "avg_mae", "win_rate", "sample_size", "best_overall")
        .orderBy("avg_mape", "model")
    )


def model_matrix(series: DataFrame) -> DataFrame:
    """Lags, shifted rolling statistics and calendar of a resampled (sku, period, y) series.

    A series has one row per calendar period, so an item fits in a window partition.
    """
    w = Window.partitionBy("sku").orderBy("period")
    week, month = w.rowsBetween(-7, -1), w.rowsBetween(-28, -1)

    def full(value: Column, frame, size: int) -> Column:
        return F.when(F.count("y").over(frame) == size, value.over(frame))

    return series.withColumns({
        **{f"lag_{k}": F.lag("y", k).over(w) for k in (1, 7, 14, 28)},
        "rolling_mean_7": full(F.avg("y"), week, 7),
        "rolling_std_7": full(F.stddev_samp("y"), week, 7),
        "rolling_mean_28": full(F.avg("y"), month, 28),
        "day_of_week": F.weekday("period"),
        "month": F.month("period"),
        "day_of_month": F.dayofmonth("period"),
        "week_of_year": F.weekofyear("period"),
        "time_idx": F.row_number().over(w) - 1,
    })


def result_date(step: Column) -> Column:
    """Date of a step of a result row, by its frequency."""
    return (
        F.when(F.col("frequency") == "W", step_date(F.col("last_period"), step, "W"))
        .when(F.col("frequency") == "M", step_date(F.col("last_period"), step, "M"))
        .otherwise(step_date(F.col("last_period"), step, "D"))
    )


def forecast_rows(results: DataFrame, horizon: Column | None = None) -> DataFrame:
    """Long form of nested results: sku, model, step, date, forecast, lower, upper; with ``horizon`` on request."""
    zipped = F.arrays_zip("forecast", "lower", "upper")
    extra = [] if horizon is None else [horizon.alias("horizon")]
    long = results.select("sku", "frequency", "last_period", "model", *extra, F.posexplode(zipped).alias("_i", "_v"))
    step = F.col("_i") + 1
    return long.select(
        "sku",
        "model",
        *["horizon" for _ in extra],
        step.alias("step"),
        result_date(step).alias("date"),
        F.col("_v.forecast").alias("forecast"),
        F.col("_v.lower").alias("lower_bound"),
        F.col("_v.upper").alias("upper_bound"),
    )


def model_rows(fitted: DataFrame, models: Sequence[str], freq: str) -> DataFrame:
    """Nested results of every model, one row per item and model asked for."""
    asked = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("asked"), F.col(name).alias("r"))) for name in models
    ]))
    rows = fitted.select("sku", "last_period", F.lit(freq).alias("frequency"), F.inline(asked))
    return rows.select("sku", "frequency", "last_period", "asked", "r.*")
