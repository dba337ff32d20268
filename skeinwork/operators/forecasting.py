"""Forecasts of windows, their errors and ensembles. Built-in models are array expressions; others come in as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.windows import KEYS, mean, slope, total
from skeinwork.plans.registry import WindowSpec

#: Name to (history, spec) -> array of forecasts; the order settles ties.
MODELS: dict[str, Callable[[Column, WindowSpec], Column]] = {}
#: Those that run where no names are given; the others leave the JVM and run by name only.
DEFAULTS: list[str] = []


def model(name: str, default: bool = True):
    """Register a model: a function of the history column and the window specification that gives an array column."""

    def put(f):
        MODELS[name] = f
        if default and name not in DEFAULTS:
            DEFAULTS.append(name)
        return f

    return put


@model("SeasonalNaive")
def seasonal_naive(hist: Column, spec: WindowSpec) -> Column:
    """The last season again and again."""
    tail = F.slice(hist, F.greatest(F.size(hist) - spec.season, F.lit(0)) + 1, F.lit(spec.season))
    return F.transform(F.sequence(F.lit(0), F.lit(spec.horizon - 1)), lambda h: F.get(tail, (h % F.size(tail)).cast("int")))


@model("HistoricAverage")
def historic_average(hist: Column, spec: WindowSpec) -> Column:
    return F.array_repeat(mean(hist), spec.horizon)


@model("ZeroModel")
def zero(hist: Column, spec: WindowSpec) -> Column:
    return F.array_repeat(F.lit(0.0), spec.horizon)


def linear_drift(hist: Column, spec: WindowSpec, recent: int = 24) -> Column:
    """The last value plus the slope of the last few, by step."""
    tail = F.slice(hist, F.greatest(F.size(hist) - recent, F.lit(0)) + 1, F.lit(recent))
    return F.get(F.transform(F.array(slope(tail)), lambda v: F.transform(F.sequence(F.lit(1), F.lit(spec.horizon)), lambda h: F.element_at(hist, -1) + v * h)), F.lit(0))


def theta_values(y: np.ndarray, horizon: int, season: int) -> np.ndarray:
    """Theta forecasts of the rows of y: exponential smoothing of the deseasonalised series plus half its linear drift."""
    rows, n = y.shape
    index = np.ones((rows, n + horizon))
    if season > 1 and n >= 2 * season:
        # An even season is centred by half weights at both ends.
        kernel = np.ones(season) if season % 2 else np.r_[0.5, np.ones(season - 1), 0.5]
        trend = np.lib.stride_tricks.sliding_window_view(y, len(kernel), axis=1) @ kernel / season
        at = len(kernel) // 2
        ratio = np.full((rows, n), np.nan)
        np.divide(y[:, at : at + trend.shape[1]], trend, out=ratio[:, at : at + trend.shape[1]], where=trend > 0)
        up = (y > 0).all(1)
        factor = np.stack([np.nanmean(np.where(up[:, None], ratio[:, k::season], 1.0), axis=1) for k in range(season)], axis=1)
        index = (factor / factor.mean(1, keepdims=True))[:, np.arange(n + horizon) % season]
    x = y / index[:, :n]
    t = np.arange(n) - (n - 1) / 2
    drift = (x - x.mean(1, keepdims=True)) @ t / max((t * t).sum(), 1.0)
    alphas = np.linspace(0.05, 0.95, 19)
    level, err = np.repeat(x[:, :1], len(alphas), axis=1), np.zeros((rows, len(alphas)))
    for k in range(1, n):
        e = x[:, k : k + 1] - level
        err += e * e
        level += alphas * e
    best = err.argmin(1)
    alpha, level = alphas[best][:, None], level[np.arange(rows), best][:, None]
    return (level + drift[:, None] / 2 * (np.arange(horizon) + (1 - (1 - alpha) ** n) / alpha)) * index[:, n:]


def theta(spec: WindowSpec) -> Callable[[Column], Column]:
    """The Theta model over Arrow batches; an empty history, or one with values that are no finite numbers, gives null, which skips the model."""

    @F.pandas_udf("array<double>")
    def run(hist: pd.Series) -> pd.Series:
        values = [np.asarray([] if y is None else y, float) for y in hist]
        sizes = np.array([len(y) if np.isfinite(y).all() else 0 for y in values])
        out = pd.Series([None] * len(values), index=hist.index, dtype=object)
        for n in set(sizes) - {0}:
            at = np.flatnonzero(sizes == n)
            for k, f in zip(at, theta_values(np.stack([values[i] for i in at]), spec.horizon, spec.season), strict=True):
                out.iat[k] = f.tolist()
        return out

    return run


@model("Theta", default=False)
def theta_model(hist: Column, spec: WindowSpec) -> Column:
    return theta(spec)(hist)


def forecasts(windows: DataFrame, spec: WindowSpec, names: Iterable[str] | None = None) -> DataFrame:
    """sid, wid, model, ord, yhat, and fut where windows have it: a row for each window and model, the default ones if no names are given. Narrow. Empty histories have none."""
    names = list(DEFAULTS if names is None else names)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ord"), F.when(F.size("hist") > 0, MODELS[n](F.col("hist"), spec)).alias("yhat")) for i, n in enumerate(names)])
    keep = [c for c in ("hist", "fut") if c in windows.columns]
    return windows.select(*KEYS, *keep, F.inline(rows)).where("yhat IS NOT NULL")


def ensemble(hist: Column, spec: WindowSpec, names: Iterable[str] | None = None) -> Column:
    """The plain ensemble of the default models, or of those named, as one array; null for an empty history."""
    names = list(names or DEFAULTS)
    weights = [1.6 if n == "seasonal_naive" else 1.2 if n == "linear_drift" else 1.0 for n in names]
    scaled = lambda n, w: F.transform(MODELS[n](hist, spec), lambda y: y * w)
    parts = F.array(*[scaled(n, w) for n, w in zip(names, weights)])
    place = F.sequence(F.lit(0), F.lit(spec.horizon - 1))
    whole = F.get(F.transform(F.array(parts), lambda p: F.transform(place, lambda h: total(F.transform(p, lambda y: F.get(y, h))) / sum(weights))), F.lit(0))
    return F.when(F.size(hist) > 0, whole)


def plugged(name: str, run: Callable[[np.ndarray, int, int], np.ndarray]) -> None:
    """Register a Python function (history, horizon, season) -> forecast that may fail; it runs by isolated() only, when named."""
    PLUGGED[name] = run


#: Python models by name. What they raise is kept as a row.
PLUGGED: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {}


def isolated(windows: DataFrame, spec: WindowSpec, names: Iterable[str] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Forecasts (as forecasts() gives them) and failures (sid, wid, model, message) of models that run apart by window.

    A failing model leaves the other forecasts of its window alone. A forecast of another length than the horizon, or a null one,
    is a failure too. In strict mode the first failure ends the job. Without Python models among the names there can be no
    failures beside empty histories, which have no rows at all; the second table is then None.
    """
    names = list(names or DEFAULTS)
    built, own = [n for n in names if n in MODELS], [n for n in names if n in PLUGGED]
    unknown = set(names) - set(built) - set(own)
    if unknown:
        raise KeyError(f"no model {', '.join(sorted(unknown))}")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    plain = forecasts(windows, spec, built).withColumn("ord", order[F.col("model")]) if built else None
    if not own:
        return plain, None
    runs = {n: PLUGGED[n] for n in own}
    horizon, season = spec.horizon, spec.season
    keep = [c for c in ("hist", "fut") if c in windows.columns]

    def run(hist: pd.Series) -> pd.Series:
        out = []
        for y in hist:
            row = []
            for n, f in runs.items():
                try:
                    got = np.asarray(f(np.asarray(y, float), horizon, season), float)
                    if got.shape != (horizon,):
                        raise ValueError(f"forecast of shape {got.shape} for a horizon of {horizon}")
                    row.append({"model": n, "yhat": got.tolist(), "message": None})
                except Exception as e:  # a model's failure is data
                    if strict:
                        raise RuntimeError(f"model {n} failed") from e
                    row.append({"model": n, "yhat": None, "message": f"{type(e).__name__}: {e}"})
            out.append(row)
        return pd.Series(out, index=hist.index)

    done = F.pandas_udf(run, "array<struct<model:string,yhat:array<double>,message:string>>")
    rows = windows.where(F.size("hist") > 0).select(*KEYS, *keep, F.explode(done("hist")).alias("r"))
    good = rows.where("r.message IS NULL").select(*KEYS, *keep, "r.model", order[F.col("r.model")].alias("ord"), "r.yhat")
    bad = rows.where("r.message IS NOT NULL").select(*KEYS, "r.model", "r.message")
    return (good if plain is None else plain.unionByName(good)), bad


def steps(f: DataFrame) -> DataFrame:
    """sid, wid, model, step, yhat: a row a forecast value."""
    return f.select(*KEYS, "model", F.posexplode("yhat").alias("step", "yhat"))


def squared_error(yhat: Column, truth: Column) -> Column:
    """Mean squared error of arrays of equal size; what isn't finite counts as 1e12."""
    e = mean(F.zip_with(yhat, truth, lambda a, b: (a - b) * (a - b)))
    return F.when(e.isNull() | F.isnan(e) | (e == float("inf")), F.lit(1e12)).otherwise(e)


def absolute_error(yhat: Column, truth: Column) -> Column:
    return mean(F.zip_with(yhat, truth, lambda a, b: F.abs(a - b)))


def scored(f: DataFrame) -> DataFrame:
    return f.select("*", squared_error(F.col("yhat"), F.col("fut")).alias("mse"), absolute_error(F.col("yhat"), F.col("fut")).alias("mae"))


def best_models(f: DataFrame) -> DataFrame:
    """The model of least error by window, the first registered on ties."""
    best = F.min(F.struct("mse", "ord", "model"))
    return scored(f).groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, F.col("b.model").alias("best_model"), F.col("b.mse").alias("mse"))


def ensemble_weight(name: Column) -> Column:
    """Weights of the plain ensemble before they are normalised; two names, spelled so, count for more."""
    return F.when(name == "seasonal_naive", 1.6).when(name == "linear_drift", 1.2).otherwise(1.0)


def weighted(f: DataFrame, weights: Column) -> DataFrame:
    """Weighted mean forecast by window and step; the weights need not be normalised."""
    rows = f.select(*KEYS, weights.alias("w"), F.posexplode("yhat").alias("step", "v"))
    return rows.groupBy(*KEYS, "step").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("yhat"))


def inverse_error_weights(similar: DataFrame) -> DataFrame:
    """similar (query, model, similarity, error): a model's share of max(similarity, 0) / max(error, 1e-8) by query."""
    w = similar.groupBy("query", "model").agg(F.sum(F.greatest("similarity", F.lit(0.0)) / F.greatest(F.coalesce("error", F.lit(1e6)), F.lit(1e-8))).alias("w"))
    return w.select("query", "model", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("query"))), F.lit(0.0)).alias("weight"))
