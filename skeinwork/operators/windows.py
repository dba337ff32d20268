"""Lookback/horizon windows of series, one row a window with arrays hist and fut; everything after that is narrow.

A point explodes into the few windows that hold it ((lookback + horizon) / step of them) and one hash aggregation by
(series, window) gathers each, so a long series is spread over its windows: there is no self-join and no task with a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.plans.registry import WindowSpec

KEYS = ["sid", "wid"]


def sliding(series: DataFrame, spec: WindowSpec, cap: int | None = None, stamps: bool = False) -> DataFrame:
    """sid, wid, hist, fut of every whole window; stamps and fut_stamps too, as texts, if asked for. cap: at most so many a series, though never less than one."""
    span, step = spec.lookback + spec.horizon, spec.step
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - span + 1) / step)).cast("long")
    last = F.floor(F.col("pos") / step).cast("long")
    more = [_text("ts").alias("t")] if stamps else []
    hit = series.select("sid", "pos", "y", *more, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("wid"))
    if cap is not None:
        hit = hit.where(F.col("wid") < max(1, cap))
    rows = hit.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "y", *(["t"] if stamps else [])))).alias("a")).where(F.size("a") == span)
    y = F.transform("a", lambda x: x["y"])
    t = F.transform("a", lambda x: x["t"]) if stamps else None
    out = [F.slice(y, 1, spec.lookback).alias("hist"), F.slice(y, spec.lookback + 1, spec.horizon).alias("fut")]
    if stamps:
        out += [F.slice(t, 1, spec.lookback).alias("stamps"), F.slice(t, spec.lookback + 1, spec.horizon).alias("fut_stamps")]
    return rows.select(*KEYS, *out)


def _text(ts: str) -> Column:
    return F.coalesce(F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss"), F.col("pos").cast("string"))


def latest(series: DataFrame, lookback: int, stamps: bool = False) -> DataFrame:
    """The last rows of every series that has enough of them; with their stamps, as texts, if asked for."""
    n = series.groupBy("sid").agg((F.max("pos") + 1).alias("n"))
    tail = series.join(n, "sid").where((F.col("n") >= lookback) & (F.col("pos") >= F.col("n") - lookback))
    if stamps:
        tail = tail.withColumn("t", _text("ts"))
    rows = tail.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "y", *(["t"] if stamps else [])))).alias("a"))
    return rows.select("sid", F.transform("a", lambda x: x["y"]).alias("hist"), *([F.transform("a", lambda x: x["t"]).alias("stamps")] if stamps else []))


def points(windows: DataFrame, column: str = "hist") -> DataFrame:
    """sid, wid, pos, y: a row a point. Narrow, and still partitioned by window."""
    return windows.select(*KEYS, F.posexplode(column).alias("pos", "y"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), F.size(a))


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return F.get(F.transform(F.array(mean(a)), lambda m: F.sqrt(mean(F.transform(a, lambda x: (x - m) * (x - m))))), F.lit(0))


def differences(a: Column) -> Column:
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def slope(a: Column) -> Column:
    """Least-squares slope over the index; 0 for fewer than two points."""
    n = F.size(a).cast("double")
    moment = total(F.transform(a, lambda x, i: (x - F.get(a, F.lit(0))) * (i - (n - 1) / 2)))  # exactly 0 where nothing varies
    return F.when(n < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(moment * 12, n * (n * n - 1)), F.lit(0.0)))


def zscored(a: Column) -> Column:
    """Standard scores; zeros where nothing varies."""
    scale = F.array(F.struct(mean(a).alias("m"), deviation(a).alias("s")))
    return F.get(F.transform(scale, lambda z: F.transform(a, lambda x: F.when(z["s"] <= 1e-12, 0.0).otherwise((x - z["m"]) / F.greatest(z["s"], F.lit(1e-300))))), F.lit(0))


def samples(a: Column, k: int = 24) -> Column:
    """k evenly spaced values (places rounded down); interpolated where there are fewer than k, zeros where there are none."""
    n = F.size(a)
    grid = F.sequence(F.lit(0), F.lit(k - 1))

    def at(i: Column) -> Column:
        x = i * (n - 1)
        low, part = F.floor(x / (k - 1)).cast("int"), (x % (k - 1)) / (k - 1)
        left = F.get(a, low)
        return F.when(n >= k, left).otherwise(left + part * (F.coalesce(F.get(a, low + 1), left) - left))

    return F.when(n > 0, F.transform(grid, at)).otherwise(F.array_repeat(F.lit(0.0), k))


def aligned(a: Column, n: int) -> Column:
    """The last n values, or the first value repeated before them."""
    return F.when(F.size(a) >= n, F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, F.lit(n))).otherwise(F.concat(F.array_repeat(F.get(a, F.lit(0)), F.greatest(n - F.size(a), F.lit(0))), a))
