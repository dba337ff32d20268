"""Diagnostic features of windows. Each takes windows (sid, wid, hist) and returns a row a window.

Points keep the partitioning of their windows, so the grouped statistics below add no shuffle of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skeinwork.operators.spectrum import whole_periodicity
from skeinwork.operators.windows import KEYS, deviation, differences, mean, points, slope, total


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("pos")


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


def finite(c: Column) -> Column:
    """The value, null where it is no finite number."""
    return F.when(F.abs(c) < float("inf"), c)  # NaN sorts above infinity in Spark


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are finite numbers; 0 where one doesn't vary. (corr() fails there.)"""
    a, b = finite(a), finite(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def statistical(windows: DataFrame) -> DataFrame:
    y = F.col("y")
    return points(windows).groupBy(*KEYS).agg(
        rounded(F.avg(y)).alias("mean"), rounded(F.stddev_pop(y)).alias("std"), rounded(F.min(y)).alias("min"),
        rounded(F.max(y)).alias("max"), rounded(F.max(y) - F.min(y)).alias("range"),
    )


def basic_statistics(windows: DataFrame, season: int) -> DataFrame:
    """The whole tool: what basic() gives, and the spectral entropy."""
    return basic(windows, season).join(spectral_entropy(windows), KEYS)


def basic(windows: DataFrame, season: int) -> DataFrame:
    """Median, median deviation, 5 and 95 % quantiles, autocorrelation at lag 1 and the season."""
    lag = max(1, season)
    p = points(windows).withColumns({"a": F.lag("y", 1).over(ordered()), "b": F.lag("y", lag).over(ordered()), "med": F.median("y").over(Window.partitionBy(*KEYS))})
    return p.groupBy(*KEYS).agg(
        rounded(F.first("med")).alias("median"), rounded(F.median(F.abs(F.col("y") - F.col("med")))).alias("mad"),
        rounded(F.percentile("y", F.lit(0.05))).alias("q05"), rounded(F.percentile("y", F.lit(0.95))).alias("q95"),
        rounded(correlation(F.col("y"), F.col("a"))).alias("acf1"), rounded(correlation(F.col("y"), F.col("b"))).alias("acf_s"),
    )


def spectral_entropy(windows: DataFrame) -> DataFrame:
    """Entropy of the power spectrum of the demeaned window over that of a flat one; bins without power, and the mean's, don't count."""
    n = F.size("hist")
    power = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), lambda k: F.aggregate(
        F.transform("hist", lambda x, i: F.struct((x * F.cos(k * i * (2 * F.pi() / n))).alias("c"), (x * F.sin(k * i * (2 * F.pi() / n))).alias("s"))),
        F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s")), lambda a, z: F.struct((a["c"] + z["c"]).alias("c"), (a["s"] + z["s"]).alias("s")),
        lambda a: a["c"] * a["c"] + a["s"] * a["s"],
    ))
    with_power = windows.select(*KEYS, power.alias("p")).withColumn("t", total(F.col("p")))
    bins = with_power.select(*KEYS, "t", F.filter("p", lambda x: x > F.lit(1e-9) * F.col("t")).alias("p"))
    entropy = -total(F.transform("p", lambda x: x / F.col("t") * F.ln(x / F.col("t"))))
    return bins.select(*KEYS, rounded(F.when(F.size("p") > 1, entropy / F.ln(F.size("p"))).otherwise(0.0), 5).alias("spectral_entropy"))


def quality(windows: DataFrame) -> DataFrame:
    y = F.col("y")
    ratio = F.count_distinct(y) / F.count("*")
    return points(windows).groupBy(*KEYS).agg(
        rounded(F.avg(F.coalesce(F.isnan(y), F.lit(True)).cast("double"))).alias("dropout_ratio"), F.when(ratio <= 0.02, 1.0).otherwise(0.0).alias("constant_channel_ratio"),
        rounded(ratio).alias("unique_ratio"), rounded(F.avg(y) - 3 * F.stddev_pop(y)).alias("clip_low"), rounded(F.avg(y) + 3 * F.stddev_pop(y)).alias("clip_high"),
    )


def trend(windows: DataFrame) -> DataFrame:
    s = windows.select(*KEYS, slope(F.col("hist")).alias("s"), (F.array_max("hist") - F.array_min("hist")).alias("r"))
    way = F.when(F.col("s") > 0, "increasing").when(F.col("s") < 0, "decreasing").otherwise("flat")
    return s.select(*KEYS, rounded(F.col("s")).alias("slope"), way.alias("trend_direction"), rounded(F.coalesce(F.try_divide(F.abs("s"), F.col("r")), F.lit(0.0))).alias("trend_strength"))


def changepoints(windows: DataFrame, recent: int = 5) -> DataFrame:
    """Steps beyond mean(|step|) + 2 deviations, their extremes, and the mean of the last few."""
    p = points(windows).withColumn("d", F.col("y") - F.lag("y").over(ordered())).withColumn("dd", F.col("d") - F.lag("d").over(ordered()))
    whole = Window.partitionBy(*KEYS)
    p = p.withColumns({"limit": F.avg(F.abs("d")).over(whole) + 2 * F.stddev_pop("d").over(whole), "last": F.max("pos").over(whole)})
    return p.groupBy(*KEYS).agg(
        F.count_if(F.abs("d") > F.col("limit")).alias("changepoint_count"), rounded(F.max(F.abs("d")) / (F.stddev_pop("y") + 1e-8), 5).alias("changepoint_score"),
        rounded(F.max("d")).alias("slope_max"), rounded(F.min("d")).alias("slope_min"), rounded(F.coalesce(F.max("dd"), F.lit(0.0))).alias("second_diff_max"),
        rounded(F.avg(F.when(F.col("pos") > F.col("last") - recent, F.col("d")))).alias("recent_momentum"),
    )


def events(windows: DataFrame) -> DataFrame:
    """Oscillation, flat, rise or fall, and the share of steps whose sign changes."""
    p = points(windows).withColumn("g", F.signum(F.col("y") - F.lag("y").over(ordered()))).withColumn("was", F.lag("g").over(ordered()))
    p = p.groupBy(*KEYS).agg(F.coalesce(F.avg((F.col("g") != F.col("was")).cast("double")), F.lit(0.0)).alias("o"), F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0)).alias("s"), F.stddev_pop("y").alias("d"))
    pattern = F.when(F.col("o") > 0.55, "oscillation").when(F.abs("s") <= F.greatest(F.lit(1e-8), F.col("d") * 0.01), "flat").when(F.col("s") > 0, "rise").otherwise("fall")
    return p.select(*KEYS, pattern.alias("dominant_pattern"), rounded(F.col("o")).alias("oscillation_ratio"))


def array_facts(a: Column) -> Column:
    """m, d, slope, momentum (mean of the last five steps) and pattern of a history, from its row alone.

    The same values as statistical, trend, changepoints and events give, for operators that need several of them at once.
    """
    steps = differences(a)
    base = F.struct(mean(a).alias("m"), deviation(a).alias("d"), slope(a).alias("slope"), steps.alias("s"), F.transform(steps, lambda x: F.signum(x)).alias("g"))

    def facts(k: Column) -> Column:
        n = F.size(k["s"])
        last = F.slice(k["s"], F.greatest(n - 4, F.lit(1)), F.lit(5))
        turns = F.zip_with(F.slice(k["g"], F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(k["g"], F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: (x != y).cast("double"))
        o = F.when(n > 1, mean(turns)).otherwise(0.0)
        pattern = F.when(o > 0.55, "oscillation").when(F.abs(k["slope"]) <= F.greatest(F.lit(1e-8), k["d"] * 0.01), "flat").when(k["slope"] > 0, "rise").otherwise("fall")
        return F.struct(k["m"].alias("m"), k["d"].alias("d"), k["slope"].alias("slope"), F.when(n > 0, mean(last)).alias("momentum"), pattern.alias("pattern"))

    return F.get(F.transform(F.array(base), facts), F.lit(0))


def residuals(windows: DataFrame) -> DataFrame:
    """Mean, largest size and lag-1 autocorrelation of the first differences."""
    p = points(windows).withColumn("r", F.col("y") - F.lag("y").over(ordered())).withColumn("was", F.lag("r").over(ordered()))
    return p.groupBy(*KEYS).agg(rounded(F.avg("r")).alias("residual_mean"), rounded(F.max(F.abs("r"))).alias("residual_max"), rounded(correlation(F.col("r"), F.col("was"))).alias("residual_acf1"))


def periodicity(windows: DataFrame) -> DataFrame:
    """The lag (1 to half the window) of the largest raw autocorrelation of the demeaned window, the least on ties; 1 for short ones."""
    n = F.size("hist")
    w = windows.select(*KEYS, "hist", (total(F.col("hist")) / n).alias("m"))
    centred = w.select(*KEYS, F.transform("hist", lambda x: x - F.col("m")).alias("c"))
    k = F.size("c")
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(k / 2).cast("int") - 1)), lambda lag: F.round(
        total(F.zip_with(F.slice("c", lag + 1, F.greatest(k - lag, F.lit(0))), F.slice("c", F.lit(1), F.greatest(k - lag, F.lit(0))), lambda x, y: x * y)), 2))
    found = centred.select(*KEYS, k.alias("k"), at.alias("at"))
    return found.select(*KEYS, F.when(F.col("k") < 3, F.lit(1).cast("long")).otherwise(F.array_position("at", F.array_max("at"))).alias("period"))


def frequency(series: DataFrame) -> DataFrame:
    """The commonest distance of neighbouring timestamps of each series in seconds (the least on ties) and its label."""
    t = series.select("sid", "pos", F.unix_timestamp("ts").alias("t"))
    gaps = t.join(t.select("sid", (F.col("pos") + 1).alias("pos"), F.col("t").alias("was")), ["sid", "pos"]).select("sid", (F.col("t") - F.col("was")).alias("d")).where("d IS NOT NULL")
    counted = gaps.groupBy("sid", "d").count()
    best = counted.groupBy("sid").agg(F.min(F.struct((-F.col("count")).alias("c"), "d"))["d"].alias("seconds"))
    d = F.col("seconds")
    unit = lambda size, name: F.concat(F.when(d / size > 1, (d / size).cast("long").cast("string")).otherwise(""), F.lit(name))
    return best.select("sid", "seconds", F.when(d <= 0, None).when(d % 86400 == 0, unit(86400, "D")).when(d % 3600 == 0, unit(3600, "H")).when(d % 60 == 0, unit(60, "min")).otherwise(unit(1, "s")).alias("frequency"))


def lead_lag(pairs: DataFrame, most: int = 8) -> DataFrame:
    """pairs (sid, wid, pos, other, y, x): for each other channel the lag of the strongest correlation, lag 0 first on ties, then the least.

    Each point is compared at 2 * most + 1 lags: one explode and one equi-join within the window, no pairs of all points.
    """
    keys = [*KEYS, "other"]
    n = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    lags = F.expr(f"sequence(-least({most}, cast(n div 4 as int)), least({most}, cast(n div 4 as int)))")
    moved = pairs.join(n, keys).select(*keys, "pos", "x", F.explode(lags).alias("lag")).select(*keys, (F.col("pos") + F.col("lag")).alias("at"), "lag", "x")
    both = moved.join(pairs.select(*keys, F.col("pos").alias("at"), "y"), [*keys, "at"])
    c = both.groupBy(*keys, "lag").agg(rounded(correlation(F.col("y"), F.col("x"))).alias("c"))
    order = F.struct((-F.abs("c")).alias("a"), (F.col("lag") != 0).alias("z"), "lag", "c")
    return c.groupBy(*keys).agg(F.min(order).alias("b")).select(*keys, F.col("b.lag").cast("long").alias("lag"), F.col("b.c").alias("peak"))


def exogenous_ranking(pairs: DataFrame, top: int = 3) -> DataFrame:
    """The channels of strongest correlation with the target by window, by name on ties."""
    c = pairs.groupBy(*KEYS, "other").agg(rounded(correlation(F.col("y"), F.col("x"))).alias("c"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.abs("c").desc(), "other"))
    return c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def paired(target: DataFrame, others: DataFrame) -> DataFrame:
    """sid, wid, other, ys, xs: windows of target channels (sid, wid, hist) by those of others (other, wid, hist), a row a pair, from one join by window number."""
    return target.select("sid", "wid", F.col("hist").alias("ys")).join(others.select("other", "wid", F.col("hist").alias("xs")), "wid").select("sid", "wid", "other", "ys", "xs")


def array_correlation(ys: Column, xs: Column) -> Column:
    """Pearson correlation of two arrays over the places where both are finite numbers; 0 where one doesn't vary or fewer than two are left.

    One pass over values shifted by the first pair, so that nothing is lost to a large mean.
    """
    both = F.filter(F.zip_with(ys, xs, lambda y, x: F.struct(finite(y).alias("y"), finite(x).alias("x"))), lambda p: p["y"].isNotNull() & p["x"].isNotNull())

    def of(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        zero = F.lit(0.0)
        start = F.struct(zero.alias("y"), zero.alias("x"), zero.alias("yy"), zero.alias("xx"), zero.alias("xy"))

        def add(a: Column, v: Column) -> Column:
            y, x = v["y"] - first["y"], v["x"] - first["x"]
            return F.struct((a["y"] + y).alias("y"), (a["x"] + x).alias("x"), (a["yy"] + y * y).alias("yy"), (a["xx"] + x * x).alias("xx"), (a["xy"] + x * y).alias("xy"))

        def end(a: Column) -> Column:
            n = F.size(p)
            var = lambda q, s: F.greatest(a[q] * n - a[s] * a[s], zero)
            scale = F.sqrt(var("yy", "y")) * F.sqrt(var("xx", "x"))
            flat = (F.size(F.array_distinct(F.transform(p, lambda v: v["y"]))) < 2) | (F.size(F.array_distinct(F.transform(p, lambda v: v["x"]))) < 2)
            return F.when(flat | (scale == 0), zero).otherwise((a["xy"] * n - a["x"] * a["y"]) / scale)

        return F.aggregate(p, start, add, end)

    return F.get(F.transform(F.array(both), of), F.lit(0))


def lagged(pairs: DataFrame, most: int = 8) -> DataFrame:
    """pairs (sid, wid, other, ys, xs) with c: (lag, correlation) at lags of up to `most` and a quarter of the window either way. Narrow: a row is all it takes."""
    n = F.size("ys")
    reach = F.least(F.lit(most), F.floor(n / 4).cast("int"))
    part = lambda a, start, gap: F.slice(F.col(a), start + 1, F.greatest(n - gap, F.lit(0)))
    zero = F.lit(0)

    def at(lag: Column) -> Column:
        ys = part("ys", F.greatest(lag, zero), F.abs(lag))
        xs = part("xs", F.greatest(-lag, zero), F.abs(lag))
        return F.struct(lag.cast("long").alias("lag"), rounded(array_correlation(ys, xs)).alias("c"))

    return pairs.select(*KEYS, "other", F.transform(F.sequence(-reach, reach), at).alias("c"))


def lead_lag_rows(pairs: DataFrame, most: int = 8) -> DataFrame:
    """What lead_lag() gives, from pairs() rows: sid, wid, other, lag, peak; and the correlation at lag 0."""
    order = lambda x: F.struct((-F.abs(x["c"])).alias("a"), (x["lag"] != 0).alias("z"), x["lag"].alias("lag"), x["c"].alias("c"))
    best = F.array_min(F.transform("c", order))
    plain = F.get(F.filter("c", lambda x: x["lag"] == 0), F.lit(0))["c"]
    found = lagged(pairs, most).select(*KEYS, "other", best.alias("b"), plain.alias("correlation"))
    return found.select(*KEYS, "other", F.col("b.lag").alias("lag"), F.col("b.c").alias("peak"), "correlation")


def strongest_row(pairs: DataFrame, most: int = 8) -> DataFrame:
    """The channel with the largest peak of each window, the first by name on ties: other, correlation at lag 0, lag, peak."""
    least = F.min(F.struct((-F.abs("peak")).alias("a"), "other", "correlation", "lag", "peak"))
    return lead_lag_rows(pairs, most).groupBy(*KEYS).agg(least.alias("b")).select(*KEYS, "b.other", "b.correlation", "b.lag", "b.peak")


def strongest_channel(pairs: DataFrame, most: int = 8) -> DataFrame:
    """strongest_row() of pairs as points (sid, wid, pos, other, y, x)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "y", "x")))
    arrays = pairs.groupBy(*KEYS, "other").agg(rows.alias("r")).select(*KEYS, "other", F.transform("r", lambda v: v["y"]).alias("ys"), F.transform("r", lambda v: v["x"]).alias("xs"))
    return strongest_row(arrays, most)


def series_statistics(series: DataFrame) -> DataFrame:
    """A row a series (sid, ts, pos, y): extremes, mean, population variance, length, periodicity of the whole, frequency label."""
    y = F.col("y")
    plain = series.groupBy("sid").agg(F.max(y).alias("max"), F.min(y).alias("min"), rounded(F.avg(y)).alias("mean"), rounded(F.var_pop(y), 3).alias("variance"), F.count("*").alias("series_length"))
    return plain.join(whole_periodicity(series), "sid").join(frequency(series).select("sid", "frequency"), "sid", "left")
