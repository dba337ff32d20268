"""The forecasting workflow without a language model: plan, act, refine, reflect and choose, each a projection of the state row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import features
from skeinwork.operators.forecasting import ensemble, ensemble_weight, isolated
from skeinwork.operators.windows import KEYS, mean, total
from skeinwork.plans.registry import WindowSpec

# Names of the tools, those always run first, those added without a plan, schedules to try, and older names.
MANDATORY = ("model_auxiliary_tool", "exogenous_analysis_tool")
OPTIONAL = (
    "statistical_analysis_tool", "basic_statistics_tool", "data_quality_tool", "comprehensive_feature_tool", "trend_analysis_tool",
    "changepoint_trend_tool", "cross_channel_tool", "event_summary_tool",
)
TRAIN_ONLY = "autoregressive_residual_tool"
HEURISTIC = ("statistical_analysis_tool", "trend_analysis_tool", "changepoint_trend_tool")
STRATEGIES = (HEURISTIC, ("basic_statistics_tool", "changepoint_trend_tool", "data_quality_tool", "event_summary_tool"))
WIDE_STRATEGY = ("cross_channel_tool", "event_summary_tool", "comprehensive_feature_tool")
TRAIN_STRATEGY = (TRAIN_ONLY, "statistical_analysis_tool", "trend_analysis_tool")
OLDER_NAMES = {
    "statistical_analysis": "statistical_analysis_tool",
    "trend_analysis": "trend_analysis_tool",
    "exogenous_analysis": "exogenous_analysis_tool",
    "ar_residual_tool": "autoregressive_residual_tool",
}

# Why a tool was skipped, where the model tool's forecast comes from, and why not from a library.
SKIPPED = "train_only_tool_disabled"
SOURCES = ("anchor_library", "deterministic_fallback")
NO_LIBRARY = "anchor_library_not_configured"


def names(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _optional(train: bool) -> tuple[str, ...]:
    return (*OPTIONAL, TRAIN_ONLY) if train else OPTIONAL


def current_name(name: Column) -> Column:
    """A tool's name of today; unknown names as they are."""
    table = F.create_map(*[F.lit(x) for pair in OLDER_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), name)


def older_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for old, new in OLDER_NAMES.items() for x in (new, old)])
    return F.coalesce(F.try_element_at(table, name), name)


def planned(remembered: Column, proposed: Column | None = None, train: bool = False) -> Column:
    """A plan: the mandatory tools and the allowed ones proposed, if that adds any; else those of similar remembered runs, under
    today's names, and the heuristic ones. Each once, in order of first mention."""
    none = names(())
    past = F.transform(F.coalesce(remembered, none), current_name)
    fallback = F.array_distinct(F.concat(names(MANDATORY), past, names(HEURISTIC)))
    if proposed is None:
        return fallback
    allowed = names([*MANDATORY, *_optional(train)])
    plan = F.array_distinct(F.concat(names(MANDATORY), F.filter(F.coalesce(proposed, none), lambda x: F.array_contains(allowed, x))))
    return F.when(F.size(plan) > len(MANDATORY), plan).otherwise(fallback)


def candidate_schedules(baseline: Column, channels: Column, k: int = 4, train: bool = False) -> Column:
    """At most k different schedules, mandatory tools first: the optional tools of the plan (the heuristic ones if it has none), then the fixed strategies that apply."""
    allowed = names(_optional(train))
    own = F.filter(F.array_distinct(baseline), lambda x: F.array_contains(allowed, x))
    own = F.when(F.size(own) > 0, own).otherwise(names(HEURISTIC))
    none = F.array().cast("array<array<string>>")
    tried = [F.array(own), F.array(*[names(s) for s in STRATEGIES]), F.when(channels > 2, F.array(names(WIDE_STRATEGY))).otherwise(none)]
    tried.append(F.array(names(TRAIN_STRATEGY)) if train else none)
    return F.slice(F.array_distinct(F.transform(F.concat(*tried), lambda s: F.concat(names(MANDATORY), s))), 1, max(1, k))


def named_tools(text: Column) -> Column:
    """Tools of the JSON object {"tools": [...]} in a text; else all known names that occur as words."""
    known = names([*MANDATORY, *OPTIONAL, TRAIN_ONLY])
    parsed = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "tools array<string>")["tools"]
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.filter(known, lambda x: F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"\b"), x, F.lit(r"\b")))))


def act(windows: DataFrame, schedules: DataFrame, spec: WindowSpec, pairs: DataFrame | None = None, train: bool = False, library: dict[str, DataFrame] | None = None) -> DataFrame:
    """sid, wid, tools: a map from each scheduled tool to its output as JSON; windows (sid, wid, hist), schedules (sid, wid, schedule).

    Tools that some schedule names are computed once for all windows. The train-only tool is reported as skipped outside
    training, a tool without a channel as not available, and an unknown one as such. With a library's tables the model tool works by them.
    """
    mentioned = schedules.select(F.explode("schedule").alias("t")).where(F.col("t").isin(*TOOLS)).distinct()
    wanted = {r.t for r in mentioned.collect()}  # at most one row a registered tool
    tables = {n: f(windows, spec, pairs) for n, f in TOOLS.items() if n in wanted and (train or n != TRAIN_ONLY)}
    if library is not None and "model_auxiliary_tool" in tables:
        tables["model_auxiliary_tool"] = _anchored(windows, spec, library)
    out, found = schedules, []
    for n, table in tables.items():
        if table is not None:
            out = out.join(table.select(*KEYS, F.to_json(F.struct(*[c for c in table.columns if c not in KEYS])).alias(n)), KEYS, "left")
            found.append(n)
    results = F.create_map(*[x for n in found for x in (F.lit(n), F.col(n))]) if found else F.create_map().cast("map<string,string>")
    skipped = F.when((F.lit(TRAIN_ONLY) == F.col("_t")) if not train else F.lit(False), f'{{"skipped":true,"reason":"{SKIPPED}"}}')
    other = F.coalesce(skipped, F.when(F.col("_t").isin(*TOOLS), '{"available":false}'), F.lit('{"error":"unknown tool"}'))
    rows = out.select(*KEYS, F.posexplode_outer("schedule").alias("_k", "_t"), results.alias("_r")).select(*KEYS, "_k", "_t", F.coalesce(F.try_element_at("_r", F.col("_t")), other).alias("_o"))
    entries = F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_k", "_t", "_o"))))
    return rows.groupBy(*KEYS).agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["_t"], x["_o"]))).alias("tools"))


def auxiliary(windows: DataFrame, spec: WindowSpec, models: list[str] | None = None) -> DataFrame:
    """The model tool without a library: the plain ensemble, its parts by model and their weights, all rounded to six digits."""
    runs, failed = isolated(windows.select(*KEYS, "hist"), spec, models)
    part = F.struct("model", "ord", "yhat")
    by = runs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))).alias("a"))
    share = lambda a: total(F.transform(a, lambda x: ensemble_weight(x["p"]["model"])))
    place = F.sequence(F.lit(0), F.lit(spec.horizon - 1))
    mixed = F.transform(place, lambda h: F.round(total(F.transform("a", lambda x: ensemble_weight(x["p"]["model"]) / share(F.col("a")) * F.get(x["p"]["yhat"], h))), 6))
    named = lambda f: F.map_from_entries(F.transform("a", lambda x: F.struct(x["p"]["model"], f(x["p"]))))
    six = lambda v: F.transform(v, lambda y: F.round(y, 6))
    out = by.select(
        *KEYS, mixed.alias("reference_prediction"), F.lit(spec.horizon).alias("forecast_length"), named(lambda x: six(x["yhat"])).alias("component_forecasts"),
        named(lambda x: F.round(ensemble_weight(x["model"]) / share(F.col("a")), 6)).alias("weights"), F.lit(SOURCES[1]).alias("source"), F.lit(NO_LIBRARY).alias("fallback_reason"),
    )
    if failed is None:
        return out.withColumn("model_failures", F.create_map().cast("map<string,string>"))
    messages = failed.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "message")))).alias("model_failures"))
    return out.join(messages, KEYS, "left").withColumn("model_failures", F.coalesce("model_failures", F.create_map().cast("map<string,string>")))


def _anchored(windows: DataFrame, spec: WindowSpec, library: dict[str, DataFrame]) -> DataFrame:
    """The model tool by a library; windows of a series that it doesn't have get the plain one, which says why."""
    from skeinwork.operators.library import anchored

    found = anchored(windows, spec, library)
    rest = auxiliary(windows.join(found.select(*KEYS), KEYS, "left_anti"), spec).withColumn("fallback_reason", F.lit("series not in the anchor library"))
    return found.unionByName(rest, allowMissingColumns=True)


def _aux(windows, spec, pairs):
    return auxiliary(windows, spec)


def comprehensive_features(windows: DataFrame, spec: WindowSpec) -> DataFrame:
    """Six tools' outputs of every window as structs."""
    parts = {
        "statistical": features.statistical(windows), "basic": features.basic_statistics(windows, spec.season), "trend": features.trend(windows),
        "changepoint": features.changepoints(windows), "quality": features.quality(windows), "event": features.events(windows),
    }
    out = windows.select(*KEYS)
    for name, p in parts.items():
        out = out.join(p.select(*KEYS, F.struct(*[c for c in p.columns if c not in KEYS]).alias(name)), KEYS)
    return out


def _ranking(windows, spec, pairs):
    if pairs is None:
        return None
    top = F.sort_array(F.collect_list(F.struct("rank", "other", "c")))
    return features.exogenous_ranking(pairs).groupBy(*KEYS).agg(F.transform(top, lambda x: F.struct(x["other"].alias("column"), x["c"].alias("correlation"))).alias("top"))


#: Tool names to functions of (windows, spec, pairs with outside channels or None).
TOOLS = {
    "model_auxiliary_tool": _aux,
    "exogenous_analysis_tool": _ranking,
    "statistical_analysis_tool": lambda w, spec, pairs: features.statistical(w),
    "basic_statistics_tool": lambda w, spec, pairs: features.basic_statistics(w, spec.season),
    "data_quality_tool": lambda w, spec, pairs: features.quality(w),
    "comprehensive_feature_tool": lambda w, spec, pairs: comprehensive_features(w, spec),
    "trend_analysis_tool": lambda w, spec, pairs: features.trend(w),
    "changepoint_trend_tool": lambda w, spec, pairs: features.changepoints(w),
    "cross_channel_tool": lambda w, spec, pairs: None if pairs is None else features.strongest_channel(pairs),
    "event_summary_tool": lambda w, spec, pairs: features.events(w),
    TRAIN_ONLY: lambda w, spec, pairs: features.residuals(w),
}


def older_calls(schedule: Column, outputs: Column) -> Column:
    """Tool calls under older names, in order of the schedule, of the tools that have an output (a map under today's names)."""
    kept = F.filter(schedule, lambda x: F.map_contains_key(outputs, x))
    return F.transform(kept, lambda x: F.struct(older_name(x).alias("tool_name"), F.element_at(outputs, x).alias("output")))


def last_value(hist: Column, horizon: int) -> Column:
    """A fallback forecast: the last value again and again."""
    return F.array_repeat(F.element_at(hist, -1), horizon)


def invalid(horizon: int) -> Column:
    """What stands for a forecast that couldn't be made."""
    return F.array_repeat(F.lit(float("nan")), horizon)


def bent(baseline: Column, hist: Column, slope_: Column, momentum: Column, pattern: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A forecast bent by slope and momentum, drawn to a level if the window is flat or oscillates, and clipped where bounds are known.

    Null slope, momentum or pattern (a tool that didn't run) count as none.
    """
    drift = 0.2 * (0.7 * F.coalesce(slope_, F.lit(0.0)) + 0.3 * F.coalesce(momentum, F.lit(0.0)))
    recent = mean(F.slice(hist, F.greatest(F.size(hist) - 11, F.lit(1)), F.lit(12)))
    facts = F.struct(drift.alias("d"), recent.alias("level"), mean(hist).alias("m"))

    def value(k: Column) -> Column:
        y = lambda b, h: b + k["d"] * (h + 1)
        drawn = lambda v: F.when(pattern == "flat", 0.85 * v + 0.15 * k["level"]).when(pattern == "oscillation", 0.95 * v + 0.05 * k["m"]).otherwise(v)
        cut = lambda v: v if low is None else F.when(low.isNotNull() & high.isNotNull(), F.least(F.greatest(v, low), high)).otherwise(v)
        return F.transform(baseline, lambda b, h: cut(drawn(y(b, h))))

    return F.get(F.transform(F.array(facts), value), F.lit(0))


def refined(windows: DataFrame, spec: WindowSpec, models: list[str] | None = None, clip: bool = True, train: bool = False) -> DataFrame:
    """sid, wid, step, yhat: the plain ensemble, bent and drawn as bent() says; clipped to three deviations where the quality tool ran.

    In training the ensemble is the forecast as it is. Everything is read off the window's own row.
    """
    hist = F.col("hist")
    base = windows.select(*KEYS, "hist", ensemble(hist, spec, models).alias("base"), features.array_facts(hist).alias("x")).where("size(hist) > 0")
    bounds = (F.round(F.col("x.m") - 3 * F.col("x.d"), 6), F.round(F.col("x.m") + 3 * F.col("x.d"), 6)) if clip else ()
    y = F.col("base") if train else bent(F.col("base"), hist, F.round(F.col("x.slope"), 6), F.round(F.col("x.momentum"), 6), F.col("x.pattern"), *bounds)
    return base.select(*KEYS, F.posexplode(y).alias("step", "yhat"))


def verdict(forecast: Column, horizon: int, message: Column | None = None) -> Column:
    """'PASS', or what is wrong with a forecast; a reviewer's message fails it by FAIL without PASS."""
    message = F.lit(None).cast("string") if message is None else message
    odd = F.exists(forecast, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    said = F.upper(message)
    return (
        F.when(forecast.isNull(), "there is no forecast")
        .when(F.size(forecast) != horizon, F.concat(F.size(forecast).cast("string"), F.lit(f" values for a horizon of {horizon}")))
        .when(odd, "some values are no finite numbers")
        .when(said.contains("FAIL") & ~said.contains("PASS"), message).otherwise("PASS")
    )


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (keys, candidate, valid, mse): a valid one of least error if there is any, else one of least error; unknown errors last."""
    err = F.when(F.col("mse").isNull() | F.isnan("mse"), float("inf")).otherwise(F.col("mse"))
    best = F.min(F.struct((~F.coalesce("valid", F.lit(False))).alias("bad"), err.alias("e"), "candidate"))
    return candidates.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.candidate").alias("candidate"), (~F.col("b.bad")).alias("valid"), F.col("b.e").alias("mse"))


def excellent(mse: Column, mae: Column, mse_bar: float = 168.0, mae_bar: float = 8.6) -> Column:
    return F.coalesce((mse < mse_bar) & (mae < mae_bar), F.lit(False))
