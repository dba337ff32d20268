"""Texts around forecasts: reasoning and answers of a response, JSON columns of rewards, series as JSON, and parts of prompts."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.answers import ANSWER, _value, last_wins, once, stripped, unelided

# Tags, a fenced block, a quoted timestamp, and the shapes of a timestamp with its value in loose text.
THINK = r"(?is)<think>(.*?)</think>"
FENCED = r"(?s)```(?:json)?\s*(.*?)```"
STAMP_KEY = r'"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"'
STAMP_PAIRS = (r'"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"\s*:\s*([+-]?\d+\.?\d*)', r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}):\s*([+-]?\d+\.?\d*)")
STAMP_NAMES = ("timestamp", "time", "t", "date")
VALUE_NAMES = ("value", "val", "v")


def _found(t: Column, pattern: str) -> Column:
    return stripped(F.regexp_extract(F.coalesce(t, F.lit("")), pattern, 1))


def reasoning(t: Column) -> Column:
    """What a response thinks, or nothing."""
    return _found(t, THINK)


def tagged_answer(t: Column) -> Column:
    """The first answer tag's text, or nothing."""
    return _found(t, ANSWER)


def _stamped(text: str | None) -> str:
    opened, spans = [], []
    for m in re.finditer(r"[{}]", text or ""):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            spans.append((opened.pop(), m.end()))
    stamps = [m.span() for m in re.finditer(STAMP_KEY, text or "")]
    for a, b in sorted(spans):
        k = bisect.bisect_left(stamps, (a, 0))
        if k < len(stamps) and stamps[k][1] <= b:
            return text[a:b]
    return ""


def stamped_object(t: Column) -> Column:
    """The leftmost balanced {...} that holds a quoted timestamp, or nothing. Nesting is beyond regular expressions; one pass a text."""

    def found(x: pd.Series) -> pd.Series:
        return x.map(_stamped)

    return F.pandas_udf(found, "string")(t)


def extracted_answer(t: Column) -> Column:
    """The tagged answer; else a fenced block with a timestamp; else the leftmost balanced object with one; else nothing."""
    tagged, fenced = tagged_answer(t), _found(t, FENCED)
    return F.when(tagged != "", tagged).when(fenced.rlike(STAMP_KEY), fenced).otherwise(stamped_object(t))


def reward_map(t: Column) -> Column:
    """Key to number of a JSON column: an object, a list of numbers (keys by place) or a list of objects (a single pair, or a
    time and a value under one of their names); where it is no JSON, timestamps with values in loose text. Null: empty.
    """
    clean = unelided(F.coalesce(t, F.lit("")))
    entries = lambda m: F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("k"), _value(x["value"]).alias("v")))
    valued = lambda e: last_wins(F.filter(e, lambda x: x["v"].isNotNull()))
    strict = {"allowSingleQuotes": "false"}
    as_object = F.from_json(clean, "map<string,string>", strict)
    items = F.from_json(clean, "array<string>", strict)
    plain = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("k"), _value(x).alias("v")))

    def entry(m: Column, i: Column) -> Column:
        named = F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in STAMP_NAMES], i.cast("string"))
        value = F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in VALUE_NAMES])
        one = F.size(m) == 1
        return F.struct(F.when(one, F.get(F.map_keys(m), F.lit(0))).otherwise(named).alias("k"), _value(F.when(one, F.get(F.map_values(m), F.lit(0))).otherwise(value)).alias("v"))

    objects = F.transform(items, lambda x, i: entry(F.from_json(x, "map<string,string>"), i))
    numbers = ~F.exists(items, lambda x: F.coalesce(_value(x), F.lit(None)).isNull())
    listed = F.when(numbers, valued(plain)).otherwise(valued(F.filter(objects, lambda x: x["k"].isNotNull())))
    loose = [(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(1)), F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), F.lit(2))) for p in STAMP_PAIRS]
    pairs = [valued(F.zip_with(k, v, lambda a, b: F.struct(a.alias("k"), b.try_cast("double").alias("v")))) for k, v in loose]
    return F.when(clean.startswith("{") & as_object.isNotNull(), valued(entries(as_object))).when(clean.startswith("[") & items.isNotNull(), listed).when(F.size(loose[0][0]) > 0, pairs[0]).otherwise(pairs[1])


_CALL = "struct<tool_name:string,name:string,output:struct<reference_prediction:array<double>,ensemble_forecast_baseline:array<double>>,reference_prediction:array<double>,ensemble_forecast_baseline:array<double>>"


def reference_prediction(t: Column) -> Column:
    """The auxiliary model's forecast in a JSON list of tool calls, or an object that holds one; null where there is none."""
    whole = F.from_json(t, f"struct<observations:array<{_CALL}>,tools:array<{_CALL}>>")
    single = F.array(F.from_json(t, _CALL))
    calls = F.when(F.trim(t).startswith("["), F.from_json(t, f"array<{_CALL}>")).otherwise(F.coalesce(whole["observations"], whole["tools"], single))
    aux = F.get(F.filter(calls, lambda x: F.coalesce(x["tool_name"] == "model_auxiliary_tool", F.lit(False)) | F.coalesce(x["name"] == "model_auxiliary_tool", F.lit(False))), F.lit(0))
    return F.coalesce(aux["output"]["reference_prediction"], aux["output"]["ensemble_forecast_baseline"], aux["reference_prediction"], aux["ensemble_forecast_baseline"])


def baseline_map(values: Column, truth: Column) -> Column:
    """values by the sorted keys of the truth; null where their numbers differ."""
    return F.when(F.size(values) == F.size(truth), F.map_from_arrays(F.array_sort(F.map_keys(truth)), values))


def key_order(keys: Column) -> Column:
    """Keys with whole numbers first, by number, then the others as text."""
    ranked = F.transform(keys, lambda k: F.struct(k.try_cast("long").isNull().alias("a"), k.try_cast("long").alias("n"), k.alias("k")))
    return F.transform(F.array_sort(ranked), lambda x: x["k"])


def with_note(text: Column, note: Column) -> Column:
    """A note below what is there already."""
    return F.when(F.coalesce(text, F.lit("")) == "", note).otherwise(F.trim(F.concat_ws("\n", text, note)))


def compact(text: Column, most: int) -> Column:
    """One space for each run of white space, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def prompt_id(prompt: Column) -> Column:
    """A number from the first eight hex digits of the prompt's MD5."""
    return F.conv(F.substring(F.md5(prompt.cast("binary")), 1, 8), 16, 10).cast("long")


def frequency_text(stamps: Column) -> Column:
    """The distance of the last two known stamps of an array in words."""
    known = F.filter(stamps, lambda x: x.isNotNull())
    second = lambda k: F.unix_timestamp(F.try_element_at(known, F.lit(k)).try_cast("timestamp"))
    seconds = second(-1) - second(-2)

    def words(s: Column) -> Column:
        unit = lambda size, name: F.concat((s / size).cast("long").cast("string"), F.when(s == size, f" {name}").otherwise(f" {name}s"))
        return F.when(s % 86400 == 0, unit(86400, "day")).when(s % 3600 == 0, unit(3600, "hour")).when(s % 60 == 0, unit(60, "minute")).otherwise(unit(1, "second"))

    return F.coalesce(once(seconds, words), F.lit("the original sampling interval"))


def series_json(keys: Column, values: Column) -> Column:
    """An object of values rounded to six digits, a key where it is first seen; of equal keys the last value counts. n log n."""
    placed = F.array_sort(F.zip_with(F.transform(keys.cast("array<string>"), lambda k, i: F.struct(k.alias("k"), i.alias("i"))), values, lambda k, v: F.struct(k["k"].alias("k"), k["i"].alias("i"), v.alias("v"))))

    def kept(s: Column) -> Column:
        first = F.filter(s, lambda x, j: (j == 0) | ~x["k"].eqNullSafe(F.get(s, j - 1)["k"]))
        last = F.filter(s, lambda x, j: (j == F.size(s) - 1) | ~x["k"].eqNullSafe(F.get(s, j + 1)["k"]))
        return F.array_sort(F.zip_with(first, last, lambda f, x: F.struct(f["i"].alias("i"), f["k"].alias("k"), x["v"].alias("v"))))

    number = lambda v: F.when(v.isNull() | F.isnan(v), "NaN").otherwise(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1"))
    return F.concat(F.lit("{"), F.array_join(F.transform(once(placed, kept), lambda x: F.concat(F.lit('"'), x["k"], F.lit('": '), number(x["v"]))), ", "), F.lit("}"))


# Our own words for what tools do, in prompts.
ABOUT = {
    "model_auxiliary_tool": "Ensemble of simple models; start from its reference prediction.",
    "exogenous_analysis_tool": "Correlation of outside channels with the target.",
    "statistical_analysis_tool": "Mean, spread and range, to bound a forecast.",
    "basic_statistics_tool": "Robust statistics, autocorrelation and quantiles.",
    "data_quality_tool": "Missing and constant values, and bounds for clipping.",
    "comprehensive_feature_tool": "All views of the window together.",
    "trend_analysis_tool": "Direction and strength of the trend.",
    "changepoint_trend_tool": "Breaks, momentum and recent changes.",
    "cross_channel_tool": "The channel that leads or follows the target most closely.",
    "event_summary_tool": "Rise, fall, flat or oscillation.",
    "autoregressive_residual_tool": "What is left of the series once its last value is taken off.",
}


def tool_section(schedule: Column, outputs: Column) -> Column:
    """A block for each scheduled tool, in order: name, what it does, and its output (a map of JSON texts); of the model tool only its reference prediction."""
    about = F.create_map(*[F.lit(x) for pair in ABOUT.items() for x in pair])

    def output(n: Column) -> Column:
        whole = F.try_element_at(outputs, n)
        reference = F.coalesce(F.get_json_object(whole, "$.reference_prediction"), F.get_json_object(whole, "$.ensemble_forecast_baseline"), F.lit("null"))
        return F.when(n == "model_auxiliary_tool", F.concat(F.lit('{"reference_prediction":'), reference, F.lit("}"))).otherwise(F.coalesce(whole, F.lit("{}")))

    block = lambda n: F.concat(F.lit("### "), n, F.lit("\n"), F.coalesce(F.try_element_at(about, n), F.lit("A diagnostic tool.")), F.lit("\n```json\n"), output(n), F.lit("\n```"))
    return F.array_join(F.transform(schedule, block), "\n\n")


def named_channels(output: Column) -> Column:
    """The channels that the exogenous tool's output (JSON) puts first: top_k_names, else those of top_correlated or top, else the first three of correlations; none after an error."""
    names = F.from_json(F.get_json_object(output, "$.top_k_names"), "array<string>")
    pairs = F.transform(F.from_json(F.get_json_object(output, "$.top_correlated"), "array<array<string>>"), lambda x: F.get(x, F.lit(0)))
    top = F.transform(F.from_json(F.get_json_object(output, "$.top"), "array<struct<column:string>>"), lambda x: x["column"])
    others = F.slice(F.map_keys(F.from_json(F.get_json_object(output, "$.correlations"), "map<string,double>")), 1, 3)
    some = lambda a: F.when(F.size(a) > 0, a)
    found = F.coalesce(some(names), some(pairs), some(top), others, F.array().cast("array<string>"))
    return F.when(output.isNull() | F.coalesce(F.get_json_object(output, "$.error"), F.lit("")).isin("", "false"), found).otherwise(F.array().cast("array<string>"))


def future_context(channels: Column, names: Column | None = None, horizon: int | None = None) -> Column:
    """The known future of outside channels (name, values) as JSON: values to two digits, their statistics and direction; nothing without any.

    With names, those channels alone and in that order; with a horizon, at most so many known values each.
    """

    def facts(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.sqrt(once(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n))
        way = F.when(F.element_at(v, -1) > F.element_at(v, 1), "increasing").otherwise("decreasing")
        return F.struct(F.round(mean, 2).alias("mean"), F.round(spread, 2).alias("std"), F.round(F.array_min(v), 2).alias("min"), F.round(F.array_max(v), 2).alias("max"), way.alias("trend"), F.transform(v, lambda x: F.round(x, 2)).alias("values"))

    cut = lambda v: v if horizon is None else F.slice(v, 1, horizon)
    known = F.transform(channels, lambda c: F.struct(c["name"].alias("name"), cut(F.filter(c["values"], lambda x: x.isNotNull() & ~F.isnan(x))).alias("values")))
    known = F.filter(known, lambda c: F.size(c["values"]) > 0)
    if names is not None:
        known = F.filter(F.transform(names, lambda n: F.get(F.filter(known, lambda c: c["name"] == n), F.lit(0))), lambda c: c.isNotNull())
    table = F.map_from_entries(F.transform(known, lambda c: F.struct(c["name"], facts(c["values"]))))
    return F.when(F.size(known) > 0, F.concat(F.lit("Future values of outside channels:\n```json\n"), F.to_json(table), F.lit("\n```"))).otherwise("")


def with_context(section: Column, context: Column) -> Column:
    """The section with a context after the block of the outside channels, at the end where there is no such block."""
    pattern = r"(?s)^(.*?### exogenous_analysis(?:_tool)?\b.*?)(\n\n### .*)?$"
    has = section.rlike(r"(?s)### exogenous_analysis(?:_tool)?\b")
    inside = F.concat(F.regexp_extract(section, pattern, 1), F.lit("\n\n"), context, F.regexp_extract(section, pattern, 2))
    return F.when(F.coalesce(context, F.lit("")) == "", section).when(has, inside).otherwise(F.concat_ws("\n\n", section, context))


def forecasting_prompt(target: str, history: Column, horizon: int, every: Column, section: Column | None = None, domain: str = "") -> Column:
    """A request for the next values of a series: what is known of its domain, the history as JSON, what tools found, and the shape of the answer."""
    parts = [
        F.concat(F.lit(f"Forecast the next {horizon} values of {target}. The series has a value every "), every, F.lit("." + (f"\n{domain}" if domain else ""))),
        F.concat(F.lit("History:\n```json\n"), history, F.lit("\n```")),
    ]
    if section is not None:
        parts.append(F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Findings:\n\n"), section)))
    parts.append(F.lit(f"Think inside <think> tags. Then give a JSON object of {horizon} keys and numbers inside <answer> tags."))
    return F.concat_ws("\n\n", *parts)


# Our own words for how a remote forecaster should use what it is given.
ADVICE = (
    "Start from reference_prediction of model_auxiliary_tool and stay close to its level and its swings.",
    "Where outside channels have known future values, let them shift the forecast as far as they went along with the target before.",
    "Statistics and trend bound a forecast; don't prolong a trend as a straight line.",
    "After a changepoint, trust what came after it; if residuals lean to one side, shift the forecast by their mean.",
    "Where values are missing or cut off, keep within the bounds of the quality tool.",
    "Follow the dominant pattern: keep rising or falling, stay near the level if flat, don't run off to one side if it oscillates.",
)


def api_prompt(history: Column, lookback: int, horizon: int, every: Column, section: Column, feedback: Column | None = None, domain: str = "") -> Column:
    """The request to a remote forecaster: task, shape of the answer, what was wrong before, history, findings and advice."""
    parts = [
        F.concat(F.lit(f"## Task\nForecast the next {horizon} values from the last {lookback}. The series has a value every "), every, F.lit("." + (f"\n{domain}" if domain else ""))),
        F.lit(f"## Answer\nThink inside <think> tags. Then give one JSON object of exactly {horizon} keys, the timestamps that follow, and numbers inside <answer> tags."),
    ]
    if feedback is not None:
        parts.append(F.when(F.coalesce(feedback, F.lit("")) != "", F.concat(F.lit("## What was wrong last time\n"), feedback)))
    parts += [
        F.concat(F.lit("## History\n```json\n"), history, F.lit("\n```")),
        F.concat(F.lit("## Findings of the tools\n"), F.when(F.coalesce(section, F.lit("")) != "", section).otherwise("No tool was run.")),
        F.lit("## Advice\n" + "\n".join(f"- {a}" for a in ADVICE)),
    ]
    return F.concat_ws("\n\n", *parts)
