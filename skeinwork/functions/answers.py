"""Forecasts written as text: extraction, parsing to maps, metrics and rewards, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.sources.series import number

# The answer tag, the shapes of a key and a number in loose text, and elisions.
ANSWER = r"(?is)<answer>(.*?)</answer>"
PAIR = r"\"?(\d{4}-\d{2}-\d{2}(?:\s+|T)\d{2}:\d{2}:\d{2}|[A-Za-z_]*\d+)\"?\s*:\s*([+-]?\d+(?:\.\d+)?)"
NUMBER = r"[+-]?\d+(?:\.\d+)?"
ELISIONS = ((r",\s*\.\.\.\s*,", ","), (r",\s*\.\.\.\s*\]", "]"), (r"\[\s*\.\.\.\s*,", "["))


def stripped(t: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def first_answer(t: Column) -> Column:
    """The first answer tag's text, or all of it."""
    return stripped(F.when(t.rlike(ANSWER), F.regexp_extract(t, ANSWER, 1)).otherwise(t))


def last_answer(t: Column) -> Column:
    return stripped(F.when(t.rlike(ANSWER), F.element_at(F.regexp_extract_all(t, F.lit(ANSWER), F.lit(1)), -1)).otherwise(t))


def unelided(t: Column) -> Column:
    for pattern, to in ELISIONS:
        t = F.regexp_replace(t, pattern, to)
    return stripped(t)


def tidied(t: Column) -> Column:
    """Elisions taken out, single quotes made double."""
    return F.translate(unelided(t), "'", '"')


def _value(v: Column) -> Column:
    v = F.regexp_replace(v, '^"(NaN|-?Infinity)"$', "$1")  # as the JSON reader hands over what isn't a number in JSON
    return F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(number(v))


def once(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later expressions read instead of repeating: projections above an explode aren't merged with those below."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")).select("*", "_settled.*").drop("_settled")


def last_wins(entries: Column) -> Column:
    """A map of (k, v) entries; of equal keys the last counts. Sorted once, so n log n."""
    placed = F.array_sort(F.transform(entries, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v"))))
    last = once(placed, lambda s: F.filter(s, lambda x, j: ~x["k"].eqNullSafe(F.get(s, j + 1)["k"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def _indexed(values: Column) -> Column:
    return F.map_from_entries(F.filter(F.transform(values, lambda v, i: F.struct(i.cast("string").alias("k"), _value(v).alias("v"))), lambda x: x["v"].isNotNull()))


def forecast_map(t: Column) -> Column:
    """Key to number of a JSON object or list in the answer; else of `key: number` pairs; else of bare numbers by place. Null: empty."""
    text = first_answer(F.coalesce(t, F.lit("")))
    clean = tidied(text)
    entries = F.filter(F.map_entries(F.from_json(clean, "map<string,string>")), lambda x: _value(x["value"]).isNotNull())
    as_object = last_wins(F.transform(entries, lambda x: F.struct(x["key"].alias("k"), _value(x["value"]).alias("v"))))
    as_list = _indexed(F.from_json(clean, "array<string>"))
    keys, values = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(g)) for g in (1, 2))
    as_pairs = last_wins(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.try_cast("double").alias("v"))))
    as_numbers = _indexed(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))
    return F.when(clean.startswith("{") & as_object.isNotNull(), as_object).when(clean.startswith("[") & as_list.isNotNull(), as_list).when(F.size(keys) > 0, as_pairs).otherwise(as_numbers)


def paired(answer: Column, truth: Column) -> Column:
    """(p, t) by common key; without any, by place in the order of the keys as text, as far as both go."""
    a, b = F.array_sort(F.map_keys(answer)), F.array_sort(F.map_keys(truth))
    common = F.array_sort(F.array_intersect(a, b))
    by_key = F.transform(common, lambda k: F.struct(F.element_at(answer, k).alias("p"), F.element_at(truth, k).alias("t")))
    n = F.least(F.size(a), F.size(b))
    by_place = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), n), lambda x: F.struct(F.element_at(answer, x["a"]).alias("p"), F.element_at(truth, x["b"]).alias("t")))
    return F.when(F.size(common) > 0, by_key).otherwise(by_place)


def metrics(pairs: Column) -> dict[str, Column]:
    """mse, mae and their roots and ratios to the truth's variance and mean; null where there are no pairs or no scale."""
    n = F.nullif(F.size(pairs), F.lit(0))
    add = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, x: s + x) / n
    mse, mae = add(lambda x: (x["p"] - x["t"]) * (x["p"] - x["t"])), add(lambda x: F.abs(x["p"] - x["t"]))
    mean = add(lambda x: x["t"])
    var = F.get(F.transform(F.array(mean), lambda m: add(lambda x: (x["t"] - m) * (x["t"] - m))), F.lit(0))
    scale = F.when(F.abs(mean) > 1e-10, F.abs(mean))
    return {
        "mse": mse, "mae": mae, "rmse": F.sqrt(mse), "nmse": mse / F.when(var > 0, var), "nmae": mae / scale,
        "nrmse": F.sqrt(mse) / scale, "n": F.size(pairs).cast("long"),
    }


def error_reward(mse: Column, bound: Column) -> Column:
    """From 1 down to 0.1 within the bound, and a tail that falls off beyond it."""
    return F.when(mse <= bound, 1 - 0.9 * F.sin(F.pi() * mse / (2 * bound))).otherwise(0.3 * F.exp(-F.ln(F.lit(3.0)) * mse / bound))


def length_penalty(answer: Column, truth: Column) -> Column:
    """Null where the answer has as many values as the truth; else what it costs to have more, fewer or none."""
    a, b = F.size(answer), F.size(truth)
    more = F.greatest(-0.5 - 0.3 * (a - b) / (0.5 * F.greatest(b, F.lit(1))), F.lit(-0.8))
    return F.when((b == 0) | (a == 0), -1.0).when(a > b, more).when(a < b, -0.8)


def contrastive_reward(mse: Column, small: Column, bound: Column, relative: Column, scale: float = 5.0, clip: float = 0.5) -> Column:
    """The absolute reward and a clipped share for being better than a small model, where that is known."""
    gain = F.least(F.greatest((small - mse) / F.greatest(relative, F.lit(1e-8)) * scale, F.lit(-clip)), F.lit(clip))
    return error_reward(mse, bound) + F.when(small.isNotNull(), gain).otherwise(0.0)  # least and greatest skip nulls


def listed(values: Column) -> Column:
    """A list of numbers as the JSON object that a reward column holds: keys by place. Null stays null."""
    pairs = F.transform(values, lambda v, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), F.when(v.isNull() | F.isnan(v), "NaN").otherwise(v.cast("string"))))
    return F.when(values.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def rewarded(df: DataFrame, contrastive: bool = True, scale: float = 5.0, clip: float = 0.5) -> DataFrame:
    """df (answer, ground_truth, dataset_name; tool and baseline where there are) with its reward.

    answer and ground_truth are texts or lists of numbers. Bounds are joined by name from a table of twelve rows; other
    names have OTHER_BOUNDS. Answers of another number of values, or none, cost their penalty; an unknown error costs -1. The
    contrastive share compares with the model tool's reference prediction in tool (JSON), else with baseline (a list), as far as
    it has as many values as the truth.
    """
    from skeinwork.functions import texts
    from skeinwork.plans.registry import OTHER_BOUNDS, reward_bounds

    kinds = dict(df.dtypes)
    text = lambda c: listed(F.col(c).cast("array<double>")) if kinds[c].startswith("array") else F.col(c)
    bounds = F.broadcast(reward_bounds(df.sparkSession).toDF("_name", "_bound", "_relative"))
    rows = settled(df, _said=last_answer(F.coalesce(text("answer"), F.lit(""))), _truth=text("ground_truth"))
    rows = settled(rows, _a=texts.reward_map(F.col("_said")), _g=texts.reward_map(F.col("_truth")))
    rows = rows.join(bounds, F.col("dataset_name") == F.col("_name"), "left")
    error = lambda m: F.get(F.transform(F.array(F.transform(F.array_intersect(F.map_keys(m), F.map_keys("_g")), lambda k: F.element_at(m, k) - F.element_at("_g", k))), lambda e: F.when(F.size(e) > 0, F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x) / F.size(e))), F.lit(0))
    rows = rows.withColumns({"_mse": error(F.col("_a")), "_bound": F.coalesce("_bound", F.lit(OTHER_BOUNDS[0])), "_relative": F.coalesce("_relative", F.lit(OTHER_BOUNDS[1]))})
    said = F.trim("_said")
    a, b = F.size("_a"), F.size("_g")
    penalty = (
        F.when((said != "") & (a == 0) | (b == 0), -1.0).when(a > b, F.greatest(-0.5 - 0.3 * (a - b) / (0.5 * F.greatest(b, F.lit(1))), F.lit(-0.8)))
        .when(a < b, -0.8).when(F.col("_mse").isNull() | F.isnan("_mse"), -1.0)
    )
    plain = error_reward(F.col("_mse"), F.col("_bound"))
    if contrastive:
        reference = F.lit(None).cast("array<double>")
        if "baseline" in kinds:
            reference = F.col("baseline").cast("array<double>")
        fit = lambda v: texts.baseline_map(v, F.col("_g"))
        small = F.coalesce(fit(texts.reference_prediction(F.col("tool"))), fit(reference)) if "tool" in kinds else fit(reference)
        rows = rows.withColumn("_small", error(small))
        small_error = F.when(~F.isnan("_small"), F.col("_small"))
        plain = contrastive_reward(F.col("_mse"), small_error, F.col("_bound"), F.col("_relative"), scale, clip)
    return rows.withColumn("reward", F.coalesce(penalty, plain)).drop("_said", "_truth", "_a", "_g", "_name", "_bound", "_relative", "_mse", "_small")
