"""Loops of the forecasting workflow over all windows at once: plan, act, forecast, review, and again where that failed.

A round is one job over the frontier, the windows that aren't done. Its attempts are rows, written to a folder of their own, and the
next round's frontier is read from them, so a round's plan doesn't grow with those before it. Windows leave as they pass, and the
loop ends when none is left. What tools find doesn't depend on the attempt, so it is computed once.

Remote models are plain functions from a prompt to an answer that may raise. They run in tasks, a row at a time, and what they
raise is kept as text. Without them every part is decided by column expressions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import answers, texts
from skeinwork.operators import features, similarity, workflow
from skeinwork.operators.forecasting import ensemble
from skeinwork.operators.windows import KEYS, mean
from skeinwork.plans.registry import WindowSpec

Client = Callable[[str], str]


@dataclass
class Clients:
    """Remote models, each optional: plan proposes tools, forecast answers prompts, review passes or fails a forecast."""

    plan: Client | None = None
    forecast: Client | None = None
    review: Client | None = None
    tries: int = 3


@dataclass
class Limits:
    attempts: int = 10
    candidates: int = 4
    mse: float = 168.0
    mae: float = 8.6


# Names of settings and the parts of Limits that they set, for the loop that fills the memory and the one of tests.
MEMORY_SETTINGS = {"MAX_REFLECTION_LOOPS": "attempts", "PARALLEL_PLAN_K": "candidates", "EXCELLENT_MSE_THRESHOLD": "mse", "EXCELLENT_MAE_THRESHOLD": "mae"}
TEST_SETTINGS = {"MAX_TEST_RETRY_LOOPS": "attempts"}


def limits_of(values: Mapping[str, str], memory: bool = False) -> Limits:
    """Limits from settings as texts, such as the environment's or Spark's; blank or missing ones keep their default."""
    out = Limits(attempts=3) if memory else Limits()
    for name, part in (MEMORY_SETTINGS if memory else TEST_SETTINGS).items():
        if str(values.get(name, "")).strip():
            setattr(out, part, type(getattr(out, part))(values[name]))
    if out.attempts < 1 or out.candidates < 1:
        raise ValueError("attempts and candidates must be positive")
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def asked(prompt: Column, client: Client, tries: int = 3) -> Column:
    """(text, error) of a client's answer; the last error where all tries failed."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            text = error = None
            for _ in range(max(1, tries)):
                try:
                    text, error = client(p), None
                    break
                except Exception as e:  # a remote model's failure is data
                    error = f"{type(e).__name__}: {e}"
            out.append((text, error))
        return pd.DataFrame(out, columns=["text", "error"])

    return F.pandas_udf(run, "text string, error string").asNondeterministic()(prompt)


def remembered(windows: DataFrame, entries: DataFrame, k: int = 3, least: float = 0.9) -> DataFrame:
    """sid, wid, remembered: tools of the k most similar entries of the memory, each once, the most similar entry's first."""
    q = windows.select(F.struct(*KEYS).alias("query"), similarity.embedding(F.col("hist")).alias("v"))
    e = entries.select(F.struct(F.coalesce("dataset_name", F.lit("")).alias("d"), "idx").alias("item"), F.col("vector").alias("u"), F.transform("tool_calls", lambda x: x["tool_name"]).alias("names"))
    near = similarity.nearest_pruned(q, e.select("item", "u"), k, least).join(e.select("item", "names"), "item")
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "names"))).alias("a"))
    return lists.select("query.*", F.array_distinct(F.flatten(F.transform("a", lambda x: F.coalesce(x["names"], F.array().cast("array<string>"))))).alias("remembered"))


def observed(windows: DataFrame, spec: WindowSpec, pairs: DataFrame | None = None, train: bool = False, library: dict[str, DataFrame] | None = None) -> DataFrame:
    """windows with outputs (of all tools, as JSON by name), the ensemble (by a library if there is one) and the facts that forecasts are bent by."""
    every = workflow.names([n for n in workflow.TOOLS if train or n != workflow.TRAIN_ONLY])
    outputs = workflow.act(windows, windows.select(*KEYS, every.alias("schedule")), spec, pairs, train, library)
    facts = windows.select("*", ensemble(F.col("hist"), spec).alias("base"), features.array_facts(F.col("hist")).alias("x"))
    state = facts.join(outputs.withColumnRenamed("tools", "outputs"), KEYS)
    if library is not None:
        told = F.from_json(F.get_json_object(F.try_element_at("outputs", F.lit("model_auxiliary_tool")), "$.reference_prediction"), "array<double>")
        state = state.withColumn("base", F.coalesce(told, "base"))
    return state


def _planned(state: DataFrame, spec: WindowSpec, clients: Clients, train: bool) -> DataFrame:
    """state with its base schedule; a failing planner leaves a note and the plan without it."""
    none = F.array().cast("array<string>")
    past = F.coalesce("remembered", none) if "remembered" in state.columns else none
    if clients.plan is None:
        return state.withColumn("plan", workflow.planned(past, train=train))
    tail = F.transform(F.slice("hist", F.greatest(F.size("hist") - 23, F.lit(1)), F.lit(24)), lambda x: F.round(x, 6))
    payload = F.to_json(F.struct(
        F.lit("choose tools for a forecast without looking ahead").alias("task"), F.col("sid").cast("string").alias("series"), F.col("wid").alias("window"), "attempt", workflow.names(workflow.MANDATORY).alias("mandatory"),
        workflow.names([*workflow.OPTIONAL, *([workflow.TRAIN_ONLY] if train else [])]).alias("optional"), F.lit(spec.lookback).alias("lookback"), F.lit(spec.horizon).alias("horizon"), tail.alias("tail"), past.alias("remembered"),
    ))
    said = state.withColumn("_a", asked(payload, clients.plan, clients.tries))
    note = texts.with_note(F.col("reflection"), F.concat(F.lit("[planner failed] "), "_a.error"))
    out = said.withColumn("plan", workflow.planned(past, F.when(F.col("_a.error").isNull(), workflow.named_tools(F.col("_a.text"))), train=train))
    return out.withColumn("reflection", F.when(F.col("_a.error").isNotNull(), note).otherwise(F.col("reflection"))).drop("_a")


def _has(tool: str) -> Column:
    return F.array_contains("schedule", tool)


def _forecast(state: DataFrame, spec: WindowSpec, clients: Clients, train: bool) -> DataFrame:
    """state (with schedule and outputs) with prompt, response, forecast and error."""
    stamped = "stamps" in state.columns
    keys = F.col("stamps") if stamped else F.transform("hist", lambda x, i: i.cast("string"))
    section = texts.tool_section(F.col("schedule"), F.col("outputs"))
    every = texts.frequency_text(F.col("stamps")) if stamped else F.lit("the original sampling interval")
    prompt = texts.api_prompt(texts.series_json(keys, F.col("hist")), spec.lookback, spec.horizon, every, section, F.col("reflection"))
    state = state.withColumn("prompt", prompt)
    if clients.forecast is not None:
        said = state.withColumn("_a", asked(F.col("prompt"), clients.forecast, clients.tries))
        found = answers.forecast_map(F.col("_a.text"))
        values = answers.once(found, lambda m: F.transform(texts.key_order(F.map_keys(m)), lambda k: F.round(F.element_at(m, k), 6)))
        said = said.withColumn("_v", F.when(F.col("_a.text").rlike(answers.ANSWER), values))
        wrong = (
            F.when(F.col("_a.error").isNotNull(), F.col("_a.error")).when(~F.col("_a.text").rlike(answers.ANSWER), "there is no <answer> tag").when(F.size("_v") < 1, "there is no number in the answer")
            .when(F.size("_v") != spec.horizon, F.concat(F.size("_v").cast("string"), F.lit(f" answers for a horizon of {spec.horizon}")))
        )
        said = said.withColumn("error", wrong).withColumn("response", F.col("_a.text"))
        said = said.withColumn("forecast", F.when(F.col("error").isNull(), F.col("_v")).otherwise(workflow.invalid(spec.horizon)))
        note = texts.with_note(F.col("reflection"), F.concat(F.lit("[forecaster failed] "), "error"))
        return said.withColumn("reflection", F.when(F.col("error").isNotNull(), note).otherwise(F.col("reflection"))).drop("_a", "_v")
    last = workflow.last_value(F.col("hist"), spec.horizon)
    base = F.when(_has("model_auxiliary_tool"), F.coalesce("base", last)).otherwise(last)
    low, high = (F.when(_has("data_quality_tool"), F.round(F.col("x.m") + s * 3 * F.col("x.d"), 6)) for s in (-1, 1))
    bent = workflow.bent(
        base, F.col("hist"), F.when(_has("trend_analysis_tool"), F.round("x.slope", 6)), F.when(_has("changepoint_trend_tool"), F.round("x.momentum", 6)),
        F.when(_has("event_summary_tool"), F.col("x.pattern")), low, high,
    )
    y = F.when(_has("model_auxiliary_tool"), base).otherwise(bent) if train else bent
    out = state.withColumn("forecast", F.transform(y, lambda v: F.round(v, 6))).withColumn("error", F.lit(None).cast("string"))
    pairs = F.transform("forecast", lambda v, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), v.cast("string")))
    return out.withColumn("response", F.concat(F.lit("<think>No forecaster is at hand; the ensemble was adjusted by what the tools found.</think>\n<answer>{"), F.array_join(pairs, ", "), F.lit("}</answer>")))


def _judged(state: DataFrame, spec: WindowSpec, clients: Clients) -> DataFrame:
    """state with mse, mae, valid and reflection."""
    if "fut" in state.columns:
        off = F.zip_with("forecast", "fut", lambda p, t: p - t)
        state = state.withColumns({"mse": mean(F.transform(off, lambda e: e * e)), "mae": mean(F.transform(off, lambda e: F.abs(e)))})
    else:
        state = state.withColumns({"mse": F.lit(None).cast("double"), "mae": F.lit(None).cast("double")})
    plain = workflow.verdict(F.col("forecast"), spec.horizon)
    noted = F.when(plain != "PASS", texts.with_note(F.col("reflection"), plain))
    if clients.review is None:
        return state.withColumn("valid", plain == "PASS").withColumn("reflection", F.coalesce(noted, F.lit("PASS")))
    payload = F.when(plain == "PASS", F.to_json(F.struct(
        F.lit("check a forecast for shape and agreement with the evidence").alias("task"), F.col("sid").cast("string").alias("series"), F.col("wid").alias("window"), "attempt", "candidate", F.lit(spec.horizon).alias("horizon"),
        F.col("schedule").alias("tools"), "forecast", F.col("base").alias("baseline"), "mse", "mae", F.lit("PASS or FAIL, then one short reason").alias("answer"),
    )))
    # What is wrong by itself isn't sent.
    client = clients.review
    said = state.withColumn("_a", asked(payload, lambda p: None if p is None else client(p), clients.tries))
    message = F.when(F.col("_a.error").isNotNull(), F.concat(F.lit("FAIL [review unavailable: "), "_a.error", F.lit("]"))).otherwise(F.coalesce(F.nullif(F.trim("_a.text"), F.lit("")), F.lit("PASS")))
    failed = F.upper(message).contains("FAIL") & ~F.upper(message).contains("PASS")
    out = said.withColumn("valid", noted.isNull() & (F.col("_a.error").isNull() & ~failed))
    return out.withColumn("reflection", F.coalesce(noted, message)).drop("_a")


ATTEMPT = ["attempt", "candidate", "schedule", "prompt", "response", "forecast", "error", "mse", "mae", "valid", "reflection"]


def _round(state: DataFrame, spec: WindowSpec, clients: Clients, train: bool, candidates: int | None, channels: int) -> DataFrame:
    """Attempts of the frontier: one a window, or one for each of several schedules."""
    state = _planned(state, spec, clients, train)
    if candidates is None:
        state = state.withColumns({"candidate": F.lit(0), "schedule": F.col("plan")})
    else:
        schedules = workflow.candidate_schedules(F.col("plan"), F.lit(channels), candidates, train)
        state = state.select("*", F.posexplode(schedules).alias("candidate", "schedule"))
    return _judged(_forecast(state, spec, clients, train), spec, clients).select(*KEYS, *ATTEMPT)


def _start(windows: DataFrame, spec: WindowSpec, pairs, memory, train: bool, folder: str, library) -> DataFrame:
    windows = _kept(windows, f"{folder}/input")  # each tool reads it
    state = observed(windows, spec, pairs, train, library)
    if memory is not None:
        state = state.join(remembered(windows, memory), KEYS, "left")
    return _kept(state, f"{folder}/windows")


def run_windows(
    windows: DataFrame, spec: WindowSpec, clients: Clients | None = None, limits: Limits | None = None, pairs: DataFrame | None = None, memory: DataFrame | None = None, folder: str | None = None, train: bool = False,
    library: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """sid, wid, the columns of the last attempt, outputs, attempts: each window is tried until its forecast passes or attempts run out.

    windows (sid, wid, hist, and fut and stamps where known). Attempts of all rounds stay in the folder, a table a round.
    """
    clients, limits, spark = clients or Clients(), limits or Limits(), windows.sparkSession
    folder = folder or shared_folder(spark, "windows")
    state = _start(windows, spec, pairs, memory, train, folder, library)
    ended = []
    frontier = state.withColumns({"attempt": F.lit(1), "reflection": F.lit("")})
    for k in range(1, max(1, limits.attempts) + 1):
        tried = _kept(_round(frontier, spec, clients, train, None, 1), f"{folder}/attempts/{k}")
        last = k == max(1, limits.attempts)
        ended.append(tried if last else tried.where("valid"))
        failing = tried.where("NOT valid")
        if last or not failing.take(1):
            break
        frontier = state.join(failing.select(*KEYS, F.lit(k + 1).alias("attempt"), "reflection"), KEYS)
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.drop("candidate").withColumnRenamed("attempt", "attempts").join(state.select(*KEYS, "outputs"), KEYS)


def run_memory(
    windows: DataFrame, spec: WindowSpec, clients: Clients | None = None, limits: Limits | None = None, pairs: DataFrame | None = None, memory: DataFrame | None = None, folder: str | None = None, train: bool = True, channels: int = 1,
    library: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """sid, wid, the columns of the chosen attempt, outputs, attempts, excellent, save: the loop that fills the memory.

    A round tries several schedules a window and takes the valid one of least error, else the one of least error. A window
    whose choice is valid and excellent is done; at the end the best valid choice of all rounds counts, else the last one, which
    isn't saved. A candidate whose client failed is a row with its error and never valid.
    """
    clients, limits, spark = clients or Clients(), limits or Limits(attempts=3), windows.sparkSession
    folder = folder or shared_folder(spark, "memory")
    state = _start(windows, spec, pairs, memory, train, folder, library)
    frontier, rounds = state.withColumns({"attempt": F.lit(1), "reflection": F.lit("")}), []
    for k in range(1, max(1, limits.attempts) + 1):
        tried = _kept(_round(frontier, spec, clients, train, limits.candidates, channels), f"{folder}/attempts/{k}")
        best = workflow.best_candidates(tried, KEYS).select(*KEYS, "candidate")
        chosen = tried.join(best, [*KEYS, "candidate"]).withColumn("excellent", F.col("valid") & workflow.excellent(F.col("mse"), F.col("mae"), limits.mse, limits.mae))
        rounds.append(_kept(chosen, f"{folder}/chosen/{k}"))
        open_ = rounds[-1].where("NOT excellent")
        if k == max(1, limits.attempts) or not open_.take(1):
            break
        frontier = state.join(open_.select(*KEYS, F.lit(k + 1).alias("attempt"), "reflection"), KEYS)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    # The least (not valid, error of valid ones, earliest) is the best; without a valid one the latest.
    error = F.when(F.col("mse").isNull() | F.isnan("mse"), float("inf")).otherwise(F.col("mse"))
    order = F.struct((~F.col("valid")).alias("bad"), F.when(F.col("valid"), error).otherwise(0.0).alias("e"), F.when(F.col("valid"), F.col("attempt")).otherwise(-F.col("attempt")).alias("k"))
    rest = F.struct(*[c for c in out.columns if c not in KEYS])
    pick = out.groupBy(*KEYS).agg(F.min_by(rest, order).alias("r"), F.max("attempt").alias("attempts"))
    return pick.select(*KEYS, "r.*", "attempts").withColumn("save", F.col("valid")).join(state.select(*KEYS, "outputs"), KEYS)
