"""Tables of prompts, answers and forecasts: checked scans, and writers with fixed columns.

Writers go through Spark's committer, so a file is there as a whole or not at all; run them by part to resume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import answers, texts
from skeinwork.operators.exports import numbered
from skeinwork.plans.registry import WindowSpec

# Columns of the tables, and parts of a path that name a dataset, the first that occurs.
SFT_COLUMNS = ("idx", "dataset_name", "input", "ground_truth", "tool", "prompt", "response", "reasoning", "answer")
WINDOW_COLUMNS = ("idx", "model_name", "answer", "ground_truth", "prompt", "full_answer", "mse", "mae", "tools", "reflection")
PATH_NAMES = (
    ("windy", "windy"), ("wind", "windy"), ("sunny", "sunny"), ("solar", "sunny"), ("mopex", "MOPEX"), ("etth1", "ETTh1"), ("ettm1", "ETTm1"),
    ("pjm", "PJM"), ("np", "NP"), ("be", "BE"), ("de", "DE"), ("fr", "FR"),
)


def needed(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {', '.join(missing)} are missing; found {', '.join(df.columns)}")
    return df


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; an empty field is an empty text, not null. Quoted line ends are kept."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.na.fill("")


def prompt_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a prompt; idx by the order of prompts where there is none."""
    df = needed(text_table(spark, path), "prompt")
    return df if "idx" in df.columns else numbered(df, "prompt")


def evaluation_rows(spark: SparkSession, path: str, answer: str = "answer", truth: str = "ground_truth") -> DataFrame:
    return needed(text_table(spark, path), answer, truth)


def dataset_in(path: Column, default: str = "") -> Column:
    """The dataset that a path names, for rewards."""
    low = F.lower(path)
    found = F.when(F.lit(False), "")
    for part, name in PATH_NAMES:
        found = found.when(low.contains(part), name)
    return found.otherwise(default)


def rl_rows(spark: SparkSession, path: str) -> DataFrame:
    """Reinforcement rows: prompt and ground truth are needed, dataset_name and tool are filled in, extra_info becomes a map with an index.

    An index that is missing is the row's place in the table: files in order of their paths, rows as they lie in them.
    """
    df = needed(spark.read.parquet(path), "prompt", "ground_truth")
    if not df.take(1):
        raise ValueError(f"no rows in {path}")
    if "extra_info" in df.columns:
        df = placed(df)
    if "dataset_name" not in df.columns:
        df = df.withColumn("dataset_name", dataset_in(F.lit(path)))
    if "tool" not in df.columns:
        df = df.withColumn("tool", F.lit(""))
    if "extra_info" in df.columns:
        text = F.col("extra_info") if dict(df.dtypes)["extra_info"] == "string" else F.to_json("extra_info")
        df = df.withColumn("_info", F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))  # parsed once
        info = F.col("_info")
        index = F.coalesce(F.try_element_at(info, F.lit("index")), F.try_element_at(info, F.lit("idx")), F.col("_place").cast("string"))
        df = df.withColumn("extra_info", F.map_concat(F.map_filter(info, lambda k, v: k != "index"), F.create_map(F.lit("index"), index))).drop("_info", "_place")
    return df


def placed(scan: DataFrame) -> DataFrame:
    """A Parquet scan with _place, the row's number from 0 over all files in order of their paths; only rows a file are counted ahead.

    The counts, a row a file, are broadcast: a join by shuffle would put a whole file into one task.
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    sizes = rows.groupBy("_f").agg(F.count("*").alias("_n"))
    before = sizes.select("_f", (F.sum("_n").over(Window.orderBy("_f")) - F.col("_n")).alias("_o"))  # a row a file
    return rows.join(F.broadcast(before), "_f").withColumn("_place", F.col("_o") + F.col("_i")).drop("_f", "_i", "_o")


PROMPT_COLUMNS = ("idx", "input", "ground_truth", "tool", "prompt", "target_col", "lookback", "horizon")


def prompts_of(windows: DataFrame, target: str, lookback: int, horizon: int) -> DataFrame:
    """Prompt rows of windows (sid, wid, hist, fut, stamps, fut_stamps): idx, the series and its future as JSON, an empty tool, the prompt, and the window's shape."""
    series = texts.series_json(F.col("stamps"), F.col("hist"))
    prompt = texts.forecasting_prompt(target, series, horizon, texts.frequency_text(F.col("stamps")))
    return windows.select(
        F.col("wid").alias("idx"), series.alias("input"), texts.series_json(F.col("fut_stamps"), F.col("fut")).alias("ground_truth"), F.lit("").alias("tool"), prompt.alias("prompt"),
        F.lit(target).alias("target_col"), F.lit(lookback).alias("lookback"), F.lit(horizon).alias("horizon"),
    )


def forecast_rows(ran: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of a window-forecast table from loops.run_windows() and its windows (with fut, stamps and fut_stamps where known), ready for window_rows()."""
    stamped = "fut_stamps" in windows.columns
    keys = F.col("fut_stamps") if stamped else F.transform("fut", lambda x, i: i.cast("string"))
    truth = windows.select("sid", "wid", texts.series_json(keys, F.col("fut")).alias("ground_truth"))
    best = F.from_json(F.get_json_object(F.try_element_at("outputs", F.lit("model_auxiliary_tool")), "$.best_model"), "map<string,double>")
    return ran.join(truth, ["sid", "wid"]).select(
        "sid", F.col("wid").alias("idx"), F.coalesce(F.array_join(F.array_sort(F.map_keys(best)), ","), F.lit("")).alias("model_name"), answers.first_answer(F.coalesce("response", F.lit(""))).alias("answer"), "ground_truth",
        "prompt", F.col("response").alias("full_answer"), "mse", "mae", F.to_json("schedule").alias("tools"), "reflection",
    )


def forecast_csv(spark: SparkSession, path: str | list[str], out: str, spec: WindowSpec, latest: bool = False, target: str | None = None, time: str | None = None, cap: int | None = None, **how) -> DataFrame:
    """Forecast a CSV or Parquet series and write the result as CSV: a row a window with its metrics, or the steps after the last row.

    The steps are written if asked for, or where the series has no whole window; their time_stamp goes on at the commonest distance of the stamps. `how`
    goes to loops.run_windows(). Returns what was written.
    """
    from skeinwork.operators import features, loops
    from skeinwork.operators import windows as w
    from skeinwork.sources import series

    rows = series.load_series(spark, path, target=target, time=time)
    found = None if latest else w.sliding(rows, spec, cap, stamps=True)
    if found is not None and found.take(1):
        table = window_rows(forecast_rows(loops.run_windows(found, spec, **how), found))
    else:
        last = w.latest(rows, spec.lookback, stamps=True).withColumn("wid", F.lit(0).cast("long"))
        if not last.take(1):
            raise ValueError(f"the series is shorter than {spec.lookback} rows")
        ran = loops.run_windows(last, spec, **how).select("sid", "forecast")
        dated = rows.where("ts IS NOT NULL")
        step = features.frequency(dated.withColumn("ts", F.col("ts").cast("timestamp"))).select("sid", "seconds")
        end = dated.groupBy("sid").agg(F.max("ts").cast("timestamp").alias("last"))
        known = ran.join(step, "sid", "left").join(end, "sid", "left").withColumn("first", F.timestamp_seconds(F.unix_timestamp("last") + F.col("seconds")))
        table = forecast_steps(known, [], "first", "seconds") if known.where("first IS NOT NULL").take(1) else forecast_steps(known, [])
    write_csv(table, out)
    return table


def forecast_steps(forecasts: DataFrame, keys: list[str], start: str | None = None, seconds: str | None = None) -> DataFrame:
    """keys, step from 1, forecast of rows with an array `forecast`; time_stamp too, given the first stamp and the seconds between."""
    rows = forecasts.select(*keys, *[c for c in (start, seconds) if c], F.posexplode("forecast").alias("_k", "value"))
    stamp = [F.timestamp_seconds(F.unix_timestamp(start) + F.col("_k") * F.col(seconds)).alias("time_stamp")] if start and seconds else []
    return rows.select(*keys, *stamp, (F.col("_k") + 1).alias("step"), F.col("value").alias("forecast"))


def window_rows(df: DataFrame) -> DataFrame:
    """The columns of a window-forecast table, in order; missing ones are empty."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in WINDOW_COLUMNS])


def sft_rows(entries: DataFrame) -> DataFrame:
    """Training rows of memory entries: the response with its reasoning and answer apart, tool calls as JSON."""
    response = F.coalesce("Forecasting_answer", F.lit(""))
    return entries.select(
        "idx", F.coalesce("dataset_name", F.lit("")).alias("dataset_name"), F.coalesce("input_json", F.lit("")).alias("input"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"),
        F.coalesce(F.to_json("tool_calls"), F.lit("[]")).alias("tool"), F.coalesce("forecast_full_prompt", F.lit("")).alias("prompt"), response.alias("response"),
        texts.reasoning(response).alias("reasoning"), texts.tagged_answer(response).alias("answer"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Any of these tables as CSV with a header; texts are quoted and quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")


def write_rollouts(df: DataFrame, path: str, folders: bool = False) -> None:
    """Rollouts (idx, rollout_id, prompt, answer, ground_truth, reward, mse) as JSON lines, each with its task, in order of task and rollout; what isn't finite is null.

    A file holds a range of tasks, and a task with many rollouts goes on in the next one, so the number of files doesn't grow with
    prompts. With folders, a folder a prompt instead (task=prompt_0), for few prompts: each is a file at least, which 90,000 prompts make too slow.
    """
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c)
    rows = df.select(F.concat(F.lit("prompt_"), F.col("idx").cast("string")).alias("task"), F.regexp_replace("rollout_id", "^ro-", "").alias("rollout_id"), "prompt", "answer", "ground_truth", finite("reward"), finite("mse"))
    order = ["task", "rollout_id"]
    writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append")
    (writer.partitionBy("task") if folders else writer).json(path)


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """Means of metric columns and counts as one JSON text, as a command prints it."""
    return df.agg(F.to_json(F.struct(F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in columns])).alias("summary"))
