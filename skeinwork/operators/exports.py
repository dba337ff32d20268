"""Training-data preparation from run tables, resumable runs, and batch inference through a given client."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import texts
from skeinwork.functions.answers import forecast_map, paired

# Columns that may hold a response, in order of preference, and columns that reinforcement data keep.
RESPONSES = ("response", "full_answer", "answer_teacher", "full_response", "answer_local_llm", "answer")
RL_KEEP = ("idx", "prompt", "response", "ground_truth", "answer", "tool", "dataset_name", "baseline_forecast")


def filled(c: Column) -> Column:
    """The text, null where it is blank."""
    return F.nullif(F.trim(c), F.lit(""))


def _response(df: DataFrame) -> Column:
    found = [c for c in RESPONSES if c in df.columns]
    if not found:
        raise ValueError(f"one of {', '.join(RESPONSES)} is needed")
    return F.col(found[0])


def prepare_sft(df: DataFrame) -> DataFrame:
    """prompt and response of rows that have both; an error if there are none."""
    out = df.select(F.col("prompt"), _response(df).alias("response")).where(filled(F.col("prompt")).isNotNull() & filled(F.col("response")).isNotNull())
    if not out.take(1):
        raise ValueError("no row has both a prompt and a response")
    return out


def chat(df: DataFrame) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(F.array(message("user", "prompt"), message("assistant", "response")).alias("messages"))


def prepare_rl(df: DataFrame, dataset: str, source: str = "forecast", ability: str = "time_series_forecasting", reward: str = "rule") -> DataFrame:
    """Kept columns and constants of rows with a prompt and a ground truth.

    A blank ground truth is that of column response, where there is one; empty dataset names are replaced; tool is empty and
    idx the place in the order of prompts where they are missing. The three constants name the trainer's own parts, so they
    are parameters.
    """
    if "prompt" not in df.columns:
        raise ValueError(f"a prompt column is needed, found {', '.join(df.columns)}")
    has = set(df.columns)
    own = F.col("ground_truth") if "ground_truth" in has else F.lit("")
    other = F.col("response") if "response" in has else own
    out = df.withColumn("ground_truth", F.when(filled(own).isNull(), other).otherwise(own))
    name = F.col("dataset_name") if "dataset_name" in has else F.lit("")
    out = out.withColumn("dataset_name", F.when(F.coalesce(name, F.lit("")) == "", F.lit(dataset)).otherwise(name))
    if "tool" not in has:
        out = out.withColumn("tool", F.lit(""))
    if "idx" not in has:
        out = numbered(out, "prompt")
    out = out.where(filled(F.col("prompt")).isNotNull() & filled(F.col("ground_truth")).isNotNull())
    return out.select(*[c for c in RL_KEEP if c in out.columns], F.lit(source).alias("data_source"), F.lit(ability).alias("ability"), F.lit(reward).alias("reward_model"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with idx from 0 by the order of some columns: ranges are sorted apart, then shifted by the sizes of those before."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    spread = spread.withColumn("_p", F.shiftright("_i", 33))
    sizes = spread.groupBy("_p").count()  # a row a partition
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
    return spread.join(F.broadcast(before), "_p").withColumn("idx", F.col("_b") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_i", "_p", "_b")


def ordered_export(df: DataFrame) -> DataFrame:
    """Rows by dataset, then by numeric idx (other values as 0)."""
    return df.orderBy("dataset_name", F.when(F.col("idx").cast("string").rlike("^[0-9]+$"), F.col("idx").cast("string").try_cast("long")).otherwise(0))


def pending(rows: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose key hasn't been completed yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def scored_by(answer: Column, truth: Column) -> Column:
    """Whether an answer can be scored against a ground truth: both are there and share a value."""
    there = filled(answer).isNotNull() & filled(truth).isNotNull()
    return F.coalesce(there & (F.size(paired(forecast_map(answer), forecast_map(truth))) > 0), F.lit(False))


def valid_answers(done: DataFrame, truth: DataFrame | None = None, key: str = "idx") -> DataFrame:
    """Earlier answers that count: not blank or nan, with a whole number as key, and where a ground truth is known (their own, else that of the same key) scored by it.

    Rows whose key the other table doesn't have keep an unknown truth and don't count, if there is such a table.
    """
    own = "ground_truth" in done.columns
    if not own and truth is not None and "ground_truth" in truth.columns:
        done = done.join(truth.select(key, "ground_truth").dropDuplicates([key]), key, "left")
        own = True
    said = filled(F.col("answer")).isNotNull() & (F.lower(F.trim("answer")) != "nan") & F.col(key).cast("string").try_cast("long").isNotNull()
    return done.where(said & scored_by(F.col("answer"), F.col("ground_truth")) if own else said)


def inferred(rows: DataFrame, client: Callable[[str], str], attempts: int = 3, workers: int | None = None, timeout: float | None = None) -> DataFrame:
    """rows (idx, prompt, and ground_truth where there is one) with the client's full_response, reasoning and answer, success, error, attempt and elapsed seconds.

    The client runs inside tasks, each call in a thread of its own that is given up after `timeout` seconds. Where a truth is known an answer that can't be
    scored is tried again, and kept with that error after the last attempt. A row whose attempts all raise keeps the last error.
    """
    truth = F.col("ground_truth") if "ground_truth" in rows.columns else F.lit(None).cast("string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for idx, prompt, known, values in part.itertuples(index=False):
                began, text, error, k = time.time(), None, None, 0
                for k in range(1, attempts + 1):
                    began = time.time()
                    try:
                        text, error = called(client, prompt, timeout), None
                    except Exception as e:  # any failure of a remote model is data here
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if known is None or values > 0 and numbered_answer(text or ""):
                        break
                    error = UNSCORED
                out.append((idx, text, error, k, time.time() - began, known))
            yield pd.DataFrame(out, columns=["idx", "full_response", "error", "attempt", "elapsed", "ground_truth"])

    dealt = rows.select(F.col("idx").cast("long").alias("idx"), "prompt", truth.alias("ground_truth"), F.size(forecast_map(truth)).alias("values"))
    dealt = dealt.repartition(workers) if workers else dealt
    got = dealt.mapInPandas(run, "idx long, full_response string, error string, attempt int, elapsed double, ground_truth string")
    whole = F.coalesce("full_response", F.lit(""))
    got = got.withColumn("reasoning", texts.reasoning(whole)).withColumn("answer", texts.extracted_answer(whole))
    good = F.col("ground_truth").isNull() | scored_by(F.col("answer"), F.col("ground_truth"))
    got = got.withColumn("error", F.coalesce("error", F.when(~good, UNSCORED)))
    return got.select("idx", "full_response", F.col("error").isNull().alias("success"), "error", "attempt", "elapsed", "reasoning", "answer")


UNSCORED = "the answer can't be scored against the ground truth"


def called(client: Callable[[str], str], prompt: str, timeout: float | None):
    """The client's answer; TimeoutError if it takes longer, the thread is left to end by itself."""
    if timeout is None:
        return client(prompt)
    box: list = []

    def call() -> None:
        try:
            box.append((client(prompt), None))
        except Exception as e:
            box.append((None, e))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    thread.join(timeout)
    if not box:
        raise TimeoutError(f"no answer within {timeout} seconds")
    text, error = box[0]
    if error is not None:
        raise error
    return text


def numbered_answer(text: str) -> bool:
    """Whether a response has an answer, tagged, fenced or as an object, with a number in it: the check between tries, in the task."""
    tagged = re.search(r"<answer>(.*?)</answer>", text, re.S | re.I) or re.search(r"```(?:json)?\s*(.*?)```", text, re.S) or re.search(r"({.*})", text, re.S)
    return bool(tagged and re.search(r"\d", tagged[1]))


def teacher_rows(rows: DataFrame, client: Callable[[str], str], **how) -> DataFrame:
    """rows with the client's full response as `response`, for supervised training; those without one are left out. `how` goes to inferred()."""
    got = inferred(rows, client, **how).where(filled(F.col("full_response")).isNotNull())
    return rows.drop("response").join(got.select("idx", F.col("full_response").alias("response")), "idx")


def resumed(rows: DataFrame, done: DataFrame, client: Callable[[str], str], **how) -> DataFrame:
    """rows with an answer each: earlier ones that count as they are (attempt 0), the others from the client."""
    kept = valid_answers(done, rows).select(F.col("idx").cast("long").alias("idx"), "answer").dropDuplicates(["idx"])
    old = kept.select("idx", F.lit("").alias("full_response"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempt"), F.lit(0.0).alias("elapsed"), F.lit("").alias("reasoning"), "answer")
    own = rows.withColumn("idx", F.col("idx").cast("long"))
    new = inferred(own.join(kept, "idx", "left_anti"), client, **how)
    return own.drop("full_response", "success", "error", "attempt", "elapsed", "reasoning", "answer").join(old.unionByName(new), "idx", "left")
