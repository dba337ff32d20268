"""Memory of past forecasts: entries as a table by dataset and window, resumed, appended and searched; and the case library on disk."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import texts
from skeinwork.functions.answers import forecast_map
from skeinwork.operators import library, similarity
from skeinwork.operators.windows import KEYS, zscored

ENTRY = (
    "idx long, dataset_name string, input_json string, ground_truth string, tool_calls array<struct<tool_name:string,output:string>>, tool_outputs map<string,string>, "
    "forecast_full_prompt string, Forecasting_answer string, model_name string, metrics map<string,double>, vector array<float>"
)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list, or of the list `entries` of a JSON object; a missing vector is made from the input series."""
    raw = spark.read.schema(f"{ENTRY}, entries array<struct<{_fields()}>>").json(path, multiLine=True)
    lists = F.coalesce("entries", F.array(F.struct(*[F.col(c) for c in _names()])))
    e = raw.select(F.explode(lists).alias("e")).select("e.*")
    return with_vectors(e)


def _names() -> list[str]:
    return [x.split()[0] for x in _split(ENTRY)]


def _split(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:k].strip())
            last = k + 1
    return [*out, schema[last:].strip()]


def _fields() -> str:
    return ",".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in _split(ENTRY))


def with_vectors(entries: DataFrame) -> DataFrame:
    """Entries with their vector; those without one get that of the values of input_json in the order of their keys."""
    series = F.map_entries(forecast_map(F.col("input_json")))
    values = F.transform(F.array_sort(series), lambda x: x["value"])
    return entries.withColumn("vector", F.coalesce("vector", F.when(F.size(values) > 0, similarity.embedding(values))))


STATE = "batch string, entries long"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """batch, entries of every commit that was completed; no rows for a new folder."""
    try:
        return spark.read.schema(STATE).parquet(f"{folder}/state/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The memory kept in a folder by append(): entries of completed commits only."""
    batches = [r.batch for r in committed(spark, folder).where("entries > 0").select("batch").collect()]  # a row a commit
    if not batches:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(*[f"{folder}/entries/{b}" for b in sorted(batches)])


def window_number() -> Column:
    """The window that an entry is of: window_idx of its metrics, else its idx."""
    return F.coalesce(F.try_element_at("metrics", F.lit("window_idx")).cast("long"), F.col("idx"))


def append(entries: DataFrame, folder: str, batch: str) -> int:
    """Commit a named batch of entries, of any number of datasets, to the memory in a folder; the number of entries added.

    A batch is committed once: doing so again adds nothing. Entries whose window of their dataset is in the memory already are
    left out, and of several entries of a window the one of least idx and error stays, so batches cut in another way add
    nothing twice either. The entries are written first, the batch's state last: what a job left that died between is not read, and is
    written again. One writer at a time.
    """
    spark = entries.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits and _ . -, not {batch!r}")
    if committed(spark, folder).where(F.col("batch") == batch).take(1):
        return 0
    key = [F.coalesce("dataset_name", F.lit("")), window_number()]
    new = entries.select(*[F.col(c) for c in _names()], key[0].alias("_d"), key[1].alias("_w"))
    known = read(spark, folder).select(key[0].alias("_d"), key[1].alias("_w")).where("_w IS NOT NULL")
    new = new.join(known, ["_d", "_w"], "left_anti")
    row = F.struct(*[F.col(c) for c in _names()])
    numbered = new.where("_w IS NOT NULL").groupBy("_d", "_w").agg(F.min_by(row, F.struct(F.coalesce(F.try_element_at("metrics", F.lit("mse")), F.lit(float("inf"))).alias("e"), F.col("idx"), F.xxhash64(F.to_json(row)))).alias("r")).select("r.*")
    loose = new.where("_w IS NULL").select(*_names())
    path = f"{folder}/entries/{batch}"
    numbered.unionByName(loose).write.mode("overwrite").parquet(path)
    n = spark.read.schema(ENTRY).parquet(path).count()
    spark.createDataFrame([(batch, n)], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/{batch}")
    return n


def build(windows: DataFrame, spec, folder: str, batches: int = 1, name: str = "windows", **how) -> int:
    """Fill the memory in a folder from windows by loops.run_memory(); the number of entries added.

    Windows are dealt to batches by hash; each batch is one run and one commit, so a killed build goes on with the first batch
    that isn't committed, and a finished one adds nothing when run again. Windows that the memory has are not run. Windows that
    ended without a valid forecast aren't kept, nor tried again under the same name. `how` goes to run_memory(); its memory is what is committed so far.
    """
    from skeinwork.operators import loops

    spark, added = windows.sparkSession, 0
    done = {r.batch for r in committed(spark, folder).select("batch").collect()}
    for b in range(batches):
        batch = f"{name}-{b}-of-{batches}"
        if batch in done:
            continue
        known = read(spark, folder)
        own = pending(windows.where(F.pmod(F.xxhash64(*KEYS), F.lit(batches)) == b), known)
        ran = loops.run_memory(own, spec, memory=known if known.take(1) else None, **how)
        chosen = ran.where("save").join(windows, KEYS)
        added += append(accepted(chosen), folder, batch)
    return added


def pending(windows: DataFrame, entries: DataFrame, dataset: str = "sid", window: str = "wid") -> DataFrame:
    """Windows without an entry of their dataset, or of a blank one, that has their number."""
    done = entries.select(F.coalesce("dataset_name", F.lit("")).alias("_d"), window_number().alias("_w")).where("_w IS NOT NULL").distinct()
    named, blank = done.where("_d <> ''"), done.where("_d = ''").select("_w")
    out = windows.join(named, (F.col(dataset) == F.col("_d")) & (F.col(window) == F.col("_w")), "left_anti")
    return out.join(blank, F.col(window) == F.col("_w"), "left_anti")


def sizes(entries: DataFrame) -> DataFrame:
    """Entries a dataset, and the names of the models in them, sorted."""
    models = F.array_sort(F.collect_set(F.nullif("model_name", F.lit(""))))
    return entries.groupBy(F.coalesce("dataset_name", F.lit("")).alias("dataset_name")).agg(F.count("*").alias("entries"), models.alias("models"))


def retrieved(queries: DataFrame, entries: DataFrame, k: int = 3, least: float = 0.8) -> DataFrame:
    """query, item, sim, rank: the k entries most similar to each query (query, v), at least `least`."""
    return similarity.nearest_pruned(queries, entries.select(F.col("idx").alias("item"), F.col("vector").alias("u")), k, least)


def accepted(rows: DataFrame) -> DataFrame:
    """Entries of the chosen attempts of windows: (sid, wid, hist, fut, schedule, outputs, prompt, response, mse, mae), stamps and fut_stamps where known."""
    from skeinwork.operators.workflow import older_calls

    place = lambda c: F.transform(c, lambda x, i: i.cast("string"))
    keys = (F.col("stamps"), F.col("fut_stamps")) if "stamps" in rows.columns else (place("hist"), place("fut"))
    run = F.map_filter("outputs", lambda k, v: F.array_contains("schedule", k))
    models = F.from_json(F.get_json_object(F.try_element_at("outputs", F.lit("model_auxiliary_tool")), "$.best_model"), "map<string,double>")
    return rows.select(
        F.col("wid").cast("long").alias("idx"), F.col("sid").cast("string").alias("dataset_name"), texts.series_json(keys[0], F.col("hist")).alias("input_json"),
        texts.series_json(keys[1], F.col("fut")).alias("ground_truth"), older_calls(F.col("schedule"), run).alias("tool_calls"), run.alias("tool_outputs"),
        F.col("prompt").alias("forecast_full_prompt"), F.col("response").alias("Forecasting_answer"), F.coalesce(F.array_join(F.array_sort(F.map_keys(models)), ","), F.lit("")).alias("model_name"),
        F.create_map(F.lit("mse"), "mse", F.lit("mae"), "mae", F.lit("window_idx"), F.col("wid").cast("double")).alias("metrics"), similarity.embedding(F.col("hist")).alias("vector"),
    )


def save_library(windows: DataFrame, spec, folder: str, series: DataFrame | None = None, **how) -> None:
    """The case library of all series, each of its tables in the folder, so that forecasts read them instead of building them; with series (sid, ts, pos, y) their statistics too."""
    from skeinwork.operators import features

    library.built(windows, spec, folder, **how)
    if series is not None:
        features.series_statistics(series).write.mode("overwrite").parquet(f"{folder}/series")


#: Libraries that were opened, by session, folder and the time of its last commit: a library that was written again is read again.
_OPENED: dict[tuple, dict[str, DataFrame]] = {}


def opened(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """load_library() once a session and version of the folder; plans are kept, not rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/weights")
    stamp = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, folder, stamp)
    if key not in _OPENED:
        _OPENED[key] = load_library(spark, folder)
    return _OPENED[key]


def load_library(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """cases, medoids and weights; a case without its scaled window gets it from its history."""
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in ("cases", "medoids", "weights")}
    c = out["cases"]
    z = zscored(F.col("hist"))
    out["cases"] = c.withColumn("z", F.coalesce("z", z) if "z" in c.columns else z)
    return out


def library_forecast(windows: DataFrame, spec, tables: dict[str, DataFrame]) -> DataFrame:
    """sid, wid, step, yhat of windows by a saved library."""
    from skeinwork.operators.forecasting import forecasts

    chosen = library.nearest_cluster(windows, tables["medoids"]).join(tables["weights"], ["sid", "cluster"]).select(*KEYS, "model", "weight")
    rows = forecasts(windows, spec).join(chosen, [*KEYS, "model"]).select(*KEYS, "weight", F.posexplode("yhat").alias("step", "v"))
    return rows.groupBy(*KEYS, "step").agg(F.sum(F.col("weight") * F.col("v")).alias("yhat"))
