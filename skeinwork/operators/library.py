"""Case library: windows with their best model, clusters around evenly spaced medoids, and ensembles weighted by cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.forecasting import DEFAULTS, MODELS, forecasts, squared_error
from skeinwork.operators.similarity import BLOCK, blocked, comprehensive, top_k, traits
from skeinwork.operators.windows import KEYS, total, zscored
from skeinwork.plans.registry import WindowSpec

CLUSTERS = 6
RARE = 3


def cases(windows: DataFrame, spec: WindowSpec, models: list[str] | None = None) -> DataFrame:
    """sid, wid, hist, fut, z, best_model, mse, errors (by model) of every window, all from its own row: no join, no shuffle."""
    names = list(DEFAULTS if models is None else models)
    tried = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ord"), MODELS[n](F.col("hist"), spec).alias("yhat")) for i, n in enumerate(names)])
    scored = F.transform("_t", lambda x: F.struct(squared_error(x["yhat"], F.col("fut")).alias("mse"), x["ord"].alias("ord"), x["model"].alias("model")))
    rows = windows.where(F.size("hist") > 0).withColumn("_t", tried).withColumn("_t", F.filter("_t", lambda x: x["yhat"].isNotNull())).withColumn("_e", scored)
    best = F.array_min("_e")
    errors = F.map_from_entries(F.transform("_e", lambda x: F.struct(x["model"], x["mse"])))
    return rows.where(F.size("_e") > 0).select(*KEYS, "hist", "fut", zscored(F.col("hist")).alias("z"), best["model"].alias("best_model"), best["mse"].alias("mse"), errors.alias("errors"))


def medoids(c: DataFrame, clusters: int = CLUSTERS) -> DataFrame:
    """sid, cluster, medoid, mz: evenly spaced cases of each series, at most `clusters` (rounded half to even)."""
    n = c.groupBy("sid").agg(F.count("*").alias("n")).withColumn("k", F.least(F.col("n"), F.lit(clusters)))
    spaced = n.select("sid", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("cluster"))
    at = F.when(F.col("k") <= 1, F.lit(0)).otherwise(F.bround(F.col("cluster") * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1)), 0)).cast("long")
    spaced = spaced.select("sid", "cluster", at.alias("medoid"))
    return spaced.join(c.select("sid", F.col("wid").alias("medoid"), F.col("z").alias("mz")), ["sid", "medoid"])


def assigned(c: DataFrame, m: DataFrame) -> DataFrame:
    """c with the cluster of its nearest medoid, the lowest number on ties. A series' few medoids travel as one array a series."""
    lists = m.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("cluster", "mz"))).alias("ms"))
    far = F.transform("ms", lambda x: F.struct(F.round(total(F.zip_with(x["mz"], F.col("z"), lambda a, b: (a - b) * (a - b))), 6).alias("d"), x["cluster"].alias("cluster")))
    return c.join(lists, "sid").withColumn("cluster", F.array_min(far)["cluster"]).drop("ms")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder of spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def recentred(a: DataFrame) -> DataFrame:
    """sid, cluster, medoid, mz: of each cluster the case with the least sum of squared distances to all of its cases.

    That is the case nearest to the cluster's mean, so no pairs are formed; the lowest window on ties.
    """
    means = a.select("sid", "cluster", F.posexplode("z").alias("pos", "v")).groupBy("sid", "cluster", "pos").agg(F.avg("v").alias("v"))
    centres = means.groupBy("sid", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))
    d = F.round(total(F.zip_with("z", "mean", lambda x, y: (x - y) * (x - y))), 6)
    best = a.join(centres, ["sid", "cluster"]).groupBy("sid", "cluster").agg(F.min(F.struct(d.alias("d"), "wid")).alias("b"))
    return best.select("sid", "cluster", F.col("b.wid").alias("medoid")).join(a.select("sid", F.col("wid").alias("medoid"), F.col("z").alias("mz")), ["sid", "medoid"])


def k_medoids(c: DataFrame, clusters: int = CLUSTERS, rounds: int = 50) -> DataFrame:
    """sid, cluster, medoid, mz: medoids by alternating assignment and recentring from evenly spaced ones, until none changes.

    All series go through a round together. The sum of squared distances falls with each round, so it ends; an error says so if `rounds`
    weren't enough. A round's medoids are cut off by checkpoint(), see _cut. Clusters that lose all
    cases (equal vectors) are left out.
    """
    c = _cut(c)
    m = _cut(medoids(c, clusters))
    for _ in range(max(1, rounds)):
        new = _cut(recentred(assigned(c, m)))
        same = new.select("sid", "cluster", "medoid")
        old = m.select("sid", "cluster", "medoid")
        m = new
        if not old.join(same, ["sid", "cluster", "medoid"], "left_anti").take(1):
            return m
    raise RuntimeError(f"medoids still change after {rounds} rounds")


def cluster_weights(a: DataFrame) -> DataFrame:
    """sid, cluster, model, n, weight: counts of best models, rare ones left out where others are not, over their total."""
    n = a.groupBy("sid", "cluster", F.col("best_model").alias("model")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("sid", "cluster")
    kept = n.withColumn("top", F.max("n").over(by)).where((F.col("n") > RARE) | (F.col("top") <= RARE))
    return kept.select("sid", "cluster", "model", "n", (F.col("n") / F.sum("n").over(by)).alias("weight"))


def nearest_cluster(windows: DataFrame, m: DataFrame) -> DataFrame:
    """sid, wid, cluster, sim: the cluster whose medoid is most similar to a window's history, the lowest number on ties."""
    lists = m.select("sid", "cluster", traits(F.col("mz")).alias("t")).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("cluster", "t"))).alias("ms"))
    q = windows.select(*KEYS, traits(F.col("hist")).alias("q")).join(lists, "sid").select(*KEYS, "q", F.explode("ms").alias("x"))
    sims = q.select(*KEYS, F.col("x.cluster").alias("cluster"), F.round(comprehensive(F.col("q"), F.col("x.t")), 9).alias("sim"))
    best = sims.groupBy(*KEYS).agg(F.min(F.struct((-F.col("sim")).alias("s"), "cluster")).alias("b"))
    return best.select(*KEYS, F.col("b.cluster").alias("cluster"), (-F.col("b.s")).alias("sim"))


def built(windows: DataFrame, spec: WindowSpec, folder: str, models: list[str] | None = None, recentre: bool = False) -> dict[str, DataFrame]:
    """The library's tables, each written below a folder and read from there: cases, medoids, weights, and what is kept of them for others.

    case_base (window, best model), case_neighbor (history and what followed), cluster_base (medoid, counts of best models, their total),
    cases_stats (cases by best model). recentre: medoids by k_medoids() instead of evenly spaced ones.
    """
    spark = windows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    c = kept(cases(windows, spec, models), "cases")
    m = kept(k_medoids(c) if recentre else medoids(c), "medoids")
    a = kept(assigned(c.select("sid", "wid", "z", "best_model"), m).drop("z"), "assigned")
    w = kept(cluster_weights(a), "weights")
    members = a.groupBy("sid", "cluster").agg(F.count("*").alias("size"))
    votes = w.groupBy("sid", "cluster").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("best_model"), F.sum("n").alias("total_weight"))
    return {
        "cases": c, "medoids": m, "weights": w, "assigned": a,
        "case_base": kept(c.select(*KEYS, F.col("z").alias("window"), "best_model"), "case_base"),
        "case_neighbor": kept(c.select(*KEYS, F.col("hist").alias("look_back_window"), F.col("fut").alias("pred_window")), "case_neighbor"),
        "cluster_base": kept(m.join(votes, ["sid", "cluster"]).join(members, ["sid", "cluster"]).select("sid", "cluster", "medoid", F.col("mz").alias("window"), "best_model", "total_weight", "size"), "cluster_base"),
        "cases_stats": kept(c.groupBy("sid", "best_model").agg(F.count("*").alias("cases")), "cases_stats"),
    }


def anchored(windows: DataFrame, spec: WindowSpec, tables: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """The model tool by a library: sid, wid, reference_prediction, component_forecasts, weights, best_model (votes), selected_cluster, anchor_cases, forecast_length and source.

    Models that won in the cluster of a window's nearest medoid are weighted by their votes. Windows are joined to their series'
    few medoids and votes, nothing larger; the similar cases are searched in blocks.
    """
    from skeinwork.operators.workflow import SOURCES

    votes = tables["weights"].groupBy("sid", "cluster").agg(F.array_sort(F.collect_list(F.struct("model", "n", "weight"))).alias("v"))
    q = windows.select(*KEYS, "hist").join(nearest_cluster(windows, tables["medoids"]), KEYS).join(votes, ["sid", "cluster"])
    names = [n for n in MODELS if n in DEFAULTS] + [n for n in MODELS if n not in DEFAULTS]
    voted = {r.model for r in tables["weights"].select("model").distinct().collect()}  # at most one row a model
    used = [n for n in names if n in voted]
    part = lambda n: F.struct(F.lit(n).alias("model"), F.when(F.exists("v", lambda x: x["model"] == n), MODELS[n](F.col("hist"), spec)).alias("yhat"))
    rows = q.withColumn("f", F.filter(F.array(*[part(n) for n in used]), lambda x: x["yhat"].isNotNull())).withColumn("f", F.transform("f", lambda x: F.struct(
        x["model"].alias("model"), x["yhat"].alias("yhat"), F.get(F.filter("v", lambda y: y["model"] == x["model"]), F.lit(0))["weight"].alias("w"))))
    place = F.sequence(F.lit(0), F.lit(spec.horizon - 1))
    mixed = F.transform(place, lambda h: F.round(total(F.transform("f", lambda x: x["w"] * F.get(x["yhat"], h))), 6))
    six = lambda a: F.transform(a, lambda y: F.round(y, 6))
    out = rows.select(
        *KEYS, mixed.alias("reference_prediction"), F.map_from_entries(F.transform("f", lambda x: F.struct(x["model"], six(x["yhat"])))).alias("component_forecasts"),
        F.map_from_entries(F.transform("f", lambda x: F.struct(x["model"], F.round(x["w"], 6)))).alias("weights"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["model"], x["n"]))).alias("best_model"),
        F.col("cluster").alias("selected_cluster"), F.lit(spec.horizon).alias("forecast_length"), F.lit(SOURCES[0]).alias("source"),
    )
    near = similar_cases(windows.select(*KEYS, "hist"), tables["cases"].select(*KEYS, "hist"), k).join(tables["cases"].select("sid", F.col("wid").alias("item"), "best_model", "errors"), ["sid", "item"])
    found = near.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item").alias("case_id"), F.round("sim", 6).alias("similarity"), "best_model"))).alias("anchor_cases"))
    return out.join(found, KEYS, "left")


def library_ensemble(windows: DataFrame, spec: WindowSpec, folder: str | None = None) -> DataFrame:
    """sid, wid, step, yhat: forecasts of the models that won in a window's cluster, by their weights there.

    Windows are made once; cases, medoids and weights are written to a folder, by default a fresh one of the shared kind.
    """
    from skeinwork.operators.loops import shared_folder

    tables = built(windows, spec, folder or shared_folder(windows.sparkSession, "library"))
    w = tables["cases"].select(*KEYS, "hist")
    chosen = nearest_cluster(w, tables["medoids"]).join(tables["weights"], ["sid", "cluster"]).select(*KEYS, "model", "weight")
    rows = forecasts(w, spec).join(chosen, [*KEYS, "model"]).select(*KEYS, "weight", F.posexplode("yhat").alias("step", "v"))
    return rows.groupBy(*KEYS, "step").agg(F.sum(F.col("weight") * F.col("v")).alias("yhat"))


def similar_cases(queries: DataFrame, c: DataFrame, k: int = 3) -> DataFrame:
    """sid, wid, item, sim, rank: the k cases of the same series that are most similar to each of a stated set of windows."""
    n = queries.groupBy("sid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    q = queries.join(n, "sid").select("sid", F.col("wid").alias("id"), F.struct("wid", traits(F.col("hist")).alias("t")).alias("q"), "n")
    e = c.join(n, "sid").select("sid", F.col("wid").alias("id"), F.struct(F.col("wid").alias("item"), traits(F.col("hist")).alias("t")).alias("e"), "n")
    pairs = blocked(q, e).select("sid", "q.wid", F.concat_ws("/", "sid", "q.wid").alias("query"), "e.item", F.round(comprehensive(F.col("q.t"), F.col("e.t")), 9).alias("sim"))
    return top_k(pairs, "query", "item", max(1, k)).drop("query")
