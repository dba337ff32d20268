"""Loops with remote models, model pools, memory commits, autocorrelation, sources and the stream, on small made-up tables."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork import queries
from skeinwork.functions import answers, surface
from skeinwork.operators import exports, features, forecasting, library, loops, memory, similarity, spectrum, windows, workflow
from skeinwork.plans import registry
from skeinwork.plans.registry import WindowSpec
from skeinwork.sources import series, tables
from skeinwork.streaming import latest

SPEC = WindowSpec(24, 4, 4, 4)


def made(spark, n=60, sids=("a", "b")):
    rows = [(s, k, float(10 + k % 4 + 3 * np.sin(k / (2 + i)))) for i, s in enumerate(sids) for k in range(n)]
    return windows.sliding(spark.createDataFrame(rows, "sid string, pos long, y double"), SPEC)


@pytest.fixture(scope="module")
def w(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("w") / "w")
    made(spark).write.parquet(path)
    return spark.read.parquet(path)


def test_act_with_many_names(spark, w):
    names = ["trend_analysis_tool", *[f"odd{k}" for k in range(100)], workflow.TRAIN_ONLY]
    few = w.where("wid < 2")
    got = workflow.act(few, few.select("sid", "wid", workflow.names(names).alias("schedule")), SPEC).collect()
    assert len(got) == 4
    for r in got:
        assert "slope" in json.loads(r.tools["trend_analysis_tool"]) and sum("unknown" in v for v in r.tools.values()) == 100
        assert json.loads(r.tools[workflow.TRAIN_ONLY]) == {"skipped": True, "reason": "train_only_tool_disabled"}


def test_model_tool(spark, w):
    few = w.where("wid < 2")
    got = workflow.act(few, few.select("sid", "wid", workflow.names(["model_auxiliary_tool", "basic_statistics_tool"]).alias("schedule")), SPEC).collect()
    for r, x in zip(sorted(got), sorted(few.collect())):
        t = json.loads(r.tools["model_auxiliary_tool"])
        assert set(t["component_forecasts"]) == {"SeasonalNaive", "HistoricAverage", "ZeroModel"} and sum(t["weights"].values()) == pytest.approx(1, abs=1e-5)
        mean = sum(x.hist) / 24
        assert t["reference_prediction"] == pytest.approx([(x.hist[20 + h] + mean) / 3 for h in range(4)], abs=1e-5) and t["source"] == "deterministic_fallback"
        assert "spectral_entropy" in json.loads(r.tools["basic_statistics_tool"])


def test_facts_are_those_of_the_tools(spark, w):
    facts = {(r.sid, r.wid): r.x for r in w.select("sid", "wid", features.array_facts(F.col("hist")).alias("x")).collect()}
    for r in features.changepoints(w).join(features.events(w), ["sid", "wid"]).join(features.trend(w), ["sid", "wid"]).collect():
        x = facts[r.sid, r.wid]
        assert x.pattern == r.dominant_pattern and x.momentum == pytest.approx(r.recent_momentum, abs=1e-6) and x.slope == pytest.approx(r.slope, abs=1e-6)
    short = spark.createDataFrame([([1.0],), ([1.0, 2.0],), ([],)], "a array<double>").select(features.array_facts(F.col("a")).alias("x")).collect()
    assert [r.x.momentum for r in short[:2]] == [None, 1.0] and short[1].x.pattern == "rise"


def test_refined_modes(spark, w):
    base = {(r.sid, r.wid, r.step): r.yhat for r in workflow.refined(w, SPEC, train=True).collect()}
    free = {(r.sid, r.wid, r.step): r.yhat for r in workflow.refined(w, SPEC, clip=False).collect()}
    plain = forecasting.weighted(forecasting.forecasts(w, SPEC), F.lit(1.0)).collect()
    assert all(base[r.sid, r.wid, r.step] == pytest.approx(r.yhat) for r in plain) and len(base) == len(plain)
    assert any(abs(free[k] - base[k]) > 1e-6 for k in base)
    high = spark.createDataFrame([("a", 0, [100.0, 101.0] * 12)], "sid string, wid long, hist array<double>")  # the zero model draws the ensemble down
    assert min(r.yhat for r in workflow.refined(high, SPEC).collect()) == 99.0 > max(r.yhat for r in workflow.refined(high, SPEC, clip=False).collect())


def flaky(prompt):
    """Wrong in a different way each attempt; right once the prompt tells what was wrong with the length."""
    if "1 answers for" in prompt:
        return "<think>x</think><Answer>[1, 2, 3, 4]</Answer>"
    if "no <answer> tag" in prompt:
        return "<answer>[7]</answer>"
    if "TimeoutError" in prompt:
        return "no tags, 5"
    raise TimeoutError("slow")


def test_forecaster_is_told_what_was_wrong(spark, w, tmp_path):
    r = loops.run_windows(w.where("wid < 2"), SPEC, loops.Clients(forecast=flaky, tries=1), loops.Limits(attempts=6), folder=f"file://{tmp_path}/x")
    got = r.collect()
    assert len(got) == 4 and {x.attempts for x in got} == {4} and all(x.valid and x.forecast == [1, 2, 3, 4] for x in got)
    tried = spark.read.parquet(*[f"file://{tmp_path}/x/attempts/{k}" for k in range(1, 5)])
    assert tried.count() == 16 and {x.attempt: x.error for x in tried.collect()} == {1: "TimeoutError: slow", 2: "there is no <answer> tag", 3: "1 answers for a horizon of 4", 4: None}
    short = loops.run_windows(w.where("wid < 2"), SPEC, loops.Clients(forecast=flaky, tries=1), loops.Limits(attempts=2)).collect()
    assert all(not x.valid and x.attempts == 2 and np.isnan(x.forecast).all() and "no finite numbers" in x.reflection for x in short)


def planner(prompt):
    p = json.loads(prompt)
    if p["window"] == 1:
        raise ConnectionError("gone")
    return 'use {"tools": ["event_summary_tool", "no_tool"]}'


def test_planner_and_its_failure(spark, w):
    got = {x.wid: x for x in loops.run_windows(w.where("sid = 'a' AND wid < 3"), SPEC, loops.Clients(plan=planner, tries=2)).collect()}
    must = list(workflow.MANDATORY)
    assert got[0].schedule == [*must, "event_summary_tool"] and got[1].schedule == [*must, *workflow.HEURISTIC]
    assert all(x.valid and x.attempts == 1 for x in got.values()) and len(got) == 3
    assert loops.run_windows(w.where("wid < 0"), SPEC).collect() == []


def refuse_first_candidate(prompt):
    return "FAIL" if json.loads(prompt)["candidate"] == 0 else "PASS, good"


def test_memory_loop_takes_a_valid_candidate(spark, w):
    got = loops.run_memory(w.where("wid < 3"), SPEC, loops.Clients(review=refuse_first_candidate), loops.Limits(2, 4, 1e9, 1e9), train=False).collect()
    assert all(x.candidate == 1 and x.excellent and x.save and x.attempts == 1 for x in got) and len(got) == 6
    none = loops.run_memory(w.where("wid < 3"), SPEC, loops.Clients(review=lambda p: "FAIL"), loops.Limits(2, 4, 1e9, 1e9), train=False).collect()
    assert all(not x.save and not x.excellent and x.attempts == 2 and x.attempt == 2 for x in none)


def test_memory_is_built_once(spark, w, tmp_path):
    folder, few = f"file://{tmp_path}/memory", w.where("wid < 4")
    assert memory.read(spark, folder).collect() == []
    assert memory.build(few, SPEC, folder, batches=2) == 8
    assert memory.build(few, SPEC, folder, batches=2) == 0 and memory.build(few, SPEC, folder, batches=3, name="again") == 0
    rows = memory.read(spark, folder).collect()
    assert sorted((r.dataset_name, r.idx) for r in rows) == [(s, k) for s in "ab" for k in range(4)]
    # A job that died after it wrote entries, before it said so: not read, and written again.
    e = memory.read(spark, folder).limit(1).withColumn("idx", F.lit(99).cast("long")).withColumn("metrics", F.create_map(F.lit("mse"), F.lit(1.0)))
    e.write.parquet(f"{folder}/entries/late")
    assert memory.read(spark, folder).count() == 8
    assert memory.append(e, folder, "late") == 1 and memory.read(spark, folder).count() == 9
    twice = e.unionByName(e).withColumn("idx", F.lit(100).cast("long"))
    assert memory.append(twice, folder, "twice") == 1
    assert memory.build(w.where("wid < 5"), SPEC, folder, name="more") == 2
    with pytest.raises(ValueError):
        memory.append(e, folder, "../x")


def test_remembered_tools(spark, w, tmp_path):
    folder = f"file://{tmp_path}/memory"
    memory.build(w.where("wid < 3"), SPEC, folder)
    got = loops.remembered(w.where("wid < 3"), memory.read(spark, folder)).collect()
    assert len(got) == 6 and all(set(workflow.HEURISTIC) & set(map(lambda n: workflow.OLDER_NAMES.get(n, n), r.remembered)) for r in got)


def test_isolated_models(spark, w):
    forecasting.plugged("Odd", lambda y, h, s: np.full(h, 1 / (0 if y[0] > 11 else 1)) if y[0] <= 11 else (_ for _ in ()).throw(KeyError("odd")))
    good, bad = forecasting.isolated(w, SPEC, ["Odd", "ZeroModel"])
    n, high = w.count(), w.where("hist[0] > 11").count()
    assert 0 < high < n and bad.count() == high and {r.message for r in bad.collect()} == {"KeyError: 'odd'"}
    assert good.where("model = 'ZeroModel' AND ord = 1").count() == n and good.where("model = 'Odd' AND ord = 0").count() == n - high
    with pytest.raises(Exception, match="model Odd failed"):
        forecasting.isolated(w, SPEC, ["Odd"], strict=True)[0].collect()
    with pytest.raises(KeyError):
        forecasting.isolated(w, SPEC, ["nobody"])
    aux = workflow.auxiliary(w, SPEC, ["Odd", "ZeroModel"]).collect()
    assert sum(bool(r.model_failures) for r in aux) == high and all(r.component_forecasts["ZeroModel"] == [0.0] * 4 for r in aux)


def test_theta_values(spark):
    """Against a plain loop over one series: seasonal factors, the best of nineteen smoothing weights, half of the drift."""
    rng = np.random.default_rng(2)
    y = 20 + np.arange(24) * 0.3 + np.tile([1.0, -2.0, 3.0, 0.5], 6) + rng.normal(0, 0.2, 24)
    trend = [np.nan] * 2 + [sum(y[k + j] * (0.5 if abs(j) == 2 else 1) for j in range(-2, 3)) / 4 for k in range(2, 22)] + [np.nan] * 2
    factor = np.array([np.nanmean([y[k] / trend[k] for k in range(p, 24, 4)]) for p in range(4)])
    factor = factor / factor.mean()
    x = y / np.tile(factor, 6)
    slope = np.polyfit(np.arange(24), x, 1)[0]
    best = None
    for alpha in np.linspace(0.05, 0.95, 19):
        level, err = x[0], 0.0
        for v in x[1:]:
            err += (v - level) ** 2
            level += alpha * (v - level)
        if best is None or err < best[0]:
            best = (err, alpha, level)
    _, alpha, level = best
    want = [(level + slope / 2 * (h + (1 - (1 - alpha) ** 24) / alpha)) * factor[h % 4] for h in range(4)]
    assert forecasting.theta_values(y[None, :], 4, 4)[0] == pytest.approx(want)
    df = spark.createDataFrame([("a", 0, y.tolist())], "sid string, wid long, hist array<double>")
    assert forecasting.forecasts(df, SPEC, ["Theta"]).first().yhat == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 500, 2049, 5000])
def test_autocorrelation_in_steps(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(0, 1, n).cumsum() + 5
    c = y - y.mean()
    want = np.correlate(c, c, "full")[n - 1 :]
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)] + [("t", 0, 1.0), ("t", 1, 2.0)], "sid string, pos long, y double").repartition(3)
    for short in (0, 4096):
        got = {(r.sid, r.lag): r.r for r in spectrum.autocorrelations(df, short).collect()}
        assert len(got) == n + 2 and np.allclose([got["s", k] for k in range(n)], want, atol=1e-6 * max(1, abs(want).max())) and got["t", 1] == pytest.approx(-0.25)
    assert spectrum.autocorrelations(df.where("pos < 0")).collect() == []
    lags = want[1 : max(2, n // 2)]
    best = 1 if n < 4 else int(np.argmax(np.round(lags, 2))) + 1
    assert {r.sid: r.periodicity_lag for r in spectrum.whole_periodicity(df, 64).collect()} == {"s": best, "t": 1}


def test_series_without_a_timestamp(spark, tmp_path):
    (tmp_path / "b.csv").write_text("load\n" + "\n".join(str(k) for k in range(100, 160)) + "\n")
    (tmp_path / "a.csv").write_text("load\n5\nbad\n4\n\n3\n")
    got = series.load_series(spark, [f"file://{tmp_path}/b.csv", f"file://{tmp_path}/a.csv"]).orderBy("pos").collect()
    assert [r.y for r in got] == [5, 4, 3, *range(100, 160)] and [r.pos for r in got] == list(range(63))
    spark.range(0, 500, 1, 3).select((F.col("id") * 7 % 500).cast("double").alias("v")).coalesce(1).write.parquet(f"file://{tmp_path}/p.parquet")
    again = series.load_series(spark, f"file://{tmp_path}/p.parquet").orderBy("pos").collect()
    assert [r.y for r in again] == [float(k * 7 % 500) for k in range(500)]
    (tmp_path / "t.csv").write_text("date,v\n2024-01-02,2\n2024-01-01,1\n")
    for by_file, want in ((None, [1, 2]), (True, [2, 1])):
        assert [r.y for r in series.load_series(spark, f"file://{tmp_path}/t.csv", file_order=by_file).orderBy("pos").collect()] == want
    with pytest.raises(ValueError):
        series.load_series(spark, f"file://{tmp_path}/a.csv", file_order=False)


def test_paths_of_datasets(spark, tmp_path):
    for p in ("train/EPF_NP_train_val.csv", "ETT_ETTh1_train_val.csv", "test/mopex_test.csv"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x\n1\n")
    root = f"file://{tmp_path}"
    assert registry.resolved(spark, root, ["np", "ETTh1"]) == {"NP": f"{root}/train/EPF_NP_train_val.csv", "ETTh1": f"{root}/ETT_ETTh1_train_val.csv"}
    assert registry.resolved(spark, root + "/", ["MOPEX"], "test") == {"MOPEX": f"{root}/test/mopex_test.csv"}
    with pytest.raises(FileNotFoundError, match="BE: .*SP: "):
        registry.resolved(spark, root, ["NP", "BE", "solar"])
    with pytest.raises(KeyError):
        registry.resolved(spark, root, ["nobody"])
    with pytest.raises(ValueError):
        registry.resolved(spark, root, [])


def test_forecast_of_a_file(spark, tmp_path):
    lines = ["date,load"] + [f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00,{10 + k % 4}" for k in range(60)]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    table = tables.forecast_csv(spark, f"file://{tmp_path}/x.csv", f"file://{tmp_path}/out", SPEC)
    assert table.columns == list(tables.WINDOW_COLUMNS)
    back = tables.text_table(spark, f"file://{tmp_path}/out").collect()
    assert len(back) == 9 and all(r.reflection == "PASS" and float(r.mse) >= 0 and "2024-01-0" in r.ground_truth and "every 1 hour" in r.prompt for r in back)
    steps = tables.forecast_csv(spark, f"file://{tmp_path}/x.csv", f"file://{tmp_path}/next", SPEC, latest=True).orderBy("step").collect()
    assert [r.step for r in steps] == [1, 2, 3, 4] and str(steps[0].time_stamp) == "2024-01-03 12:00:00" and str(steps[3].time_stamp) == "2024-01-03 15:00:00"
    (tmp_path / "plain.csv").write_text("load\n" + "\n".join(str(k % 4) for k in range(25)))
    assert tables.forecast_csv(spark, f"file://{tmp_path}/plain.csv", f"file://{tmp_path}/plain", SPEC).columns == ["step", "forecast"]
    with pytest.raises(ValueError):
        tables.forecast_csv(spark, f"file://{tmp_path}/plain.csv", f"file://{tmp_path}/none", WindowSpec(30, 4))


def test_library_and_its_fallback(spark, w, tmp_path):
    folder = f"file://{tmp_path}/library"
    memory.save_library(w.where("sid = 'a'"), SPEC, folder, recentre=True)
    t = memory.opened(spark, folder)
    assert memory.opened(spark, folder) is t and spark.read.parquet(f"{folder}/case_neighbor").count() == t["cases"].count()
    base = spark.read.parquet(f"{folder}/cluster_base").collect()
    assert all(sum(r.best_model.values()) == r.total_weight <= r.size for r in base) and sum(r.size for r in base) == t["cases"].count()
    few = w.where("wid < 2")
    got = workflow.act(few, few.select("sid", "wid", workflow.names(["model_auxiliary_tool"]).alias("schedule")), SPEC, library=t).collect()
    for r in got:
        x = json.loads(r.tools["model_auxiliary_tool"])
        if r.sid == "a":
            assert x["source"] == "anchor_library" and len(x["anchor_cases"]) == 3 and x["anchor_cases"][0]["case_id"] == r.wid and set(x["weights"]) == set(x["component_forecasts"])
            mixed = [sum(x["weights"][m] * x["component_forecasts"][m][h] for m in x["weights"]) for h in range(4)]
            assert x["reference_prediction"] == pytest.approx(mixed, abs=1e-4)
        else:
            assert x["source"] == "deterministic_fallback" and "library" in x["fallback_reason"]
    ran = loops.run_windows(few, SPEC, library=t).collect()
    assert len(ran) == 4 and all(r.valid for r in ran)
    with pytest.raises(RuntimeError, match="medoids still change"):
        library.k_medoids(library.cases(made(spark, 400), SPEC), rounds=1)


def test_places_in_a_table(spark, tmp_path):
    rows = [("p", "g", None if k % 3 else '{"idx": 70}', k) for k in range(40)]
    for name, part in (("b", rows[:25]), ("a", rows[25:])):
        spark.createDataFrame(part, "prompt string, ground_truth string, extra_info string, k int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/t/{name}")
    df = tables.rl_rows(spark, f"file://{tmp_path}/t/*").collect()
    want = {k: (k - 25 if k >= 25 else k + 15) for k in range(40)}
    assert {r.k: r.extra_info["index"] for r in df} == {k: str(70 if k % 3 == 0 else want[k]) for k in want}


def client(prompt):
    if prompt == "slow":
        time.sleep(5)
    if prompt == "bad":
        return "<answer>none</answer>"
    if prompt == "error":
        raise ValueError("no")
    return f'<think>t</think><answer>{{"0": {len(prompt)}}}</answer>'


def test_inference(spark):
    rows = spark.createDataFrame([(1, "ok", '{"0": 1}'), (2, "bad", '{"0": 1}'), (3, "error", '{"0": 1}'), (4, "slow", '{"0": 1}'), (5, "ok", "")], "idx int, prompt string, ground_truth string")
    got = {r.idx: r for r in exports.inferred(rows, client, attempts=2, workers=2, timeout=0.5).collect()}
    assert got[1].success and got[1].answer == '{"0": 2}' and got[1].reasoning == "t" and got[1].attempt == 1
    assert not got[2].success and got[2].error == exports.UNSCORED and got[2].attempt == 2 and got[2].full_response
    assert got[3].error == "ValueError: no" and got[4].error.startswith("TimeoutError") and not got[5].success
    free = exports.inferred(rows.drop("ground_truth"), client, attempts=1, timeout=0.5).where("success").count()
    assert free == 3  # without a truth any answer counts
    taught = exports.teacher_rows(rows, client, attempts=1, timeout=0.5).collect()
    assert sorted(r.idx for r in taught) == [1, 2, 5] and all(r.response for r in taught)
    done = spark.createDataFrame([(1, " 9 "), (2, "nan"), (4, '{"0": 5}')], "idx int, answer string")
    again = {r.idx: r for r in exports.resumed(rows, done, client, attempts=1, timeout=0.5).collect()}
    assert len(again) == 5 and again[4].attempt == 0 and again[4].answer == '{"0": 5}' and again[1].answer == " 9 " and again[3].attempt == 1
    with pytest.raises(ValueError):
        exports.prepare_sft(spark.createDataFrame([("p", " ")], "prompt string, response string"))


def test_rewards_of_lists(spark):
    rows = spark.createDataFrame([("NP", [1.0, 2.0], [1.0, 2.0]), ("q", [1.0], [1.0, 2.0]), ("q", None, [1.0])], "dataset_name string, answer array<double>, ground_truth array<double>")
    assert [r.reward for r in answers.rewarded(rows).collect()] == [1.0, -0.8, -0.8]
    tool = '[{"tool_name":"model_auxiliary_tool","output":{"reference_prediction":[3.0, 4.0]}}]'
    one = spark.createDataFrame([("NP", "<answer>[1, 2]</answer>", "[1, 2]", tool)], "dataset_name string, answer string, ground_truth string, tool string")
    assert answers.rewarded(one).first().reward == 1.5 and answers.rewarded(one, contrastive=False).first().reward == 1.0


def test_sql_functions(spark):
    surface.register(spark)
    surface.register(spark)
    a = "array(3D, 1D, 4D, 1D, 5D)"
    got = spark.sql(f"SELECT array_mean({a}) AS m, array_deviation({a}) AS d, array_slope({a}) AS s, array_steps({a}) AS e, forecast_seasonal({a}, 3, 2) AS f, forecast_drift({a}, 2, 3) AS g, array_zscores(array(2D, 2D)) AS z").first()
    y = np.array([3.0, 1, 4, 1, 5])
    assert got.m == pytest.approx(y.mean()) and got.d == pytest.approx(y.std()) and got.s == pytest.approx(np.polyfit(range(5), y, 1)[0]) and got.e == np.diff(y).tolist() and got.f == [1, 5, 1]
    assert got.g == pytest.approx([5.5, 6.0]) and got.z == [0.0, 0.0]
    assert spark.sql("SELECT window_ids(CAST(30 AS BIGINT), 28, 4) AS w, window_ids(CAST(2 AS BIGINT), 28, 4) AS v").first()[:] == ([1, 2, 3, 4, 5, 6, 7], [0])


def test_stream_of_forecasts(spark, sf_dir, tmp_path):
    """The stream over several files in order of time gives what the batch gives, up to the hours that are still open."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    rows = events.collect()
    for k in range(4):
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their times
    spec = WindowSpec(24, 6, 1, 12)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    latest.write(latest.forecast_stream(stream, spec), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(300)
    got = {(r.sid, r.ts): (r.y, r.forecast) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.sid, r.ts): (r.y, r.forecast) for r in latest.hourly_forecasts(events, spec).collect()}
    last = max(t for _, t in want)
    missing = [k for k in want if k not in got]
    assert len(got) > 0.95 * len(want) and all(got[k] == want[k] for k in got) and all((last - t).total_seconds() < 3 * 3600 + 5 * 24 * 3600 for _, t in missing)


def test_pruned_search(spark):
    """The rows of the whole search, ties and zero vectors included, with fewer than half of the pairs where vectors lie in groups."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (12, 10))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 10)).tolist()) for i in range(600)] + [(1000 + i, centres[3].tolist()) for i in range(300)] + [(2000, [0.0] * 10), (2001, (-centres[0]).tolist())]
    e = spark.createDataFrame(rows, "item long, u array<double>").repartition(5)
    q = e.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("u").alias("v"))
    for k, least in ((1, -1.0), (5, 0.3), (40, 0.9), (2000, -1.0)):
        got = sorted(map(tuple, similarity.nearest_pruned(q, e, k, least).collect()))
        assert got == sorted(map(tuple, similarity.nearest(q, e, k, least).collect())) and got
    own = q.where("query < 2000")
    n = own.count() * e.count()
    assert similarity.compared(own, e, 5, 0.3) < n / 2
    assert similarity.compared(own, e, 2000) >= own.count() * 901  # all of them are wanted
    assert similarity.nearest_pruned(q, e.where("item < 0"), 3).collect() == []


def test_channels_as_rows(spark, sf_dir):
    rng = np.random.default_rng(9)
    y, x = rng.normal(50, 3, 40), rng.normal(1e6, 2, 40)
    x[5], y[7] = np.nan, np.inf
    df = spark.createDataFrame([("a", 0, "x", y.tolist(), x.tolist()), ("a", 1, "x", [1.0] * 40, x.tolist()), ("a", 2, "x", [1.0], [2.0])], "sid string, wid long, other string, ys array<double>, xs array<double>")
    got = {r.wid: {c.lag: c.c for c in r.c} for r in features.lagged(df, 8).collect()}
    for lag in range(-8, 9):
        a, b = (y[lag:], x[: 40 - lag]) if lag >= 0 else (y[:lag], x[-lag:])
        ok = np.isfinite(a) & np.isfinite(b)
        assert got[0][lag] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1], abs=1e-5) and got[1][lag] == 0
    assert got[2] == {0: 0.0}


def test_limits_from_settings():
    got = loops.limits_of({"MAX_REFLECTION_LOOPS": "5", "EXCELLENT_MSE_THRESHOLD": "2.5", "PARALLEL_PLAN_K": " "}, memory=True)
    assert (got.attempts, got.candidates, got.mse, got.mae) == (5, 4, 2.5, 8.6)
    assert loops.limits_of({}).attempts == 10 and loops.limits_of({"MAX_TEST_RETRY_LOOPS": "2", "MAX_REFLECTION_LOOPS": "9"}).attempts == 2
    with pytest.raises(ValueError):
        loops.limits_of({"PARALLEL_PLAN_K": "0"}, memory=True)


def test_places_without_shuffle(spark, sf_dir, tmp_path):
    """Rows get their places without a shuffle by file, which would be one task a file, and files don't stay at a fixed number."""
    spark.range(50).select("id").write.parquet(f"file://{tmp_path}/t")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = tables.placed(spark.read.parquet(f"file://{tmp_path}/t"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r._place for r in df.collect()) == list(range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert len(queries.rl_rows(spark, sf_dir).inputFiles()) == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_files_of_rollouts(spark, tmp_path):
    """Many prompts from many tasks: files by range, each prompt in one or in neighbouring ones; or a folder a prompt."""
    r = spark.range(0, 4000, 1, 6).select((F.col("id") % 500).alias("idx"), F.concat(F.lit("ro-"), F.col("id").cast("string")).alias("rollout_id"), *[F.lit("p").alias(c) for c in ("prompt", "answer", "ground_truth")], F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("reward"), F.lit(2.0).alias("mse"))
    tables.write_rollouts(r, f"file://{tmp_path}/r")
    assert len(list((tmp_path / "r").glob("**/*.json"))) <= 4  # before, up to a file for each prompt and task
    want = sorted((f"prompt_{i % 500}", str(i), None if i % 2 == 0 else 1.0) for i in range(4000))
    back = spark.read.schema("task string, rollout_id string, reward double").json(f"file://{tmp_path}/r")
    assert sorted(map(tuple, back.collect())) == want
    tables.write_rollouts(r.where("idx < 3"), f"file://{tmp_path}/f", folders=True)
    assert sorted(x.name for x in (tmp_path / "f").glob("task=*")) == [f"task=prompt_{k}" for k in range(3)]
    back = spark.read.schema("rollout_id string, reward double, task string").json(f"file://{tmp_path}/f").select("task", "rollout_id", "reward")
    assert sorted(map(tuple, back.collect())) == [w for w in want if w[0] in ("prompt_0", "prompt_1", "prompt_2")]
