"""Operators of the forecasting part on small made-up tables."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinwork import queries
from skeinwork.functions import answers
from skeinwork.operators import exports, features, forecasting, library, similarity, windows, workflow
from skeinwork.plans import registry
from skeinwork.plans.registry import WindowSpec
from skeinwork.sources import series
from skeinwork.streaming import latest


def line(spark, values, sid="a"):
    return spark.createDataFrame([(sid, i, float(v)) for i, v in enumerate(values)] or [], "sid string, pos long, y double")


def test_windows_edges(spark):
    s = line(spark, range(10))
    assert windows.sliding(s, WindowSpec(6, 4)).count() == 1
    assert windows.sliding(s, WindowSpec(7, 4)).count() == 0
    assert windows.sliding(s, WindowSpec(3, 2, 1), cap=0).count() == 1
    got = windows.sliding(s, WindowSpec(3, 2, 4)).orderBy("wid").collect()
    assert [(r.wid, r.hist, r.fut) for r in got] == [(0, [0, 1, 2], [3, 4]), (1, [4, 5, 6], [7, 8])]
    assert windows.sliding(line(spark, []), WindowSpec(3, 2)).count() == 0


def test_constant_windows(spark):
    w = windows.sliding(line(spark, [0.1] * 12), WindowSpec(10, 2, 0, 3))
    assert features.events(w).first().dominant_pattern == "flat"
    assert features.trend(w).first()[2:] == (0.0, "flat", 0.0)
    assert features.basic(w, 3).first().acf1 == 0.0 and features.spectral_entropy(w).count() == 1
    assert w.select(windows.zscored(F.col("hist")).alias("z")).first().z == [0.0] * 10
    assert features.changepoints(w).first().changepoint_count == 0


def test_samples_and_alignment(spark):
    df = spark.createDataFrame([([1.0],), ([0.0, 23.0],), ([float(i) for i in range(47)],), ([],)], "a array<double>")
    one, two, many, none = (r[0] for r in df.select(windows.samples(F.col("a"))).collect())
    assert one == [1.0] * 24 and two == pytest.approx(list(range(24))) and many == [float(i * 46 // 23) for i in range(24)] and none == [0.0] * 24
    assert df.where("size(a) = 2").select(windows.aligned(F.col("a"), 4)).first()[0] == [0.0, 0.0, 0.0, 23.0]


@pytest.mark.parametrize(
    "text, want",
    [
        ('<answer>{"0": 1, "1": "2.5", "2": null, "3": true, "4": "x"}</answer>', {"0": 1.0, "1": 2.5, "3": 1.0}),
        ("<ANSWER>[1, 2, ..., 3]</ANSWER><answer>[9]</answer>", {"0": 1.0, "1": 2.0, "2": 3.0}),
        ("{'a1': 1, 'a1': 2}", {"a1": 2.0}),
        ("t1: 4, 2020-01-01 00:00:00: -5.5 and t1: 6", {"t1": 6.0, "2020-01-01 00:00:00": -5.5}),
        ("we think 3 then -4.25", {"0": 3.0, "1": -4.25}),
        ("", {}),
        (None, {}),
        ("no digits", {}),
    ],
)
def test_forecast_map(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(answers.forecast_map(F.col("t"))).first()[0] == want


def test_pairs_by_place_and_last_answer(spark):
    df = spark.createDataFrame([({"b": 1.0, "a": 2.0}, {"x": 5.0, "y": 6.0, "z": 7.0})], "a map<string,double>, g map<string,double>")
    assert [tuple(x) for x in df.select(answers.paired(F.col("a"), F.col("g"))).first()[0]] == [(2.0, 5.0), (1.0, 6.0)]
    assert spark.range(1).select(answers.last_answer(F.lit("<answer>1</answer> <answer> 2 </answer>"))).first()[0] == "2"


def test_penalties(spark):
    def of(a, g):
        row = spark.createDataFrame([({str(i): 0.0 for i in range(a)}, {str(i): 0.0 for i in range(g)})], "a map<string,double>, g map<string,double>")
        return row.select(answers.length_penalty(F.col("a"), F.col("g"))).first()[0]

    assert of(2, 2) is None and of(1, 2) == -0.8 and of(0, 2) == -1.0 and of(1, 0) == -1.0
    assert of(11, 10) == pytest.approx(-0.56) and of(30, 10) == -0.8


def test_source_roles(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,name,load,answer\n2024-01-02,b,2,7\n2024-01-01,a,1.5,7\n2024-01-03,c,bad,7\n2024-02-01,d,4,7\n")
    got = series.load_series(spark, str(tmp_path / "x.csv")).orderBy("pos").collect()
    assert [(r.pos, r.y) for r in got] == [(0, 1.5), (1, 2.0), (2, 4.0)]
    with pytest.raises(ValueError):
        series.target_column(spark.createDataFrame([("a",)], "v string"))


def test_fill(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("b", 0, None)], "k string, pos int, x double")
    got = series.exogenous_filled(df, ["k"], "pos", ["x"]).orderBy("k", "pos").collect()
    assert [r.x for r in got] == [2.0, 2.0, 2.0, 0.0]


def test_registry():
    assert registry.dataset_of("data/train/EPF_NP_train_val.csv") == "NP" and registry.dataset_of("x/windy_power_test.csv") == "WP" and registry.dataset_of("q.csv") is None
    assert registry.dataset_of("data/wind.csv") is None and registry.dataset_of("sunny.csv") is None and registry.dataset_of("windy_power.csv") is None
    assert registry.spec_of("etth1").lookback == 96 and registry.spec_of("solar") == registry.spec_of("SP")
    assert registry.dataset_of("data/BE/DE.csv") == "BE"
    with pytest.raises(KeyError):
        registry.spec_of("none")


def test_workflow_rules(spark):
    one = spark.range(1)
    nan = float("nan")
    ask = lambda f, m=None: one.select(workflow.verdict(F.lit(f).cast("array<double>") if f is None else F.array(*map(F.lit, f)), 2, m)).first()[0]
    assert ask([1.0, 2.0]) == "PASS" and "1 values for" in ask([1.0]) and "no finite" in ask([1.0, nan]) and ask(None) == "there is no forecast"
    assert ask([1.0, 2.0], F.lit("I say fail")) == "I say fail" and ask([1.0, 2.0], F.lit("FAIL? no, PASS")) == "PASS"
    past, asked = F.array(F.lit("trend_analysis"), F.lit("data_quality_tool")), F.array(F.lit("trend_analysis_tool"), F.lit("odd"), F.lit("event_summary_tool"))
    must = ["model_auxiliary_tool", "exogenous_analysis_tool"]
    assert one.select(workflow.planned(past, asked)).first()[0] == [*must, "trend_analysis_tool", "event_summary_tool"]
    assert one.select(workflow.planned(past, F.array(F.lit("odd")))).first()[0] == [*must, "trend_analysis_tool", "data_quality_tool", "statistical_analysis_tool", "changepoint_trend_tool"]
    assert one.select(workflow.named_tools(F.lit('so: {"tools": ["exogenous_analysis_tool","trend_analysis_tool"]} ok'))).first()[0] == ["exogenous_analysis_tool", "trend_analysis_tool"]
    base = workflow.names((*workflow.MANDATORY, *workflow.STRATEGIES[0]))
    assert len(one.select(workflow.candidate_schedules(base, F.lit(3), 4, True)).first()[0]) == 4
    assert len(one.select(workflow.candidate_schedules(base, F.lit(2), 4)).first()[0]) == 2
    assert one.select(workflow.named_tools(F.lit("use event_summary_tool, please"))).first()[0] == ["event_summary_tool"]
    rows = spark.createDataFrame([(1, 0, False, 1.0), (1, 1, True, 5.0), (1, 2, True, nan), (2, 0, False, None), (2, 1, False, 3.0)], "k int, candidate int, valid boolean, mse double")
    assert [(r.k, r.candidate) for r in workflow.best_candidates(rows, ["k"]).orderBy("k").collect()] == [(1, 1), (2, 1)]


def test_exports(spark):
    rows = spark.createDataFrame([("1", "p", "r", "", ""), ("2", "p", " ", "g", "NP"), ("10", " ", "r", "g", "NP")], "idx string, prompt string, answer string, ground_truth string, dataset_name string")
    assert exports.prepare_sft(rows).count() == 1 and exports.chat(exports.prepare_sft(rows)).first()[0][1].content == "r"
    rl = exports.prepare_rl(rows, "BE").orderBy("idx").collect()
    assert [(r.idx, r.ground_truth, r.dataset_name) for r in rl] == [("2", "g", "NP")]  # only column response stands in for a truth
    with_response = exports.prepare_rl(rows.withColumn("response", F.col("answer")), "BE").orderBy("idx").collect()
    assert [(r.idx, r.ground_truth, r.dataset_name, r.tool) for r in with_response] == [("1", "r", "BE", ""), ("2", "g", "NP", "")]
    assert sorted(r.idx for r in exports.prepare_rl(rows.drop("idx"), "BE").collect()) == [2]
    assert [r.idx for r in exports.ordered_export(rows).collect()] == ["1", "2", "10"]

    def client(prompt):
        if "bad" in prompt:
            raise OSError("down")
        return f"<answer>{len(prompt)}</answer>"

    got = {r.idx: r for r in exports.inferred(spark.createDataFrame([(1, "abc"), (2, "bad")], "idx long, prompt string"), client, 2).collect()}
    assert got[1].answer == "3" and got[1].success and not got[2].success and got[2].attempt == 2 and "down" in got[2].error


def test_theta_and_weights(spark):
    spec = WindowSpec(24, 4, 0, 4)
    w = windows.sliding(line(spark, [10 + (i % 4) for i in range(28)]), spec)
    yhat = w.select(forecasting.theta(spec)(F.col("hist"))).first()[0]
    assert len(yhat) == 4 and all(math.isfinite(v) for v in yhat) and yhat == pytest.approx([10, 11, 12, 13], abs=0.6)
    sims = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", 0.5, 4.0), (1, "c", -1.0, 0.1)], "query int, model string, similarity double, error double")
    assert {r.model: r.weight for r in forecasting.inverse_error_weights(sims).collect()} == pytest.approx({"a": 0.8, "b": 0.2, "c": 0.0})


def test_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    latest.write(latest.hourly(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.agg(F.sum("y")).first()[0] <= events.agg(F.sum("value")).first()[0] + 1e-6


def test_search_over_several_blocks(spark):
    """More queries than a block holds, in one series or none, with ties and a zero vector: every pair is compared once."""
    rng = np.random.default_rng(7)
    u = rng.integers(-2, 3, (180, 4)).astype(float)
    u[5], u[9] = 0.0, u[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "item long, u array<double>")
    q = rows.where("item < 150").selectExpr("item AS query", "u AS v")
    got = {(r.query, r["rank"]): (r.item, r.sim) for r in similarity.nearest(q, rows, 3, -1.0).collect()}
    unit = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit[:150] @ unit.T, 9)
    want = {(a, k + 1): (b, sims[a, b]) for a in range(150) for k, b in enumerate(sorted(range(180), key=lambda b: (-sims[a, b], b))[:3])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)

    w = spark.createDataFrame([("big", i, v.tolist()) for i, v in enumerate(u)] + [("small", 0, [1.0, 2.0, 3.0, 4.0])], "sid string, wid long, hist array<double>")
    found = library.similar_cases(w, w, 200).groupBy("sid", "wid").count().collect()
    assert {(r.sid, r.wid, r["count"]) for r in found} == {("big", i, 180) for i in range(180)} | {("small", 0, 1)}


def test_k_medoids_by_brute_force(spark):
    """Medoids against all pairwise distances, for series of several sizes, one of equal vectors and one of a single case."""
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=(60, 5)), "b": rng.normal(size=(9, 5)) + 3, "same": np.ones((7, 5)), "one": np.ones((1, 5))}
    c = spark.createDataFrame([(s, i, v.tolist()) for s, x in data.items() for i, v in enumerate(x)], "sid string, wid long, z array<double>")
    got = {s: {} for s in data}
    for r in library.k_medoids(c).collect():
        got[r.sid][r.cluster] = r.medoid
        assert r.mz == data[r.sid][r.medoid].tolist()
    for s, x in data.items():
        d = ((x[:, None] - x[None]) ** 2).sum(2).round(6)
        k = min(6, len(x))
        m = {i: 0 if k <= 1 else round(i * (len(x) - 1) / (k - 1)) for i in range(k)}
        while True:
            place = [min(m, key=lambda i: (d[w, m[i]], i)) for w in range(len(x))]
            new = {}
            for i in sorted(set(place)):
                mine = [w for w in range(len(x)) if place[w] == i]
                new[i] = min(mine, key=lambda w: (d[w, mine].sum().round(5), w))
            if new == m:
                break
            m = new
        assert got[s] == m


def test_theta_in_the_pool(spark):
    spec = WindowSpec(24, 4, 0, 4)
    rows = [("up", 0, [10.0 + i % 4 for i in range(24)]), ("odd", 0, [1.0, float("nan"), 2.0]), ("none", 0, []), ("short", 0, [5.0]), ("low", 0, [-1.0] * 24)]
    w = spark.createDataFrame(rows, "sid string, wid long, hist array<double>")
    got = {(r.sid, r.model): r.yhat for r in forecasting.forecasts(w, spec, ["HistoricAverage", "Theta"]).collect()}
    assert got["up", "Theta"] == pytest.approx([10, 11, 12, 13], abs=1e-6)
    assert got["short", "Theta"] == [5.0] * 4 and got["low", "Theta"] == pytest.approx([-1.0] * 4)
    assert ("odd", "Theta") not in got and ("none", "Theta") not in got and ("up", "HistoricAverage") in got
    assert {r.model for r in forecasting.forecasts(w, spec).select("model").distinct().collect()} == {"SeasonalNaive", "HistoricAverage", "ZeroModel"}


def test_search_in_groups(spark, monkeypatch):
    """Blocks of queries and entries meet as matrices, once each; copies, NaN, nulls, other sizes and struct keys included."""
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "ENTRY_BLOCK", 11)
    monkeypatch.setattr(similarity, "STRIP", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.5, 3.0]) for i in range(90)]
    rows += [(300, [float("nan"), 1.0, 1.0, 1.0]), (301, None), (302, [1.0, None, 0.0, 0.0]), (303, [1.0, 2.0]), (304, [0.0] * 4), (305, [])]
    e = spark.createDataFrame(rows, "item long, u array<double>").withColumn("item", F.struct(F.lit("x").alias("a"), "item"))
    q = e.select(F.col("item").alias("query"), F.col("u").alias("v"))
    dots = e.crossJoin(q).where("size(u) = size(v) AND u IS NOT NULL").select("query", "item", F.round(similarity.dot(similarity.unit(F.col("v")), similarity.unit(F.col("u"))), 9).alias("sim"))
    for k, least in ((4, -1.0), (200, 0.2)):
        got = similarity.nearest(q, e, k, least)
        assert "CoGroup" in got._jdf.queryExecution().toString()  # before, each pair was a row of a join
        assert sorted(map(repr, got.collect())) == sorted(map(repr, similarity.top_k(dots.where(F.col("sim") >= least), "query", "item", k).collect()))


def test_search_is_for_every_vector(spark, sf_dir):
    """Each vector of the table has its neighbours, not those of some ids alone."""
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").select("vec_id").collect()}
    got = queries.vector_topk(spark, sf_dir).collect()
    assert {r["query"] for r in got} == ids and all(r["item"] == r["query"] for r in got if r["rank"] == 1)


@pytest.mark.parametrize("noise", [0.0, 1e-11, 1e-7, 0.3])
def test_best_of_a_block(monkeypatch, noise):
    """The k best by nine digits, whether or not single precision can tell entries apart; vectors without a component too."""
    monkeypatch.setattr(similarity, "STRIP", 40)
    monkeypatch.setattr(similarity, "FINE", 7)
    rng = np.random.default_rng(5)
    for width, nan in ((6, False), (6, True), (0, False)):
        e = rng.normal(size=(3, width))[rng.integers(0, 3, 700)] + noise * rng.normal(size=(700, width))
        if nan:
            e[rng.integers(0, 700, 9)] = np.nan
        e = similarity._matrix(pa.chunked_array([pa.array(e.tolist(), pa.list_(pa.float64()))]))
        q = e[:90]
        sims = np.zeros((len(q), len(e)))
        for j in range(width):
            sims += q[:, j, None] * e[None, :, j]
        digits = np.where(np.isnan(sims), np.inf, np.floor(sims * 1e9 + 0.5))
        for k, least in ((5, 0.1), (60, -1.0)):
            want = [(i, int(j), float(sims[i, j])) for i in range(len(q)) for j in np.lexsort((np.arange(len(e)), -digits[i]))[:k] if not sims[i, j] < least]
            found = zip(*(c.tolist() for c in similarity.block_top(q, e, np.arange(len(e)), k, least)))
            assert repr([f for f in found if not f[2] < least]) == repr(want)
            if not nan:  # near copies don't all have to be summed again
                assert sum(len(r) for _, r, _ in similarity._candidates(q, e, k, least)) <= 4 * k * len(q)


def test_blocks_of_a_search():
    """No block is larger than it may be; there are enough pairs of blocks for as many tasks, and few queries aren't split in vain."""
    assert similarity._grid(10, 32768, 10, 32768) == (6, 6)
    assert similarity._grid(6, 32768, 615384, 32768) == (1, 32)
    assert similarity._grid(615384, 32768, 615384, 32768) == (19, 19)
    assert similarity._grid(0, 8, 0, 8)[0] >= 1
