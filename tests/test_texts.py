"""Texts, tables, memory and the workflow's tools on made-up rows."""

import math

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import answers, texts
from skeinwork.operators import features, memory, windows, workflow
from skeinwork.plans.registry import WindowSpec
from skeinwork.sources import series, tables


def of(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


STAMP = '{"2024-01-01 00:00:00": 1.5}'


@pytest.mark.parametrize(("text", "want"), [
    ("<THINK>a</THINK><Answer> b\n</Answer>", "b"), (f"x ```json\n{STAMP}\n``` y", STAMP), ("```no``` {a} tail", ""), (None, ""), ("", ""),
    (f"{{ open {STAMP} and", STAMP), (f"a {{b}} {{\"k\": {STAMP}}} c", f'{{"k": {STAMP}}}'),
])
def test_extracted(spark, text, want):
    assert of(spark, texts.extracted_answer, text) == want


def test_reasoning(spark):
    assert of(spark, texts.reasoning, "<think> so\nit is </think>") == "so\nit is" and of(spark, texts.tagged_answer, "no tag") == ""


@pytest.mark.parametrize(("text", "want"), [
    ("[1, 2.5]", {"0": 1.0, "1": 2.5}), ('{"a": 1, "b": "x", "a": 3}', {"a": 3.0}), ('[{"t": "k", "v": 2}, {"x": 4}, {"value": 7}]', {"k": 2.0, "x": 4.0, "value": 7.0}),
    ("[1, ..., 3]", {"0": 1.0, "1": 3.0}), ('say "2024-01-01 00:00:00": 2 and', {"2024-01-01 00:00:00": 2.0}), ("2024-01-01 00:00:00: -3.", {"2024-01-01 00:00:00": -3.0}), ("", {}), (None, {}),
])
def test_reward_map(spark, text, want):
    assert of(spark, texts.reward_map, text) == want


def test_nan_in_an_answer_counts(spark):
    got = of(spark, answers.forecast_map, '{"a": NaN, "b": 1}')
    assert got["b"] == 1.0 and math.isnan(got["a"])
    assert math.isnan(of(spark, answers.forecast_map, "[1, NaN]")["1"])


def test_small_texts(spark):
    calls = '[{"tool_name": "x"}, {"name": "model_auxiliary_tool", "output": {"ensemble_forecast_baseline": [1, 2.5]}}]'
    assert of(spark, texts.reference_prediction, calls) == [1.0, 2.5]
    assert of(spark, texts.reference_prediction, '{"observations": ' + calls + "}") == [1.0, 2.5] and of(spark, texts.reference_prediction, "no") is None
    one = spark.range(1)
    truth = F.create_map(F.lit("b"), F.lit(0.0), F.lit("a"), F.lit(0.0))
    assert one.select(texts.baseline_map(F.array(F.lit(1.0), F.lit(2.0)), truth)).first()[0] == {"a": 1.0, "b": 2.0}
    assert one.select(texts.baseline_map(F.array(F.lit(1.0)), truth)).first()[0] is None
    assert one.select(texts.key_order(F.array(*map(F.lit, ["b", "10", "9", "a"])))).first()[0] == ["9", "10", "a", "b"]
    assert of(spark, texts.with_note, "", "n") == "n" and of(spark, texts.with_note, "a", "n") == "a\nn"
    assert of(spark, lambda c: texts.compact(c, 5), " a \n b  cdef") == "a b c"
    assert of(spark, texts.prompt_id, "p") == int(__import__("hashlib").md5(b"p").hexdigest()[:8], 16)
    stamps = lambda *x: F.array(*[F.lit(t).cast("timestamp") for t in x])
    assert one.select(texts.frequency_text(stamps("2024-01-01 00:00:00", "2024-01-01 01:00:00"))).first()[0] == "1 hour"
    assert one.select(texts.frequency_text(stamps("2024-01-01", "2024-01-04"))).first()[0] == "3 days"
    assert one.select(texts.frequency_text(stamps("2024-01-01"))).first()[0] == "the original sampling interval"
    assert one.select(texts.series_json(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit(1.0), F.lit(2.12345678), F.lit(3.0)))).first()[0] == '{"a": 3.0, "b": 2.123457}'


def test_prompt_parts(spark):
    one = spark.range(1)
    schedule, outputs = workflow.names(("exogenous_analysis_tool", "trend_analysis_tool")), F.create_map(F.lit("trend_analysis_tool"), F.lit('{"slope":1}'))
    section = one.select(texts.tool_section(schedule, outputs)).first()[0]
    assert section.index("### exogenous_analysis_tool") < section.index("### trend_analysis_tool") and '{"slope":1}' in section
    channel = F.array(F.struct(F.lit("load").alias("name"), F.array(F.lit(1.0), F.lit(2.0)).alias("values")))
    context = one.select(texts.future_context(channel)).first()[0]
    assert '"trend":"increasing"' in context and '"std":0.5' in context
    both = of(spark, texts.with_context, section, context)
    assert both.index("outside channels:") < both.index("### trend_analysis_tool") and of(spark, texts.with_context, "plain", "c") == "plain\n\nc"
    assert "next 4 values" in one.select(texts.forecasting_prompt("y", F.lit("{}"), 4, F.lit("1 hour"), F.lit(""))).first()[0]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\nc', ""), (2, "", None)], "idx long, prompt string, answer string")
    tables.write_csv(rows, str(tmp_path / "p"))
    assert {(r.idx, r.prompt, r.answer) for r in tables.prompt_rows(spark, str(tmp_path / "p")).collect()} == {("1", 'a "b"\nc', ""), ("2", "", "")}
    tables.write_csv(rows.drop("idx"), str(tmp_path / "q"))
    assert sorted(r.idx for r in tables.prompt_rows(spark, str(tmp_path / "q")).collect()) == [0, 1]
    with pytest.raises(ValueError):
        tables.evaluation_rows(spark, str(tmp_path / "p"))
    assert of(spark, tables.dataset_in, "x/solar.csv") == "sunny" and of(spark, tables.dataset_in, "data/BE.csv") == "BE" and of(spark, tables.dataset_in, "q") == ""
    spark.createDataFrame([("p", "g", '{"idx": 7}'), ("p", "g", "bad")], "prompt string, ground_truth string, extra_info string").write.parquet(str(tmp_path / "pjm"))
    got = tables.rl_rows(spark, str(tmp_path / "pjm")).collect()
    assert {r.tool for r in got} == {""} and "7" in {r.extra_info["index"] for r in got}
    f = spark.createDataFrame([(1, "2024-01-01 00:00:00", 3600, [1.0, 2.0])], "id int, s string, d int, forecast array<double>").withColumn("s", F.col("s").cast("timestamp"))
    assert [(r.step, r.forecast, r.time_stamp.hour) for r in tables.forecast_steps(f, ["id"], "s", "d").orderBy("step").collect()] == [(1, 1.0, 0), (2, 2.0, 1)]
    assert tables.window_rows(rows).columns == list(tables.WINDOW_COLUMNS)
    r = spark.createDataFrame([(0, "ro-1", "p", "a", "g", float("nan"), 2.0)], "idx int, rollout_id string, prompt string, answer string, ground_truth string, reward double, mse double")
    tables.write_rollouts(r, str(tmp_path / "r"))
    assert [(x.task, x.rollout_id, x.mse) for x in spark.read.json(str(tmp_path / "r")).collect()] == [("prompt_0", "1", 2.0)]
    assert tables.summary(r, "mse").first()[0] == '{"rows":1,"mse":2.0}'


def test_memory(spark, tmp_path):
    entry = '{"idx": %d, "dataset_name": "%s", "input_json": "{\\"a\\": 1, \\"b\\": 3}", "Forecasting_answer": "<think>t</think><answer>1</answer>", "model_name": "m%d", "metrics": {"mse": 1.0}}'
    (tmp_path / "list.json").write_text("[" + ",".join(entry % (k, d, k) for k, d in ((0, "x"), (1, "y"), (4, ""))) + "]")
    (tmp_path / "object.json").write_text('{"entries": [' + entry % (2, "x", 2) + "]}")
    e = memory.load_json(spark, str(tmp_path / "list.json")).unionByName(memory.load_json(spark, str(tmp_path / "object.json")))
    assert sorted(len(r.vector) for r in e.collect()) == [29] * 4
    assert memory.append(e, str(tmp_path / "m"), "first") == 4 and memory.append(e, str(tmp_path / "m"), "first") == 0 and memory.append(e, str(tmp_path / "m"), "again") == 0
    back = memory.read(spark, str(tmp_path / "m"))
    assert {(r.dataset_name, r.entries, tuple(r.models)) for r in memory.sizes(back).collect()} == {("x", 2, ("m0", "m2")), ("y", 1, ("m1",)), ("", 1, ("m4",))}
    w = spark.createDataFrame([("x", k) for k in range(6)] + [("y", k) for k in range(6)], "sid string, wid long")
    assert {(r.sid, r.wid) for r in memory.pending(w, back).collect()} == {("x", 1), ("x", 3), ("x", 5), ("y", 0), ("y", 2), ("y", 3), ("y", 5)}
    s = tables.sft_rows(back)
    assert tuple(s.columns) == tables.SFT_COLUMNS and {(r.reasoning, r.answer, r.tool) for r in s.collect()} == {("t", "1", "[]")}


def test_act(spark):
    spec = WindowSpec(24, 4, 4, 4)
    rows = [("a", k, float(10 + k % 4)) for k in range(40)]
    w = windows.sliding(spark.createDataFrame(rows, "sid string, pos long, y double"), spec)
    schedule = workflow.names(("trend_analysis_tool", "cross_channel_tool", "autoregressive_residual_tool", "comprehensive_feature_tool", "odd"))
    got = workflow.act(w, w.select("sid", "wid", schedule.alias("schedule")), spec).collect()
    assert len(got) == w.count()
    t = got[0].tools
    assert "slope" in t["trend_analysis_tool"] and "skipped" in t["autoregressive_residual_tool"] and "available" in t["cross_channel_tool"] and "unknown" in t["odd"]
    assert "statistical" in t["comprehensive_feature_tool"]
    assert w.select(workflow.last_value(F.col("hist"), 3)).first()[0] == [w.first().hist[-1]] * 3
    assert all(map(math.isnan, spark.range(1).select(workflow.invalid(2)).first()[0]))


def test_series_statistics(spark, sf_dir):
    panel = series.hourly_panel(spark, sf_dir)
    got = {r.sid: r for r in features.series_statistics(panel.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    for sid in ("click", "view"):
        y = [r.y for r in panel.where(F.col("sid") == sid).orderBy("pos").collect()]
        m = sum(y) / len(y)
        best = max(range(1, len(y) // 2), key=lambda k: (round(sum((y[i] - m) * (y[i - k] - m) for i in range(k, len(y))), 2), -k))
        assert got[sid].periodicity_lag == best and got[sid].series_length == len(y) and got[sid].frequency == "H"
        assert got[sid].mean == pytest.approx(m, abs=1e-5) and got[sid].max == max(y)
