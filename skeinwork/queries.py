"""Registered queries of the forecasting operators, and their oracle SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import answers, surface, texts
from skeinwork.operators import exports, features, forecasting, library, loops, memory, similarity, spectrum, windows, workflow
from skeinwork.operators.features import rounded
from skeinwork.plans.registry import DATASETS, WindowSpec, registry
from skeinwork.sources import series, tables
from skeinwork.streaming import latest

def exact(c, digits: int):
    """Rounded half up by way of nine decimal places, so that both engines agree where a sum lies on a tie."""
    return F.round(c.cast("decimal(28,9)"), digits).cast("double")


def exact_sql(c: str, digits: int) -> str:
    return f"round(({c})::DECIMAL(28,9), {digits})::DOUBLE"


HOURLY = WindowSpec(168, 24, 24, 24)
DAILY = WindowSpec(96, 96, 48, 7)
USERS = WindowSpec(14, 7, 7, 7)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(series.hourly_panel(spark, sf_dir), HOURLY)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(series.daily_by_user(spark, sf_dir), USERS)


def _panel(unit: str, table: str, sid: str, ts: str, value: str) -> str:
    return f"""
e AS (SELECT {sid} AS sid, date_trunc('{unit}', {ts})::TIMESTAMP AS ts, sum({value}::DECIMAL(18,2))::DOUBLE AS y FROM {table} GROUP BY 1, 2),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM e),
s AS (SELECT g.sid, date_diff('{unit}', (SELECT lo FROM b), g.ts)::BIGINT AS pos, g.ts, coalesce(e.y, 0.0) AS y
      FROM (SELECT d.sid, unnest(generate_series((SELECT lo FROM b), (SELECT hi FROM b), INTERVAL 1 {unit})) AS ts FROM (SELECT DISTINCT sid FROM e) d) g
      LEFT JOIN e ON e.sid = g.sid AND e.ts = g.ts)"""


def _windows(panel: str, w: WindowSpec) -> str:
    span = w.lookback + w.horizon
    return f"""WITH {panel},
n AS (SELECT sid, max(pos) + 1 AS n FROM s GROUP BY sid),
k AS (SELECT sid, unnest(range(0, n - {span} + 1, {w.step})) // {w.step} AS wid FROM n WHERE n >= {span}),
p AS (SELECT s.sid, k.wid, s.pos - k.wid * {w.step} AS pos, s.y FROM s JOIN k ON k.sid = s.sid AND s.pos >= k.wid * {w.step} AND s.pos < k.wid * {w.step} + {span}),
h AS (SELECT * FROM p WHERE pos < {w.lookback}), f AS (SELECT sid, wid, pos - {w.lookback} AS step, y FROM p WHERE pos >= {w.lookback})"""


EVENTS = ("events", "event_type", "ts", "value")
HOUR_SQL = _windows(_panel("hour", *EVENTS), HOURLY)
USER_SQL = _windows(_panel("day", "events", "user_id::VARCHAR", "ts", "value"), USERS)
DAY_SQL = _windows(_panel("day", "orders", "'orders'", "o_orderdate", "o_totalprice"), DAILY)
ARRAYS = "a AS (SELECT sid, wid, list(y ORDER BY pos) AS a FROM h GROUP BY ALL), t AS (SELECT sid, wid, list(y ORDER BY step) AS t FROM f GROUP BY ALL)"


def _models(w: WindowSpec) -> str:
    """v: sid, wid, model, ord, step, yhat."""
    tail = w.lookback - w.season
    return f"""{ARRAYS},
v AS (SELECT sid, wid, 'SeasonalNaive' AS model, 0 AS ord, step, a[{tail} + 1 + step % {w.season}] AS yhat FROM a, (SELECT unnest(range({w.horizon})) AS step)
      UNION ALL SELECT sid, wid, 'HistoricAverage', 1, step, list_avg(a) FROM a, (SELECT unnest(range({w.horizon})) AS step)
      UNION ALL SELECT sid, wid, 'ZeroModel', 2, step, 0.0 FROM a, (SELECT unnest(range({w.horizon})) AS step)),
err AS (SELECT v.sid, v.wid, model, ord, avg((yhat - y) * (yhat - y)) AS mse, avg(abs(yhat - y)) AS mae FROM v JOIN f ON f.sid = v.sid AND f.wid = v.wid AND f.step = v.step GROUP BY ALL)"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(HOUR_SQL + " SELECT sid, wid, pos, round(y, 2) AS y FROM p")
def windows_long(spark, sf_dir):
    w = hourly(spark, sf_dir)
    whole = w.select("sid", "wid", F.concat("hist", "fut").alias("a"))
    return windows.points(whole, "a").select("sid", "wid", F.col("pos").cast("long").alias("pos"), F.round("y", 2).alias("y"))


@query(f"WITH {_panel('hour', *EVENTS)} SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY pos) - 1)::BIGINT AS pos, round(y, 2) AS y FROM (SELECT *, max(pos) OVER (PARTITION BY sid) AS m FROM s) WHERE pos > m - 168")
def latest_window(spark, sf_dir):
    w = windows.latest(series.hourly_panel(spark, sf_dir), 168)
    return w.select("sid", F.posexplode("hist").alias("pos", "y")).select("sid", F.col("pos").cast("long").alias("pos"), F.round("y", 2).alias("y"))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1)::BIGINT AS pos FROM events QUALIFY count(*) OVER (PARTITION BY user_id, ts, value) = 1")
def series_positions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    placed = series.with_positions(e.select(F.col("user_id").alias("sid"), "ts", F.col("value").alias("y")))
    alone = e.groupBy(F.col("user_id").alias("sid"), "ts", F.col("value").alias("y")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("c")).where("c = 1")
    return placed.join(alone, ["sid", "ts", "y"]).select(F.col("sid").alias("user_id"), "event_id", "pos")


def _scores(w, spec):
    return forecasting.scored(forecasting.forecasts(w, spec)).select("sid", "wid", "model", rounded(F.col("mse"), 3).alias("mse"), rounded(F.col("mae"), 6).alias("mae"))


@query(HOUR_SQL + ", " + _models(HOURLY) + " SELECT sid, wid, model, round(mse, 3) AS mse, round(mae, 6) AS mae FROM err")
def model_errors_hourly(spark, sf_dir):
    return _scores(hourly(spark, sf_dir), HOURLY)


@query(DAY_SQL + ", " + _models(DAILY) + " SELECT sid, wid, model, round(mse, 0) AS mse, round(mae, 1) AS mae FROM err")
def model_errors_daily_orders(spark, sf_dir):
    f = forecasting.scored(forecasting.forecasts(windows.sliding(series.daily_orders(spark, sf_dir), DAILY), DAILY))
    return f.select("sid", "wid", "model", F.round("mse", 0).alias("mse"), F.round("mae", 1).alias("mae"))


@query(USER_SQL + ", " + _models(USERS) + " SELECT model, count(*) AS windows, round(avg(mse), 2) AS mse, round(avg(mae), 2) AS mae FROM err GROUP BY model")
def mean_errors_by_user(spark, sf_dir):
    f = forecasting.scored(forecasting.forecasts(users(spark, sf_dir), USERS))
    return f.groupBy("model").agg(F.count("*").alias("windows"), F.round(F.avg("mse"), 2).alias("mse"), F.round(F.avg("mae"), 2).alias("mae"))


@query(HOUR_SQL + " SELECT h.sid, h.wid, k.step, " + exact_sql("l.y + g.s * (k.step + 1)", 4) + " AS yhat FROM (SELECT DISTINCT sid, wid FROM h) h JOIN (SELECT sid, wid, regr_slope(y, pos) AS s FROM h WHERE pos >= 144 GROUP BY ALL) g ON g.sid = h.sid AND g.wid = h.wid JOIN h l ON l.sid = h.sid AND l.wid = h.wid AND l.pos = 167, (SELECT unnest(range(24)) AS step) k")
def linear_drift(spark, sf_dir):
    f = hourly(spark, sf_dir).select("sid", "wid", F.posexplode(forecasting.linear_drift(F.col("hist"), HOURLY)).alias("step", "yhat"))
    return f.select("sid", "wid", F.col("step").cast("long").alias("step"), exact(F.col("yhat"), 4).alias("yhat"))


@query()
def theta_forecast(spark, sf_dir):
    w = hourly(spark, sf_dir)
    return w.select("sid", "wid", F.posexplode(forecasting.theta(HOURLY)(F.col("hist"))).alias("step", "yhat"))


@query(HOUR_SQL + " SELECT sid, wid, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(min(y), 6) AS min, round(max(y), 6) AS max, round(max(y) - min(y), 6) AS range FROM h GROUP BY ALL")
def tool_statistical(spark, sf_dir):
    return features.statistical(hourly(spark, sf_dir))


_ACF = "coalesce(covar_pop({0}, {1}) / nullif(stddev_pop(CASE WHEN {1} IS NOT NULL THEN {0} END) * stddev_pop({1}), 0), 0)"


@query(HOUR_SQL + ", l AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b FROM h WINDOW w AS (PARTITION BY sid, wid ORDER BY pos)) SELECT sid, wid, round(median(y), 6) AS median, round(mad(y), 6) AS mad, "
       f"round(quantile_cont(y, 0.05), 6) AS q05, round(quantile_cont(y, 0.95), 6) AS q95, round({_ACF.format('y', 'a')}, 6) AS acf1, round({_ACF.format('y', 'b')}, 6) AS acf_s FROM l GROUP BY ALL")  # fmt: skip
def tool_basic(spark, sf_dir):
    return features.basic(hourly(spark, sf_dir), HOURLY.season)


@query(HOUR_SQL + ", q AS (SELECT h.sid, h.wid, k.k, pow(sum(y * cos(2 * pi() * k.k * pos / 168)), 2) + pow(sum(y * sin(2 * pi() * k.k * pos / 168)), 2) AS x FROM h, (SELECT unnest(range(1, 85)) AS k) k GROUP BY ALL), "
       "r AS (SELECT *, sum(x) OVER (PARTITION BY sid, wid) AS t FROM q) SELECT sid, wid, coalesce(round(-sum(x / t * ln(x / t)) / nullif(ln(count(*)), 0), 5), 0) AS spectral_entropy FROM r WHERE x > 1e-9 * t GROUP BY ALL")  # fmt: skip
def tool_spectral_entropy(spark, sf_dir):
    return features.spectral_entropy(hourly(spark, sf_dir))


@query(HOUR_SQL + " SELECT sid, wid, 0.0::DOUBLE AS dropout_ratio, CASE WHEN count(DISTINCT y) / count(*) <= 0.02 THEN 1.0 ELSE 0.0 END::DOUBLE AS constant_channel_ratio, round(count(DISTINCT y) / count(*), 6) AS unique_ratio, "
       "round(avg(y) - 3 * stddev_pop(y), 6) AS clip_low, round(avg(y) + 3 * stddev_pop(y), 6) AS clip_high FROM h GROUP BY ALL")  # fmt: skip
def tool_quality(spark, sf_dir):
    return features.quality(hourly(spark, sf_dir))


@query(HOUR_SQL + " SELECT sid, wid, round(s, 6) AS slope, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'flat' END AS trend_direction, round(coalesce(abs(s) / nullif(r, 0), 0), 6) AS trend_strength "
       "FROM (SELECT sid, wid, regr_slope(y, pos) AS s, max(y) - min(y) AS r FROM h GROUP BY ALL)")  # fmt: skip
def tool_trend(spark, sf_dir):
    return features.trend(hourly(spark, sf_dir))


_STEPS = ", d AS (SELECT *, y - lag(y) OVER w AS d FROM h WINDOW w AS (PARTITION BY sid, wid ORDER BY pos)), dd AS (SELECT *, d - lag(d) OVER w AS dd, sign(d) AS g, lag(sign(d)) OVER w AS was, lag(d) OVER w AS ld FROM d WINDOW w AS (PARTITION BY sid, wid ORDER BY pos))"


@query(HOUR_SQL + _STEPS + ", m AS (SELECT sid, wid, avg(abs(d)) + 2 * stddev_pop(d) AS lim FROM d GROUP BY ALL) SELECT dd.sid, dd.wid, count(*) FILTER (abs(d) > lim) AS changepoint_count, round(max(abs(d)) / (stddev_pop(y) + 1e-8), 5) AS changepoint_score, "
       "round(max(d), 6) AS slope_max, round(min(d), 6) AS slope_min, round(coalesce(max(dd), 0), 6) AS second_diff_max, round(avg(d) FILTER (pos > 162), 6) AS recent_momentum FROM dd JOIN m ON m.sid = dd.sid AND m.wid = dd.wid GROUP BY ALL")  # fmt: skip
def tool_changepoint(spark, sf_dir):
    return features.changepoints(hourly(spark, sf_dir))


_PATTERN = "e2 AS (SELECT sid, wid, coalesce(avg((g <> was)::INT), 0) AS o, regr_slope(y, pos) AS sl, stddev_pop(y) AS sd FROM dd GROUP BY ALL), ev AS (SELECT sid, wid, CASE WHEN o > 0.55 THEN 'oscillation' WHEN abs(sl) <= greatest(1e-8, sd * 0.01) THEN 'flat' WHEN sl > 0 THEN 'rise' ELSE 'fall' END AS dominant_pattern, round(o, 6) AS oscillation_ratio FROM e2)"


@query(HOUR_SQL + _STEPS + ", " + _PATTERN + " SELECT * FROM ev")
def tool_event(spark, sf_dir):
    return features.events(hourly(spark, sf_dir))


@query(HOUR_SQL + _STEPS + f" SELECT sid, wid, round(avg(d), 6) AS residual_mean, round(max(abs(d)), 6) AS residual_max, round({_ACF.format('d', 'ld')}, 6) AS residual_acf1 FROM dd GROUP BY ALL")
def tool_ar_residual(spark, sf_dir):
    return features.residuals(hourly(spark, sf_dir))


@query(HOUR_SQL + ", c AS (SELECT *, y - avg(y) OVER (PARTITION BY sid, wid) AS c FROM h), r AS (SELECT x.sid, x.wid, x.pos - z.pos AS lag, round(sum(x.c * z.c), 2) AS r FROM c x JOIN c z ON z.sid = x.sid AND z.wid = x.wid AND x.pos > z.pos AND x.pos - z.pos < 84 GROUP BY ALL) "
       "SELECT sid, wid, lag AS period FROM r QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY r DESC, lag) = 1")  # fmt: skip
def periodicity(spark, sf_dir):
    return features.periodicity(hourly(spark, sf_dir))


@query(f"WITH {_panel('hour', *EVENTS)} SELECT sid, 3600::BIGINT AS seconds, 'H' AS frequency FROM s GROUP BY sid HAVING count(*) > 1")
def frequency_label(spark, sf_dir):
    panel = series.hourly_panel(spark, sf_dir)
    return features.frequency(panel.withColumn("ts", F.col("ts").cast("timestamp")))


def channels(spark, sf_dir):
    """Windows of purchases with each other event type as an outside channel: sid, wid, pos, other, y, x."""
    p = windows.points(hourly(spark, sf_dir))
    y = p.where("sid = 'purchase'").select("sid", "wid", "pos", "y")
    x = p.where("sid <> 'purchase'").select(F.col("sid").alias("other"), "wid", "pos", F.col("y").alias("x"))
    return y.join(x, ["wid", "pos"]).select("sid", "wid", "pos", "other", "y", "x")


def channel_rows(spark, sf_dir):
    """The same as a row a window and other channel; the windows are made once and written, since both sides read them."""
    folder, w = loops.shared_folder(spark, "channels"), hourly(spark, sf_dir).select("sid", "wid", "hist")
    w.write.parquet(folder)
    w = spark.read.schema(w.schema).parquet(folder)
    return features.paired(w.where("sid = 'purchase'"), w.where("sid <> 'purchase'").withColumnRenamed("sid", "other"))


_PAIRS = HOUR_SQL + ", pr AS (SELECT y.sid, y.wid, y.pos, x.sid AS other, y.y, x.y AS x FROM h y JOIN h x ON x.wid = y.wid AND x.pos = y.pos WHERE y.sid = 'purchase' AND x.sid <> 'purchase')"


@query(_PAIRS + f", c AS (SELECT sid, wid, other, round({_ACF.format('y', 'x')}, 6) AS c FROM pr GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY sid, wid ORDER BY abs(c) DESC, other) AS rank FROM c QUALIFY rank <= 3")
def tool_exogenous(spark, sf_dir):
    return features.exogenous_ranking(channels(spark, sf_dir))


@query(_PAIRS + f", g AS (SELECT y.sid, y.wid, y.other, l.l AS lag, round({_ACF.format('y.y', 'x.x')}, 6) AS c FROM pr y, (SELECT unnest(range(-8, 9)) AS l) l JOIN pr x ON x.sid = y.sid AND x.wid = y.wid AND x.other = y.other AND x.pos = y.pos - l.l GROUP BY ALL) "
       "SELECT sid, wid, other, lag, c AS peak FROM g QUALIFY row_number() OVER (PARTITION BY sid, wid, other ORDER BY abs(c) DESC, lag <> 0, lag) = 1")  # fmt: skip
def tool_cross_channel(spark, sf_dir):
    return features.lead_lag_rows(channel_rows(spark, sf_dir)).drop("correlation")


@query(_PAIRS + f", g AS (SELECT y.sid, y.wid, y.other, l.l AS lag, round({_ACF.format('y.y', 'x.x')}, 6) AS c FROM pr y, (SELECT unnest(range(-8, 9)) AS l) l JOIN pr x ON x.sid = y.sid AND x.wid = y.wid AND x.other = y.other AND x.pos = y.pos - l.l GROUP BY ALL) "
       "SELECT sid, wid, other, lag, c AS peak FROM g QUALIFY row_number() OVER (PARTITION BY sid, wid, other ORDER BY abs(c) DESC, lag <> 0, lag) = 1")  # fmt: skip
def cross_channel_of_points(spark, sf_dir):
    """The same for pairs that come as points: each point meets its lags by a join within the window."""
    return features.lead_lag(channels(spark, sf_dir))


@query(HOUR_SQL + " SELECT sid, wid, pos, round(CASE WHEN sd <= 1e-12 THEN 0 ELSE (y - m) / sd END, 6) AS z FROM (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS sd FROM h WINDOW w AS (PARTITION BY sid, wid))")
def zscore_windows(spark, sf_dir):
    w = hourly(spark, sf_dir).select("sid", "wid", F.posexplode(windows.zscored(F.col("hist"))).alias("pos", "z"))
    return w.select("sid", "wid", F.col("pos").cast("long").alias("pos"), rounded(F.col("z")).alias("z"))


@query(HOUR_SQL + f", {ARRAYS}, r AS (SELECT sid, wid, avg(y) AS m, stddev_pop(y) AS d, min(y) AS lo, max(y) AS hi, regr_slope(y, pos) AS s FROM h GROUP BY ALL), "
       "x AS (SELECT a.sid, a.wid, unnest(list_concat([m, d, lo, hi, s], list_transform(range(24), lambda i: a[(i * 167) // 23 + 1]))) AS v, unnest(range(29)) AS i FROM a JOIN r ON r.sid = a.sid AND r.wid = a.wid) SELECT sid, wid, i, round(v::FLOAT::DOUBLE, 2) AS v FROM x")  # fmt: skip
def embedding29(spark, sf_dir):
    w = hourly(spark, sf_dir).select("sid", "wid", F.posexplode(similarity.embedding(F.col("hist"))).alias("i", "v"))
    return w.select("sid", "wid", F.col("i").cast("long").alias("i"), rounded(F.col("v").cast("double"), 2).alias("v"))


@query("WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT query, vec_id AS item, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS sim FROM q, embeddings) "
       "SELECT query, item, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM p WHERE sim >= 0.1 QUALIFY rank <= 5")  # fmt: skip
def vector_topk(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    out = similarity.nearest(q, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("u")), 5, 0.1)
    return out.select("query", "item", rounded(F.col("sim")).alias("sim"), "rank")


@query(HOUR_SQL + f", {ARRAYS}, r AS (SELECT sid, wid, avg(y) AS m, stddev_pop(y) AS d, min(y) AS lo, max(y) AS hi, regr_slope(y, pos) AS s FROM h GROUP BY ALL), "
       "x AS (SELECT a.sid, a.wid, list_transform(list_concat([m, d, lo, hi, s], list_transform(range(24), lambda i: a[(i * 167) // 23 + 1])), lambda v: v::FLOAT::DOUBLE) AS v FROM a JOIN r ON r.sid = a.sid AND r.wid = a.wid), "
       "pq AS (SELECT q.sid, e.sid AS item_sid, e.wid AS item_wid, round(list_cosine_similarity(q.v, e.v), 9) AS sim FROM x q, x e WHERE q.wid = 0) SELECT sid, item_sid, item_wid, round(sim, 5) AS sim, row_number() OVER (PARTITION BY sid ORDER BY sim DESC, item_sid, item_wid) AS rank FROM pq WHERE sim >= 0.5 QUALIFY rank <= 3")  # fmt: skip
def window_retrieval(spark, sf_dir):
    """The windows most like the first one of each series, among all series, by their 29 values; cells that can't hold them are skipped."""
    folder = loops.shared_folder(spark, "embeddings")
    hourly(spark, sf_dir).select("sid", "wid", similarity.embedding(F.col("hist")).alias("u")).write.parquet(folder)
    w = spark.read.parquet(folder)
    e = w.select(F.struct("sid", "wid").alias("item"), "u")
    out = similarity.nearest_pruned(w.where("wid % 100 = 0").select(F.struct("sid", "wid").alias("query"), F.col("u").alias("v")), e, 3, 0.5)
    return out.select("query.sid", F.col("item.sid").alias("item_sid"), F.col("item.wid").alias("item_wid"), rounded(F.col("sim"), 5).alias("sim"), "rank")


_BEST = _models(HOURLY) + ", bm AS (SELECT sid, wid, model AS best_model, mse FROM err QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY mse, ord) = 1)"


@query(HOUR_SQL + ", " + _BEST + " SELECT sid, wid, best_model, round(mse, 3) AS mse FROM bm")
def case_best_model(spark, sf_dir):
    c = library.cases(hourly(spark, sf_dir), HOURLY)
    return c.select("sid", "wid", "best_model", rounded(F.col("mse"), 3).alias("mse"))


_CLUSTERS = _BEST + """, z AS (SELECT sid, wid, pos, CASE WHEN sd <= 1e-12 THEN 0 ELSE (y - m) / sd END AS z FROM (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS sd FROM h WINDOW w AS (PARTITION BY sid, wid))),
cn AS (SELECT sid, count(*) AS n FROM bm GROUP BY sid), md AS (SELECT sid, c AS cluster, CASE WHEN least(n, 6) <= 1 THEN 0 ELSE round_even(c * (n - 1) / (least(n, 6) - 1), 0)::BIGINT END AS wid FROM cn, (SELECT unnest(range(6)) AS c) WHERE c < least(n, 6)),
ds AS (SELECT z.sid, z.wid, md.cluster, round(sum((z.z - mz.z) * (z.z - mz.z)), 6) AS d FROM z JOIN md ON md.sid = z.sid JOIN z mz ON mz.sid = md.sid AND mz.wid = md.wid AND mz.pos = z.pos GROUP BY ALL),
asg AS (SELECT sid, wid, cluster FROM ds QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY d, cluster) = 1),
cm AS (SELECT asg.sid, cluster, best_model AS model, count(*) AS n FROM asg JOIN bm ON bm.sid = asg.sid AND bm.wid = asg.wid GROUP BY ALL),
kept AS (SELECT * FROM cm QUALIFY n > 3 OR max(n) OVER (PARTITION BY sid, cluster) <= 3),
cw AS (SELECT sid, cluster, model, n, n / sum(n) OVER (PARTITION BY sid, cluster) AS weight FROM kept)"""


@query(HOUR_SQL + ", " + _CLUSTERS + " SELECT sid, wid, cluster FROM asg")
def cluster_assign(spark, sf_dir):
    c = library.cases(hourly(spark, sf_dir), HOURLY)
    return library.assigned(c, library.medoids(c)).select("sid", "wid", "cluster")


@query(HOUR_SQL + ", " + _CLUSTERS + " SELECT sid, cluster, model, n, round(weight, 6) AS weight FROM cw")
def cluster_weights(spark, sf_dir):
    c = library.cases(hourly(spark, sf_dir), HOURLY)
    return library.cluster_weights(library.assigned(c, library.medoids(c))).withColumn("weight", rounded(F.col("weight")))


@query()
def k_medoids(spark, sf_dir):
    return library.k_medoids(library.cases(hourly(spark, sf_dir), HOURLY)).select("sid", "cluster", "medoid")


@query(HOUR_SQL + ", " + _CLUSTERS + """, mu AS (SELECT asg.sid, cluster, pos, avg(z) AS mu FROM asg JOIN z ON z.sid = asg.sid AND z.wid = asg.wid GROUP BY ALL),
dm AS (SELECT asg.sid, asg.cluster, asg.wid, round(sum((z - mu) * (z - mu)), 6) AS d FROM asg JOIN z ON z.sid = asg.sid AND z.wid = asg.wid JOIN mu ON mu.sid = asg.sid AND mu.cluster = asg.cluster AND mu.pos = z.pos GROUP BY ALL)
SELECT sid, cluster, wid AS medoid FROM dm QUALIFY row_number() OVER (PARTITION BY sid, cluster ORDER BY d, wid) = 1""")
def medoids_recentred(spark, sf_dir):
    c = library.cases(hourly(spark, sf_dir), HOURLY)
    return library.recentred(library.assigned(c, library.medoids(c))).select("sid", "cluster", "medoid")


def _similar(left: str, right: str, on: str) -> str:
    """sim: similarities of left (sid, wid, pos, v) with right (sid, item, pos, v)."""
    side = "SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd, v - lag(v) OVER (PARTITION BY sid, {0} ORDER BY pos) AS d FROM {1} WINDOW w AS (PARTITION BY sid, {0})"
    return f"""sa AS (SELECT *, CASE WHEN sd <= 1e-12 THEN 0 ELSE (v - m) / sd END AS z FROM ({side.format('wid', left)})), sb AS (SELECT *, CASE WHEN sd <= 1e-12 THEN 0 ELSE (v - m) / sd END AS z FROM ({side.format('item', right)})),
tr AS (SELECT sa.sid, sa.wid, sb.item, sum(sa.z * sb.z) AS dot, sqrt(sum(sa.z * sa.z)) * sqrt(sum(sb.z * sb.z)) AS nn, abs(regr_slope(sa.v, sa.pos) - regr_slope(sb.v, sb.pos)) AS sd,
       greatest(max(sa.v) - min(sa.v), max(sb.v) - min(sb.v), 1e-8) AS sp, stddev_pop(sa.d) AS va, stddev_pop(sb.d) AS vb, avg((sign(sa.d) = sign(sb.d))::INT) AS pt FROM sa JOIN sb ON sb.sid = sa.sid AND sb.pos = sa.pos {on} GROUP BY ALL),
sim AS (SELECT sid, wid, item, round(least(greatest(0.4 * CASE WHEN nn <= 1e-12 THEN 0 ELSE 0.5 + 0.5 * dot / nn END + 0.25 * exp(-sd / sp) + 0.2 * exp(-abs(va - vb) / greatest(va, vb, 1e-8)) + 0.15 * pt, 0), 1), 9) AS sim FROM tr)"""


@query(HOUR_SQL + ", l AS (SELECT sid, wid, pos, y AS v FROM h WHERE wid % 100 = 0), r AS (SELECT sid, wid AS item, pos, y AS v FROM h), " + _similar("l", "r", "") +
       " SELECT sid, wid, item, round(sim, 6) AS sim, row_number() OVER (PARTITION BY sid, wid ORDER BY sim DESC, item) AS rank FROM sim QUALIFY rank <= 3")
def case_topk(spark, sf_dir):
    w = hourly(spark, sf_dir)
    return library.similar_cases(w.where("wid % 100 = 0"), w).withColumn("sim", rounded(F.col("sim")))


_NEAREST = _CLUSTERS + ", l AS (SELECT sid, wid, pos, y AS v FROM h), r AS (SELECT md.sid, md.cluster AS item, z.pos, z.z AS v FROM md JOIN z ON z.sid = md.sid AND z.wid = md.wid), " + _similar("l", "r", "") + ", nc AS (SELECT sid, wid, item AS cluster, sim FROM sim QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY sim DESC, item) = 1)"


@query(HOUR_SQL + ", " + _NEAREST + " SELECT v.sid, v.wid, v.step, " + exact_sql("sum(cw.weight * v.yhat)", 4) + " AS yhat FROM v JOIN nc ON nc.sid = v.sid AND nc.wid = v.wid JOIN cw ON cw.sid = nc.sid AND cw.cluster = nc.cluster AND cw.model = v.model GROUP BY ALL")
def library_ensemble(spark, sf_dir):
    out = library.library_ensemble(hourly(spark, sf_dir), HOURLY)
    return out.select("sid", "wid", F.col("step").cast("long").alias("step"), exact(F.col("yhat"), 4).alias("yhat"))


@query(HOUR_SQL + ", " + _models(HOURLY) + " SELECT sid, wid, step, " + exact_sql("sum(yhat) / 3", 4) + " AS yhat FROM v GROUP BY ALL")
def primitive_ensemble(spark, sf_dir):
    f = forecasting.weighted(forecasting.forecasts(hourly(spark, sf_dir), HOURLY), forecasting.ensemble_weight(F.col("model")))
    return f.select("sid", "wid", F.col("step").cast("long").alias("step"), exact(F.col("yhat"), 4).alias("yhat"))


@query(HOUR_SQL + _STEPS + ", " + _PATTERN + ", " + _models(HOURLY) + """, st AS (SELECT dd.sid, dd.wid, avg(y) AS m, stddev_pop(y) AS sd, avg(y) FILTER (pos >= 156) AS level, round(regr_slope(y, pos), 6) AS slope, round(avg(d) FILTER (pos > 162), 6) AS mom FROM dd GROUP BY ALL),
bs AS (SELECT v.sid, v.wid, v.step, sum(yhat) / 3 + 0.2 * (0.7 * any_value(slope) + 0.3 * any_value(mom)) * (v.step + 1) AS y, any_value(m) AS m, any_value(sd) AS sd, any_value(level) AS level FROM v JOIN st ON st.sid = v.sid AND st.wid = v.wid GROUP BY v.sid, v.wid, v.step)
SELECT bs.sid, bs.wid, bs.step, """ + exact_sql("""least(greatest(CASE dominant_pattern WHEN 'flat' THEN 0.85 * y + 0.15 * level WHEN 'oscillation' THEN 0.95 * y + 0.05 * m ELSE y END, round(m - 3 * sd, 6)), round(m + 3 * sd, 6))""", 4) + """ AS yhat FROM bs JOIN ev ON ev.sid = bs.sid AND ev.wid = bs.wid""")  # fmt: skip
def deterministic_refine(spark, sf_dir):
    out = workflow.refined(hourly(spark, sf_dir), HOURLY)
    return out.select("sid", "wid", F.col("step").cast("long").alias("step"), exact(F.col("yhat"), 4).alias("yhat"))


_BENT = HOUR_SQL + _STEPS + ", " + _PATTERN + ", " + _models(HOURLY) + """, st AS (SELECT dd.sid, dd.wid, avg(y) AS m, stddev_pop(y) AS sd, avg(y) FILTER (pos >= 156) AS level, round(regr_slope(y, pos), 6) AS slope, round(avg(d) FILTER (pos > 162), 6) AS mom FROM dd GROUP BY ALL),
vv AS (SELECT v.sid, v.wid, v.step, sum(yhat) / 3 AS b, any_value(slope) AS slope, any_value(mom) AS mom, any_value(m) AS m, any_value(sd) AS sd, any_value(level) AS level, any_value(dominant_pattern) AS pat
       FROM v JOIN st ON st.sid = v.sid AND st.wid = v.wid JOIN ev ON ev.sid = v.sid AND ev.wid = v.wid GROUP BY v.sid, v.wid, v.step),
dr AS (SELECT *, b + 0.06 * mom * (step + 1) AS y FROM vv),
fc AS (SELECT sid, wid, step, 0 AS candidate, b + 0.2 * (0.7 * slope + 0.3 * mom) * (step + 1) AS y FROM vv UNION ALL
       SELECT sid, wid, step, 1, least(greatest(CASE pat WHEN 'flat' THEN 0.85 * y + 0.15 * level WHEN 'oscillation' THEN 0.95 * y + 0.05 * m ELSE y END, round(m - 3 * sd, 6)), round(m + 3 * sd, 6)) FROM dr),
er AS (SELECT fc.sid, fc.wid, candidate, avg((round(fc.y, 6) - f.y) * (round(fc.y, 6) - f.y)) AS mse, avg(abs(round(fc.y, 6) - f.y)) AS mae FROM fc JOIN f ON f.sid = fc.sid AND f.wid = fc.wid AND f.step = fc.step GROUP BY ALL)"""


def flaky_review(prompt: str) -> str:
    """A reviewer that is at times out of reach and passes a window after some attempts."""
    p = json.loads(prompt)
    if p["window"] % 5 == 4 and p["attempt"] == 1 or p["window"] % 7 == 6 and p["candidate"] == 1:
        raise TimeoutError("busy")
    return "PASS" if p["attempt"] > p["window"] % 4 else "FAIL: once more"


@query(_BENT + ", nd AS (SELECT *, greatest(wid % 4, (wid % 5 = 4)::INT) + 1 AS need FROM er WHERE candidate = 0) "
       "SELECT sid, wid, least(need, 3)::INT AS attempts, need <= 3 AS valid, CASE WHEN need <= 3 THEN 'PASS' ELSE 'FAIL: once more' END AS reflection, round(mse, 1) AS mse FROM nd")  # fmt: skip
def retry_loop(spark, sf_dir):
    """Windows are forecast again until the reviewer passes them, three times at most."""
    r = loops.run_windows(hourly(spark, sf_dir), HOURLY, loops.Clients(review=flaky_review, tries=1), loops.Limits(attempts=3))
    return r.select("sid", "wid", "attempts", "valid", "reflection", rounded(F.col("mse"), 1).alias("mse"))


@query(_BENT + """, tr AS (SELECT er.*, k.k, k.k > wid % 4 AND NOT (wid % 5 = 4 AND k.k = 1) AND NOT (wid % 7 = 6 AND candidate = 1) AS valid FROM er, (SELECT unnest(range(1, 4)) AS k) k),
ch AS (SELECT *, valid AND mse < 9000 AND mae < 60 AS excellent FROM tr QUALIFY row_number() OVER (PARTITION BY sid, wid, k ORDER BY NOT valid, mse, candidate) = 1),
ed AS (SELECT *, coalesce(min(CASE WHEN excellent THEN k END) OVER (PARTITION BY sid, wid), 3) AS attempts FROM ch)
SELECT sid, wid, candidate::INT AS candidate, k::INT AS attempt, attempts::INT AS attempts, excellent, valid AS save, round(mse, 1) AS mse FROM ed WHERE k <= attempts
QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY NOT valid, CASE WHEN valid THEN mse ELSE 0 END, CASE WHEN valid THEN k ELSE -k END) = 1""")
def memory_loop(spark, sf_dir):
    """Two schedules a window and round, the better valid one is chosen, excellent windows leave; three rounds at most."""
    r = loops.run_memory(hourly(spark, sf_dir), HOURLY, loops.Clients(review=flaky_review, tries=1), loops.Limits(3, 4, 9000.0, 60.0), train=False)
    return r.select("sid", "wid", "candidate", "attempt", "attempts", "excellent", "save", rounded(F.col("mse"), 1).alias("mse"))


def moody(y, horizon, season):
    """A model that fails on some histories and is too short on others."""
    k = int(y.mean() // 1) % 3
    if k == 0:
        raise ValueError("no")
    return np.full(horizon - (k == 1), y[-1])


@query(HOUR_SQL + ", " + _models(HOURLY) + """, st AS (SELECT sid, wid, floor(avg(y))::BIGINT % 3 AS k, max_by(y, pos) AS l FROM h GROUP BY ALL)
SELECT sid, wid, model, round(mse, 2) AS mse, NULL AS message FROM err WHERE model = 'SeasonalNaive' UNION ALL
SELECT st.sid, st.wid, 'Moody', CASE WHEN k = 2 THEN round(avg((l - f.y) * (l - f.y)), 2) END, CASE k WHEN 0 THEN 'ValueError: no' WHEN 1 THEN 'ValueError: forecast of shape (23,) for a horizon of 24' END FROM st JOIN f ON f.sid = st.sid AND f.wid = st.wid GROUP BY st.sid, st.wid, k, l""")
def isolated_models(spark, sf_dir):
    """A model that fails on some windows leaves the other's forecasts alone."""
    forecasting.plugged("Moody", moody)
    good, bad = forecasting.isolated(hourly(spark, sf_dir), HOURLY, ["SeasonalNaive", "Moody"])
    good = forecasting.scored(good).select("sid", "wid", "model", rounded(F.col("mse"), 2).alias("mse"), F.lit(None).cast("string").alias("message"))
    return good.unionByName(bad.select("sid", "wid", "model", F.lit(None).cast("double").alias("mse"), "message"))


def _built(spark, sf_dir):
    """A memory built twice in the same folder, in three commits."""
    folder, w = loops.shared_folder(spark, "built-memory"), hourly(spark, sf_dir)
    how = dict(batches=3, clients=loops.Clients(review=flaky_review, tries=1), limits=loops.Limits(3, 4, 9000.0, 60.0), train=False)
    memory.build(w, HOURLY, folder, **how)
    memory.build(w, HOURLY, folder, **how)
    return memory.read(spark, folder)


@query(HOUR_SQL + " SELECT sid AS dataset_name, wid::BIGINT AS idx, count(*) AS history, round(sum(y), 2) AS total, 'model_auxiliary_tool' AS first_tool FROM h WHERE wid % 4 < 3 GROUP BY ALL")
def memory_build(spark, sf_dir):
    """Entries of the windows that passed: one each, though the build ran twice."""
    e = _built(spark, sf_dir)
    series_ = answers.forecast_map(F.col("input_json"))
    return e.select("dataset_name", "idx", F.size(series_).cast("long").alias("history"), rounded(windows.total(F.map_values(series_)), 2).alias("total"), F.col("tool_calls")[0]["tool_name"].alias("first_tool"))


def responses(spark, sf_dir):
    """Forecasts as text: the last day before each window's future, in four spellings that wid picks, and the truth as JSON."""
    text = lambda a: F.transform(a, lambda x: x.cast("decimal(18,2)").cast("string"))
    w = hourly(spark, sf_dir).select("sid", "wid", text(F.slice("hist", 145, 24)).alias("p"), text(F.col("fut")).alias("t"))
    pairs = lambda a, q: F.array_join(F.transform(a, lambda x, i: F.concat(F.lit(q), i.cast("string"), F.lit(q + ": "), x)), ", ")
    k = F.col("wid") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("<think>so</think>\n<Answer>{"), pairs(F.col("p"), '"'), F.lit("}</Answer>")))
        .when(k == 1, F.concat(F.lit("<answer>["), F.array_join("p", ", "), F.lit("]</answer>")))
        .when(k == 2, F.concat(F.lit("<answer>{"), pairs(F.slice("p", 1, 23), "'"), F.lit("}</answer>")))
        .otherwise(F.array_join("p", " then "))
    )
    return w.select("sid", "wid", answer.alias("answer"), F.concat(F.lit("{"), pairs(F.col("t"), '"'), F.lit("}")).alias("ground_truth"))


def evaluated(spark, sf_dir):
    r = answers.settled(responses(spark, sf_dir), a=answers.forecast_map(F.col("answer")), g=answers.forecast_map(F.col("ground_truth")))
    r = answers.settled(r, p=answers.paired(F.col("a"), F.col("g")))
    return r.select("sid", "wid", "a", "g", *[c.alias(n) for n, c in answers.metrics(F.col("p")).items()])


_EVAL = HOUR_SQL + """, pt AS (SELECT f.sid, f.wid, f.y AS t, h.y AS p FROM f JOIN h ON h.sid = f.sid AND h.wid = f.wid AND h.pos = 144 + f.step WHERE NOT (f.wid % 4 = 2 AND f.step = 23)),
ms AS (SELECT sid, wid, avg((p - t) * (p - t)) AS mse, avg(abs(p - t)) AS mae, avg(t) AS m, var_pop(t) AS v, count(*) AS n FROM pt GROUP BY ALL),
ev AS (SELECT sid, wid, mse, mae, sqrt(mse) AS rmse, CASE WHEN v > 0 THEN mse / v END AS nmse, CASE WHEN abs(m) > 1e-10 THEN mae / abs(m) END AS nmae, CASE WHEN abs(m) > 1e-10 THEN sqrt(mse) / abs(m) END AS nrmse, n FROM ms)"""
#: Metrics and digits: mean errors of 24 values of two decimals end within 6.
_NAMES = {"mse": 3, "mae": 6, "rmse": 3, "nmse": 3, "nmae": 3, "nrmse": 3}


@query(_EVAL + " SELECT sid, wid, n, " + ", ".join(f"round({x}, {d}) AS {x}" for x, d in _NAMES.items()) + " FROM ev")
def evaluate_rows(spark, sf_dir):
    return evaluated(spark, sf_dir).select("sid", "wid", "n", *[rounded(F.col(x), d).alias(x) for x, d in _NAMES.items()])


@query(_EVAL + " SELECT count(*) AS total, count(mse) AS valid, count(*) - count(mse) AS invalid, " + ", ".join(f"round(avg({x}), 3) AS {x}" for x in _NAMES) + " FROM ev")
def evaluate_summary(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    return e.agg(F.count("*").alias("total"), F.count("mse").alias("valid"), (F.count("*") - F.count("mse")).alias("invalid"), *[rounded(F.avg(x), 3).alias(x) for x in _NAMES])


@query(_EVAL + """, sm AS (SELECT sid, wid, avg(y * y) AS small FROM f GROUP BY ALL), rw AS (SELECT ev.*, small, CASE WHEN mse <= 3000 THEN 1 - 0.9 * sin(pi() * mse / 6000) ELSE 0.3 * exp(-ln(3) * mse / 3000) END AS r FROM ev JOIN sm ON sm.sid = ev.sid AND sm.wid = ev.wid)
SELECT sid, wid, CASE WHEN wid % 4 = 2 THEN -0.8 ELSE round(r, 6) END AS absolute, CASE WHEN wid % 4 = 2 THEN -0.8 ELSE round(r + least(greatest((small - mse) / 30 * 5, -0.5), 0.5), 6) END AS contrastive FROM rw""")  # fmt: skip
def rewards(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    zeros = F.transform(F.map_values("g"), lambda v: v * v)
    small = F.aggregate(zeros, F.lit(0.0), lambda s, x: s + x) / F.size("g")
    penalty = answers.length_penalty(F.col("a"), F.col("g"))
    plain = answers.error_reward(F.col("mse"), F.lit(3000.0))
    better = answers.contrastive_reward(F.col("mse"), small, F.lit(3000.0), F.lit(30.0))
    return e.select("sid", "wid", rounded(F.coalesce(penalty, plain)).alias("absolute"), rounded(F.coalesce(penalty, better)).alias("contrastive"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k')::DOUBLE AS value FROM events")
def parse_json_map(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.explode(answers.forecast_map(F.col("props"))).alias("key", "value"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return exports.pending(rows, done, "o_orderkey")


@query(HOUR_SQL + ", " + _models(HOURLY) + " SELECT sid, wid, ord::INT AS candidate, mse < 15000 AS valid, round(mse, 3) AS mse FROM err QUALIFY row_number() OVER (PARTITION BY sid, wid ORDER BY NOT (mse < 15000), mse, ord) = 1")
def select_best_candidate(spark, sf_dir):
    f = forecasting.scored(forecasting.forecasts(hourly(spark, sf_dir), HOURLY)).select("sid", "wid", F.col("ord").alias("candidate"), (F.col("mse") < 15000).alias("valid"), "mse")
    return workflow.best_candidates(f, ["sid", "wid"]).withColumn("mse", rounded(F.col("mse"), 3))


_ROWS = ", ".join(str(tuple(r)) for r in DATASETS)
_LISTED = ", ".join(f"'{r[0]}'" for r in DATASETS)


@query(f"SELECT n.name, t.lookback, t.horizon, t.season, t.memory_stride, t.case_stride, count(*) AS customers FROM (SELECT coalesce([{_LISTED}][1 + c_custkey % 11], 'other') AS name FROM customer) n "
       f"LEFT JOIN (VALUES {_ROWS}) AS t(name, lookback, horizon, season, memory_stride, case_stride) ON t.name = n.name GROUP BY ALL")  # fmt: skip
def dataset_registry(spark, sf_dir):
    """Customers stand for series of datasets, some of no known one; the registry is joined by name."""
    names = F.array(*[F.lit(r[0]) for r in DATASETS])
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.coalesce(F.get(names, (F.col("c_custkey") % 11).cast("int")), F.lit("other")).alias("name"))
    rows = c.groupBy("name").agg(F.count("*").alias("customers")).join(F.broadcast(registry(spark)), "name", "left")
    return rows.select("name", "lookback", "horizon", "season", "memory_stride", "case_stride", "customers")


@query(f"WITH {_panel('hour', *EVENTS)}, c AS (SELECT sid, pos, y - avg(y) OVER (PARTITION BY sid) AS c, count(*) OVER (PARTITION BY sid) AS n FROM s), "
       "r AS (SELECT x.sid, x.pos - z.pos AS lag, round(sum(x.c * z.c), 2) AS r FROM c x JOIN c z ON z.sid = x.sid AND x.pos > z.pos AND x.pos - z.pos < x.n // 2 GROUP BY ALL), "
       "bl AS (SELECT sid, lag FROM r QUALIFY row_number() OVER (PARTITION BY sid ORDER BY r DESC, lag) = 1) "
       "SELECT s.sid, round(max(y), 2) AS max, round(min(y), 2) AS min, round(avg(y), 4) AS mean, round(var_pop(y), 1) AS variance, count(*) AS series_length, any_value(bl.lag) AS periodicity_lag, 'H' AS frequency FROM s JOIN bl ON bl.sid = s.sid GROUP BY s.sid")  # fmt: skip
def series_statistics(spark, sf_dir):
    panel = series.hourly_panel(spark, sf_dir)
    r = features.series_statistics(panel.withColumn("ts", F.col("ts").cast("timestamp")))
    return r.select("sid", F.round("max", 2).alias("max"), F.round("min", 2).alias("min"), rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("variance"), 1).alias("variance"), "series_length", "periodicity_lag", "frequency")


_TEN = """WITH e AS (SELECT event_type AS sid, date_diff('second', TIMESTAMP '2000-01-01', ts::TIMESTAMP) // 600 AS b, sum(value::DECIMAL(18,2))::DOUBLE AS y FROM events GROUP BY 1, 2),
lo AS (SELECT min(b) AS a, max(b) AS z FROM e), s AS (SELECT g.sid, g.b - lo.a AS pos, coalesce(e.y, 0) AS y FROM (SELECT sid, unnest(range(lo.a, lo.z + 1)) AS b FROM (SELECT DISTINCT sid FROM e), lo) g JOIN lo ON true LEFT JOIN e ON e.sid = g.sid AND e.b = g.b),
c AS (SELECT sid, pos, y - avg(y) OVER (PARTITION BY sid) AS c, count(*) OVER (PARTITION BY sid) AS n FROM s),
r AS (SELECT x.sid, x.pos - z.pos AS lag, round(sum(x.c * z.c), 2) AS r FROM c x JOIN c z ON z.sid = x.sid AND x.pos > z.pos AND x.pos - z.pos < x.n // 2 GROUP BY ALL)"""


@query(_TEN + " SELECT sid, lag AS periodicity_lag FROM r QUALIFY row_number() OVER (PARTITION BY sid ORDER BY r DESC, lag) = 1")
def periodicity_ten_minutes(spark, sf_dir):
    """The strongest of all lags up to half of some thousands of points a series: long enough for the transform in steps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bins = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600)
    cells = e.groupBy(F.col("event_type").alias("sid"), bins.alias("b")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("y"))
    low, high = cells.agg(F.min("b"), F.max("b")).first()
    grid = cells.select("sid").distinct().select("sid", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("b"))
    panel = grid.join(cells, ["sid", "b"], "left").select("sid", (F.col("b") - low).alias("pos"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return spectrum.whole_periodicity(panel)


@query(_PAIRS + f", g AS (SELECT y.sid, y.wid, y.other, l.l AS lag, round({_ACF.format('y.y', 'x.x')}, 6) AS c FROM pr y, (SELECT unnest(range(-8, 9)) AS l) l JOIN pr x ON x.sid = y.sid AND x.wid = y.wid AND x.other = y.other AND x.pos = y.pos - l.l GROUP BY ALL), "
       "pk AS (SELECT sid, wid, other, lag, c AS peak FROM g QUALIFY row_number() OVER (PARTITION BY sid, wid, other ORDER BY abs(c) DESC, lag <> 0, lag) = 1) "
       "SELECT pk.sid, pk.wid, pk.other, g.c AS correlation, pk.lag, peak FROM pk JOIN g ON g.sid = pk.sid AND g.wid = pk.wid AND g.other = pk.other AND g.lag = 0 QUALIFY row_number() OVER (PARTITION BY pk.sid, pk.wid ORDER BY abs(peak) DESC, pk.other) = 1")  # fmt: skip
def tool_strongest_channel(spark, sf_dir):
    return features.strongest_row(channel_rows(spark, sf_dir))


@query("SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT AS prompt_id FROM customer")
def prompt_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", texts.prompt_id(F.col("c_name")).alias("prompt_id"))


@query("SELECT event_id, '<think>' || event_type || '</think>' AS raw, event_type AS reasoning, props AS answer FROM events")
def think_and_answer(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.select("event_id", F.concat(F.lit("<think>"), "event_type", F.lit("</think>")).alias("raw"), F.concat(F.lit("<Think>\n"), "event_type", F.lit(" </Think>\n<ANSWER> "), "props", F.lit("\n</ANSWER>")).alias("t"))
    return t.select("event_id", "raw", texts.reasoning(F.col("t")).alias("reasoning"), texts.tagged_answer(F.col("t")).alias("answer"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k')::DOUBLE AS value FROM events UNION ALL SELECT event_id, '0', json_extract_string(props, '$.k')::DOUBLE FROM events")
def reward_columns(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    listed = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]"))
    both = e.select("event_id", F.explode(F.array("props", listed)).alias("t"))
    return both.select("event_id", F.explode(texts.reward_map(F.col("t"))).alias("key", "value"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'N' AND l_linestatus = 'F' OR l_returnflag = 'R' AND l_linenumber = 1))")
def memory_pending(spark, sf_dir):
    """Orders stand for windows, line items for entries: some name the dataset, some none, some another one."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("orders").alias("sid"), F.col("o_orderkey").alias("wid"), "o_custkey")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.when(F.expr("l_returnflag = 'N' AND l_linestatus = 'F'"), "").when(F.expr("l_returnflag = 'R' AND l_linenumber = 1"), "orders").otherwise("other")
    e = line.select(F.col("l_orderkey").alias("idx"), name.alias("dataset_name"), F.create_map().cast("map<string,double>").alias("metrics"))
    return memory.pending(o, e).select(F.col("wid").alias("o_orderkey"), "o_custkey")


@query("SELECT coalesce(event_type, '') AS dataset_name, count(*) AS entries, array_to_string(list_sort(list(DISTINCT user_id % 5)), ',') AS models FROM events GROUP BY 1")
def memory_sizes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("dataset_name"), (F.col("user_id") % 5).cast("string").alias("model_name"))
    return memory.sizes(e).withColumn("models", F.array_join("models", ","))


@query(HOUR_SQL + f", {ARRAYS} SELECT sid, wid, (i + 1)::INT AS step, round(a[168], 2) AS forecast, '1 hour' AS every FROM a, (SELECT unnest(range(24)) AS i)")
def last_value_steps(spark, sf_dir):
    w = hourly(spark, sf_dir).select("sid", "wid", workflow.last_value(F.col("hist"), 24).alias("forecast"))
    stamps = F.array(*[F.lit(f"2024-01-01 0{k}:00:00").cast("timestamp") for k in range(2)])
    rows = tables.forecast_steps(w, ["sid", "wid"])
    return rows.select("sid", "wid", "step", F.round("forecast", 2).alias("forecast"), texts.frequency_text(stamps).alias("every"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'model_auxiliary_tool,exogenous_analysis_tool,event_summary_tool' ELSE 'model_auxiliary_tool,exogenous_analysis_tool,data_quality_tool,statistical_analysis_tool,trend_analysis_tool,changepoint_trend_tool' END AS plan, "
       "CASE WHEN p_size % 2 = 0 THEN 3 WHEN p_size % 3 = 0 THEN 4 ELSE 3 END + CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 1 ELSE 0 END AS schedules FROM part")  # fmt: skip
def plans(spark, sf_dir):
    """A proposal for parts of even size, remembered tools under an older name for the others; outside channels for sizes divisible by three."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    even = F.col("p_size") % 2 == 0
    proposed = F.when(even, F.array(F.lit("event_summary_tool"), F.lit("no_tool"))).otherwise(F.array(F.lit("no_tool")))
    plan = workflow.planned(F.array(F.lit("data_quality_tool"), F.lit("statistical_analysis")), proposed)
    p = p.select("p_partkey", plan.alias("plan"), F.when(F.col("p_size") % 3 == 0, 3).otherwise(1).alias("channels"))
    return p.select("p_partkey", F.array_join("plan", ",").alias("plan"), F.size(workflow.candidate_schedules(F.col("plan"), F.col("channels"))).alias("schedules"))


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events)
SELECT user_id, event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS x FROM x""")
def exogenous_fill(spark, sf_dir):
    """Events of a user stand for points of a window; most values are unknown."""
    x = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", x.alias("x"))
    return series.exogenous_filled(rows, ["user_id"], "event_id", ["x"])


_PATHS = " ".join(f"WHEN contains(lower(url), '{part}') THEN '{name}'" for part, name in tables.PATH_NAMES)


@query(f"SELECT page_id, CASE {_PATHS} ELSE 'none' END AS dataset_name FROM pages")
def dataset_of_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", tables.dataset_in(F.col("url"), "none").alias("dataset_name"))


def _turns(spark, sf_dir):
    """Turns of conversations with the next turn as the response, blank in some conversations."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    blank = F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(F.col("response"))
    return c.join(after, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("prompt"), blank.alias("response"))


_TURNS = "WITH t AS (SELECT a.conv_id, a.turn, a.text AS prompt, CASE WHEN a.conv_id % 5 = 0 THEN '  ' ELSE b.text END AS response FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@query(_TURNS + " SELECT md5(prompt) AS p, md5(response) AS r, count(*) AS n FROM t WHERE trim(prompt) <> '' AND trim(response) <> '' GROUP BY ALL")
def sft_preparation(spark, sf_dir):
    return exports.prepare_sft(_turns(spark, sf_dir)).groupBy(F.md5("prompt").alias("p"), F.md5("response").alias("r")).agg(F.count("*").alias("n"))


@query(_TURNS + """ SELECT idx, md5(prompt) AS p, md5(CASE WHEN conv_id % 3 = 0 THEN 'truth' ELSE response END) AS g, CASE WHEN conv_id % 2 = 0 THEN 'NP' ELSE 'BE' END AS dataset_name, tool, 'time_series_forecasting' AS ability
FROM (SELECT *, conv_id * 1000 + turn AS idx, '' AS tool FROM t) WHERE trim(prompt) <> '' AND (conv_id % 3 = 0 OR trim(response) <> '')""")
def rl_preparation(spark, sf_dir):
    """The ground truth is blank in most conversations, the dataset's name in half of them."""
    t = _turns(spark, sf_dir).withColumn("idx", F.col("conv_id") * 1000 + F.col("turn"))
    t = t.withColumns({"ground_truth": F.when(F.col("conv_id") % 3 == 0, "truth").otherwise(" "), "dataset_name": F.when(F.col("conv_id") % 2 == 0, "").otherwise("BE")})
    return exports.prepare_rl(t, "NP").select("idx", F.md5("prompt").alias("p"), F.md5("ground_truth").alias("g"), "dataset_name", "tool", "ability")


@query("SELECT event_id, event_type AS first, user_id::VARCHAR AS last FROM events")
def first_and_last_answers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.concat(F.lit("so <answer> "), "event_type", F.lit("\n</answer> or <ANSWER>"), F.col("user_id").cast("string"), F.lit("</ANSWER> end"))
    return e.select("event_id", answers.first_answer(t).alias("first"), answers.last_answer(t).alias("last"))


@query("SELECT event_id, 'a' AS key, user_id::DOUBLE AS value FROM events UNION ALL SELECT event_id, 'b', 0.5 FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b', 1.5 FROM events WHERE event_id % 2 = 1")
def reference_predictions(spark, sf_dir):
    """The model tool's forecast in a list of calls, or alone in an object, by the sorted keys of the truth."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("user_id").cast("string")
    called = F.concat(F.lit('[{"tool_name":"other","output":{}},{"name":"model_auxiliary_tool","output":{"reference_prediction":['), n, F.lit(",0.5]}}]"))
    alone = F.concat(F.lit('{"tool_name":"model_auxiliary_tool","ensemble_forecast_baseline":['), n, F.lit(",1.5]}"))
    truth = F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(2.0))
    m = texts.baseline_map(texts.reference_prediction(F.when(F.col("event_id") % 2 == 0, called).otherwise(alone)), truth)
    return e.select("event_id", F.explode(m).alias("key", "value"))


@query("SELECT event_id, k - 1 AS place, [least(user_id, event_id), greatest(user_id, event_id)][k]::VARCHAR AS key FROM events, (SELECT unnest(range(1, 3)) AS k) UNION ALL SELECT event_id, 2, event_type FROM events")
def forecast_keys(spark, sf_dir):
    """Whole numbers by value, then texts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = F.array("event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.select("event_id", F.posexplode(texts.key_order(keys)).alias("place", "key")).withColumn("place", F.col("place").cast("long"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN s ELSE trim('kept' || chr(10) || s) END AS note FROM (SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 40) AS s FROM conversations)")
def notes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kept = F.when(F.col("turn") % 2 == 0, "").otherwise("kept")
    return c.select("conv_id", "turn", texts.with_note(kept, texts.compact(F.col("text"), 40)).alias("note"))


@query("""WITH w AS (SELECT l_orderkey AS query, l_returnflag || l_linestatus AS model, sum(greatest(10 * l_discount::DOUBLE - 0.3, 0) / greatest(coalesce(CASE WHEN l_linenumber < 5 THEN l_tax::DOUBLE * 100 END, 1e6), 1e-8)) AS w FROM lineitem GROUP BY ALL)
SELECT query, model, round(coalesce(w / nullif(sum(w) OVER (PARTITION BY query), 0), 0), 6) AS weight FROM w""")
def case_error_weights(spark, sf_dir):
    """Lines of an order stand for similar cases of a query, flags for models; some errors are unknown."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("query"), F.concat("l_returnflag", "l_linestatus").alias("model"), (10 * F.col("l_discount").cast("double") - 0.3).alias("similarity"),
        F.when(F.col("l_linenumber") < 5, F.col("l_tax").cast("double") * 100).alias("error"),
    )
    return forecasting.inverse_error_weights(rows).withColumn("weight", rounded(F.col("weight")))


@query("SELECT p_partkey, 0 AS place, 'statistical_analysis' AS tool_name, p_size::VARCHAR AS output FROM part UNION ALL SELECT p_partkey, 1, 'event_summary_tool', p_name FROM part WHERE p_size % 2 = 0")
def older_tool_calls(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    outputs = F.map_filter(F.create_map(F.lit("event_summary_tool"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.lit("statistical_analysis_tool"), F.col("p_size").cast("string")), lambda k, v: v.isNotNull())
    calls = workflow.older_calls(workflow.names(("statistical_analysis_tool", "data_quality_tool", "event_summary_tool")), outputs)
    return p.select("p_partkey", F.posexplode(calls).alias("place", "c")).select("p_partkey", F.col("place").cast("int").alias("place"), "c.tool_name", "c.output")


@query("""SELECT p_partkey, '### model_auxiliary_tool' || chr(10) || '""" + texts.ABOUT["model_auxiliary_tool"] + """' || chr(10) || '```json' || chr(10) || '{"reference_prediction":[' || p_size || ',2.5]}' || chr(10) || '```' || chr(10) || chr(10)
|| '### exogenous_analysis_tool' || chr(10) || '""" + texts.ABOUT["exogenous_analysis_tool"] + """' || chr(10) || '```json' || chr(10) || '{"top_k_names":["load","price"]}' || chr(10) || '```' || chr(10) || chr(10) || 'Future values of outside channels:' || chr(10) || '```json' || chr(10)
|| '{"load":{"mean":' || m || ',"std":' || CASE WHEN p_size = 1 THEN '0.0' WHEN p_size % 2 = 0 THEN abs(p_size - 1) // 2 || '.5' ELSE (p_size - 1) // 2 || '.0' END || ',"min":1.0,"max":' || p_size || '.0,"trend":"' || CASE WHEN p_size > 1 THEN 'increasing' ELSE 'decreasing' END || '","values":[1.0,' || p_size || '.0]}}' || chr(10) || '```' AS section
FROM (SELECT *, CASE WHEN p_size % 2 = 1 THEN (p_size + 1) // 2 || '.0' ELSE p_size // 2 || '.5' END AS m FROM part)""")
def tool_sections(spark, sf_dir):
    """The model tool is cut down to its reference, and of the outside channels those that the tool named come with what is known of the horizon."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    aux = F.concat(F.lit('{"reference_prediction":['), size, F.lit(',2.5],"weights":{"a":1.0}}'))
    outside = '{"top_k_names":["load","price"]}'
    outputs = F.create_map(F.lit("model_auxiliary_tool"), aux, F.lit("exogenous_analysis_tool"), F.lit(outside))
    channel = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("values"))
    known = F.array(channel("wind", F.array(F.lit(1.0))), channel("load", F.array(F.lit(None).cast("double"), F.lit(1.0), F.col("p_size").cast("double"), F.lit(9.0))), channel("price", F.array().cast("array<double>")))
    section = texts.tool_section(workflow.names(workflow.MANDATORY), outputs)
    return p.select("p_partkey", texts.with_context(section, texts.future_context(known, texts.named_channels(F.lit(outside)), 2)).alias("section"))


@query(_PAIRS + f", c AS (SELECT sid, wid, other, round({_ACF.format('y', 'x')}, 6) AS c FROM pr WHERE pos % 5 <> 0 AND pos % 7 <> 0 AND pos % 11 <> 0 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY sid, wid ORDER BY abs(c) DESC, other) AS rank FROM c QUALIFY rank <= 3")
def exogenous_with_gaps(spark, sf_dir):
    """Channels with NaN, infinite and unknown values: only points where both values are finite count."""
    x = F.when(F.col("pos") % 5 == 0, float("nan")).when(F.col("pos") % 7 == 0, float("inf")).when(F.col("pos") % 11 != 0, F.col("x"))
    return features.exogenous_ranking(channels(spark, sf_dir).withColumn("x", x))


def stamped(spark, sf_dir):
    return windows.sliding(series.hourly_panel(spark, sf_dir), HOURLY, stamps=True)


@query(HOUR_SQL + f", u AS (SELECT sid, min(ts) AS t0 FROM s GROUP BY sid), {ARRAYS} SELECT a.sid, a.wid::BIGINT AS idx, 'load' AS target_col, 168 AS lookback, 24 AS horizon, '' AS tool, strftime(t0 + to_hours(24 * a.wid), '%Y-%m-%d %H:%M:%S') AS first, strftime(t0 + to_hours(24 * a.wid + 168), '%Y-%m-%d %H:%M:%S') AS next, "
       "round(list_sum(a), 2) AS input, round(list_sum(t), 2) AS truth, true AS hour FROM a JOIN t ON t.sid = a.sid AND t.wid = a.wid JOIN u ON u.sid = a.sid")  # fmt: skip
def prompt_rows(spark, sf_dir):
    """The eight columns of a prompt table; series as JSON are told by their first stamps and sums."""
    w = stamped(spark, sf_dir)
    rows = tables.prompts_of(w.withColumn("wid", F.struct("sid", "wid")), "load", 168, 24)
    first = lambda c: F.array_min(F.map_keys(answers.forecast_map(F.col(c))))
    add = lambda c: rounded(windows.total(F.map_values(answers.forecast_map(F.col(c)))), 2)
    return rows.select("idx.sid", F.col("idx.wid").alias("idx"), "target_col", "lookback", "horizon", "tool", first("input").alias("first"), first("ground_truth").alias("next"), add("input").alias("input"), add("ground_truth").alias("truth"), F.col("prompt").contains("every 1 hour").alias("hour"))


@query(_BENT + """ SELECT er.sid, er.wid::BIGINT AS idx, round(mse, 1) AS mse, round(mae, 3) AS mae, 'PASS' AS reflection, 24 AS answer, 24 AS truth, '["model_auxiliary_tool","exogenous_analysis_tool","statistical_analysis_tool","trend_analysis_tool","changepoint_trend_tool"]' AS tools FROM er WHERE candidate = 0""")
def window_forecasts(spark, sf_dir):
    """The whole workflow without remote models: a row a window as the forecast table has it."""
    w = stamped(spark, sf_dir)
    rows = tables.forecast_rows(loops.run_windows(w, HOURLY), w)
    n = lambda c: F.size(answers.forecast_map(F.col(c)))
    return rows.select("sid", "idx", rounded(F.col("mse"), 1).alias("mse"), rounded(F.col("mae"), 3).alias("mae"), "reflection", n("answer").alias("answer"), n("ground_truth").alias("truth"), "tools")


@query(HOUR_SQL + ", " + _NEAREST + ", vt AS (SELECT sid, cluster, sum(n) AS votes FROM cw GROUP BY ALL) SELECT v.sid, v.wid, v.step, any_value(nc.cluster)::BIGINT AS cluster, any_value(vt.votes)::BIGINT AS votes, 3 AS cases, " + exact_sql("sum(cw.weight * v.yhat)", 4) + " AS yhat FROM v JOIN nc ON nc.sid = v.sid AND nc.wid = v.wid JOIN cw ON cw.sid = nc.sid AND cw.cluster = nc.cluster AND cw.model = v.model JOIN vt ON vt.sid = nc.sid AND vt.cluster = nc.cluster GROUP BY ALL")
def library_tool(spark, sf_dir):
    """The model tool by a library: its forecast, the cluster and its votes, and the similar cases."""
    w = hourly(spark, sf_dir)
    t = library.built(w, HOURLY, loops.shared_folder(spark, "library"))
    rows = library.anchored(t["cases"].select("sid", "wid", "hist"), HOURLY, t)
    votes = F.aggregate(F.map_values("best_model"), F.lit(0).cast("long"), lambda s, x: s + x)
    out = rows.select("sid", "wid", F.col("selected_cluster").alias("cluster"), votes.alias("votes"), F.size("anchor_cases").alias("cases"), F.posexplode("reference_prediction").alias("step", "yhat"))
    return out.select("sid", "wid", F.col("step").cast("long").alias("step"), "cluster", "votes", "cases", exact(F.col("yhat"), 4).alias("yhat"))


_NAMED = "CASE ev.sid WHEN 'click' THEN 'windy' WHEN 'purchase' THEN 'SP' WHEN 'view' THEN 'BE' ELSE 'none' END"


@query(_EVAL + f""", sm AS (SELECT sid, wid, avg(y * y) AS small FROM f GROUP BY ALL), bd AS (SELECT ev.*, small, {_NAMED} AS name FROM ev JOIN sm ON sm.sid = ev.sid AND sm.wid = ev.wid),
rb AS (SELECT *, CASE name WHEN 'windy' THEN 3000 WHEN 'SP' THEN 50 WHEN 'BE' THEN 800 ELSE 10 END AS b, CASE name WHEN 'windy' THEN 30 WHEN 'SP' THEN 3 ELSE 10 END AS rl FROM bd),
rw AS (SELECT *, CASE WHEN mse <= b THEN 1 - 0.9 * sin(pi() * mse / (2 * b)) ELSE 0.3 * exp(-ln(3) * mse / b) END AS r FROM rb)
SELECT sid, wid, CASE WHEN wid % 4 >= 2 THEN -1.0 ELSE round(r, 6) END AS absolute, CASE WHEN wid % 4 >= 2 THEN -1.0 ELSE round(r + least(greatest((small - mse) / rl * 5, -0.5), 0.5), 6) END AS contrastive FROM rw""")
def reward_dispatch(spark, sf_dir):
    """Rewards of texts by the dataset's bounds; answers that are no JSON cost all. The baseline is a list of zeros."""
    sid = F.col("sid")
    name = F.when(sid == "click", "windy").when(sid == "purchase", "SP").when(sid == "view", "BE").otherwise("none")
    r = responses(spark, sf_dir).withColumns({"dataset_name": name, "baseline": F.array_repeat(F.lit(0.0), 24)})
    both = answers.rewarded(answers.rewarded(r, contrastive=False).withColumnRenamed("reward", "absolute"))
    return both.select("sid", "wid", rounded(F.col("absolute")).alias("absolute"), rounded(F.col("reward")).alias("contrastive"))


@query(HOUR_SQL + " SELECT DISTINCT sid, wid FROM h WHERE wid % 2 = 0 AND wid % 4 <> 2")
def resumable_answers(spark, sf_dir):
    """Earlier answers that count: half of the truths are unknown, and some answers are blank."""
    r = responses(spark, sf_dir).withColumn("idx", F.xxhash64("sid", "wid"))
    done = r.select("idx", "sid", "wid", F.when(F.col("wid") % 4 == 2, " ").otherwise(F.col("answer")).alias("answer"))
    return exports.valid_answers(done, r.where("wid % 2 = 0").select("idx", "ground_truth")).select("sid", "wid")


@query(HOUR_SQL + f", {ARRAYS}, g AS (SELECT sid, wid, regr_slope(y, pos) AS s, avg(y) AS m FROM h GROUP BY ALL) SELECT g.sid, g.wid, CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'flat' END AS trend, round(s, 6) AS slope, "
       + exact_sql("avg((a.a[144 + f.step + 1] - f.y) * (a.a[144 + f.step + 1] - f.y))", 3) + " AS seasonal, " + exact_sql("avg(abs(g.m - f.y))", 5) + " AS average FROM g JOIN a ON a.sid = g.sid AND a.wid = g.wid JOIN f ON f.sid = g.sid AND f.wid = g.wid GROUP BY g.sid, g.wid, s, m")
def sql_windows(spark, sf_dir):
    """Windows, features, forecasts and errors by SQL alone."""
    surface.register(spark)
    series.hourly_panel(spark, sf_dir).createOrReplaceTempView("hourly_series")
    return spark.sql("""
        WITH i AS (SELECT sid, pos, y, window_ids(pos, 192, 24) AS ids FROM hourly_series),
        p AS (SELECT sid, pos, y, explode(ids) AS wid FROM i),
        g AS (SELECT sid, wid, collect_list(struct(pos, y)) AS a FROM p GROUP BY sid, wid HAVING count(*) = 192),
        w AS (SELECT sid, wid, window_values(a) AS a FROM g),
        h AS (SELECT sid, wid, slice(a, 1, 168) AS hist, slice(a, 169, 24) AS fut FROM w)
        SELECT sid, wid, trend_direction(hist) AS trend, round(array_slope(hist), 6) + 0D AS slope, 
               CAST(round(CAST(squared_error(forecast_seasonal(hist, 24, 24), fut) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS seasonal,
               CAST(round(CAST(absolute_error(forecast_average(hist, 24), fut) AS DECIMAL(28, 9)), 5) AS DOUBLE) AS average FROM h
    """)


@query("""WITH e AS (SELECT event_type AS sid, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(round(value * 100)::BIGINT)::BIGINT AS v FROM events GROUP BY ALL),
g AS (SELECT sid, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM e GROUP BY sid), s AS (SELECT g.sid, g.ts, coalesce(e.v, 0) / 100 AS y FROM g LEFT JOIN e ON e.sid = g.sid AND e.ts = g.ts),
q AS (SELECT sid, ts, y, row_number() OVER w AS n, lag(y, 23) OVER w AS f0, lag(y, 18) OVER w AS f5 FROM s WINDOW w AS (PARTITION BY sid ORDER BY ts)) SELECT sid, strftime(ts, '%Y-%m-%d %H') AS hour, y, f0, f5, 12 AS horizon FROM q WHERE n >= 48""")
def closed_hour_forecasts(spark, sf_dir):
    """What the stream gives, of the whole table: a forecast of the next hours at each closed hour."""
    f = latest.hourly_forecasts(spark.read.parquet(f"{sf_dir}/events.parquet"), WindowSpec(48, 12, 1, 24))
    return f.select("sid", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "y", F.get("forecast", F.lit(0)).alias("f0"), F.get("forecast", F.lit(5)).alias("f5"), F.size("forecast").alias("horizon"))


@query(HOUR_SQL + """ SELECT DISTINCT sid, wid, CASE WHEN wid % 5 = 1 THEN '23 values for a horizon of 24' WHEN wid % 5 IN (2, 3) THEN 'some values are no finite numbers' WHEN wid % 5 = 4 THEN 'there is no forecast'
WHEN sid = 'click' THEN 'I say fail' ELSE 'PASS' END AS verdict, wid % 5 = 0 AND sid = 'view' AS excellent FROM h""")
def forecast_verdicts(spark, sf_dir):
    """Whole, short, partly unknown, infinite and missing forecasts; a reviewer fails one series and is of two minds on another."""
    w = hourly(spark, sf_dir)
    k, day = F.col("wid") % 5, F.slice("hist", 145, 24)
    odd = lambda v: F.transform(day, lambda x, i: F.when(i == 3, F.lit(v).cast("double")).otherwise(x))
    f = F.when(k == 0, day).when(k == 1, F.slice("hist", 1, 23)).when(k == 2, odd(float("nan"))).when(k == 3, odd(float("inf")))
    said = F.when(F.col("sid") == "click", "I say fail").when(F.col("sid") == "purchase", "FAIL? no, PASS")
    good = workflow.excellent(F.when(F.col("sid") == "view", 1.0).otherwise(200.0), F.when(k == 0, 1.0))
    return w.select("sid", "wid", workflow.verdict(f, 24, said).alias("verdict"), good.alias("excellent"))


@query(HOUR_SQL + " SELECT sid, wid, count(*) AS points, round(sum(y), 2) AS total FROM p WHERE wid < 3 GROUP BY ALL")
def windows_capped(spark, sf_dir):
    w = windows.sliding(series.hourly_panel(spark, sf_dir), HOURLY, cap=3)
    whole = F.concat("hist", "fut")
    return w.select("sid", "wid", F.size(whole).cast("long").alias("points"), rounded(windows.total(whole), 2).alias("total"))


@query(HOUR_SQL + f", {ARRAYS} SELECT sid, wid, round(a[145], 2) AS first, round(list_sum(a[145:]), 2) AS cut, round(list_sum(a) + 32 * a[1], 2) AS padded FROM a")
def aligned_windows(spark, sf_dir):
    """Histories brought to 24 and to 200 values."""
    w = hourly(spark, sf_dir)
    short, long = windows.aligned(F.col("hist"), 24), windows.aligned(F.col("hist"), 200)
    return w.select("sid", "wid", F.round(F.get(short, F.lit(0)), 2).alias("first"), rounded(windows.total(short), 2).alias("cut"), rounded(windows.total(long), 2).alias("padded"))


@query(HOUR_SQL + ", " + _models(HOURLY) + " SELECT sid, wid, CASE WHEN wid % 3 = 2 THEN round(mse, 3) ELSE 1e12 END AS mse FROM err WHERE model = 'SeasonalNaive'")
def finite_errors(spark, sf_dir):
    """Errors of forecasts that hold what is no number, or infinity."""
    w = hourly(spark, sf_dir)
    f = forecasting.seasonal_naive(F.col("hist"), HOURLY)
    odd = F.transform(f, lambda x, i: F.when((i == 5) & (F.col("wid") % 3 == 0), float("nan")).when((i == 5) & (F.col("wid") % 3 == 1), float("inf")).otherwise(x))
    return w.select("sid", "wid", rounded(forecasting.squared_error(odd, F.col("fut")), 3).alias("mse"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'trend_analysis_tool,' || p_name WHEN p_size % 3 = 1 THEN 'exogenous_analysis_tool,event_summary_tool' ELSE '' END AS tools FROM part")
def tools_in_texts(spark, sf_dir):
    """A planner's answer: JSON with any names, known names in loose text in their own order, or none."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    listed = F.concat(F.lit('plan:\n{"tools": ["trend_analysis_tool", "'), "p_name", F.lit('"]} ok'))
    t = F.when(F.col("p_size") % 3 == 0, listed).when(F.col("p_size") % 3 == 1, "event_summary_tool, then (exogenous_analysis_tool) and my_trend_analysis_tool2").otherwise(F.col("p_name"))
    return p.select("p_partkey", F.array_join(workflow.named_tools(t), ",").alias("tools"))


@query("""SELECT event_id AS idx, event_type AS dataset_name, '{"a":' || user_id || '}' AS input, '' AS ground_truth, '[{"tool_name":"t","output":"' || event_type || '"}]' AS tool, 'p' || user_id AS prompt,
'<think> why ' || event_type || ' </think><answer>' || user_id || '</answer>' AS response, 'why ' || event_type AS reasoning, user_id::VARCHAR AS answer FROM events""")
def sft_export(spark, sf_dir):
    """Training rows of memory entries."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id").cast("string")
    entries = e.select(
        F.col("event_id").alias("idx"), F.col("event_type").alias("dataset_name"), F.concat(F.lit('{"a":'), user, F.lit("}")).alias("input_json"), F.lit(None).cast("string").alias("ground_truth"),
        F.array(F.struct(F.lit("t").alias("tool_name"), F.col("event_type").alias("output"))).alias("tool_calls"), F.concat(F.lit("p"), user).alias("forecast_full_prompt"),
        F.concat(F.lit("<think> why "), "event_type", F.lit(" </think><answer>"), user, F.lit("</answer>")).alias("Forecasting_answer"),
    )
    return exports.ordered_export(tables.sft_rows(entries))


@query(f"WITH {_panel('day', 'orders', chr(39) + 'orders' + chr(39), 'o_orderdate', 'o_totalprice')} SELECT strftime(ts, '%Y-%m-%d') AS day, (row_number() OVER (ORDER BY ts) - 1)::BIGINT AS pos, round(y, 2) AS y FROM s WHERE pos % 7 <> 3")
def csv_series(spark, sf_dir):
    """A table written as CSV with a text column and values that are no numbers, and loaded with its roles inferred."""
    folder = loops.shared_folder(spark, "csv-series")
    panel = series.daily_orders(spark, sf_dir)
    value = F.when(F.col("pos") % 7 == 3, "n/a").otherwise(F.col("y").cast("decimal(18,2)").cast("string"))
    panel.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit('a "b", c').alias("note"), (F.col("pos") % 5).alias("answer"), value.alias("load")).write.csv(folder, header=True, escape='"')
    got = series.load_series(spark, folder)
    return got.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "pos", F.round("y", 2).alias("y"))


@query("SELECT idx, md5(prompt) AS prompt, md5(answer) AS answer FROM (SELECT (conv_id * 1000 + turn)::VARCHAR AS idx, text AS prompt, role || chr(10) || ',\"' || coalesce(text, '') AS answer FROM conversations WHERE text IS NOT NULL)")
def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and line ends through a CSV table and back."""
    folder = loops.shared_folder(spark, "csv-table")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    tables.write_csv(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("prompt"), F.concat("role", F.lit('\n,"'), "text").alias("answer"), F.lit("").alias("ground_truth")), folder)
    tables.evaluation_rows(spark, folder)
    return tables.prompt_rows(spark, folder).select("idx", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR END AS index, 'NP' AS dataset_name FROM orders")
def rl_rows(spark, sf_dir):
    """Rows of several files; the index of those without one is their place in the table."""
    folder = loops.shared_folder(spark, "rl-NP")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    info = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"idx": "x'), F.col("o_orderkey").cast("string"), F.lit('"}'))).otherwise("no json")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))  # as many as any other shuffle has tasks, so a file doesn't grow with the table
    rows = o.select("o_orderkey", F.lit("p").alias("prompt"), F.lit("g").alias("ground_truth"), info.alias("extra_info")).repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey")
    rows.write.parquet(folder)
    return tables.rl_rows(spark, folder).select("o_orderkey", F.element_at("extra_info", F.lit("index")).alias("index"), "dataset_name")


@query("SELECT 'prompt_' || user_id AS task, event_id::VARCHAR AS rollout_id, CASE WHEN event_id % 4 > 0 THEN value END AS reward FROM events")
def rollout_files(spark, sf_dir):
    """Rollouts written as JSON lines in order of prompts, what isn't finite as null, and read back."""
    folder = loops.shared_folder(spark, "rollouts")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value"))
    tables.write_rollouts(e.select(F.col("user_id").alias("idx"), F.concat(F.lit("ro-"), F.col("event_id").cast("string")).alias("rollout_id"), F.lit("p").alias("prompt"), F.lit("a").alias("answer"), F.lit("g").alias("ground_truth"), odd.alias("reward"), F.lit(1.0).alias("mse")), folder)
    return spark.read.schema("rollout_id string, reward double, task string").json(folder).select("task", "rollout_id", "reward")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error of three naive forecasts of the next 24 hours of each event type."""
    f = forecasting.scored(forecasting.forecasts(hourly(spark, sf_dir), HOURLY))
    return f.groupBy("model").agg(F.count("*").alias("windows"), F.round(F.avg("mse"), 4).alias("mse"))
