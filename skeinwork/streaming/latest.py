"""Forecasts of an event stream: hourly sums by series, and a forecast whenever an hour closes.

An hour closes when the watermark passes its end. The state of a series is what its open hours hold and the last `lookback` closed
ones; hours without events count as 0, as in the batch panel, so the stream gives what hourly_forecasts() gives on the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinwork.operators.forecasting import seasonal_naive
from skeinwork.plans.registry import WindowSpec

HOUR = 3600
FORECASTS = "sid string, ts timestamp, y double, forecast array<double>"
STATE = "closed long, past array<long>, hours array<long>, sums array<long>"


def cents(events: DataFrame) -> DataFrame:
    """sid, ts, v: event values in hundredths, so that sums don't depend on the order."""
    return events.select(F.col("event_type").alias("sid"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("v"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """sid, ts, y of each closed hour that has events; events later than the watermark are left out."""
    sums = cents(events).withWatermark("ts", late).groupBy("sid", F.window("ts", "1 hour").alias("w")).agg(F.sum("v").alias("v"))
    return sums.select("sid", F.col("w.start").alias("ts"), (F.col("v") / 100).alias("y"))


def forecast_stream(events: DataFrame, spec: WindowSpec, late: str = "2 hours") -> DataFrame:
    """sid, ts, y, forecast: for each closed hour of each series its sum and the seasonal forecast of the hours after it, once the series has
    `lookback` closed hours. State holds at most lookback closed hours and the open ones a series.
    """
    lookback, horizon, season = spec.lookback, spec.horizon, spec.season

    def closed_hours(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, past, hours, sums = state.get if state.exists else (-1, [], [], [])
        past, open_ = list(past), dict(zip(hours, sums, strict=True))
        edge = state.getCurrentWatermarkMs() // 1000 // HOUR  # hours before this one are closed
        for part in parts:
            by = part["v"].groupby(part["ts"].astype("datetime64[s]").astype("int64") // HOUR).sum()
            for hour, v in by.items():
                if hour > closed:
                    open_[int(hour)] = open_.get(int(hour), 0) + int(v)
        out = []
        while open_ and (now := closed + 1 if closed >= 0 else min(open_)) < edge:
            past = [*past, open_.pop(now, 0)][-lookback:]
            closed = now
            if len(past) == lookback:
                tail = past[-min(season, lookback) :]
                out.append((key[0], pd.Timestamp(now * HOUR, unit="s"), past[-1] / 100, [tail[h % len(tail)] / 100 for h in range(horizon)]))
        state.update((closed, past, list(open_), list(open_.values())))
        if open_:
            state.setTimeoutTimestamp(max((min(open_) + 1) * HOUR * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sid", "ts", "y", "forecast"])

    rows = cents(events).withWatermark("ts", late)
    return rows.groupBy("sid").applyInPandasWithState(closed_hours, FORECASTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_forecasts(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """The same of a whole table: hours from the first to the last event of each series, gaps as 0."""
    from skeinwork.operators import windows

    cells = cents(events).groupBy("sid", F.floor(F.unix_timestamp("ts") / HOUR).alias("h")).agg(F.sum("v").alias("v"))
    span = cells.groupBy("sid").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    spine = span.select("sid", F.posexplode(F.sequence("a", "b")).alias("pos", "h"))
    panel = spine.join(cells, ["sid", "h"], "left").select("sid", F.col("pos").cast("long").alias("pos"), (F.coalesce("v", F.lit(0)) / 100).alias("y"), "h")
    w = windows.sliding(panel, WindowSpec(spec.lookback - 1, 1, 1, spec.season)).select("sid", "wid", F.concat("hist", "fut").alias("hist"))
    at = span.select("sid", "a")
    stamp = F.timestamp_seconds((F.col("a") + F.col("wid") + spec.lookback - 1) * HOUR)
    return w.join(at, "sid").select("sid", stamp.alias("ts"), F.element_at("hist", -1).alias("y"), seasonal_naive(F.col("hist"), spec).alias("forecast"))


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append closed hours as Parquet until the source's present end."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
