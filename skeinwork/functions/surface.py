"""The forecasting functions in SQL: temporary functions of the session that Catalyst inlines, so that a query needs no Python.

register(spark) defines them; series tables have sid, pos, y. A window's history is an array, as in operators.windows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: arguments, type, body.
FUNCTIONS = {
    "window_ids": ("pos BIGINT, span INT, step INT", "ARRAY<BIGINT>", "CASE WHEN CAST(greatest(0, ceil((pos - span + 1) / step)) AS BIGINT) <= pos div step THEN sequence(CAST(greatest(0, ceil((pos - span + 1) / step)) AS BIGINT), pos div step) ELSE CAST(array() AS ARRAY<BIGINT>) END"),
    "window_values": ("points ARRAY<STRUCT<pos: BIGINT, y: DOUBLE>>", "ARRAY<DOUBLE>", "transform(array_sort(points), p -> p.y)"),
    "array_total": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x)"),
    "array_mean": ("a ARRAY<DOUBLE>", "DOUBLE", "try_divide(array_total(a), size(a))"),
    "array_deviation": ("a ARRAY<DOUBLE>", "DOUBLE", "get(transform(array(array_mean(a)), m -> sqrt(aggregate(a, 0D, (s, x) -> s + (x - m) * (x - m)) / greatest(size(a), 1))), 0)"),
    "array_zscores": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "get(transform(array(struct(array_mean(a) AS m, array_deviation(a) AS d)), z -> transform(a, x -> CASE WHEN z.d <= 1e-12 THEN 0D ELSE (x - z.m) / greatest(z.d, 1e-300) END)), 0)"),
    "array_steps": ("a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "zip_with(slice(a, 2, greatest(size(a) - 1, 0)), slice(a, 1, greatest(size(a) - 1, 0)), (x, y) -> x - y)"),
    "array_slope": ("a ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) < 2 THEN 0D ELSE 12 * aggregate(transform(a, (x, i) -> (x - get(a, 0)) * (i - (size(a) - 1) / 2)), 0D, (s, x) -> s + x) / (CAST(size(a) AS DOUBLE) * (CAST(size(a) AS DOUBLE) * size(a) - 1)) END"),
    "trend_direction": ("a ARRAY<DOUBLE>", "STRING", "CASE WHEN array_slope(a) > 0 THEN 'increasing' WHEN array_slope(a) < 0 THEN 'decreasing' ELSE 'flat' END"),
    "forecast_seasonal": ("a ARRAY<DOUBLE>, horizon INT, season INT", "ARRAY<DOUBLE>", "transform(sequence(0, horizon - 1), h -> get(a, greatest(size(a) - season, 0) + h % least(season, size(a))))"),
    "forecast_average": ("a ARRAY<DOUBLE>, horizon INT", "ARRAY<DOUBLE>", "array_repeat(array_mean(a), horizon)"),
    "forecast_drift": ("a ARRAY<DOUBLE>, horizon INT, recent INT", "ARRAY<DOUBLE>", "transform(sequence(1, horizon), h -> element_at(a, -1) + h * array_slope(slice(a, greatest(size(a) - recent, 0) + 1, recent)))"),
    "squared_error": ("p ARRAY<DOUBLE>, t ARRAY<DOUBLE>", "DOUBLE", "array_mean(zip_with(p, t, (x, y) -> (x - y) * (x - y)))"),
    "absolute_error": ("p ARRAY<DOUBLE>, t ARRAY<DOUBLE>", "DOUBLE", "array_mean(zip_with(p, t, (x, y) -> abs(x - y)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions in this session, or define them anew; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
