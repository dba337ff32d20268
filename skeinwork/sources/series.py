"""Series tables: sid (series), pos (ordinal within it), ts, y. Sources infer roles; panels fill gaps without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names that mark a timestamp column, in order of preference, and columns that are never a target.
TIME_NAMES = ("date", "time_stamp", "timestamp", "ds", "time")
NOT_TARGETS = frozenset("predicted_ans features_used answer ground_truth".split())


def number(c: Column) -> Column:
    """The value as a double, null where it isn't one; a trailing type letter is no number."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"(?i)[df]$") & ~text.rlike("(?i)^[+-]?inf$"), F.lit(None)).otherwise(text.try_cast("double"))


def time_column(df: DataFrame) -> str | None:
    return next((n for n in TIME_NAMES if n in df.columns), None)


def target_column(df: DataFrame) -> str:
    """The last column that holds a number, besides the timestamp and answers; one pass over all candidates."""
    names = [c for c in df.columns if c != time_column(df) and c not in NOT_TARGETS]
    counts = df.agg(*[F.count(number(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(names)]).first() if names else []
    found = [c for c, n in zip(names, counts, strict=True) if n]
    if not found:
        raise ValueError("no column holds a number")
    return found[-1]


def load_series(spark: SparkSession, path: str | list[str], sid: str = "series", target: str | None = None, time: str | None = None, file_order: bool | None = None) -> DataFrame:
    """CSV or Parquet files as one series: roles inferred where they aren't given, rows without a target left out.

    Rows are in order of their timestamp; in that of the files (by path) and their lines where there is no timestamp, or where
    file_order says so. Then ts is what the file says, or null.
    """
    paths = [path] if isinstance(path, str) else list(path)
    parquet = paths[0].rstrip("/").endswith(".parquet")
    raw = spark.read.parquet(*paths) if parquet else spark.read.csv(paths, header=True, multiLine=True, escape='"')
    target, time = target or target_column(raw), time or time_column(raw)
    by_file = time is None if file_order is None else file_order
    if time is None and not by_file:
        raise ValueError(f"a series needs one of the columns {', '.join(TIME_NAMES)} to be ordered by")
    stamp = F.col(f"`{time}`").try_cast("timestamp_ntz") if time else F.lit(None).cast("timestamp_ntz")
    rows = raw.select(F.lit(sid).alias("sid"), stamp.alias("ts"), number(F.col(f"`{target}`")).alias("y"), *(_places(parquet) if by_file else []))
    rows = rows.where(F.col("y").isNotNull() & ~F.isnan("y"))
    if len(rows.take(2)) < 2:
        raise ValueError(f"fewer than two rows with a number in {target}: {path}")
    return in_file_order(rows) if by_file else with_positions(rows)


def _places(parquet: bool) -> list[Column]:
    """File, block of it and place within the block of each row scanned."""
    file = F.col("_metadata.file_path").alias("_f")
    if parquet:
        return [file, F.floor(F.col("_metadata.row_index") / (1 << 20)).alias("_b"), F.col("_metadata.row_index").alias("_i")]
    return [file, F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i")]


def in_file_order(rows: DataFrame) -> DataFrame:
    """Number rows (sid, ts, y, _f, _b, _i) by file, block and place: blocks are counted apart and offset by those before, a row a block."""
    sizes = rows.groupBy("sid", "_f", "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("sid", "_f", "_b").orderBy("_i")) - 1
    placed = rows.withColumn("_p", place).join(sizes.select("sid", "_f", "_b", before.alias("_o")), ["sid", "_f", "_b"])
    return placed.select("sid", (F.col("_o") + F.col("_p")).cast("long").alias("pos"), "ts", "y")


def with_positions(rows: DataFrame) -> DataFrame:
    """Number the rows of each series by ts, so that no task holds a whole long series.

    A row's place is counted within its month of its series; months are offset by the sums of those before.
    """
    month = F.date_format("ts", "yyyy-MM")
    rows = rows.withColumn("_m", F.coalesce(month, F.lit("")))
    sizes = rows.groupBy("sid", "_m").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("sid", "_m").orderBy("ts", "y")) - 1
    placed = rows.withColumn("_i", place).join(sizes.select("sid", "_m", before.alias("_b")), ["sid", "_m"])
    return placed.select("sid", (F.col("_b") + F.col("_i")).cast("long").alias("pos"), "ts", "y")


def filled(cells: DataFrame, unit: str, bounds: tuple | None = None) -> DataFrame:
    """cells (sid, ts on a grid of `unit`, y) with a row for every grid point between the table's first and last, 0 where there was none.

    Each cell makes the points up to the next cell of its series, so the grid needs no join; a series' cells are in order in one
    task, at most one a grid point. Only the two bounds reach the driver.
    """
    low, high = bounds or cells.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return cells.select("sid", F.lit(0).cast("long").alias("pos"), "ts", "y")
    start, end = F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")
    at = lambda a, b: F.timestamp_diff(unit, a, b).cast("long")
    own = Window.partitionBy("sid").orderBy("place")
    placed = cells.where("ts IS NOT NULL").select("sid", "y", at(start, F.col("ts")).alias("place"))
    first = F.when(F.lag("place").over(own).isNull(), F.lit(0).cast("long")).otherwise(F.col("place"))
    last = F.coalesce(F.lead("place").over(own) - 1, at(start, end))
    points = placed.select("sid", "y", "place", first.alias("a"), last.alias("b")).select("sid", "y", "place", F.explode(F.sequence("a", "b")).alias("pos"))
    return points.select("sid", "pos", F.timestamp_add(unit, F.col("pos").cast("int"), start).alias("ts"), F.when(F.col("pos") == F.col("place"), F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"))


def totals(rows: DataFrame, sid: Column, ts: Column, value: Column, unit: str) -> DataFrame:
    """Sum of value by series and unit of time; decimals, so that the sum doesn't depend on the order."""
    at = F.date_trunc(unit, ts).cast("timestamp_ntz")
    cells = rows.select(sid.alias("sid"), at.alias("ts"), value.cast("decimal(18,2)").alias("v"))
    return cells.groupBy("sid", "ts").agg(F.sum("v").cast("double").alias("y"))


def panel(rows: DataFrame, sid: Column, ts: Column, value: Column, unit: str) -> DataFrame:
    """totals() with its gaps filled; the bounds are read off the timestamps alone."""
    edge = lambda f: F.date_trunc(unit, f(ts)).cast("timestamp_ntz")
    return filled(totals(rows, sid, ts, value, unit), unit.upper(), tuple(rows.agg(edge(F.min), edge(F.max)).first()))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of events.value by event type, gaps as 0."""
    return panel(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type"), F.col("ts"), F.col("value"), "hour")


def daily_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of events.value by user, gaps as 0: many short series."""
    return panel(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id").cast("string"), F.col("ts"), F.col("value"), "day")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of order prices, gaps as 0: one long series."""
    return panel(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.lit("orders"), F.col("o_orderdate"), F.col("o_totalprice"), "day")


def exogenous_filled(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Within each window: the last known value, else the next one, else 0."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    coming = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(coming), F.lit(0.0)) for c in columns})
