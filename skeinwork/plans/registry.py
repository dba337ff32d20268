"""Registry of the known datasets and the rules that tell a dataset from a file path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class WindowSpec:
    """Lookback and horizon in rows, distance between window starts (0: the horizon), and the seasonal period."""

    lookback: int = 96
    horizon: int = 96
    stride: int = 0
    season: int = 24

    @property
    def step(self) -> int:
        return self.stride if self.stride > 0 else self.horizon


# Name, lookback, horizon, season, stride of memory windows, stride of case windows.
DATASETS = (
    ("BE", 168, 24, 24, 48, 48),
    ("DE", 168, 24, 24, 48, 48),
    ("FR", 168, 24, 24, 48, 48),
    ("NP", 168, 24, 24, 48, 48),
    ("PJM", 168, 24, 24, 48, 48),
    ("ETTh1", 96, 96, 24, 48, 24),
    ("ETTm1", 96, 96, 24, 96, 24),
    ("MOPEX", 96, 96, 24, 48, 24),
    ("SP", 96, 96, 24, 96, 24),
    ("WP", 96, 96, 24, 96, 24),
)
# Upper bound of the absolute error of a reward, and that of the relative one.
REWARD_BOUNDS = (
    ("NP", 40.0, 3.0),
    ("BE", 800.0, 10.0),
    ("DE", 350.0, 10.0),
    ("FR", 1000.0, 10.0),
    ("PJM", 45.0, 4.0),
    ("MOPEX", 7.0, 1.5),
    ("sunny", 50.0, 3.0),
    ("SP", 50.0, 3.0),
    ("windy", 3000.0, 30.0),
    ("WP", 3000.0, 30.0),
    ("ETTh1", 12.0, 2.0),
    ("ETTm1", 3.5, 1.0),
)
# Other names of datasets.
NICKNAMES = {"sunny": "SP", "sunny_power": "SP", "solar": "SP", "windy": "WP", "windy_power": "WP", "wind": "WP"}


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a ten-row table for lookup joins."""
    return spark.createDataFrame(list(DATASETS), "name string, lookback int, horizon int, season int, memory_stride int, case_stride int")


#: Bounds of a reward for a dataset without any.
OTHER_BOUNDS = (10.0, 10.0)


def reward_bounds(spark: SparkSession) -> DataFrame:
    """Bounds by name, as spelled in forecasts and in reward data: twelve rows."""
    return spark.createDataFrame(list(REWARD_BOUNDS), "name string, mse_bound double, relative_bound double")


def spec_of(name: str) -> WindowSpec:
    """The window specification of a dataset; KeyError for an unknown name."""
    lookback, horizon, season, _, stride = next(r[1:] for r in DATASETS if r[0] == canonical(name))
    return WindowSpec(lookback, horizon, stride, season)


# Stem of each dataset's files, and what follows it in the training and the test file.
STEMS = {n: f"EPF_{n}" for n in ("BE", "DE", "FR", "NP", "PJM")} | {n: f"ETT_{n}" for n in ("ETTh1", "ETTm1")} | {"MOPEX": "mopex", "SP": "sunny_power", "WP": "windy_power"}
PARTS = {"train": "_train_val", "test": "_test"}


def file_of(name: str, part: str = "train") -> str:
    """Path of a dataset's training or test file below a data folder."""
    return f"{part}/{STEMS[name]}{PARTS[part]}.csv"


def dataset_of(path: str) -> str | None:
    """The first dataset of the registry whose name, or the stem of one of whose files, a path holds anywhere."""
    low = path.replace("\\", "/").lower()
    return next((n for n, *_ in DATASETS if n.lower() in low or any(f"{STEMS[n]}{p}".lower() in low for p in PARTS.values())), None)


def resolved(spark: SparkSession, root: str, names: list[str] | None = None, part: str = "train") -> dict[str, str]:
    """Path of each dataset's file: below root in its own folder, else in root itself; all that are missing in one error.

    Asks Spark's file system layer, so root may be any path that Spark reads.
    """
    wanted = [canonical(n) for n in names] if names is not None else sorted(n for n, *_ in DATASETS)
    if not wanted:
        raise ValueError("no datasets selected")
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, missing = {}, []
    for n in wanted:
        own = file_of(n, part)
        tried = [f"{root.rstrip('/')}/{x}" for x in (own, own.rsplit("/", 1)[1])]
        there = [t for t in tried if path_of(t).getFileSystem(conf).exists(path_of(t))]
        if there:
            found[n] = there[0]
        else:
            missing.append(f"{n}: {own}")
    if missing:
        raise FileNotFoundError(f"below {root} are missing {', '.join(missing)}")
    return found


def canonical(name: str) -> str:
    """The registry's spelling of a dataset's name or nickname; KeyError for an unknown one."""
    low = NICKNAMES.get(name.strip().lower(), name.strip()).lower()
    for n, *_ in DATASETS:
        if n.lower() == low:
            return n
    raise KeyError(name)
