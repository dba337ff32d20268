"""Autocorrelation of whole series at all lags, by Fourier transforms over the cluster.

r = F^-1(|F(x)|^2) of the demeaned series, padded with zeros to N >= 2n so that nothing wraps around. A short series is transformed in
one batch call. A long one goes through a transform in steps, N = N1 * N2: columns of length N1 are transformed and turned
(group 1), rows of length N2 are transformed, squared, transformed again and turned (group 2), and columns of length N1 end
it (group 3). Between them travel square tiles of packed complex numbers, so a shuffle moves 16 bytes a value and no task holds more
than TILE rows or columns of a series: O(n log n) work and O(sqrt n) values a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 2048
TILE = 32


def shape(n: int) -> tuple[int, int]:
    """Powers of two N1 >= N2 with N1 * N2 >= 2n."""
    bits = max(2, int(np.ceil(np.log2(2 * max(n, 2)))))
    return 1 << (bits + 1) // 2, 1 << bits // 2


def _turned(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Row a, column b times exp(-2 pi i a b / size)."""
    return values * np.exp((-2j * np.pi / size) * ((rows[:, None] * np.arange(values.shape[1])[None, :]) % size))


def _tiles(sid, n, m, values: np.ndarray, first: int) -> pd.DataFrame:
    """Rows first, first + 1, ... cut into tiles; each goes to the group of its columns."""
    out = [(sid, n, m, b // TILE, first, np.ascontiguousarray(values[:, b : b + TILE]).tobytes(), values[:, b : b + TILE].shape[1]) for b in range(0, values.shape[1], TILE)]
    return pd.DataFrame(out, columns=["sid", "n", "m", "g", "at", "tile", "w"])


def _gathered(part: pd.DataFrame, length: int) -> np.ndarray:
    """The group's rows (the tiles' columns), each of `length` values put together from its tiles."""
    width = int(part["w"].iloc[0])
    out = np.zeros((width, length), complex)
    for at, tile in zip(part["at"], part["tile"]):
        t = np.frombuffer(tile, complex).reshape(-1, width)
        out[:, at : at + len(t)] = t.T
    return out


def _columns(part: pd.DataFrame) -> pd.DataFrame:
    """Group 1: some columns of the series, x[N2 * j1 + j2] for j2 in a block."""
    sid, n, m, g = (part[c].iloc[0] for c in ("sid", "n", "m", "g"))
    n1, n2 = shape(int(n))
    width = min(TILE, n2 - int(g) * TILE)
    x = np.zeros((width, n1))
    x[part["pos"].to_numpy() % n2 - int(g) * TILE, part["pos"].to_numpy() // n2] = part["y"].to_numpy() - m
    at = int(g) * TILE + np.arange(width)
    return _tiles(sid, n, m, _turned(np.fft.fft(x, axis=1), at, n1 * n2), int(g) * TILE)


def _rows(part: pd.DataFrame) -> pd.DataFrame:
    """Group 2: rows k1 of the transform, X[k1 + N1 * k2]; its squares are transformed along k2."""
    sid, n, m, g = (part[c].iloc[0] for c in ("sid", "n", "m", "g"))
    n1, n2 = shape(int(n))
    power = np.abs(np.fft.fft(_gathered(part, n2), axis=1)) ** 2
    at = int(g) * TILE + np.arange(len(power))
    return _tiles(sid, n, m, _turned(np.fft.fft(power, axis=1), at, n1 * n2), int(g) * TILE)


def _lags(part: pd.DataFrame) -> pd.DataFrame:
    """Group 3: sums of products at lags q1 + N2 * q2."""
    sid, n, g = (part[c].iloc[0] for c in ("sid", "n", "g"))
    n1, n2 = shape(int(n))
    r = np.fft.fft(_gathered(part, n1), axis=1).real / (n1 * n2)  # squares are even, so forwards is backwards
    lag = (int(g) * TILE + np.arange(len(r)))[:, None] + n2 * np.arange(n1)[None, :]
    use = lag < n
    return pd.DataFrame({"sid": sid, "lag": lag[use], "r": r[use]})


def autocorrelations(series: DataFrame, short: int = SHORT) -> DataFrame:
    """sid, lag, r: sums of products of the demeaned series (sid, pos, y) with itself at each lag from 0 to its length less one.

    Positions run from 0 without gaps, as with_positions gives them. Empty tables give no rows.
    """
    sizes = series.groupBy("sid").agg(F.count("*").alias("n"), F.avg("y").alias("m"))
    rows = series.select("sid", "pos", "y").join(sizes, "sid")

    @F.pandas_udf("array<double>")
    def at_once(y: pd.Series) -> pd.Series:
        out = []
        for v in y:
            v = np.asarray(v) - np.mean(v)
            size = 1 << int(np.ceil(np.log2(2 * max(len(v), 2))))
            out.append(np.fft.irfft(np.abs(np.fft.rfft(v, size)) ** 2, size)[: len(v)].tolist())
        return pd.Series(out)

    few = rows.where(F.col("n") <= short).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda x: x["y"]).alias("y"))
    direct = few.select("sid", F.posexplode(at_once("y")).alias("lag", "r")).select("sid", F.col("lag").cast("long").alias("lag"), "r")
    kind = dict(series.dtypes)["sid"]
    tiles = f"sid {kind}, n long, m double, g long, at long, tile binary, w int"
    bits = F.greatest(F.lit(2), F.ceil(F.log2(2 * F.greatest("n", F.lit(2)))).cast("int"))
    n2 = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    many = rows.where(F.col("n") > short).withColumn("g", F.floor((F.col("pos") % n2) / TILE))
    first = many.groupBy("sid", "g").applyInPandas(_columns, tiles)
    second = first.groupBy("sid", "g").applyInPandas(_rows, tiles)
    stepped = second.groupBy("sid", "g").applyInPandas(_lags, f"sid {kind}, lag long, r double")
    return direct.unionByName(stepped)


def whole_periodicity(series: DataFrame, short: int = SHORT) -> DataFrame:
    """sid, periodicity_lag: the lag from 1 to half the series of the largest autocorrelation (rounded to two digits), the least on ties; 1 for series of under four rows."""
    n = series.groupBy("sid").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.round("r", 2)).alias("a"), "lag"))
    found = autocorrelations(series, short).join(n, "sid").where("lag > 0 AND lag < greatest(n div 2, 2)").groupBy("sid").agg(best.alias("b"))
    return n.join(found, "sid", "left").select("sid", F.coalesce("b.lag", F.lit(1)).cast("long").alias("periodicity_lag"))
