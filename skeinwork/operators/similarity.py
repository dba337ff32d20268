"""Similarity of histories and vectors, and top-k retrieval. What one side needs is computed once a row, before any join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from skeinwork.operators.windows import deviation, differences, mean, samples, slope, total, zscored

BLOCK = 64
SALTS = 16
QUERY_BLOCK, ENTRY_BLOCK = 32768, 32768  # what meets in one group
VALUES = 1 << 22  # components of a block at most
GROUPS = 32  # groups at least, for as many tasks
STRIP, FINE = 256, 32  # queries in one product, of single and of double precision
WIDE = 64  # entries whose greatest cosine is looked at first
TIE = 2e-9  # more than nine digits and the order of a sum can differ by


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def traits(hist: Column) -> Column:
    """What a history is compared by: standard scores and their norm, slope, spread, deviation and signs of its steps."""
    z = zscored(hist)
    return F.struct(
        z.alias("z"), norm(z).alias("n"), slope(hist).alias("slope"), (F.array_max(hist) - F.array_min(hist)).alias("spread"),
        deviation(differences(hist)).alias("vol"), F.transform(differences(hist), lambda d: F.signum(d)).alias("signs"), F.size(hist).alias("k"),
    )


def comprehensive(a: Column, b: Column) -> Column:
    """Similarity of two histories of equal size by their traits, in [0, 1]: shape, trend, volatility and pattern of signs."""
    scale = a["n"] * b["n"]
    cosine = F.when(scale <= 1e-12, 0.0).otherwise(0.5 + 0.5 * dot(a["z"], b["z"]) / F.greatest(scale, F.lit(1e-300)))
    trend = F.exp(-F.abs(a["slope"] - b["slope"]) / F.greatest(a["spread"], b["spread"], F.lit(1e-8)))
    volatility = F.exp(-F.abs(a["vol"] - b["vol"]) / F.greatest(a["vol"], b["vol"], F.lit(1e-8)))
    pattern = mean(F.zip_with(a["signs"], b["signs"], lambda x, y: (x == y).cast("double")))
    value = F.least(F.greatest(0.4 * cosine + 0.25 * trend + 0.2 * volatility + 0.15 * pattern, F.lit(0.0)), F.lit(1.0))
    return F.when((a["k"] < 2) | (b["k"] < 2), 0.0).otherwise(value)


def embedding(hist: Column) -> Column:
    """29 single-precision values: mean, deviation, least, greatest, slope, and 24 samples."""
    head = F.array(mean(hist), deviation(hist), F.array_min(hist), F.array_max(hist), slope(hist))
    return F.concat(head, samples(hist, 24)).cast("array<float>")


def unit(v: Column) -> Column:
    """The vector at length 1, so that cosines are plain products; a zero vector stays."""
    d = v.cast("array<double>")
    return F.get(F.transform(F.array(norm(d)), lambda n: F.transform(d, lambda x: F.when(n > 0, x / F.greatest(n, F.lit(1e-300))).otherwise(0.0))), F.lit(0))


def top_k(pairs: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The k most similar items of each query, ties to the smaller item; Spark prunes by partition before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("sim").desc(), item))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def blocked(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """queries (sid, id, q, n) and entries (sid, id, e, n): q, e of all pairs within a sid, n being its number of blocks.

    Queries, a stated set, are gathered in n blocks a sid, and each entry meets each block of its sid once, at one of SALTS
    copies of the block: an equi-join on (sid, block, salt) whose size is entries times blocks. A sid with most of the rows is
    dealt over its blocks and salts; the pairs are formed inside the joined row. Neither side is collected or broadcast by us.
    """
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    blocks = q.groupBy("sid", "block").agg(F.collect_list("q").alias("qs")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = entries.select("sid", "e", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    return e.join(blocks, ["sid", "block", "salt"]).select("sid", "e", F.explode("qs").alias("q"))


def nearest(queries: DataFrame, entries: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
    """queries (query, v) against all of entries (item, u), by cosine of at least threshold: query, item, sim, rank.

    Exact, so all pairs are compared: blocks of queries meet blocks of entries, each pair of blocks is one group and its cosines are a
    product of matrices. A group gives k items a query; memory is bounded by the block sizes, the rows shuffled are the pairs
    divided by them. Vectors are shuffled as they come and brought to length 1 in the group. Vectors of other sizes, or none, are
    similar to nothing.
    """
    nq, ne = _grid(*_rows(queries, "v", QUERY_BLOCK), *_rows(entries, "u", ENTRY_BLOCK))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("v IS NOT NULL").select(F.size("v").alias("size"), number("query", nq).alias("qb"), every(ne).alias("eb"), "query", _plain(queries, "v"))
    e = entries.where("u IS NOT NULL").select(F.size("u").alias("size"), every(nq).alias("qb"), number("item", ne).alias("eb"), "item", _plain(entries, "u"))
    schema = StructType([queries.schema["query"], entries.schema["item"], StructField("sim", DoubleType())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        at, of, sims = block_top(_matrix(left["v"]), *_by_item(right["item"], _matrix(right["u"])), k, threshold)
        return pa.table([left["query"].take(pa.array(at)), right["item"].take(pa.array(of)), pa.array(sims)], names=["query", "item", "sim"])

    keys = ("size", "qb", "eb")
    dealt = lambda df: df.repartition(4 * nq * ne, *keys).groupBy(*keys)  # noqa: E731  # by number: partitions of few bytes but much work aren't joined
    pairs = dealt(q).cogroup(dealt(e)).applyInArrow(meet, schema)
    sims = pairs.select("query", "item", F.round("sim", 9).alias("sim"))
    return top_k(sims.where(F.col("sim") >= threshold), "query", "item", k)


def _rows(df: DataFrame, vector: str, most: int) -> tuple[int, int]:
    """How many rows there are, and how many a block may have."""
    n, width = df.agg(F.count("*"), F.max(F.size(vector))).first()
    return n, max(1, min(most, VALUES // max(width or 1, 1)))


def _grid(queries: int, query_block: int, entries: int, entry_block: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of entries: no more rows than a block may have, and GROUPS pairs with the fewest copies of rows."""
    nq, ne = max(1, -(-queries // query_block)), max(1, -(-entries // entry_block))
    while nq * ne < GROUPS:
        nq, ne = (nq + 1, ne) if entries * nq <= queries * ne else (nq, ne + 1)
    return nq, ne


def _plain(df: DataFrame, vector: str) -> Column:
    """Vectors of single or double precision as they are, others in double."""
    kept = isinstance(df.schema[vector].dataType.elementType, (FloatType, DoubleType))
    return F.col(vector) if kept else F.col(vector).cast("array<double>").alias(vector)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal size as rows of length 1, to the bit as unit() has them: one that is zero or holds a null is zero."""
    flat = pc.list_flatten(column).combine_chunks().cast(pa.float64())
    shape = (len(column), len(flat) // max(len(column), 1))
    v = flat.to_numpy(zero_copy_only=False).reshape(shape)
    n = np.zeros(len(v))
    with np.errstate(all="ignore"):
        for j in range(shape[1]):
            n += v[:, j] * v[:, j]
        n = np.sqrt(n)[:, None]
        v = np.where(n <= 0, 0.0, v / np.maximum(n, 1e-300))
    if flat.null_count:
        v[flat.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(axis=1)] = 0.0
    return v


def _by_item(items: pa.ChunkedArray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in ascending order of their items, as Spark orders them, and the rows they come from."""
    plain = pa.table({"k": items})
    while any(pa.types.is_struct(t) for t in plain.schema.types):
        plain = plain.flatten()
    plain = plain.rename_columns([str(i) for i in range(plain.num_columns)])
    order = pc.sort_indices(plain, sort_keys=[(c, "ascending") for c in plain.column_names], null_placement="at_start").to_numpy()
    return e[order], order


def block_top(q: np.ndarray, e: np.ndarray, items: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q its k most similar rows of e, ties by nine digits to the first: rows of q, their items, and the cosines.

    Of equal vectors only the first k can be among them, so copies are left out first. The product chooses what comes near the k-th best;
    what it chose is summed again in order of the components, so that a cosine depends on its two vectors alone. NaN is above all, as in Spark.
    """
    if len(e) > k:
        same = np.unique(np.ascontiguousarray(e).view(np.dtype((np.void, 8 * e.shape[1]))).ravel(), return_inverse=True)[1].ravel() if e.shape[1] else np.zeros(len(e), int)
        order = np.argsort(same, kind="stable")
        first = np.concatenate([[True], np.diff(same[order]) != 0])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = np.sort(order[place < k])
        e, items = e[kept], items[kept]
    out = []
    for a, row, col in _candidates(q, e, k, threshold) if len(e) else ():
        sim = np.zeros(len(row))
        for j in range(e.shape[1]):
            sim += q[a + row, j] * e[col, j]
        digits = np.where(np.isnan(sim), np.inf, np.floor(sim * 1e9 + 0.5))
        order = np.lexsort((col, -digits, row))
        row, col, sim = row[order], col[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out.append((a + row[place < k], items[col[place < k]], sim[place < k]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _candidates(q: np.ndarray, e: np.ndarray, k: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Strips of q: the first row's place, then rows (from there) and rows of e that may be among their k best.

    Products of single precision err by less than `slack`, twice the bound of a sum in any order. Where too many lie that near to the
    k-th best, the strip is done again in double precision.
    """
    longest = np.prod([np.sqrt(np.nanmax(np.einsum("ij,ij->i", m, m), initial=0.0)) for m in (q, e)])
    slack, doubt = ((e.shape[1] + 4) * ulp * longest for ulp in (2.0**-23, 2.0**-51))
    nan = bool(np.isnan(q).any() or np.isnan(e).any())
    q4, e4 = q.astype(np.float32), e.astype(np.float32)
    for a in range(0, len(q), STRIP):
        found = _near_best(q4[a : a + STRIP], e4, k, threshold, 2 * slack + TIE, nan)
        if found:
            yield a, *found
            continue
        for b in range(a, min(a + STRIP, len(q)), FINE):
            yield b, *_fine_best(q[b : min(b + FINE, a + STRIP)], e, k, threshold, doubt)


def _near_best(q: np.ndarray, e: np.ndarray, k: int, threshold: float, slack: float, nan: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of q and e whose product is at least the k-th best of the row of q, or the threshold, less slack; NaN always. None if that may be very many.

    Entries are looked at in groups: the k-th greatest of their maxima is no more than the k-th best, and only groups whose
    maximum reaches it are opened.
    """
    wide = max(1, min(WIDE, len(e) // (4 * k)))
    groups = -(-len(e) // wide)
    s = np.empty((len(q), wide * groups), q.dtype)
    np.matmul(q, e.T, out=s[:, : len(e)])
    s[:, len(e) :] = -np.inf
    if nan:
        s[np.isnan(s)] = np.inf
    s = s.reshape(len(q), wide, groups)
    best = s.max(axis=1)
    least = np.partition(best, groups - k, axis=1)[:, groups - k].astype(float) if groups > k else np.full(len(q), -np.inf)
    least = np.maximum(least, threshold) - slack
    row, group = np.nonzero(best >= least[:, None])
    if len(row) > 3 * k * len(q):
        return None
    pair, place = np.nonzero(s[row, :, group] >= least[row, None])
    row, col = row[pair], place * groups + group[pair]
    return row[col < len(e)], col[col < len(e)]


def _fine_best(q: np.ndarray, e: np.ndarray, k: int, threshold: float, doubt: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and e whose cosine may be among the k best of the row of q by nine digits, each known but for `doubt`.

    Of those surely equal to the k-th best only the first k can be chosen, so that near copies don't all remain.
    """
    s = q @ e.T
    s[np.isnan(s)] = np.inf
    low, high = (np.floor(s * 1e9 + (0.5 + d)) for d in (-doubt * 1e9 - 1e-6, doubt * 1e9 + 1e-6))
    least = np.partition(low, len(e) - k, axis=1)[:, len(e) - k, None] if len(e) > k else np.full((len(s), 1), -np.inf)
    equal = (low == least) & (high == least)
    return np.nonzero((high >= least) & (~equal | (np.cumsum(equal, axis=1) <= k)) & (s >= threshold - TIE))


PIVOTS = 32
RING = 0.05
SLACK = 1e-6


@dataclass
class Cells:
    """Entries by the pivot nearest to them and the ring of their angle to it: a bounded summary, PIVOTS * (pi / RING + 1) cells at most."""

    pivots: np.ndarray
    pivot: np.ndarray  # of each cell
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def wanted(self, q: np.ndarray, k: int, least: float) -> list[np.ndarray]:
        """For each query the cells that may hold one of its k nearest entries with a cosine of `least` or more.

        An entry of a cell is at an angle of at least max(a - high, low - a) and at most a + high from a query at angle a from the pivot. Cells
        in order of the latter hold k entries by some bound; what begins beyond it can't be among the k nearest. Angles are a metric.
        """
        a = np.arccos(np.clip(q @ self.pivots.T, -1, 1))[:, self.pivot]
        near, far = np.maximum(0, np.maximum(a - self.high, self.low - a)), a + self.high
        out = []
        for lo, hi in zip(near, far):
            order = np.argsort(hi)
            full = np.cumsum(self.count[order])
            at = int(np.searchsorted(full, k))
            bound = hi[order[at]] if at < len(order) else np.pi
            out.append(np.nonzero(lo <= min(bound, np.arccos(np.clip(least, -1, 1))) + SLACK)[0])
        return out


def _units(column: pd.Series, width: int) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in column]) if len(column) else np.zeros((0, width))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def celled(entries: DataFrame, pivots: int = PIVOTS, ring: float = RING) -> tuple[DataFrame, Cells | None]:
    """entries (item, u) with their cell number, and the cells; None without entries. Pivots are the entries of least hash."""
    spark = entries.sparkSession
    least = entries.select(F.xxhash64("u").alias("h")).distinct().orderBy("h").limit(pivots)  # hashes alone are shuffled
    few = entries.withColumn("h", F.xxhash64("u")).join(F.broadcast(least), "h").groupBy("h").agg(F.first("u").alias("u")).orderBy("h").collect()  # `pivots` rows
    if not few:
        return entries.withColumn("cell", F.lit(0)), None
    points = _units(pd.Series([r.u for r in few]), len(few[0].u))
    schema = StructType([*entries.select("item", "u").schema.fields, StructField("pivot", IntegerType()), StructField("angle", DoubleType())])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a = np.arccos(np.clip(_units(part["u"], points.shape[1]) @ points.T, -1, 1))
            yield part.assign(pivot=a.argmin(1).astype("int32"), angle=a.min(1))

    placed = entries.select("item", "u").mapInPandas(place, schema).withColumn("ring", F.floor(F.col("angle") / ring).cast("int"))
    stats = placed.groupBy("pivot", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("pivot", "ring").collect()
    numbers = spark.createDataFrame([(r.pivot, r.ring, i) for i, r in enumerate(stats)], "pivot int, ring int, cell int")
    cells = Cells(points, *(np.asarray([getattr(r, c) for r in stats]) for c in ("pivot", "low", "high", "n")))
    return placed.join(F.broadcast(numbers), ["pivot", "ring"]).select("item", "u", "cell"), cells


def nearest_pruned(queries: DataFrame, entries: DataFrame, k: int, threshold: float = -1.0, pivots: int = PIVOTS, ring: float = RING) -> DataFrame:
    """The rows of nearest(), comparing each query only with the cells of entries that its bounds leave open. compared() counts the pairs.

    Vectors must not be all zeros for the bounds to hold; such ones are compared with everything. A cell with most of the
    entries is dealt over SALTS.
    """
    pairs = _open_pairs(queries, entries, k, threshold, pivots, ring)
    if pairs is None:
        return nearest(queries, entries, k, threshold)
    sims = pairs.select("query", "item", F.round(dot(F.col("v"), F.col("u")), 9).alias("sim"))
    return top_k(sims.where(F.col("sim") >= threshold), "query", "item", k)


def compared(queries: DataFrame, entries: DataFrame, k: int, threshold: float = -1.0, pivots: int = PIVOTS, ring: float = RING) -> int:
    """Number of pairs that nearest_pruned() compares."""
    pairs = _open_pairs(queries, entries, k, threshold, pivots, ring)
    return 0 if pairs is None else pairs.count()


def _open_pairs(queries, entries, k, threshold, pivots, ring) -> DataFrame | None:
    known = entries.where(F.exists("u", lambda x: x != 0))
    zeros = entries.where(~F.exists("u", lambda x: x != 0))
    placed, cells = celled(known, pivots, ring)
    if cells is None:
        return None
    fields = queries.select("query", "v").schema.fields
    schema = StructType([*fields, StructField("cells", ArrayType(IntegerType()))])

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = cells.wanted(_units(part["v"], cells.pivots.shape[1]), k, threshold)
            zero = np.asarray([not np.any(np.asarray(v, float)) for v in part["v"]])
            every = np.arange(len(cells.pivot))
            yield part.assign(cells=[(every if z else f).astype("int32").tolist() for f, z in zip(found, zero)])

    q = queries.select("query", "v").mapInPandas(choose, schema).select("query", unit(F.col("v")).alias("v"), F.explode("cells").alias("cell"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    e = placed.select("item", unit(F.col("u")).alias("u"), "cell", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int").alias("salt"))
    open_ = q.join(e, ["cell", "salt"]).select("query", "v", "item", "u")
    if zeros.take(1):  # their cosine is 0 with everything, and no angle is theirs
        all_in, n = F.lit(0).alias("sid"), F.lit(max(1, -(-queries.count() // BLOCK))).alias("n")
        more = blocked(queries.select(all_in, F.col("query").alias("id"), F.struct("query", unit(F.col("v")).alias("v")).alias("q"), n), zeros.select(all_in, F.col("item").alias("id"), F.struct("item", unit(F.col("u")).alias("u")).alias("e"), n))
        open_ = open_.unionByName(more.select("q.query", "q.v", "e.item", "e.u"))
    return open_
