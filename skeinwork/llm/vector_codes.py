"""Vector code compression: product quantisation with one kd-tree a codebook, in exact integers.

Components become integers floor(scale * x); a vector is cut into equal consecutive parts, and each part is replaced by the index
of its nearest codebook entry. A round broadcasts the codebooks, every task searches its vectors in kd-trees and adds up the
parts by entry, and the sums are added by entry over all tasks: at most parts x entries x (dimension + 1) integers a task and on
the driver, whatever the data. Everything is integer, so any order of adding gives the same codebooks.

The search is branch and bound over whole batches: queries go down the nearer child first and then into the other one if its
box can hold an entry as near as the best so far. Boxes at exactly that distance are visited as well, so of entries at equal
distance the one with the lowest index is found.

The table is read once a round; nothing is kept between rounds but the codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import work_dir, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 16
BATCH = 4096
FEW_LABELS = 1 << 17
SALTS = 32


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray  # indices below this node, ascending
    children: tuple = field(default=())


class KdTree:
    """Entries of one codebook, split at the median of the widest dimension; each node knows its box."""

    def __init__(self, book: np.ndarray, leaf: int = LEAF):
        self.book, self.leaf = book, leaf
        self.root = self._node(np.arange(len(book)))

    def _node(self, at: np.ndarray) -> Node:
        rows = self.book[at]
        node = Node(rows.min(0), rows.max(0), at)
        wide = int((node.high - node.low).argmax())
        if len(at) > self.leaf and node.high[wide] > node.low[wide]:
            order = at[np.argsort(rows[:, wide], kind="stable")]
            half = len(order) // 2
            node.children = tuple(self._node(np.sort(x)) for x in (order[:half], order[half:]))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones the lowest index.

        Where all sums of a distance stay below 2**53 they are exact in doubles too, and a leaf is one product of matrices.
        """
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.book).max(initial=0)))
        kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
        self.x, self.y = x.astype(kind), self.book.astype(kind)
        self.xx, self.yy = (np.einsum("ij,ij->i", v, v) for v in (self.x, self.y))
        self.best = np.full(len(x), np.iinfo(np.int64).max)
        self.index = np.full(len(x), len(self.book))
        self.compared = 0
        if len(x):
            self._visit(self.root, np.arange(len(x)))
        return self.index, self.best

    def _bound(self, node: Node, at: np.ndarray) -> np.ndarray:
        q = self.x[at]
        off = np.maximum(node.low - q, 0) + np.maximum(q - node.high, 0)
        return np.einsum("ij,ij->i", off, off)

    def _visit(self, node: Node, at: np.ndarray) -> None:
        if not node.children:
            d = self.xx[at][:, None] + self.yy[node.entries][None, :] - 2 * (self.x[at] @ self.y[node.entries].T)
            j = d.argmin(1)  # entries ascend, so the first of equals has the lowest index
            d, e = d[np.arange(len(at)), j].astype(np.int64), node.entries[j]
            take = (d < self.best[at]) | ((d == self.best[at]) & (e < self.index[at]))
            self.best[at[take]], self.index[at[take]] = d[take], e[take]
            self.compared += len(at) * len(node.entries)
            return
        a, b = (self._bound(c, at) for c in node.children)
        first = a <= b
        for near, far, chosen, bound in ((0, 1, first, b), (1, 0, ~first, a)):
            mine, bounds = at[chosen], bound[chosen]
            if len(mine):
                self._visit(node.children[near], mine)
                still = bounds <= self.best[mine]  # equal bounds too: a lower index may lie there
                if still.any():
                    self._visit(node.children[far], mine[still])


def cuts(dimension: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts; equal where the dimension divides, else the first ones are one longer."""
    ends = np.cumsum([dimension // parts + (k < dimension % parts) for k in range(parts)])
    return [(int(e - (dimension // parts + (k < dimension % parts))), int(e)) for k, e in enumerate(ends)]


def integers(column: pa.Array, dimension: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their components as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sized = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dimension), False))
    at = np.nonzero(sized)[0]
    if not len(at) or not dimension:
        return at[:0], np.empty((0, dimension), np.int64)
    flat = pc.list_flatten(column.filter(pa.array(sized)))
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), dimension)
    fine = np.isfinite(x).all(1)
    x = np.floor(x[fine] * scale)
    limit = math.isqrt(((1 << 63) - 1) // (4 * dimension))
    if x.size and np.abs(x).max() > limit:
        raise ValueError(f"a component beyond {limit // scale} would overflow the 64-bit distances")
    return at[fine], x.astype(np.int64)


@dataclass
class Codec:
    """Codebooks, one a part, and what encodes with them."""

    books: list[np.ndarray]
    dimension: int
    scale: int = SCALE

    def trees(self) -> list[KdTree]:
        return [KdTree(b) for b in self.books]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """Approximate vectors of codes (rows of part indices), in the input's units; the middle of each integer's interval."""
        return (np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], 1) + 0.5) / self.scale


def _searched(codec: Codec, trees: list[KdTree], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for p, (a, b) in enumerate(cuts(codec.dimension, len(codec.books))):
        part = np.ascontiguousarray(x[:, a:b])
        index, distance = trees[p].nearest(part)
        yield p, part, index, distance


def seeded(vectors: DataFrame, parts: int, entries: int, scale: int, vector: str, key: str) -> Codec | None:
    """Codebooks of the parts of the `entries` kept rows with the smallest keys; None if no row is kept.

    The keys are ordered alone, and only then the vectors of those up to the last one, so tasks send narrow rows on.
    """
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(vectors[key].alias("k"), vectors[vector].cast("array<double>").alias("v")).where(fine)
    first = kept.agg(F.min(F.struct(F.col("k").isNull().alias("last"), "k", "v")).alias("x")).first().x
    if first is None:
        return None
    dimension, order = len(first.v), F.col("k").asc_nulls_last()
    sized = kept.where(F.size("v") == dimension)
    keys = [r.k for r in sized.select("k").orderBy(order).limit(entries).collect()]
    few = sized if len(keys) < entries or keys[-1] is None else sized.where(F.col("k") <= F.lit(keys[-1]))
    rows = few.orderBy(order, "v").limit(entries).collect()  # `entries` rows
    column = pa.array([r.v for r in rows], pa.list_(pa.float64()))
    _, x = integers(column, dimension, scale)
    return Codec([x[:, a:b] for a, b in cuts(dimension, min(parts, dimension))], dimension, scale)


def recentred(vectors: DataFrame, codec: Codec, vector: str) -> Codec:
    """One round: every part to its nearest entry, then every used entry to the floored mean of its parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(codec)  # parts x entries x dimension integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = own.trees()
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in own.books]  # the last column counts
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                _, x = integers(batch.column(0).slice(i, BATCH), own.dimension, own.scale)
                for p, part, index, _ in _searched(own, trees, x):
                    np.add.at(sums[p], index, np.concatenate([part, np.ones((len(part), 1), np.int64)], 1))
        for p, s in enumerate(sums):
            used = np.nonzero(s[:, -1])[0]
            entry, place = np.repeat(used, s.shape[1]), np.tile(np.arange(s.shape[1]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(s[used].ravel())], names=["part", "entry", "place", "total"])

    totals = vectors.select(vectors[vector]).mapInArrow(run, "part long, entry long, place long, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in codec.books]
    for r in totals.collect():  # at most parts x entries x (dimension + 1) rows
        sums[r.part][r.entry, r.place] = r.total
    books = [np.where(s[:, -1:] > 0, np.floor_divide(s[:, :-1], np.maximum(s[:, -1:], 1)), b) for s, b in zip(sums, codec.books)]
    return Codec(books, codec.dimension, codec.scale)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id") -> Codec | None:
    codec = seeded(vectors, parts, entries, scale, vector, key)
    for _ in range(rounds if codec else 0):
        codec = recentred(vectors, codec, vector)
    return codec


def encoded(vectors: DataFrame, codec: Codec, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """key, label, code (two hex digits a part) and error of every kept row."""
    shared = vectors.sparkSession.sparkContext.broadcast(codec)
    wide = max(2, *[len(f"{max(len(b) - 1, 0):x}") for b in codec.books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        trees = own.trees()
        digits = np.asarray([f"{k:0{wide}x}" for k in range(max(len(b) for b in own.books))], object)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                batch = whole.slice(i, BATCH)
                at, x = integers(batch.column(2), own.dimension, own.scale)
                code, error = np.full(len(at), "", object), np.zeros(len(at), np.int64)
                for _, _, index, distance in _searched(own, trees, x):
                    code, error = code + digits[index], error + distance
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(code, pa.string()), pa.array(error)], names=[key, label, "code", "error"])

    types = dict(vectors.select(vectors[key], vectors[label]).dtypes)
    return vectors.select(vectors[key], vectors[label], vectors[vector]).mapInArrow(run, f"`{key}` {types[key]}, `{label}` {types[label]}, code string, error long")


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id", label: str = "label"
) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every kept row.

    Rows are left out whose vector is null, empty, or holds null or non-finite components, and those of another length than the
    kept vector with the smallest key. Null keys sort last; repeated rows are coded one by one, ties of keys are seeded in the
    order of their vectors; fewer rows than entries give fewer entries; an empty table gives no rows. Components so large that
    distances could overflow 64 bits raise an error. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    codec = trained(vectors, parts, entries, rounds, scale, vector, key)
    if codec is None:
        type_of = dict(vectors.dtypes)[key]
        return spark.createDataFrame([], f"`{key}` {type_of}, code string, error long, label_error long, codebooks_sha256 string")
    table = written(encoded(vectors, codec, vector, key, label).toDF("_key", "_label", "code", "error"), work_dir(spark, "vector-codes"), "codes")
    totals = table.groupBy("_label").agg(F.sum("error").alias("label_error"))
    if totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        joined = table.join(F.broadcast(totals.withColumnRenamed("_label", "_l")), F.col("_label").eqNullSafe(F.col("_l")))
    else:  # a frequent label is dealt over salts
        salted = totals.withColumnRenamed("_label", "_l").withColumn("_s2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = table.withColumn("_s", F.pmod(F.xxhash64("_key", "code"), F.lit(SALTS)).cast("int")).join(salted, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_s2")))
    return joined.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(codec.sha256()).alias("codebooks_sha256"))
