"""Importance resampling towards a target distribution: Gumbel top-k over log-ratio weights of hashed n-grams.

Words are lower-cased (A-Z only) runs of ASCII letters and digits and of all characters beyond ASCII. Each run of up to
`grams` words is a feature in the bucket of its crc32. Two count vectors, of the source and of the target texts, give every
bucket an integer gain; a document's weight is the gains' sum, gathered from an array. A score adds noise that depends on the
document's id alone, so the highest scores are a sample without replacement, the same on every run.

The draw is an external merge. Each partition of eligible rows becomes a sorted run of packed blocks, cut at score bounds into
ranges and written to the shared folder. Exact counts by range tell where the draw ends, so later ranges are never read. One
task a range takes its blocks in the order of their first keys and merges the runs with a tournament tree, one block a run in
memory; it knows the rank it starts at, and the last one stops at the exact count. Bounds of ranges only balance the work:
they come from approximate quantiles, ranks from the exact counts.

Sizes: gains are `buckets` long whatever the data. The driver sees one count a range, and there are at most MAX_RANGES. A
score value holds at most 1 in 2,700 of rows with distinct ids (the noise's densest point), so a range can always be cut.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import dropped, few_rows, work_dir, written

BUCKETS = 10_000
SEED = 2024
BLOCK = 1024
RANGE_ROWS = 1_000_000
MAX_RANGES = 4096
LAST = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_features long, weight long, score long, rank long"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # bytes above 7F belong to characters beyond ASCII
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK_COLUMNS = 6  # key (-score, id or LAST), row number; and id is null, n_features, weight


class Buckets(dict):
    """A word's bytes to its bucket; cleared when it holds too many."""

    def __init__(self, buckets: int, limit: int = 500_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = b = zlib.crc32(word) % self.buckets
        return b

    def of(self, text: str | None, grams: int) -> tuple[int, np.ndarray]:
        """Number of words and the buckets of all features of a text."""
        words = _WORD.findall((text or "").encode().translate(_LOWER))
        out = [np.fromiter(map(self.__getitem__, words), np.uint32, len(words))]
        for n in range(2, grams + 1):
            out.append(np.asarray([zlib.crc32(b" ".join(words[i : i + n])) % self.buckets for i in range(len(words) - n + 1)], np.uint32))
        return len(words), np.concatenate(out)


def featured(docs: DataFrame, buckets: int = BUCKETS, grams: int = 1) -> DataFrame:
    """doc_id, h (noise hash), n_words and f, the buckets of all features as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in few_rows(batches):
            found = [known.of(t, grams) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([f.astype("<u4").tobytes() for _, f in found], pa.binary())],
                names=["doc_id", "h", "n_words", "f"],
            )

    doc_id = docs["doc_id"].cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return docs.select(doc_id.alias("doc_id"), noise.alias("h"), docs["text"]).mapInArrow(run, "doc_id long, h long, n_words long, f binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket: one array a task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in few_rows(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("f").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer log-ratio of each bucket, smoothed by one."""
    s, t, k = source.sum(), target.sum(), len(source)
    return np.floor(1000 * np.log((target + 1.0) * float(s + k) / ((source + 1.0) * float(t + k)))).astype(np.int64)


def scored(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: weights are gathered from the array of gains."""
    shared = features.sparkSession.sparkContext.broadcast(gain)  # `buckets` long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            at = [np.frombuffer(f, "<u4") for f in batch.column(3).to_pylist()]
            weight = np.asarray([int(shared.value[x].sum()) for x in at], np.int64)
            h = np.asarray(batch.column(1), np.int64)
            score = weight + np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(x) for x in at], pa.int64()), pa.array(weight), pa.array(score)],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return features.select("doc_id", "h", "n_words", "f").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tournament tree over runs: each inner node holds the run with the smaller key below it, so a change replays one path."""

    def __init__(self):
        self.size, self.rows, self.at = 1, [[]], [0]
        self.tree = [0, 0]
        self.leaf: dict[int, int] = {}

    def _key(self, leaf: int):
        at = self.at[leaf]
        return self.rows[leaf][at] if at < len(self.rows[leaf]) else None

    def _better(self, a: int, b: int) -> int:
        x, y = self._key(a), self._key(b)
        return b if x is None or (y is not None and y < x) else a

    def _replay(self, leaf: int) -> None:
        node = (self.size + leaf) >> 1
        while node:
            self.tree[node] = self._better(self._child(2 * node), self._child(2 * node + 1))
            node >>= 1

    def _child(self, node: int) -> int:
        return node - self.size if node >= self.size else self.tree[node]

    def _grow(self) -> None:
        self.rows += [[] for _ in range(self.size)]
        self.at += [0] * self.size
        self.size *= 2
        self.tree = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = self._better(self._child(2 * node), self._child(2 * node + 1))

    def add(self, run: int, rows: list[tuple]) -> None:
        """Put a run's next block on its leaf; the block before it is used up."""
        leaf = self.leaf.setdefault(run, len(self.leaf))
        while leaf >= self.size:
            self._grow()
        self.rows[leaf], self.at[leaf] = rows, 0
        self._replay(leaf)

    def _runner_up(self, leaf: int):
        """The smallest key outside the winner's leaf: one of the losers on its path."""
        best, node = None, self.size + leaf
        while node > 1:
            key = self._key(self._child(node ^ 1))
            if key is not None and (best is None or key < best):
                best = key
            node >>= 1
        return best

    def below(self, horizon: tuple | None) -> Iterator[tuple]:
        """Rows in order, as far as they sort before `horizon` (None: all)."""
        while True:
            leaf = self._child(1)
            key = self._key(leaf)
            if key is None or (horizon is not None and key >= horizon):
                return
            bound = self._runner_up(leaf)
            if horizon is not None and (bound is None or horizon < bound):
                bound = horizon
            rows, a = self.rows[leaf], self.at[leaf]
            b = len(rows) if bound is None else max(a + 1, bisect_left(rows, bound, a))
            yield from rows[a:b]
            self.at[leaf] = b
            if b == len(rows):
                self.rows[leaf] = []
                self.at[leaf] = 0
            self._replay(leaf)


def sorted_runs(table: DataFrame, bounds: list[int]) -> DataFrame:
    """Blocks (range, run, first key, rows, packed rows) of each partition's sorted rows, cut where a range begins.

    Bounds fall; range r has the scores from bounds[r] up that are below bounds[r - 1].
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_k")]
    edges = -np.asarray(bounds, np.int64)
    names = ["doc_id", "_k", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = None
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                doc, k, n, w, s = (part.column(i) for i in range(5))
                if run_id is None:
                    run_id = k[0].as_py()  # a row number of this partition, so no other run has it
                null = np.asarray(doc.is_null())
                ids = np.where(null, LAST, np.asarray(doc.fill_null(0)))
                rows = np.stack([-np.asarray(s), ids, np.asarray(k), null.astype(np.int64), np.asarray(n), np.asarray(w)], 1)
                of = np.searchsorted(edges, rows[:, 0], side="left")  # a score at a bound still belongs above it
                cuts = [0, *(np.nonzero(np.diff(of))[0] + 1), len(rows)]
                pieces = [rows[i:j] for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(of[i]) for i in cuts[:-1]], pa.int64()),
                        pa.array([run_id] * len(pieces), pa.int64()),
                        *[pa.array([int(p[0, c]) for p in pieces], pa.int64()) for c in range(3)],
                        pa.array([len(p) for p in pieces], pa.int64()),
                        pa.array([p.tobytes() for p in pieces], pa.binary()),
                    ],
                    names=["range", "run", "k0", "k1", "k2", "n", "rows"],
                )

    return table.sortWithinPartitions(*order).select(*names).mapInArrow(run, "range long, run long, k0 long, k1 long, k2 long, n long, rows binary")


def merged(blocks: DataFrame, starts: dict[int, int], count: int, parts: int) -> DataFrame:
    """Rows of the ranges in `starts` with their ranks, up to `count` of them: one tournament a range, its blocks streamed in order."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(starts)  # one entry a range, at most MAX_RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple], first: int) -> pa.RecordBatch:
            a = np.asarray(rows, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[:, 1], pa.int64(), mask=a[:, 3] == 1), pa.array(a[:, 4]), pa.array(a[:, 5]), pa.array(-a[:, 0]),
                 pa.array(np.arange(first, first + len(a))), pa.array(a[:, 2])],
                names=["doc_id", "n_features", "weight", "score", "rank", "_k"],
            )

        now, tree, out, rank = None, None, [], 0

        def drain(horizon):
            nonlocal out, rank
            if tree is None or rank + len(out) > count:
                return
            for row in tree.below(horizon):
                if rank + len(out) > count:  # the exact count is reached
                    break
                out.append(row)
                if len(out) == 4096:
                    yield packed(out, rank)
                    rank, out = rank + len(out), []

        def finish():
            nonlocal out, rank
            yield from drain(None)
            if out:
                yield packed(out, rank)
            out = []

        for batch in batches:
            for r, run_id, k0, k1, k2, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 6))):
                if r != now:
                    yield from finish()
                    now, tree, rank = r, Tournament(), shared.value[r] + 1
                yield from drain((k0, k1, k2))  # no block still to come has a smaller key
                tree.add(run_id, list(map(tuple, np.frombuffer(data, np.int64).reshape(-1, _BLOCK_COLUMNS).tolist())))
        yield from finish()

    wanted = blocks.where(F.col("range").between(min(starts), max(starts)))
    ordered = wanted.repartition(parts, "range").sortWithinPartitions("range", "k0", "k1", "k2")
    return ordered.mapInArrow(run, SCHEMA + ", _k long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, grams: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for rows that aren't drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn, highest scores first, ties to the smaller
    id. Null texts have no features and weight 0; a null id takes part as the empty id and loses ties; repeated rows are drawn
    one by one, in any order among equals; an empty table gives no rows, an empty target leaves only the smoothing. Long texts
    are read whole. Columns other than doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "resampling")
    features = written(featured(docs, buckets, grams), folder, "features", "zstd")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), target["text"])
    gain = gains(bucket_counts(features, buckets), bucket_counts(featured(wanted, buckets, grams), buckets))
    table = written(scored(features, gain).withColumn("_k", F.monotonically_increasing_id()), folder, "scored")
    dropped(spark, f"{folder}/features")
    eligible = table.where(F.col("n_words") >= least_words)
    count = percent * eligible.count() // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if count == 0:
        return table.select(*columns, undrawn)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = min(MAX_RANGES, max(4 * parts, -(-count // RANGE_ROWS)))
    shares = [1 - percent / 100 * (k + 1) / n for k in range(n)]
    bounds = eligible.agg(F.percentile_approx("score", shares, 20 * n).alias("q")).first().q
    blocks = written(sorted_runs(eligible, sorted({int(b) for b in bounds}, reverse=True)), folder, "runs")
    starts, at = {}, 0
    for r, size in sorted((x.range, x.size) for x in blocks.groupBy("range").agg(F.sum("n").alias("size")).collect()):  # a row a range
        if at < count:
            starts[r] = at
        at += size
    drawn = written(merged(blocks, starts, count, max(parts, len(starts))), folder, "drawn")
    last = drawn.where(F.col("rank") == count).first()
    null_last = lambda c: F.coalesce(c, F.lit(int(LAST)))
    doc = int(LAST) if last.doc_id is None else last.doc_id
    later = (F.col("score") < last.score) | (F.col("score") == last.score) & (
        (null_last(F.col("doc_id")) > doc) | (null_last(F.col("doc_id")) == doc) & (F.col("_k") > last._k)
    )
    rest = table.where((F.col("n_words") < least_words) | later)
    return rest.select(*columns, undrawn).unionByName(drawn.select(*columns, "rank"))
