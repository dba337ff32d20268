"""Bulk-synchronous best-fit packing of tokenized documents into sequences of fixed capacity.

A document's ids are cut into pieces of the capacity, the first taking what is left over. Pieces are range-sorted once by
(length, document, piece); as lengths are at most the capacity, a piece is named by its length and its rank in that class.
Documents and gaps are counted by class, at most one row a token of capacity, whatever the number of documents. From the
longest class down, each takes its successor gaps, the smallest that fit, and a gap takes as many of the class as fit into
it; a new sequence is opened only where no gap fits. That is best-fit decreasing for all documents of a class at once.
Gaps with the same contents so far are a range of sequences, so the plan is a list of runs: ranks of a class to a range of
sequences. A class splits at most two ranges, so the runs are bounded by the capacity too. Within a class conflicts are
resolved by rank: each document looks up the run that holds its (length, rank).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import few_rows, work_dir, written
from skeinwork.llm.units import ByteIds, loaded

CAPACITY = 1024
END_ID = 2
RANK_BITS = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every document: whole text (null: empty), end id appended, the first piece the shorter one."""
    end = np.asarray([END_ID], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = loaded(ByteIds, path).of
        for batch in few_rows(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([ids_of(text or ""), end]).astype("<u4", copy=False)
                n = len(ids)
                a, b, k = 0, n % capacity or capacity, 0
                while a < n:
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b])))
                    a, b, k = b, b + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, PIECES)


def ranked(df: DataFrame, size: str, ties: list[str], folder: str, name: str, capacity: int) -> tuple[DataFrame, np.ndarray]:
    """df with `rank` within its size class, by a range sort; and the number of rows of each class.

    Ranks are partition offset plus place: what reaches the driver is a row for each pair of partition and class that
    meet, which range-sorted data have at most partitions + capacity of.
    """
    order = [size, *ties]
    df = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), folder, name)
    part, place = F.shiftright("_i", 33).cast("long"), F.col("_i").bitwiseAND((1 << 33) - 1)
    met = df.groupBy(part.alias("p"), F.col(size).cast("long").alias("c")).count().collect()
    counts, before, at = np.zeros(capacity + 1, np.int64), {}, 0
    for p, c, n in sorted((r.p, r.c, r["count"]) for r in met):
        before.setdefault(p, at)
        counts[c] += n
        at += n
    first = np.cumsum(counts) - counts
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_p long, _o long")
    starts = spark.createDataFrame([(c, int(first[c])) for c in range(capacity + 1)], "_c long, _f long")
    df = df.withColumn("_p", part).withColumn("_c", F.col(size).cast("long"))
    df = df.join(F.broadcast(offsets), "_p", "left").join(F.broadcast(starts), "_c", "left")
    return df.withColumn("rank", F.col("_o") + place - F.col("_f")).drop("_p", "_c", "_i", "_o", "_f"), counts


def sweep(docs: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, documents a sequence, offset of the first) that place docs[l] documents of each length l."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free to ranges of sequences: first, number
    open_classes: list[int] = []
    opened = 0

    def add(free: int, first: int, number: int) -> None:
        if free and number:
            if free not in gaps:
                gaps[free] = []
                bisect.insort(open_classes, free)
            gaps[free].append((first, number))

    for length in range(capacity, 0, -1):
        left, rank = int(docs[length]), 0
        while left:
            at = bisect.bisect_left(open_classes, length)
            if at < len(open_classes):
                free = open_classes[at]
                first, number = gaps[free].pop()
                if not gaps[free]:
                    del gaps[free], open_classes[at]
            else:
                free, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            each = free // length
            whole = min(number, left // each)
            rest = min(left - whole * each, each) if whole < number else 0
            for n, k, start in ((whole, each, first), (bool(rest), rest, first + whole)):
                if n:
                    runs.append((length, rank, start, k, capacity - free))
                    add(free - k * length, start, int(n))
                    rank += n * k
                    left -= n * k
            add(free, first + whole + bool(rest), number - whole - bool(rest))
    return np.asarray(runs, np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and gapless offset; no rows give no rows."""
    spark = items.sparkSession
    items, docs = ranked(items, "length", ["doc_id", "piece", "ids_crc32"], work_dir(spark, "packing"), "items", capacity)
    runs = sweep(docs, capacity)
    runs = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, seq, each, offset = runs.value.T
        keys = (length << RANK_BITS) + first
        for batch in batches:
            size, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, (size << RANK_BITS) + rank, "right") - 1
            place = rank - first[at]
            where = [pa.array(seq[at] + place // each[at]), pa.array(offset[at] + place % each[at] * size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return items.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack all rows of docs; null ids and repeated rows are packed like any other row, no rows give none.

    Pieces are written once, so texts are encoded once; a very long text is one row's work and gives many narrow rows.
    """
    return pack(written(pieces(docs, path, capacity), work_dir(docs.sparkSession, "packing-pieces"), "pieces"), capacity)
