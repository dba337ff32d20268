"""Helpers shared by the training-data operators: shared work folder, row keys, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names no such folder (tests on one machine) a temporary one is set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and sc.master.startswith("local"):
        base = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str, codec: str = "snappy") -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder that is no longer needed, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with those of an operator."""
    return df.select(*[df[n] for n in names])


def keyed(df: DataFrame, folder: str, order: str = "doc_id", key: str = "_rk") -> DataFrame:
    """Add a unique long key that sorts as `order`.

    Unique ids are their own key. Where ids repeat or are null, rows are range-sorted by (id, text), nulls last, and
    numbered by partition offset plus place in the partition, so no task sees more than its own range.
    """
    ids = df.select(order)
    if not ids.where(F.col(order).isNull()).take(1) and not ids.groupBy(order).count().where("count > 1").take(1):
        return df.withColumn(key, F.col(order).cast("long"))
    cols = [F.col(order).asc_nulls_last()] + ([F.xxhash64("text")] if "text" in df.columns else [])
    ranged = written(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(key, F.monotonically_increasing_id()), folder, "keyed")
    part = F.shiftright(key, 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).collect()  # a row per partition
    offsets, at = {}, 0
    for p, n in sorted((r._p, r._n) for r in sizes):
        offsets[p], at = at, at + n
    table = df.sparkSession.createDataFrame([(p, o) for p, o in offsets.items()] or [(0, 0)], "_p long, _o long")
    return (
        ranged.withColumn("_p", part).join(F.broadcast(table), "_p", "left")
        .withColumn(key, F.col("_o") + F.col(key).bitwiseAND((1 << 33) - 1)).drop("_p", "_o")
    )


class WordHashes(dict):
    """Words as bytes to 64-bit hashes; trim() between documents keeps it bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > self.limit:
            self.clear()
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Hash of every run of k consecutive word hashes; wraps in 64 bits."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for c, i in zip(odd_constants(k, seed + k), range(k)):
        acc += words[i : i + n] * c
    return mixed(acc)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def few_rows(batches, rows: int = 256):
    """Batches of at most `rows` rows, cut without a copy. Spark bounds a batch in bytes; this bounds what is made of it at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def few_bytes(batches, column: int, most: int = 1 << 21):
    """Batches whose texts or bytes in a column hold at most `most` bytes, cut without a copy; a longer one is a batch of its own."""
    for batch in batches:
        size, a, total = pc.binary_length(batch.column(column)).fill_null(0).to_pylist(), 0, 0
        for b, n in enumerate(size):
            if total + n > most and b > a:
                yield batch.slice(a, b - a)
                a, total = b, 0
            total += n
        if a < len(size):
            yield batch.slice(a)
