"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file row holds one document: its number of ids, control bytes (two bits an id: bytes less one, four ids a byte, low bits
first) and data bytes (the id's frequency rank, little-endian, 1 to 4 bytes). Rows ascend by doc_id within and across the
files, so a row's place in the corpus is its file's offset plus `local_start`. Reading decodes by numpy table lookup: a
control byte's four lengths come from a 256-row table, and ranks become ids again through the rank table.

Each text is encoded once. The rank table has one row a vocabulary entry, so its size is bounded; ids that are beyond the
table can't occur, as it is made from the counts of all ids written. Rank table and file offsets are written beside the
files, so a later session reads them from the folder alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import dropped, few_bytes, work_dir, written
from skeinwork.llm.units import WordRuns, loaded

END_ID = 2
RAW = "doc_id long, n long, ids binary"
FILES = "doc_id long, shard int, local_start long, n_tokens long, control binary, data binary"

#: Lengths of the four ids of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1).astype(np.uint8)


def encode_all(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of documents with n[0], n[1], ... ranks, and each document's number of data bytes."""
    r = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(int((n + -n % 4).sum()), np.uint8)
    codes[_padded(n)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    before = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ends = np.cumsum(n)
    return control, data, before[ends] - before[ends - n]


def _padded(n: np.ndarray) -> np.ndarray:
    """Places of all ids' lengths where each document begins with a new control byte."""
    return np.arange(n.sum()) + np.repeat(np.cumsum(-n % 4) - -n % 4, n)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks."""
    control, data, _ = encode_all(ranks, np.asarray([len(ranks)]))
    return control.tobytes(), data.tobytes()


def decode_all(control: bytes, data: bytes, n: np.ndarray) -> np.ndarray:
    """The ranks of documents with n[0], n[1], ... of them, whose control and data bytes follow one another."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[_padded(n)].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.nonzero(lengths > k)[0]
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    return decode_all(control, data, np.asarray([n]))


def strung(column: pa.Array) -> bytes:
    """All bytes of a binary column without nulls."""
    return b"".join(column.to_pylist())


def widened(data: bytes, n: int) -> np.ndarray:
    """Ids kept as 16 or 32 bits each; their number tells which."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary column whose rows hold the next n[0], n[1], ... values."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(n * values.itemsize)]), pa.int32())  # raises beyond 2 GB
    return pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number and bytes of the ids of each whole text (null: empty) with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = loaded(WordRuns, path)
        for batch in few_bytes(batches, 1, 1 << 24):  # the more texts, the fewer pieces for each
            ids, n = words.of(batch.column(1))
            ids, n = np.insert(ids, np.cumsum(n), END_ID), n + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), binaries(ids, n)], names=["doc_id", "n", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, RAW)


def _counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs: counted by task, summed by id; one row a vocabulary entry reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in few_bytes(batches, 1):
            n = np.bincount(widened(strung(batch.column(1)), batch.column(0).to_numpy().sum()), minlength=len(total))
            n[: len(total)] += total
            total = n
        ids = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    rows = raw.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_token_files(docs: DataFrame, path: str, folder: str) -> None:
    """Write all documents to folder/files in ascending doc_id order (nulls last, equal ids by their ids' bytes).

    Beside them go what reading needs: folder/ranks (id of each rank) and folder/offsets (ids before each file).
    """
    spark = docs.sparkSession
    encode_texts(docs, path).write.option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(RAW).parquet(f"{folder}/raw")
    counts = _counts(raw)
    by_rank = np.argsort(-counts, kind="stable").astype(np.uint32)
    written(spark.createDataFrame(pa.table({"rank": np.arange(len(by_rank)), "id": by_rank.astype(np.int64)})), folder, "ranks")
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in few_bytes(batches, 2):
            n = batch.column(1).to_numpy()
            control, data, size = encode_all(rank[widened(strung(batch.column(2)), n.sum())], n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + np.cumsum(n) - n), batch.column(1), binaries(control, -(-n // 4)), binaries(data, size)],
                names=["doc_id", "shard", "local_start", "n_tokens", "control", "data"],
            )
            at += int(n.sum())

    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ranged = raw.withColumn("h", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    files = written(ranged.mapInArrow(run, FILES), folder, "files")
    sizes = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())  # a row per file
    before = np.cumsum([0, *[n for _, n in sizes]])[:-1].tolist()
    written(spark.createDataFrame([(s, a) for (s, _), a in zip(sizes, before, strict=True)], "shard int, before long"), folder, "offsets")
    dropped(spark, f"{folder}/raw")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the folder alone: doc_id, start, n_tokens, ids_crc32."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").toArrow()  # a row per vocabulary entry
    by_rank = np.empty(ranks.num_rows, "<u4")
    by_rank[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()
    files = spark.read.schema(FILES).parquet(f"{folder}/files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_bytes(batches, 5):
            n = batch.column(3).to_numpy()
            ids = by_rank[decode_all(strung(batch.column(4)), strung(batch.column(5)), n)]
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(crc, pa.int64())], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    back = files.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    offsets = spark.read.schema("shard int, before long").parquet(f"{folder}/offsets")  # a row per file
    joined = back.join(F.broadcast(offsets), "shard")
    return joined.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Encode, write, and read back all documents.

    Null texts are empty (the end id alone), repeated rows are kept, other columns are left out, an empty table gives no
    rows. A very long text is one row of a file: its ids must fit in a worker.
    """
    folder = work_dir(docs.sparkSession, "token-files")
    write_token_files(docs, path, folder)
    return read_token_files(docs.sparkSession, folder)
