"""Substring deduplication over a log-structured fingerprint index.

A window is WINDOW consecutive words; its fingerprint is the least hash of the GRAM-word runs inside it, so neighbouring
windows share one and equal windows always have equal ones. The index is a folder: a document file per batch (row key, text,
the document's fingerprints), and sorted immutable runs of the distinct fingerprints of all batches so far. A new batch is
hashed once, into its document file; its fingerprints are joined with the runs, and those that the history or the batch itself
has before are shared. What is new becomes the next run. Runs lie on levels, one a level at most: a new run and those on the levels
from 0 up without a gap are merged to one on the level above, so a fingerprint is written anew once a level, and there are as many
runs as the number of batches has binary ones. The state (names of files and runs, next row key) is written last, so that an index is
opened again from its folder as it was after the last complete batch; a batch whose keys begin below the next one is refused.

Shared fingerprints are then verified on the windows themselves: the 64-bit hash of all WINDOW words of each occurrence, and
the first by (document, start) stays. Documents of the history and the batch without a shared fingerprint are told by the
fingerprints kept with them and not hashed again. Which fingerprints are shared is told by a Bloom filter of fixed size; where
it errs, or fills up, more windows are sent to the shuffle and the result is the same. Windows that repeat within a task's
block are settled there, so a passage that many documents share costs a row a block; fingerprints with more than a 2000th of
all occurrences (so fewer than 2000 of them) are dealt by window instead of by fingerprint. Different windows are taken for
equal only if their hashes agree and they meet in one block or slice of about 2**20 windows: for W windows in all, about
W * 2**20 / 2**65 such pairs are to be expected, less than one in 10**13 windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.common import WordHashes, dropped, few_rows, gram_hashes, keyed, listed, mixed, text_bytes, work_dir, written

WINDOW = 20
GRAM = 8
RUN = 32
BLOCK_WORDS = 1_000_000
FILTER_BITS = 25
MAX_RUNS = 63  # one a level
HOT_PARTS = 2000


def window_marks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Fingerprint and full hash of every window of a document, given its word hashes; and whether a gram repeats in it."""
    full = gram_hashes(words, WINDOW)
    least, width = gram_hashes(words, GRAM), WINDOW - GRAM + 1
    if not len(full):
        return full, full, False
    again = len(np.unique(least)) < len(least)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[: len(full)], least[width - step : width - step + len(full)]), full, again


def _blocks(batches: Iterator[pa.RecordBatch], filter_words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row key, start, fingerprint, full hash of the windows of a block of documents, in order of key and start.

    Documents without a fingerprint that passes the filter are left out.
    """
    hashes = WordHashes()

    def packed(docs):
        docs.sort(key=lambda d: d[0])
        rk = np.repeat(np.asarray([d[0] for d in docs], np.int64), [len(d[1]) for d in docs])
        start = np.concatenate([np.arange(len(d[1]), dtype=np.int32) for d in docs])
        return rk, start, np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs])

    docs, size = [], 0
    for batch in few_rows(batches):
        fps = batch.column(2).to_pylist()
        ends = np.cumsum([len(x) // 8 for x in fps])
        hits = np.concatenate(([0], np.cumsum(_passes(filter_words, np.frombuffer(b"".join(fps), np.uint64)))))
        some = np.diff(hits[np.concatenate(([0], ends))]) > 0
        batch = batch.filter(pa.array(some))
        for rk, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            marks, full, _ = window_marks(hashes.of(data.split()))
            docs.append((rk, marks, full))
            size += len(full)
            if size >= BLOCK_WORDS:
                yield packed(docs)
                docs, size = [], 0
    if docs:
        yield packed(docs)


DOCUMENTS = "_rk long, text string, fps binary"


def document_file(docs: DataFrame) -> DataFrame:
    """_rk, text and fps: the fingerprints of the runs of neighbouring windows that share one.

    A run may hold equal windows only where words recur in its document; there each counts twice, so that it is looked into.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in few_rows(batches):
            out = []
            for data in text_bytes(batch.column(1)):
                marks, _, again = window_marks(hashes.of(data.split()))
                new = np.ones(len(marks), bool)
                new[1:] = marks[1:] != marks[:-1]
                fps = marks[new]
                out.append((np.concatenate([fps, fps]) if again else fps).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_rk", "text", "fps"])

    return docs.select("_rk", "text").mapInArrow(run, DOCUMENTS)


def fingerprints(documents: DataFrame) -> DataFrame:
    """fp and c: the number of its occurrences, counted by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, c = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            for a in range(0, len(fp), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(fp[a : a + 20_000]), pa.array(c[a : a + 20_000])], names=["fp", "c"])

    return documents.select("fps").mapInArrow(run, "fp long, c long").groupBy("fp").agg(F.sum("c").alias("c"))


def _slots(fp: np.ndarray) -> list[np.ndarray]:
    h = mixed(fp.view(np.uint64) ^ np.uint64(0x5BD1E995))
    return [(h >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1) for s in (0, 32)]


def bloom(shared: DataFrame) -> np.ndarray:
    """A Bloom filter of 2**FILTER_BITS bits over shared.fp, as 64-bit words: at most so many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            at = np.concatenate(_slots(batch.column(0).to_numpy().astype(np.int64)))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["w", "b"])

    words = shared.select("fp").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _passes(filter_words: np.ndarray, fp: np.ndarray) -> np.ndarray:
    ok = np.ones(len(fp), bool)
    for at in _slots(fp):
        ok &= (filter_words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


STATE = "step int, runs array<string>, files array<string>, next long"
OCCURRENCES = "key long, rk long, pos int, todo long, known long, full binary"


def occurrences(documents: DataFrame, filter_words, hot: np.ndarray) -> DataFrame:
    """Runs of up to RUN windows that may be shared: bits of those not seen before in the block, with their hashes, and of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_words.value
        for rk, start, marks, full in _blocks(batches, bits):
            new = np.ones(len(rk), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (rk[1:] != rk[:-1])
            heads = np.nonzero(new)[0]
            sizes = np.diff(np.append(heads, len(rk)))
            keep = np.repeat(_passes(bits, marks[heads]), sizes)
            place = (np.arange(len(rk)) - np.repeat(heads, sizes))[keep]
            rk, start, marks, full = rk[keep], start[keep], marks[keep], full[keep]
            if not len(rk):
                continue
            is_hot = hot[np.minimum(np.searchsorted(hot, marks), len(hot) - 1)] == marks if len(hot) else np.zeros(len(rk), bool)
            heads = np.nonzero((place % RUN == 0) | is_hot)[0]
            sizes = np.diff(np.append(heads, len(rk)))
            shift = np.arange(len(rk)) - np.repeat(heads, sizes)
            first = np.zeros(len(rk), bool)
            first[np.unique(full, return_index=True)[1]] = True
            bit = np.int64(1) << shift.astype(np.int64)
            todo = np.add.reduceat(np.where(first, bit, 0), heads)
            known = np.add.reduceat(np.where(first, 0, bit), heads)
            ends = np.cumsum(np.add.reduceat(first.astype(np.int64), heads)) * 8
            key = np.where(is_hot[heads], full[heads], marks[heads])
            key = np.where(todo == 0, mixed(rk[heads].view(np.uint64)), key).view(np.int64)
            data = full[first].tobytes()
            for a in range(0, len(heads), 20_000):
                b = min(len(heads), a + 20_000)
                lo = int(ends[a - 1]) if a else 0
                offsets = np.concatenate(([0], ends[a:b] - lo)).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data[lo : int(ends[b - 1])])])
                part = heads[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[a:b]), pa.array(rk[part]), pa.array(start[part]), pa.array(todo[a:b]), pa.array(known[a:b]), blob],
                    names=["key", "rk", "pos", "todo", "known", "full"],
                )

    return documents.select("_rk", "text", "fps").mapInArrow(run, OCCURRENCES)


def repeated(found: DataFrame, since: int) -> DataFrame:
    """rk, pos, bits: the windows, from row key `since` on, that start earlier too. One sorted pass over each partition."""

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        key, todo = table.column("key").to_numpy(), table.column("todo").to_numpy()
        removed = table.column("known").to_numpy().copy()
        same = key[1:] == key[:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        many &= todo != 0
        at = np.nonzero(many)[0]
        if len(at):
            full = np.frombuffer(b"".join(table.column("full").take(pa.array(at)).to_pylist()), np.uint64)
            row, shift = np.nonzero((todo[at][:, None] >> np.arange(RUN)) & 1)
            later = np.ones(len(full), bool)
            later[np.unique(full, return_index=True)[1]] = False
            removed[at] |= np.bincount(row[later], 2.0 ** shift[later], len(at)).astype(np.int64)
        rk = table.column("rk").to_numpy()
        out = (removed != 0) & (rk >= since)
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(rk[out]), pa.array(table.column("pos").to_numpy()[out]), pa.array(removed[out])], names=["rk", "pos", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in few_rows(batches):
            if not batch.num_rows:
                continue
            waiting.append(batch)
            rows += batch.num_rows
            last = batch.column(0)[-1]
            if rows < 50_000 or waiting[0].column(0)[0] == last:
                continue
            table = pa.Table.from_batches(waiting)
            cut = int(np.searchsorted(table.column("key").to_numpy(), last.as_py()))  # the last key may go on
            out = settle(table.slice(0, cut))
            if out is not None:
                yield out
            waiting = table.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in waiting)
        if waiting and (out := settle(pa.Table.from_batches(waiting))) is not None:
            yield out

    return found.repartition("key").sortWithinPartitions("key", "rk", "pos").mapInArrow(run, "rk long, pos int, bits long")


class FingerprintIndex:
    """Document files and sorted immutable runs of fingerprints in a shared folder; opened again if the folder holds an index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.step, self.runs, self.files, self.next = 0, [], [], -(1 << 63)
        states = [int(x) for x in listed(spark, f"{folder}/state")]
        if states:
            last = spark.read.schema(STATE).parquet(f"{folder}/state/{max(states)}").first()  # one row
            self.step, self.runs, self.files, self.next = last.step, list(last.runs), list(last.files), last.next

    def _table(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def add(self, docs: DataFrame, since: int) -> DataFrame:
        """Merge a batch (_rk, text; its row keys start at `since`, above all earlier ones) and return its repeated windows."""
        if since < self.next:
            raise ValueError(f"row keys below {self.next} are in the index already")
        step = self.step + 1
        files = [*self.files, f"documents-{step}"]
        batch = written(document_file(docs), self.folder, files[-1], "zstd")
        own = fingerprints(batch)
        known = own.withColumn("old", F.lit(False))
        if self.runs:
            old = self._table(self.runs, "fp long").select("fp", F.lit(True).alias("_o"))
            known = own.join(old, "fp", "left").select("fp", "c", F.coalesce("_o", F.lit(False)).alias("old"))
        merged = written(known, self.folder, f"merged-{step}")
        shared = merged.where("c > 1 OR old").select("fp", "c")
        total = merged.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        limit = max(500, total // HOT_PARTS)
        hot = np.sort(np.asarray([r.fp for r in shared.where(F.col("c") > limit).select("fp").collect()], np.int64).view(np.uint64))
        bits = self.spark.sparkContext.broadcast(bloom(shared))
        out = written(repeated(occurrences(self._table(files, DOCUMENTS), bits, hot), since), self.folder, f"repeated-{step}")
        runs = self._levelled(merged.where("NOT old").select("fp"), step)
        last = batch.agg(F.max("_rk")).first()[0]
        following = max(self.next, since, since if last is None else last + 1)
        state = self.spark.createDataFrame([(step, runs, files, following)], STATE)
        written(state, self.folder, f"state/{step}")
        for name in [f"merged-{step}", *set(self.runs).difference(runs)]:
            dropped(self.spark, f"{self.folder}/{name}")
        self.step, self.runs, self.files, self.next = step, runs, files, following
        return out

    def _levelled(self, new: DataFrame, step: int) -> list[str]:
        """Write new fingerprints, merged with the runs of the lowest levels as far as these are taken, as one sorted run; runs have none in common."""
        levels = {int(r.split("-")[1]): r for r in self.runs}
        level = next(k for k in range(MAX_RUNS + 1) if k not in levels)
        merged = [levels[k] for k in range(level)]
        every = new.unionByName(self._table(merged, "fp long")) if merged else new
        written(every.repartitionByRange("fp").sortWithinPartitions("fp"), self.folder, f"run-{level}-{step}")
        return [*[r for r in self.runs if r not in merged], f"run-{level}-{step}"]


def _spans(docs: DataFrame, batches: int) -> DataFrame:
    """row (all columns of docs as a struct, so that none can clash) and spans: its repeated windows as an array of (pos, bits)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "substring")
    docs = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), folder)
    narrow = docs.select("_rk", "text")
    bounds = docs.stat.approxQuantile("_rk", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [-(1 << 63), *sorted({int(b) + 1 for b in bounds}), (1 << 63) - 1]
    index, found = FingerprintIndex(spark, folder), None
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = narrow.where(F.col("_rk").between(lo, hi - 1 if hi < (1 << 63) - 1 else hi))
        out = index.add(part, lo)
        found = out if found is None else found.unionByName(out)
    spans = found.groupBy("rk").agg(F.collect_list(F.struct("pos", "bits")).alias("spans"))
    return docs.select("row", "_rk").join(spans, F.col("_rk") == F.col("rk"), "left").select("row", "spans")


def kept_words(text: str | None, spans) -> tuple[list[bytes], int]:
    """Words that no repeated window covers, and the number of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    pos = np.asarray([s["pos"] for s in spans], np.int64)
    bits = np.asarray([s["bits"] for s in spans], np.int64)
    row, shift = np.nonzero((bits[:, None] >> np.arange(RUN)) & 1)
    starts = pos[row] + shift
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c], len(words)


def substring_digest(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Null and empty texts have no words, an empty table gives no rows, other columns are left out. Rows that repeat an id, or
    have none, are documents of their own, ordered by (id, nulls last, text hash). A very long text is hashed in one task.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(parts):
            n, removed, sha = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, total = kept_words(text, spans)
                n.append(total)
                removed.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = _spans(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), batches)
    return marked.select("row.*", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, batches: int = 2) -> DataFrame:
    """docs with repeated words taken out of text, and n_chars, where there is one, counted anew.

    A text that loses nothing stays as it is; one that does becomes its kept words joined by one space.
    """
    columns, place = docs.columns, docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(parts):
            out = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                out.append(b" ".join(kept_words(text, spans)[0]).decode() if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == place else batch.column(k) for k in range(len(columns))], names=columns)

    done = _spans(docs, batches).select("row.*", F.col("spans").alias("_" * (1 + max(map(len, columns))))).mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else done
