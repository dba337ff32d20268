"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

Ids are those of the sentencepiece library for a BPE model. Such an encoding is the only path of pieces over the text in
which each piece encodes to itself and each two neighbours encode to themselves, so it is a shortest-path problem whose
weights are 0 for such neighbours and minus infinity for others: a max-plus semiring. A giant document is cut into chunks;
a state at a cut is the piece that ends at it or runs over it, (characters before, characters after). Each chunk yields the
transfer matrix from the states at its left cut to those at its right. Matrices of neighbouring chunks are multiplied in the
max-plus sense, pair by pair, in log rounds of joins, so no task sees a document's whole chain; the states at the cuts are
handed back down through the rounds, and each chunk is backtraced on its own. A giant document's ids come together in one row,
as that is the result.

No piece holds a space after another character, so all paths meet where a word begins: inside a chunk only the parts before
the first and after the last such place depend on the cuts, and whole words between them are looked up, each distinct word
encoded once per worker by the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import few_rows, keyed, work_dir, written

CHUNK = 32_768
CHUNKS_A_TASK = 64
LONGEST = 64  # characters; longer words are not kept
MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_START = re.compile(f"(?<=[^{MARK}]){MARK}")


class Pieces(dict):
    """A BPE model: words (from a space mark to before the next) to ids as little-endian 32-bit bytes; bounded."""

    def __init__(self, path: str, limit: int = 500_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        super().__init__()
        self.limit = limit
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        spec.normalizer_spec.add_dummy_prefix = False  # parts of texts are encoded as they stand
        self.model = SentencePieceProcessor(model_proto=spec.SerializeToString())
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [i for i in range(len(names)) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece with a space inside: words can't be encoded apart")
        self.longest = max(map(len, self.ids))
        self.surface = [names[i].replace(MARK, " ").encode() for i in range(len(names))]
        for i in range(len(names)):
            if self.model.is_byte(i):
                self.surface[i] = bytes([int(names[i][3:5], 16)])
            elif self.model.is_control(i):
                self.surface[i] = b""
        self.single: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def raw(self, text: str) -> list[int]:
        return self.model.encode(text)

    def words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that start with a space mark; every distinct word that isn't known yet is encoded once."""
        if len(self) > self.limit:
            self.clear()
        cut = [_UNIT.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self)) if cut else []
        self.update((w, np.asarray(x, "<u4").tobytes()) for w, x in zip(new, self.model.encode(new, num_threads=1) if new else [], strict=True))
        out = [b"".join(map(self.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del self[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes; the space that encoding put before the first word is taken off."""
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:] if out[:1] == b" " else out

    def alone(self, s: str) -> bool:
        """Whether a string can be a step of a path: a piece that encodes to itself, or a character that falls back to bytes."""
        if s not in self.single:
            self.single[s] = (s in self.ids and self.raw(s) == [self.ids[s]]) or (len(s) == 1 and s not in self.ids)
        return self.single[s]

    def follows(self, a: str, b: str) -> bool:
        """Whether two steps stay as they are when they stand next to each other."""
        if (a, b) not in self.pairs:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[a, b] = self.raw(a + b) == self.raw(a) + self.raw(b)
        return self.pairs[a, b]


def states(model: Pieces, text: str, cut: int) -> list[tuple[int, int]]:
    """All (start, end) of steps with start < cut <= end."""
    return [(s, e) for s in range(max(0, cut - model.longest), cut) for e in range(cut, min(len(text), s + model.longest) + 1) if model.alone(text[s:e])]


def paths(model: Pieces, text: str, entry: tuple[int, int] | None, at: int, stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
    """Steps that end at or beyond `stop` and those before them, each with the step before it, from `entry` that ends at `at`."""
    before: dict[tuple[int, int], tuple[int, int] | None] = {}
    ends: dict[int, list] = {at: [entry]}
    for p in range(at, stop):
        for last in ends.pop(p, ()):
            for e in range(p + 1, min(len(text), p + model.longest) + 1):
                step = (p, e)
                if step not in before and model.alone(text[p:e]) and (last is None or model.follows(text[last[0] : last[1]], text[p:e])):
                    before[step] = last
                    ends.setdefault(e, []).append(step)
    return before


def _walk(before: dict, step) -> list[tuple[int, int]]:
    out = []
    while step in before:
        out.append(step)
        step = before[step]
    return out[::-1]


def _word_starts(text: str, lo: int, hi: int) -> tuple[int | None, int | None]:
    """First and last place in [lo, hi) where a word begins."""
    first = last = None
    for m in _START.finditer(text, lo, hi):
        first = m.start() if first is None else first
        last = m.start()
    return first, last


def transfer(model: Pieces, text: str, lo: int, hi: int) -> list[tuple[tuple[int, int] | None, tuple[int, int] | None]]:
    """The finite entries of a chunk's max-plus matrix: (state at lo, state at hi). None: the text's start, or its end."""
    entries = states(model, text, lo) if lo else [None]
    first, last = _word_starts(text, lo, hi)
    goals = None
    if first is not None:
        tail = paths(model, text, None, last, hi)
        goals = [s for s in tail if s[1] >= hi] if hi < len(text) else [None]
    out = []
    for entry in entries:
        at = entry[1] if entry else 0
        if at >= hi:
            out.append((entry, entry if hi < len(text) or at == hi else None))
            continue
        if first is not None and at <= first:
            steps = paths(model, text, entry, at, first) if at < first else {}
            if at == first or any(s[1] == first for s in steps):
                out += [(entry, g) for g in goals]
        else:
            steps = paths(model, text, entry, at, hi)
            ends = [s for s in steps if s[1] >= hi]
            out += [(entry, g) for g in ends] if hi < len(text) else [(entry, None)] if any(s[1] == hi for s in ends) else []
    return out


def backtrace(model: Pieces, text: str, lo: int, hi: int, entry, goal) -> bytes:
    """Ids of the steps that start in [lo, hi), given the states at both cuts."""
    at = entry[1] if entry else 0
    if at >= hi:
        return b""
    whole = hi == len(text)

    def ids(steps) -> bytes:
        return np.asarray([i for a, b in steps for i in model.raw(text[a:b])], "<u4").tobytes()

    first, last = _word_starts(text, lo, hi)
    if first is None or at > first:
        steps = paths(model, text, entry, at, hi)
        return ids(_walk(steps, goal if goal in steps else next(s for s in steps if s[1] == hi)))
    head = paths(model, text, entry, at, first) if at < first else {}
    out = ids(_walk(head, next((s for s in head if s[1] == first), None)))
    if whole:
        return out + model.words([text[first:hi]])[0]
    tail = paths(model, text, None, last, hi)
    return out + model.words([text[first:last]])[0] + ids(_walk(tail, goal))


_MODELS: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def marked(text: str | None) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


def coded(state: tuple[int, int] | None, cut: int) -> int:
    """A state as a number: 0 for the text's start or end, else (characters before the cut, characters after it)."""
    return 0 if state is None else (cut - state[0]) << 16 | (state[1] - cut)


def decoded(code: int, cut: int) -> tuple[int, int] | None:
    return None if code == 0 else (cut - (code >> 16), cut + (code & 0xFFFF))


def products(entries: DataFrame, chunks: int, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """Max-plus products of neighbouring matrices by (document, k div 2), in as many rounds as it takes to have one a document.

    entries (_rk, k, f, t, w): finite weights from state f at the left to t at the right. Returns the rounds' tables with
    `mid`, the state between the two (null where a matrix had no right neighbour), and the last round's entries.
    """
    rounds = []
    while chunks > 1:
        half = F.floor(F.col("k") / 2).cast("int")
        last = F.max("k").alias("last")
        left = entries.where("k % 2 = 0").select("_rk", half.alias("h"), "f", F.col("t").alias("mid"), F.col("w").alias("wa"))
        right = entries.where("k % 2 = 1").select("_rk", half.alias("h"), F.col("f").alias("mid"), "t", F.col("w").alias("wb"))
        best = F.max(F.struct((F.col("wa") + F.col("wb")).alias("w"), (-F.col("mid")).alias("m")))  # ties: the least state
        pairs = left.join(right, ["_rk", "h", "mid"]).groupBy("_rk", "h", "f", "t").agg(best.alias("x")).select("_rk", F.col("h").alias("k"), "f", "t", "x.w", (-F.col("x.m")).alias("mid"))
        odd = entries.join(entries.groupBy("_rk").agg(last), "_rk").where("k = last AND k % 2 = 0").select("_rk", half.alias("k"), "f", "t", "w", F.lit(None).cast("long").alias("mid"))
        rounds.append(written(pairs.unionByName(odd), folder, f"product-{len(rounds)}"))
        entries, chunks = rounds[-1].select("_rk", "k", "f", "t", "w"), (chunks + 1) // 2
    return rounds, entries


def cut_states(rounds: list[DataFrame], entries: DataFrame, folder: str) -> DataFrame:
    """_rk, k, f, t: the states at both cuts of every chunk on the one best path, handed down through the rounds."""
    at = entries.select("_rk", "k", "f", "t")  # one entry a document: from its start to its end
    for n in range(len(rounds) - 1, -1, -1):
        found = at.join(rounds[n].select("_rk", "k", "f", "t", "mid"), ["_rk", "k", "f", "t"])
        alone = found.where("mid IS NULL").select("_rk", (F.col("k") * 2).alias("k"), "f", "t")
        left = found.where("mid IS NOT NULL").select("_rk", (F.col("k") * 2).alias("k"), "f", F.col("mid").alias("t"))
        right = found.where("mid IS NOT NULL").select("_rk", (F.col("k") * 2 + 1).alias("k"), F.col("mid").alias("f"), "t")
        at = written(alone.unionByName(left).unionByName(right), folder, f"states-{n}")
    return at


def _giants(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """_rk and ids of documents longer than a chunk: matrices by chunk, products by pairs of chunks, backtraces by chunk."""
    spark = docs.sparkSession
    folder = work_dir(spark, "sentencepiece")
    margin = 2 * loaded(path).longest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1):
            rk, text = batch.column(0)[0].as_py(), marked(batch.column(1)[0].as_py())
            for first in range(0, len(text), 64 * chunk):
                rows = []
                for lo in range(first, min(len(text), first + 64 * chunk), chunk):
                    hi, base = min(len(text), lo + chunk), max(0, lo - margin)
                    rows.append((rk, lo // chunk, lo - base, hi - base, text[base : hi + margin]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["_rk", "k", "lo", "hi", "t"])

    chunks = written(docs.select("_rk", "text").mapInArrow(cut, "_rk long, k int, lo int, hi int, t string"), folder, "chunks")
    number, longest = chunks.agg(F.count("*"), F.coalesce(F.max("k") + 1, F.lit(0))).first()
    parts = max(1, number // CHUNKS_A_TASK)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in few_rows(batches):
            rk, ks, f, t = [], [], [], []
            for doc, k, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in transfer(model, text, lo, hi):
                    rk.append(doc)
                    ks.append(k)
                    f.append(coded(a, lo))
                    t.append(coded(b, hi))
            yield pa.RecordBatch.from_arrays([pa.array(rk, pa.int64()), pa.array(ks, pa.int32()), pa.array(f, pa.int64()), pa.array(t, pa.int64()), pa.array(np.zeros(len(rk)))], names=["_rk", "k", "f", "t", "w"])

    entries = written(chunks.repartition(parts, "_rk", "k").mapInArrow(matrices, "_rk long, k int, f long, t long, w double"), folder, "entries")
    cuts = cut_states(*products(entries, longest, folder), folder)

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in few_rows(batches):
            out = []
            for lo, hi, t, f, g in zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True):
                out.append(backtrace(model, t, lo, hi, decoded(f, lo), decoded(g, hi)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_rk", "k", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1):
            ids = [x["ids"] for x in batch.column(1)[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(ids)], pa.binary()), pa.array([len(ids)], pa.int32())], names=["_rk", "ids", "chunks"])

    placed = chunks.repartition(parts, "_rk", "k").join(cuts.repartition(parts, "_rk", "k").withColumnRenamed("t", "g"), ["_rk", "k"])
    traced = placed.select("_rk", "k", "lo", "hi", "t", "f", "g").mapInArrow(traces, "_rk long, k int, ids binary")
    by_doc = traced.groupBy("_rk").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))
    return by_doc.mapInArrow(joined, "_rk long, ids binary, chunks int")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """docs' doc_id and text with ids (little-endian unsigned 32-bit bytes) and the number of chunks of each row.

    Null and empty texts have no ids, an empty table gives no rows. Rows that repeat an id, or have none, are rows of their
    own; other columns are left out.
    """
    spark = docs.sparkSession
    docs = keyed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), work_dir(spark, "sentencepiece-rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in few_rows(batches):
            ids = model.words([marked(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int32())], names=["doc_id", "text", "ids", "chunks"])

    big = F.length("text") >= chunk
    short = docs.where(~F.coalesce(big, F.lit(False))).select("doc_id", "text").mapInArrow(run, "doc_id long, text string, ids binary, chunks int")
    giant = docs.where(big)
    return short.unionByName(giant.join(_giants(giant, path, chunk), "_rk").select("doc_id", "text", "ids", "chunks"))


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chunks and round_trip: whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in few_rows(batches):
            ids = batch.column(2).to_pylist()
            same = [model.decode(x) == (t or "").replace(MARK, " ").encode() for t, x in zip(batch.column(1).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), batch.column(3), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "n_chunks", "round_trip"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chunks int, round_trip boolean")
