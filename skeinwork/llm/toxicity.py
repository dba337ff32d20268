"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words are lower-cased, stripped of punctuation and hashed; a word's embedding is the sum of those of the word and of its
first characters, so that forms of one stem share what is learned. Filters of several widths slide over the whole text,
each keeps its maximum, and a logistic unit turns the maxima into a score. Training fits on a bounded sample of
labelled documents outside the held-out fold (MAX_TRAIN and MAX_BYTES, parameters); the model's size doesn't depend on the data.

The language that picks a threshold is told from the text itself, by counts of function words; the columns lang, source
and doc_id are never read. Thresholds of each language are found on a part of the sample that isn't fitted, and scores are
rescaled piecewise so that each language's threshold lies at CUT: one cut serves all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import few_rows

BUCKETS = 1 << 15
PREFIXES = (4, 5)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
DROPOUT = 0.4
RATE = 0.02
BATCH = 64
MAX_TRAIN = 6000
MAX_BYTES = 64 << 20
LEAST_POSITIVE = 10
FEW_POSITIVE = 100
PRIOR, PRIOR_SCALE = 2.0, 0.5
CUT = 0.3
HELD_OUT = 2
CHUNK = 200_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Function words that tell four languages apart.
MARKERS = (
    "the of and to in is that for was it with by be this are".split(),
    "der die das und ist den dem zu mit von auf nicht für ein eine des".split(),
    "le les des et une du dans pour que qui est au pas sur par".split(),
    "el los las y que del una con para por se su al como".split(),
)
_LANG = {w: k for k, ws in reversed(list(enumerate(MARKERS))) for w in ws}
_STRIP = b".,;:!?\"'()[]*#$%&-_"


class Words(dict):
    """A word's bytes to its row here; rows hold the word's embedding buckets and the language that it marks.

    New words are collected while a text is looked up and get their rows together.
    """

    def __init__(self, project=None, limit: int = 200_000):
        super().__init__()
        self.project, self.limit = project, limit
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.subs = np.zeros((1024, 1 + len(PREFIXES)), np.int32)
        self.langs = np.zeros(1024, np.int32)
        self.rows = np.zeros((1024, self.project.shape[1]), np.float32) if self.project is not None else None
        self.filled, self.new_subs, self.new_langs, self.collecting = 0, [], [], False

    def __missing__(self, raw: bytes) -> int:
        word = raw.strip(_STRIP).decode("utf-8", "replace").lower()
        self[raw] = k = len(self)
        # bucket 0 stays empty: for short words' missing parts
        self.new_subs += [1 + xxhash.xxh3_64_intdigest(x) % (BUCKETS - 1) if x else 0 for x in (word, *[f"{n} {word[:n]}" if len(word) > n else "" for n in PREFIXES])]
        self.new_langs.append(1 + _LANG[word] if word in _LANG else 0)
        if not self.collecting:
            self._fill()
        return k

    def _fill(self) -> None:
        a, b = self.filled, len(self)
        while b > len(self.langs):
            self.subs = np.concatenate([self.subs, np.zeros_like(self.subs)])
            self.langs = np.concatenate([self.langs, np.zeros_like(self.langs)])
            if self.rows is not None:
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.subs[a:b] = np.asarray(self.new_subs, np.int32).reshape(b - a, -1)
        self.langs[a:b] = self.new_langs
        if self.rows is not None:
            self.rows[a:b] = sum(self.project[self.subs[a:b, j]] for j in range(self.subs.shape[1]))
        self.filled, self.new_subs, self.new_langs = b, [], []

    def of(self, text: bytes) -> np.ndarray:
        """Rows of a text's words, valid until the next text."""
        if len(self) > self.limit:
            self._reset()
        words = text.split()
        self.collecting = True
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        self.collecting = False
        if len(self) > self.filled:
            self._fill()
        return at


@dataclass
class Model:
    project: np.ndarray  # [buckets, sum of widths x filters]: what a bucket adds at each place of each filter
    bias: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray  # by language, the last for none

    def maxima(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Each filter's maximum over a text, at least 0; in chunks, so memory doesn't grow with the text."""
        out = np.zeros((len(WIDTHS), FILTERS), np.float32)
        for a in range(0, len(at), CHUNK):
            col = 0
            part = words.rows[at[a : a + CHUNK + WIDTHS[-1] - 1]]
            for k, width in enumerate(WIDTHS):
                n = min(CHUNK, len(part) - width + 1)
                if n > 0:
                    total = part[:n, col : col + FILTERS]
                    for j in range(1, width):
                        total = total + part[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
                    np.maximum(out[k], total.max(0) + self.bias[k], out=out[k])
                col += width * FILTERS
        return out.ravel()

    def plain(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.intercept, -30, 30)))

    def scores(self, words: Words, texts: list[bytes]) -> np.ndarray:
        """Calibrated scores of whole texts; a text without words has no evidence, so the intercept's score."""
        if not texts:
            return np.empty(0)
        pooled, langs = [], []
        for text in texts:
            at = words.of(text)
            pooled.append(self.maxima(words, at))
            langs.append(language(words.langs[at]))
        p, t = self.plain(np.stack(pooled)), self.thresholds[np.asarray(langs)]
        return np.where(p < t, p * CUT / t, CUT + (p - t) * (1 - CUT) / np.maximum(1 - t, 1e-9)).clip(0, 1)


def language(marks: np.ndarray) -> int:
    """Index of the language whose function words are most frequent (the first on ties), or the number of languages."""
    n = np.bincount(marks, minlength=len(MARKERS) + 1)[1:]
    return int(n.argmax()) if n.any() else len(MARKERS)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Train on four of five rows and calibrate on the fifth; without both labels the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    words = Words(limit=1 << 60)
    at = [words.of(t) for t in texts]
    subs = words.subs
    y = np.asarray(labels, np.float32)
    part = np.arange(len(y)) % 5 == 4
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    emb[0] = 0
    filt = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
    rate = float(y[~part].mean()) if (~part).any() else 0.0
    intercept = np.float32(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    if 0 < y[~part].sum() < FEW_POSITIVE:
        emb[:, 0], filt[0][:, :, 0], weights[0] = informed(at, subs, y, ~part), 0, 1
        filt[0][0, 0, 0] = 1
    state = {}

    def adam(name, value, grad, rows=None):
        m, v, t = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value), 0])
        state[name][2] = t = t + 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= RATE * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)

    train = np.nonzero(~part)[0]
    if 0 < rate < 1:
        for _ in range(EPOCHS * max(1, min(5, 1500 // len(train)))):  # a small sample is gone over more often
            for a in range(0, len(train), BATCH):
                if a == 0:
                    order = rng.permutation(train)
                batch = order[a : a + BATCH]
                pooled = np.zeros((len(batch), len(weights)), np.float32)
                where = np.full(pooled.shape, -1)
                shown = {}
                for i, d in enumerate(batch):
                    shown[i] = at[d][rng.random(len(at[d])) >= DROPOUT]
                    x = emb[subs[shown[i]]].sum(1)
                    for k, w in enumerate(WIDTHS):
                        n = len(x) - w + 1
                        if n <= 0:
                            continue
                        total = sum(x[j : j + n] @ filt[k][j] for j in range(w)) + bias[k]
                        best = total.argmax(0)
                        top = total[best, np.arange(FILTERS)]
                        own = slice(k * FILTERS, (k + 1) * FILTERS)
                        pooled[i, own] = np.maximum(top, 0)
                        where[i, own] = np.where(top > 0, best, -1)
                p = 1 / (1 + np.exp(-np.clip(pooled @ weights + intercept, -30, 30)))
                delta = ((p - y[batch]) / len(batch)).astype(np.float32)
                back = delta[:, None] * weights[None, :]
                g_filt = [1e-4 * f for f in filt]
                g_bias = [np.zeros_like(b) for b in bias]
                rows, grads = [], []
                for i in range(len(batch)):
                    for k, w in enumerate(WIDTHS):
                        for f in range(FILTERS):
                            c = k * FILTERS + f
                            if where[i, c] < 0 or back[i, c] == 0:
                                continue
                            hit = subs[shown[i][where[i, c] : where[i, c] + w]]
                            g_filt[k][:, :, f] += back[i, c] * emb[hit].sum(1)
                            g_bias[k][f] += back[i, c]
                            rows.append(hit.ravel())
                            grads.append(np.repeat(back[i, c] * filt[k][:, :, f], hit.shape[1], 0))
                adam("w", weights, pooled.T @ delta + 1e-3 * weights / len(train))
                one = np.asarray([intercept])
                adam("b", one, delta.sum(keepdims=True))
                intercept = one[0]
                for k in range(len(WIDTHS)):
                    adam(f"f{k}", filt[k], g_filt[k])
                    adam(f"c{k}", bias[k], g_bias[k])
                if rows:
                    flat = np.concatenate(rows)
                    unique, inverse = np.unique(flat, return_inverse=True)
                    total = np.zeros((len(unique), DIM), np.float32)
                    np.add.at(total, inverse, np.concatenate(grads))
                    adam("e", emb, total, unique)
                    emb[0] = 0
    else:
        weights[:] = 0
    project = np.concatenate([emb @ f[j] for f in filt for j in range(len(f))], 1)
    model = Model(project, bias, weights, float(intercept), np.full(len(MARKERS) + 1, CUT))
    model.thresholds = calibrated(model, [texts[i] for i in np.nonzero(part)[0]], y[part])
    return model


def informed(at: list[np.ndarray], subs: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """A first value of each word bucket for samples with few positives: how much likelier a document that holds it is to have label 1, shrunk and scaled."""
    seen = np.zeros((2, BUCKETS))
    for d in np.nonzero(use)[0]:
        seen[int(y[d]), np.unique(subs[at[d], 0])] += 1
    n0, n1 = max(1, int((y[use] == 0).sum())), max(1, int((y[use] == 1).sum()))
    odds = np.log((seen[1] + PRIOR) / n1 / ((seen[0] + PRIOR * n0 / n1) / n0))
    odds[0] = 0
    return np.clip(odds, -2, 2) * PRIOR_SCALE


def calibrated(model: Model, texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Each language's threshold of best F1 on rows that weren't fitted; that of all rows where a language has few; a half where all have."""
    words = Words(model.project)
    raw = model.scores(words, texts)  # thresholds are at CUT yet, so these are the plain probabilities
    found = lambda at: language(words.langs[at])  # noqa: E731 (the table may grow while a text is looked up)
    langs = np.asarray([found(words.of(t)) for t in texts])

    def best(p, t) -> float:
        if t.sum() < LEAST_POSITIVE or t.sum() == len(t):
            return 0.5
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(t[order])
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + t.sum())
        k = int(f1.argmax())
        below = p[order[k + 1]] if k + 1 < len(p) else 0.0
        return float(np.clip((p[order[k]] + below) / 2, 0.02, 0.98))

    every = best(raw, y)
    return np.asarray([best(raw[langs == k], y[langs == k]) if (y[langs == k] == 1).sum() >= LEAST_POSITIVE else every for k in range(len(MARKERS) + 1)])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on at most max_train labelled documents outside the held-out fold, those with the smallest hashes of their ids, as far
    as their texts have at most max_bytes in all.

    Ids are chosen from two narrow columns, sizes told from a row a chosen id, and only then texts are joined and sent to the
    driver. An id with several labels counts as toxic if one says so; one with several texts gives that of the least hash.
    """
    labelled = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"]).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    labelled = labelled.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_train).collect()  # narrow rows
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id,) for r in chosen], "doc_id long")
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("size"))
    sizes = {r.doc_id: (r.x.t, r.x.size) for r in own.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "size")).alias("x")).collect()}
    taken, used = [], 0
    for r in chosen:
        if r.doc_id in sizes and used + sizes[r.doc_id][1] <= max_bytes:
            used += sizes[r.doc_id][1]
            taken.append((r.doc_id, sizes[r.doc_id][0]))
    wanted = spark.createDataFrame(taken, "doc_id long, t long")
    texts = {r.doc_id: r.text for r in own.join(F.broadcast(wanted), ["doc_id", "t"]).select("doc_id", "text").dropDuplicates(["doc_id"]).collect()}
    rows = [(texts[r.doc_id].encode(), int(r.toxic)) for r in chosen if r.doc_id in texts]
    return fit([t for t, _ in rows], np.asarray([y for _, y in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text, very long ones in chunks.

    Null texts are empty, null ids are not held out, repeated rows are scored one by one, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x filters x widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.project)
        for batch in few_rows(batches):
            s = shared.value.scores(words, [(t or "").encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False)).alias("held_out"), docs["text"]).mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose text scores below CUT, with the columns of docs alone, as they are.

    A null or empty text has no words and the score of the intercept; repeated rows and null ids are judged by their texts like any
    other; an empty table gives no rows; a very long text is scored whole, in chunks; columns may have any names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.project)
        for batch in few_rows(batches):
            s = shared.value.scores(words, [(t or "").encode() for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(s < CUT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
