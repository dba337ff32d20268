"""Secret scans: rules find what is certain, a convolutional network over characters judges every other candidate.

Rules (kinds assign, access, hex) are patterns of fixed meaning. A candidate is any run of at least LEAST characters of
ASCII letters, digits and +/_.=- that holds a digit or has at least LONG characters. The network sees a candidate's whole value and
CONTEXT characters on either side, as classes of characters marked as value or surroundings; filters of two widths
slide over both, each keeps its maximum and a logistic unit makes a score of the maxima.

Labelled findings train it: (before, value, after, secret), by default the rules' own findings against the other candidates of
all documents. Half of the findings are shown without their surroundings, so that a value counts on its
own. A part that isn't fitted calibrates: scores are mapped to probabilities (Platt), and a threshold for each shape of
value (digits alone, with and without letters) is the highest one that still finds RECALL of its secrets; a shape
with few labelled secrets takes the threshold of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm.common import few_rows, work_dir, written

KINDS = ("assign", "access", "hex", "network")
CONTEXT = 24
LEAST, LONG = 12, 24
WIDTHS = (3, 5)
FILTERS = 8
DIM = 8
EPOCHS = 12  # in all
RATE = 0.02
BATCH = 128
RECALL = 0.95
LEAST_POSITIVE = 10
ROUNDS = 3
GROUP, GROUP_CHARS = 4096, 1 << 24  # rows and characters that one task trains on
CHUNK = 1 << 17
#: A document's rule findings and candidates are scored in blocks of this many.
BLOCK = 2048

# The rules' patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is taken whole, so its length can stand in the pattern
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")

#: Classes of characters: each ASCII character its own, all others by their low byte's parity of letters or not (two classes).
CLASSES = 130
FINDINGS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))


def base_findings(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value's start, value's end) of what the rules find, in that order; per kind leftmost and without overlap."""
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int]]:
    """Candidates that no rule's finding touches."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a and (b - a >= LONG or _DIGIT.search(text, a, b)):
            out.append((a, b))
    return out


def shape(value: str) -> int:
    """0: no letters, 1: letters and digits, 2: no digits."""
    return 0 if not _LETTER.search(value) else 1 if _DIGIT.search(value) else 2


def classes(before: str, value: str, after: str) -> np.ndarray:
    """Class of each character; those of the value lie CLASSES higher. 0 is a gap."""
    whole = np.frombuffer((before + value + after).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    out = np.where(whole < 128, 1 + whole, 129)
    out[len(before) : len(before) + len(value)] += CLASSES
    return out


def joined(cases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All cases in one array, a gap after each so that no filter spans two, and where each begins."""
    gap = np.zeros(WIDTHS[-1] - 1, np.int32)
    starts = np.cumsum([0, *[len(c) + len(gap) for c in cases]])
    return np.concatenate([x for c in cases for x in (c, gap)] or [gap]), starts[:-1]


@dataclass
class Model:
    project: np.ndarray  # [classes, sum of widths x filters]
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float, float] = (0.5, 0.5, 0.5)

    def pooled(self, cases: list[np.ndarray]) -> np.ndarray:
        """Each filter's maximum over each whole case, at least 0; in chunks, so memory doesn't grow with a case's length."""
        flat, starts = joined(cases)
        out = np.zeros((len(cases), len(WIDTHS) * FILTERS), np.float32)
        of = np.repeat(np.arange(len(cases)), np.diff([*starts, len(flat)])) if cases else starts
        for a in range(0, len(flat) if cases else 0, CHUNK):
            own = of[a : a + CHUNK]
            cut = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
            rows, col = self.project[flat[a : a + CHUNK + WIDTHS[-1] - 1]], 0
            for k, w in enumerate(WIDTHS):
                n = min(len(own), len(rows) - w + 1)
                mine = slice(k * FILTERS, (k + 1) * FILTERS)
                if n > 0:
                    total = sum(rows[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(w)) + self.bias[mine]
                    total[flat[a : a + n] == 0] = -np.inf  # from a gap a filter would look into the next case
                    heads = cut[cut < n]
                    top = np.maximum.reduceat(total, heads, axis=0)
                    ids = own[heads]
                    out[ids, mine] = np.maximum(out[ids, mine], top)
                col += w * FILTERS
        return out

    def logits(self, cases: list[np.ndarray]) -> np.ndarray:
        return self.pooled(cases).astype(np.float64) @ self.weights + self.intercept

    def scores(self, cases: list[np.ndarray]) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(cases) + b, -30, 30)))


def started(seed: int) -> dict[str, np.ndarray]:
    """Parameters before training."""
    rng = np.random.default_rng(seed)
    wide = len(WIDTHS) * FILTERS
    emb = rng.normal(0, 0.3, (2 * CLASSES, DIM)).astype(np.float32)
    emb[0] = 0
    filt = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, weights, one = np.zeros(wide, np.float32), rng.normal(0, 0.3, wide).astype(np.float32), np.zeros(1, np.float32)
    return {"e": emb, "b": bias, "w": weights, "i": one, **{f"f{k}": f for k, f in enumerate(filt)}}


def projected(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params["e"] @ f[j] for f in (params[f"f{k}"] for k in range(len(WIDTHS))) for j in range(len(f))], 1)


def tops(project: np.ndarray, flat: np.ndarray, cases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's greatest sum over each case, and where in flat it begins (-1: nowhere); in chunks, as Model.pooled."""
    best = np.full((len(cases), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    where = np.full(best.shape, -1)
    of = np.repeat(np.arange(len(cases)), [len(c) + WIDTHS[-1] - 1 for c in cases])
    for a in range(0, len(flat), CHUNK):
        own = of[a : a + CHUNK]
        cut = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
        rows, col = project[flat[a : a + CHUNK + WIDTHS[-1] - 1]], 0
        for k, w in enumerate(WIDTHS):
            n = min(len(own), len(rows) - w + 1)
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            if n > 0:
                total = sum(rows[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(w))
                total[flat[a : a + n] == 0] = -np.inf
                heads = cut[cut < n]
                top = np.maximum.reduceat(total, heads, axis=0)
                hit = total == np.repeat(top, np.diff([*heads, n]), axis=0)
                first = np.minimum.reduceat(np.where(hit, np.arange(a, a + n)[:, None], len(flat)), heads, axis=0)
                ids = own[heads]
                better = top > best[ids, mine]
                where[ids, mine] = np.where(better, first, where[ids, mine])
                best[ids, mine] = np.maximum(best[ids, mine], top)
            col += w * FILTERS
    return best, where


def descend(params: dict[str, np.ndarray], cases: list[np.ndarray], y: np.ndarray, share: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Train params in place on all cases, each counted by its share, in small batches."""
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    steps, emb, bias, weights, one = 0, *(params[k] for k in "ebwi")
    for _ in range(epochs):
        order = rng.permutation(len(cases))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            flat, _ = joined([cases[i] for i in batch])
            best, where = tops(projected(params), flat, [cases[i] for i in batch])
            where[best + bias <= 0] = -1
            pooled = np.maximum(best + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ weights + one, -30, 30)))
            delta = ((p - y[batch]) * share[batch] / share[batch].sum()).astype(np.float32)
            back = np.where(where >= 0, delta[:, None] * weights[None, :], 0)
            grads = {"w": pooled.T @ delta + 1e-4 * weights, "i": delta.sum(keepdims=True), "b": back.sum(0), "e": np.zeros_like(emb)}
            for k, w in enumerate(WIDTHS):
                filt = params[f"f{k}"]
                g = np.zeros_like(filt)
                for f in range(FILTERS):
                    c = k * FILTERS + f
                    hit = np.nonzero(back[:, c])[0]
                    for j in range(w):
                        x = flat[where[hit, c] + j]
                        g[j, :, f] = back[hit, c] @ emb[x]
                        np.add.at(grads["e"], x, back[hit, c][:, None] * filt[j, :, f][None, :])
                grads[f"f{k}"] = g
            steps += 1
            for name, value in params.items():
                m, v = state[name]
                m += 0.1 * (grads[name] - m)
                v += 0.01 * (grads[name] ** 2 - v)
                value -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
            emb[0] = 0


def made(params: dict[str, np.ndarray]) -> Model:
    return Model(projected(params), params["b"], params["w"].astype(np.float64), float(params["i"][0]))


def unlearned() -> Model:
    """Nothing is a secret."""
    params = started(5)
    return Model(projected(params), params["b"], np.zeros(len(WIDTHS) * FILTERS), -30.0, thresholds=(1.0, 1.0, 1.0))


def fit(findings: list[tuple[str, str, str, int]], recall: float = RECALL, seed: int = 5) -> Model:
    """Train in this process on four of five of a few labelled findings and calibrate on the fifth; without both labels nothing is a secret."""
    cases = [classes(b, v, a) for b, v, a, _ in findings]
    y = np.asarray([s for *_, s in findings], np.float32)
    apart = np.arange(len(y)) % 5 == 4
    train_, held = np.nonzero(~apart)[0], np.nonzero(apart)[0]
    if not len(train_) or not 0 < y[train_].mean() < 1:
        return unlearned()
    params = started(seed)
    descend(params, [cases[i] for i in train_], y[train_], np.ones(len(train_)), EPOCHS, np.random.default_rng(seed))
    model = made(params)
    calibrate(model, model.logits([cases[i] for i in held]), y[held], np.asarray([shape(findings[i][1]) for i in held]), np.ones(len(held)), recall)
    return model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, shapes: np.ndarray, n: np.ndarray, recall: float) -> None:
    """Platt scaling of logits x, which occur n times each, by Newton steps on smoothed labels, then the thresholds by shape."""
    n1, n0 = float((n * y).sum()), float((n * (1 - y)).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-9)
        grad = np.asarray([(n * (p - t) * x).sum(), (n * (p - t)).sum()])
        h = np.asarray([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.platt = (float(a), float(b)) if a > 0 else (1.0, 0.0)
    score = 1 / (1 + np.exp(-np.clip(model.platt[0] * x + model.platt[1], -30, 30)))

    def threshold(at: np.ndarray) -> float:
        """The highest score that at least `recall` of the secrets reach, but no less than what no clean value exceeds by chance: a half."""
        at = np.nonzero(at & (y == 1))[0]
        at = at[np.argsort(score[at], kind="stable")]
        full = np.cumsum(n[at])
        return max(0.5, float(score[at[np.searchsorted(full, np.floor((1 - recall) * full[-1]), "right")]])) if len(at) else 1.0

    every = threshold(np.ones(len(y), bool))
    model.thresholds = tuple(threshold(shapes == k) if n[(shapes == k) & (y == 1)].sum() >= LEAST_POSITIVE else every for k in range(3))


def around(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]


def labelled_findings(docs: DataFrame, max_docs: int | None = None, max_findings: int | None = None) -> DataFrame:
    """(doc_id, start, before, value, after, secret): findings of the rules as 1, other candidates as 0, of all documents.

    Only where a caller asks for fewer: at most max_docs documents, those with the smallest hashes of their ids, and at most max_findings
    of each label. Hashes are then cut at a share of their range that leaves about twice max_docs ids before the smallest are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_findings(t or "")
                for a, b, secret in [*[(a, b, 1) for *_, a, b in base], *[(a, b, 0) for a, b in candidates(t or "", base)]]:
                    out.append((d, a, *around(t, a, b), secret))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema(list(zip(names, kinds))))

    names = ["doc_id", "start", "before", "value", "after", "secret"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    if max_docs is not None:
        hashed = own.select("doc_id", F.xxhash64("doc_id").alias("h")).where("doc_id IS NOT NULL")
        rows = hashed.count()
        few = (hashed if rows <= 2 * max_docs else hashed.where(F.col("h") < 2**64 * 2 * max_docs // rows - 2**63)).distinct()
        own = own.join(F.broadcast(few.orderBy("h", "doc_id").limit(max_docs).select("doc_id")), "doc_id")
    found = own.mapInArrow(run, "doc_id long, start long, before string, value string, after string, secret int")
    if max_findings is None:
        return found
    order = [F.xxhash64("doc_id", "start", "value"), F.col("doc_id"), F.col("start")]
    return found.where("secret = 1").orderBy(*order).limit(max_findings).unionByName(found.where("secret = 0").orderBy(*order).limit(max_findings))


def one_group(shared, share: list[float], seed: list[int]):
    """What a task of train() does with its group: the parameters after its epochs, times its number of rows."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(zip(*(table[c].to_pylist() for c in ("value", "before", "after", "secret", "n"))))
        params = {k: v.copy() for k, v in shared.value.items()}
        y = np.asarray([r[3] for r in own], np.float32)
        n = np.asarray([r[4] * share[r[3]] for r in own])
        descend(params, [classes(b, v, a) for v, b, a, *_ in own], y, n, EPOCHS // ROUNDS, np.random.default_rng(seed))
        flat = np.concatenate([v.ravel() for v in params.values()]).astype(np.float64)
        return pa.table({"k": np.arange(len(flat)), "p": np.round(flat * 2**24).astype(np.int64) * len(own), "n": np.full(len(flat), len(own))})

    return run


def train(findings: DataFrame, recall: float = RECALL, seed: int = 5) -> Model:
    """Fit on all labelled findings (before, value, after, secret), as many as there are; without both labels nothing is a secret.

    Every other finding, by hash, is shown without its surroundings; equal ones are one row with their number. Rows are dealt by hash into
    groups of about GROUP. In each round every group trains the same parameters on all its rows, and their mean over the groups, summed as
    whole numbers and so in any order, begins the next round. A fifth, by hash, is kept apart: its logits are counted in steps of
    a hundredth by label and shape, and the counts calibrate. Parameters and counts, of fixed size, reach the driver.
    """
    spark, texts = findings.sparkSession, ("before", "value", "after")
    with_ids = [c for c in ("doc_id", "start") if c in findings.columns]
    bare = F.pmod(F.xxhash64(F.lit(3), *[F.coalesce(c, F.lit("")) for c in texts], *with_ids), F.lit(2)) == 0
    shown = findings.select(*[F.when(bare, "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in ("before", "after")], F.coalesce("value", F.lit("")).alias("value"), F.col("secret").cast("int").alias("secret"))
    place = F.xxhash64(*texts)
    counted = shown.groupBy(*texts, "secret").agg(F.count("*").alias("n")).withColumn("h", place).withColumn("apart", F.pmod(F.xxhash64(F.lit(5), "value"), F.lit(5)) == 4)
    rows = written(counted, work_dir(spark, "secret-findings"), "findings")
    totals = {r.secret: r for r in rows.where("NOT apart").groupBy("secret").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.sum(F.length("value")).alias("chars")).collect()}  # a row a label
    if set(totals) != {0, 1}:
        return unlearned()
    every = sum(r.n for r in totals.values())
    share = [every / (2 * totals[k].n) for k in (0, 1)]  # both labels weigh the same
    groups = max(1, -(-sum(r.rows for r in totals.values()) // GROUP), sum(r.chars for r in totals.values()) // GROUP_CHARS)
    dealt = rows.where("NOT apart").withColumn("g", F.pmod("h", F.lit(groups)))
    params = started(seed)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(params)  # of fixed size
        summed = dealt.repartition(groups, "g").groupBy("g").applyInArrow(one_group(shared, share, [seed, turn]), "k long, p long, n long").groupBy("k").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()  # a row a parameter
        flat = np.asarray([r.p / r.n / 2**24 for r in sorted(summed, key=lambda r: r.k)], np.float32)
        ends = np.cumsum([v.size for v in params.values()])[:-1]
        params = {k: x.reshape(v.shape).copy() for (k, v), x in zip(params.items(), np.split(flat, ends))}
    model = made(params)
    known = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, BLOCK):
            value, before, after, secret, n = (batch.column(k).to_pylist() for k in range(5))
            x = np.clip(np.floor(known.value.logits([classes(*c) for c in zip(before, value, after)]) * 100), -3000, 3000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([shape(v) for v in value], pa.int32()), pa.array(secret, pa.int32()), pa.array(x), pa.array(n, pa.int64())], names=["shape", "secret", "x", "n"])

    held = rows.where("apart").select("value", "before", "after", "secret", "n").mapInArrow(judge, "shape int, secret int, x long, n long")
    table = sorted(tuple(r) for r in held.groupBy("shape", "secret", "x").agg(F.sum("n").alias("n")).collect())  # 36,006 rows at most
    forms, y, x, n = (np.asarray([r[k] for r in table], float) for k in range(4))
    calibrate(model, x / 100, y, forms, n, recall)
    return model


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs plus findings: (kind, start, end, score) by start, then kind; offsets in code points, end exclusive.

    Findings of the rules are always there, with the network's score of their value; of the other candidates those that reach
    the threshold of their shape, as kind "network". Null and empty texts have no findings; repeated rows are scanned one by
    one; an empty table gives no rows; a column of docs named findings is replaced. Texts and values of any length are read
    whole.
    """
    keep = [c for c in docs.columns if c != "findings"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in few_rows(batches):
            waiting, found = [], [[] for _ in range(batch.num_rows)]

            def judged():
                scores = own.scores([c for *_, c in waiting])
                for (i, a, kind, b, form, _), s in zip(waiting, scores):
                    if kind < 3 or s >= own.thresholds[form]:
                        found[i].append((a, kind, b, float(s)))
                waiting.clear()

            for i, t in enumerate(batch.column(place).to_pylist()):
                base = base_findings(t or "")
                for a, kind, b, c, d in [*base, *[(a, 3, b, a, b) for a, b in candidates(t or "", base)]]:
                    waiting.append((i, a, kind, b, shape(t[c:d]), classes(*around(t, c, d))))
                    if len(waiting) >= BLOCK:
                        judged()
            judged()
            lists = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(lists, LISTED)], names=[*keep, "findings"])

    kept = docs.select(*[docs[c] for c in keep])
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("findings", FINDINGS)]))


LISTED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def redacted(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Scanned documents with every finding replaced by the mark (overlapping findings by one), without the findings column.

    Built-in functions only: findings lie in order of their starts, so one fold over them copies what lies between.
    """
    t = F.col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = lambda a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc, f):
        inside = f["start"] < acc["at"]  # within the finding before it
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], cut(acc["at"], f["start"]), F.lit(mark)))
        return F.struct(out.alias("out"), F.greatest(acc["at"], f["end"]).alias("at"))

    done = lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(t).cast("long")))
    return scanned.withColumn(text, F.when(F.size("findings") > 0, F.aggregate("findings", start, step, done)).otherwise(t)).drop("findings")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, numbers of the rules' findings by kind, sha256 of their spans, and all spans as text."""
    own = F.filter("findings", lambda f: f["kind"] != KINDS[3])
    spans = lambda c: F.concat_ws(",", F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))
    of_kind = lambda k: F.filter("findings", lambda f: f["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(spans(own), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
