"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on the full shingle sets.

GROUPS small hash collections of ROWS minhashes each are computed a document; a table's key combines two collections, so
GROUPS * ROWS minhashes give GROUPS * (GROUPS - 1) / 2 tables of 2 * ROWS minhashes: about the square root of the hashing
that as many independent tables need. A pair is a candidate if two of its collections agree. With 12 collections of 2 at
Jaccard similarity 0.8 a pair is missed with probability 1e-4, at 0.85 with 7e-6.

Documents with equal sets are one class from the start. In a bucket, each class is compared with the smallest and the
largest one: no pairs within a bucket are formed. Confirmed links are merged to components. Where a bucket still spans
several components, its members meet further hubs. Members of buckets that are open even then are joined on their rarest
shingles instead of on the bucket: two sets of the wanted similarity must have one in common among the rarest
n - ceil(similarity * n) + 1 of each, so no link is lost, while a passage that many documents share makes no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import WordHashes, few_rows, gram_hashes, keyed, mixed, odd_constants, work_dir, written

GROUPS = 12
ROWS = 2
PERCENT = 80
HUB_ROUNDS = 3
BLOCK = 1 << 15
_A = odd_constants(GROUPS * ROWS, 101)
_B = odd_constants(GROUPS * ROWS, 202)


def lowered_words(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes, A-Z lower-cased; both steps are ASCII-only on bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; fewer words are one run, none give none."""
    hashes = words.of(lowered_words(text))
    if len(hashes) and len(hashes) < k:
        return gram_hashes(hashes, len(hashes), seed=1000)
    return np.unique(gram_hashes(hashes, k))


def collections(shingles: np.ndarray) -> np.ndarray:
    """GROUPS hashes, each of ROWS minhashes; in blocks, so memory doesn't grow with the text."""
    least = np.full(GROUPS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), BLOCK):
        x = shingles[None, a : a + BLOCK] * _A[:, None]
        x ^= x >> np.uint64(32)
        x *= _B[:, None]
        least = np.minimum(least, x.min(1))
    g = least.reshape(GROUPS, ROWS)
    out = mixed(g[:, 0])
    for r in range(1, ROWS):
        out = mixed(out + g[:, r])
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """_rk, number of shingles, a 128-bit hash of the set and the collections of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few_rows(batches):
            n, f1, f2, g = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k, words)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                f1.append(int.from_bytes(d[:8], "little", signed=True))
                f2.append(int.from_bytes(d[8:], "little", signed=True))
                g.append(collections(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(g, pa.list_(pa.int64()))], names=["_rk", "n", "f1", "f2", "g"]
            )

    return docs.select("_rk", "text").mapInArrow(run, "_rk long, n long, f1 long, f2 long, g array<long>")


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) with ok: whether 100 * intersection >= percent * union of the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hub, hub_set = WordHashes(), None, None
        for batch in few_rows(batches):
            ok = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != hub:
                    hub, hub_set = b, shingle_set(y.as_py(), k, words)
                s = shingle_set(x.as_py(), k, words)
                if 100 * min(len(s), len(hub_set)) < percent * max(len(s), len(hub_set)):
                    ok.append(False)
                    continue
                both = np.concatenate([s, hub_set])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    texts = docs.select(F.col("_rk").alias("_id"), "text")
    left = pairs.join(texts.withColumnRenamed("text", "x"), F.col("a") == F.col("_id")).drop("_id")
    both = left.join(texts.withColumnRenamed("text", "y"), F.col("b") == F.col("_id")).drop("_id")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, ok boolean")


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b), by alternating large and small stars."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), folder, f"{name}-0")
    seen, step = None, 0
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), folder, f"{name}-l{step}")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), folder, f"{name}-s{step}")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), folder, f"{name}-m{step}")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        step += 1
        e = written(small.distinct(), folder, f"{name}-{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now


def rare_pairs(ids: DataFrame, docs: DataFrame, k: int, percent: int, folder: str) -> DataFrame:
    """Pairs (a, b), a > b, of ids (rep, comp, n) of different components that may be similar: all that are, and few others.

    A document's shingles are ordered from rare to common, counted over ids. A pair meets at its first common shingle, in
    both prefixes; from there on enough shingles must be left in both for the overlap that the similarity asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few_rows(batches):
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), k, words).view(np.int64)
                for a in range(0, len(s), BLOCK):
                    part = s[a : a + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rep, np.int64)), pa.array(part)], names=["rep", "s"])

    texts = docs.select(F.col("_rk").alias("rep"), "text").join(ids.select("rep"), "rep")
    shingles = written(texts.mapInArrow(run, "rep long, s long"), folder, "rare-shingles")
    # Counts by shingle are written before they are joined: then both sides are plain exchanges, and a hot shingle's rows are split.
    common = written(shingles.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), folder, "rare-common")
    ranked = shingles.join(common, "s", "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long")))
    ranked = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("rep").orderBy("c", "s")) - 1)
    prefix = ranked.where("c > 1").join(ids, "rep").where(f"pos <= n - (({percent} * n + 99) div 100)").select("s", "rep", "comp", "n", "pos")
    prefix = written(prefix, folder, "rare-prefixes")
    mixed = written(prefix.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("s"), folder, "rare-several")
    met = written(prefix.join(mixed, "s").select("s", "rep", "comp", "n", (F.col("n") - F.col("pos")).alias("l")), folder, "rare-mixed")
    # Which (size, rest) of a shingle can pair at all is told on their distinct values, not on documents: a hot shingle of
    # documents that can't be similar makes no pairs. Sizes are dealt by class, so that only neighbours in size meet.
    log = F.floor(F.ln("n") / math.log(100 / percent))
    groups = written(met.groupBy("s", "n", "l").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).withColumn("k", log), folder, "rare-groups")
    small = groups.select("s", F.explode(F.array("k", F.col("k") + 1)).alias("k"), *[F.col(c).alias(f"{c}a") for c in ("n", "l", "lo", "hi")])
    large = groups.select("s", "k", *[F.col(c).alias(f"{c}b") for c in ("n", "l", "lo", "hi")])
    size = (100 * F.col("na") >= percent * F.col("nb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("la") <= F.col("lb"))))
    left_over = (100 + percent) * F.least("la", "lb") >= percent * (F.col("na") + F.col("nb"))
    can = small.join(large, ["s", "k"]).where(size & left_over & (F.least("loa", "lob") < F.greatest("hia", "hib"))).select("s", "na", "la", "nb", "lb")
    one = met.select("s", F.col("n").alias("na"), F.col("l").alias("la"), F.col("rep").alias("a"), F.col("comp").alias("ca"))
    two = met.select("s", F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("rep").alias("b"), F.col("comp").alias("cb"))
    met_twice = one.join(can, ["s", "na", "la"]).join(two, ["s", "nb", "lb"]).where("ca <> cb")
    return _ordered(met_twice.select("a", "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and are their own components; an empty table gives no
    rows, other columns are left out. A very long text's shingles are hashed in one task, in blocks. Rows that repeat an id,
    or have none, count as rows of their own, ordered by (id, nulls last, text hash); then a component's id is that of its
    first row and may be null, and only its first row is kept.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "minhash")
    docs = keyed(docs.select("doc_id", "text"), folder)
    sig = written(signatures(docs, shingle), folder, "signatures")
    reps = written(sig.where("n > 0").groupBy("f1", "f2").agg(F.min("_rk").alias("rep"), F.first("n").alias("n"), F.first("g").alias("g")), folder, "classes")
    keys = F.array(*[F.xxhash64(F.col("g")[i], F.col("g")[j], F.lit(i * GROUPS + j)) for i, j in combinations(range(GROUPS), 2)])
    spread = reps.select("rep", F.explode(keys).alias("key"))
    buckets = written(spread.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("c > 1"), folder, "buckets")
    members = written(spread.join(buckets.where("c > 2"), "key").select("key", "rep", "lo", "hi"), folder, "members")
    pairs = _ordered(
        buckets.select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
        .unionByName(members.select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct())
        .unionByName(members.select(F.col("rep").alias("a"), F.col("hi").alias("b")).distinct())
    )
    done = written(compared(pairs, docs, shingle, percent), folder, "compared0")
    nodes = written(connected(done.where("ok"), folder, "components0"), folder, "nodes0")
    for step in range(1, HUB_ROUNDS + 2):
        placed = members.select("key", "rep").join(nodes, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
        open_keys = written(sizes.groupBy("key").count().where("count > 1"), folder, f"open{step}")
        if not open_keys.take(1):
            break
        still = written(placed.join(open_keys.select("key"), "key"), folder, f"still{step}")
        last = step > HUB_ROUNDS
        if last:
            new = rare_pairs(still.select("rep", "comp").distinct().join(reps.select("rep", "n"), "rep"), docs, shingle, percent, folder)
        else:
            hubs = still.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(step)).alias("h"), F.col("rep").alias("hub"), F.col("comp").alias("hc"))).alias("x"))
            hubs = written(hubs.select("key", "x.hub", "x.hc"), folder, f"hubs{step}")
            new = _ordered(still.join(hubs, "key").where("comp <> hc").select(F.col("rep").alias("a"), F.col("hub").alias("b")))
        fresh = written(compared(new.join(done.select("a", "b"), ["a", "b"], "left_anti"), docs, shingle, percent), folder, f"compared{step}")
        done = done.unionByName(fresh)
        if fresh.where("ok").take(1):
            links = fresh.where("ok").select("a", "b").unionByName(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")))
            nodes = written(connected(links, folder, f"components{step}"), folder, f"nodes{step}")
        if last:
            break
    classes = reps.select("f1", "f2", "rep").join(nodes, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.coalesce("component", "rep").alias("comp"))
    classes = written(classes, folder, "class-components")
    out = sig.select("_rk", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2").join(classes, ["f1", "f2"], "left")
    out = out.select("_rk", F.col("n").alias("n_shingles"), F.coalesce("comp", "_rk").alias("comp"))
    ids = docs.select("_rk", F.col("doc_id").cast("long").alias("doc_id"))
    if docs.columns and "_rk" in docs.columns and not _keys_are_ids(docs):
        out = out.join(ids, "_rk").join(ids.select(F.col("_rk").alias("comp"), F.col("doc_id").alias("component_id")), "comp")
    else:
        out = out.withColumn("doc_id", F.col("_rk")).withColumn("component_id", F.col("comp"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("_rk") == F.col("comp")).alias("kept"), F.col("_rk"))


def _keys_are_ids(docs: DataFrame) -> bool:
    return not docs.where(~F.col("doc_id").cast("long").eqNullSafe(F.col("_rk"))).select("_rk").take(1)
