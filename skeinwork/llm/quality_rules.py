"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are maximal runs of characters other than space and \\t\\n\\v\\f\\r. Null texts have none, and so fail the word count.
Every rule is a row (measure, least, most) over ratios of one row, so no row sees another: no shuffle, no skew, and any
number of extra columns may ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and a to in is it that for was on are as with be by at this from or an have he not "
    "der die das und ist den dem des ein eine zu mit von auf im nicht für sich als auch es an "
    "le la les de du des et un une en que qui est pour dans par pas sur au il elle "
    "el los las del y en que un una por con para se no su al lo es como"
).split()

#: measure, least, most (None: open). A document is kept if every measure lies within its row.
THRESHOLDS = (
    ("mean_word_length", 2.0, 14.0),
    ("symbol_word_ratio", None, 0.25),
    ("stop_word_ratio", 0.02, None),
    ("upper_char_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.5),
    ("repeat_word_ratio", None, 0.3),
    ("run_word_ratio", None, 0.35),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for the row even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_next(name: str, step: int) -> Column:
    return F.transform(name, lambda h, i: F.xxhash64(h, F.get(name, i + step)))


def with_window_hashes(df: DataFrame, words: str, name: str, window: int = WINDOW) -> DataFrame:
    """Add the 64-bit hashes of all runs of `window` (a power of two) words, by doubling: a hash of 2k words is one of two of k.

    Each step is a column of its own, so that the next step's lambda reads an array instead of computing it anew.
    """
    df = df.withColumn(name, F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))))
    step = 2
    while step < window:
        df = df.withColumn(name, _with_next(name, step))
        step *= 2
    return df.withColumn(name, F.slice(name, F.lit(1), F.greatest(F.size(words) - (window - 1), F.lit(0))))


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window found twice or more in the same text, from the text's window hashes.

    A hash set tells whether any window repeats at all. If so, hashes are sorted once with their places; a window is
    repeated if a neighbour in that order has its hash, and covered words are the sum of min(window, gap to the next
    repeated start): O(n log n) for a text of n words.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k + d)["h"] == F.get(s, k)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
        return F.sort_array(F.transform(places, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        gap = lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window)))
        return F.aggregate(F.transform(p, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    once = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(once, F.lit(0).cast("long")).otherwise(_let(_let(pairs, repeated), covered))


def _measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_word_ratio": F.col("n_symbols") / n,
        "stop_word_ratio": F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]))) / n,
        "upper_char_ratio": F.regexp_count("_t", F.lit(r"\p{Lu}")) / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
        "run_word_ratio": F.size(F.filter("_w", lambda w, i: w == F.get("_w", i + 1))) / n,
    }


def quality_table(docs: DataFrame, thresholds=THRESHOLDS, text: str = "text") -> DataFrame:
    """All columns of docs plus the counts, one column q_<measure> a rule, base_failed and kept.

    A null or empty text has no words, so it fails; repeated rows are judged one by one; an empty table gives no rows; columns
    of docs named as ours are replaced. A very long text is judged whole, in one task.
    """
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in wanted and c not in {f"q_{m}" for m, _, _ in thresholds}]
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*keep).alias("_keep"), whole.alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", r"[ \t\n\x0B\f\r]+"), ""))
    df = df.withColumn("_full", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]")))
    df = with_window_hashes(df, "_w", "_h")
    df = df.select(
        "_keep", "_t", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_full").cast("long").alias("_lines"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).alias("n_repeat_words"),
    )
    measures = _measures()
    df = df.select("*", *[measures[m].cast("double").alias(f"q_{m}") for m, _, _ in thresholds])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = ~failed
    for m, least, most in thresholds:
        if least is not None:
            verdict &= F.col(f"q_{m}") >= least
        if most is not None:
            verdict &= F.col(f"q_{m}") <= most
    out = F.struct("_keep", *wanted[:5], *[f"q_{m}" for m, _, _ in thresholds], failed.alias("base_failed"), verdict.alias("kept"))
    # One row in, one row out: a later filter stays above this, or the optimizer would copy the counts into every lambda.
    return df.select(F.explode(F.array(out)).alias("_x")).select("_x._keep.*", *[F.col("_x")[c].alias(c) for c in [*wanted[:5], *[f"q_{m}" for m, _, _ in thresholds], *wanted[5:]]])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs alone."""
    marked = quality_table(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return marked.where("kept").select("_row.*")
