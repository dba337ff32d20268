"""Registered queries of the training-data operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import (
    html_extract, media, minhash, packing, quality_rules, resampling, secrets, sentencepiece_scan, substring_dedup, token_counts,
    token_files, toxicity, vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = quality_rules.quality_table(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; it must be installed alike on all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).drop("_rk")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return sentencepiece_scan.digest(sentencepiece_scan.encode(_table(spark, sf_dir, "documents"), path), path)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digest(_table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(secrets.labelled_findings(docs))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_duplicates": op1_minhash_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sentencepiece_scan": op4_sentencepiece_scan,
    "op5_html_extraction": op5_html_extraction,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_media_columns": op9_media_columns,
    "op10_token_counts": op10_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys([*quality_rules.STOP_WORDS, *[w.capitalize() for w in quality_rules.STOP_WORDS]]))
    bounds = []
    for m, least, most in quality_rules.THRESHOLDS:
        bounds += [f"{m} >= {least}"] if least is not None else []
        bounds += [f"{m} <= {most}"] if most is not None else []
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({stop}))) AS stops, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS uppers,
             len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS runs
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
m AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_length, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_word_ratio,
             stops / greatest(n_words, 1)::DOUBLE AS stop_word_ratio, uppers / greatest(word_chars, 1)::DOUBLE AS upper_char_ratio,
             n_dup_lines / greatest(lines, 1)::DOUBLE AS dup_line_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_word_ratio,
             runs / greatest(n_words, 1)::DOUBLE AS run_word_ratio,
             n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM m"""


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root::BIGINT AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.node = w.doc_id"""

_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT i + k) AS c FROM r, (SELECT unnest(range(0, 20)) AS k) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(c.c), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN c.c IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(c.c, i)), lambda i: w.w[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id"""

#: crc32 of each distinct word, byte by byte over its UTF-8 form, from a table made by the polynomial's rule.
_RESAMPLING_SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, _k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS word FROM w),
x AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM u UNION SELECT word FROM v)),
y AS (SELECT word, list_transform(range(len(x) // 2), lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS y FROM x),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, y), lambda c, z: xor(c >> 8, t[xor(c & 255, z) + 1])), 4294967295) % {resampling.BUCKETS} AS b FROM y, crc),
s AS (SELECT b, count(*) AS s FROM u JOIN b USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM v JOIN b USING (word) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM u)::DOUBLE AS s, (SELECT count(*) FROM v)::DOUBLE AS t),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + {resampling.BUCKETS}) / ((s.s + 1)::DOUBLE * (n.t + {resampling.BUCKETS}))))::BIGINT AS g FROM n, s LEFT JOIN t ON t.b = s.b),
d AS (SELECT doc_id, sum(g)::BIGINT AS weight FROM u JOIN b USING (word) JOIN g USING (b) GROUP BY doc_id),
h AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_features, coalesce(d.weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{resampling.SEED}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, z.n_features, z.weight, z.score, CASE WHEN r.r <= 10 * r.n // 100 THEN r.r END AS rank FROM z LEFT JOIN r USING (doc_id)"""


def _vector_sql() -> str:
    """Four rounds and the last assignment as a chain of queries over (vector, part, place, component) rows."""
    floored = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = [rf"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, i // (len(v) // {vector_codes.PARTS}) AS part, i % (len(v) // {vector_codes.PARTS}) AS i, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM k)),
c0 AS MATERIALIZED (SELECT part, e, i, x AS y FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {vector_codes.ENTRIES}) USING (vec_id))"""]
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {vector_codes.ENTRIES} + e) // {vector_codes.ENTRIES} AS d, min(d * {vector_codes.ENTRIES} + e) % {vector_codes.ENTRIES} AS e
      FROM (SELECT vec_id, part, e, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (part, i) GROUP BY vec_id, part, e) GROUP BY vec_id, part)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT c{r}.part, c{r}.e, c{r}.i, CASE WHEN n IS NULL THEN y ELSE {floored} END AS y
      FROM c{r} LEFT JOIN (SELECT part, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id, part) GROUP BY part, e, i) USING (part, e, i))""")
    last = vector_codes.ROUNDS
    steps.append(f"""
o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)""")
    return ",".join(steps) + f"""
SELECT o.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, e, i)) FROM c{last}) AS codebooks_sha256
FROM o JOIN k USING (vec_id)"""


ORACLES: dict[str, str] = {
    "op1_minhash_near_duplicates": _NEAR_SQL,
    "op7_quality_rules": _quality_sql(),
    "op8_substring_dedup": _SUBSTRING_SQL,
    "op11_importance_resampling": _RESAMPLING_SQL,
    "op12_vector_codes": _vector_sql(),
}
