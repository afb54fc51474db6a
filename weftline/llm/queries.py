"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cube, licenses, lines, quality, shards, toxicity, wrapper
from .common import table
from .fmindex import contamination, report
from .langid import fit, held_out, predict
from .minhash import near_duplicates


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.report(cube.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_text": op1_wrapper_text,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_cube_mix": op4_cube_mix,
    "op5_line_dedup": op5_line_dedup,
    "op6_shards": op6_shards,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_licenses": op9_licenses,
    "op10_fmindex": op10_fmindex,
}

#: Words of a text without A-Z, as DuckDB SQL.
PLAIN_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ALNUM_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

STOP_LIST = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

SQL: dict[str, str] = {
    "op3_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
k AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM k) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS pos FROM r) GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({STOP_LIST}))) AS n_stop FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(quality.sql(r) for r in quality.RULES)} AS kept FROM b""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
f AS (SELECT doc_id, r, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x20\x09-\x0D]')) AS full_at, text FROM d),
w AS (SELECT r, k, array_to_string(list_transform(full_at[k:k + 2], lambda i: l[i]), chr(10)) AS s FROM (SELECT r, l, full_at, unnest(range(1, len(full_at) - 1)) AS k FROM f WHERE len(full_at) >= 3)),
o AS (SELECT r, k, rank() OVER (PARTITION BY s ORDER BY r, k) AS n FROM w),
g AS (SELECT r, list_distinct(flatten(list(range(k, k + 3)))) AS gone FROM o WHERE n > 1 GROUP BY 1),
c AS (SELECT g.r, list_distinct(flatten(list_transform(gone, lambda q: range(full_at[q], CASE WHEN list_contains(gone, q + 1) THEN full_at[q + 1] ELSE full_at[q] + 1 END)))) AS cut FROM g JOIN f ON f.r = g.r)
SELECT f.doc_id, CASE WHEN g.gone IS NULL THEN f.text ELSE coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(c.cut, i)), chr(10)), '') END AS text, len(full_at) AS n_lines, coalesce(len(g.gone), 0) AS n_removed
FROM f LEFT JOIN g ON g.r = f.r LEFT JOIN c ON c.r = f.r""",
    "op6_shards": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, 't' || text, 't'))[1:15])::BIGINT AS bits FROM documents),
l AS (SELECT n AS depth, bits >> (60 - n) AS prefix, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs FROM d, range(0, 61) t(n) GROUP BY 1, 2),
b AS (SELECT d.doc_id, d.n_bytes, d.bits, min(l.depth) AS depth FROM d JOIN l ON l.prefix = d.bits >> (60 - l.depth) WHERE l.bytes <= {shards.LIMIT} OR l.depth = 60 GROUP BY ALL)
SELECT b.doc_id, b.n_bytes, right(lpad(bin(b.bits >> (60 - b.depth)), 60, '0'), b.depth::INT) AS shard, b.depth::INT AS shard_depth, l.bytes AS shard_bytes, l.docs AS shard_docs, l.bytes > {shards.LIMIT} AS oversize
FROM b JOIN l ON l.depth = b.depth AND l.prefix = b.bits >> (60 - b.depth)""",
    "op7_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {PLAIN_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' .'] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY 1) c ON c.doc_id = d.doc_id""",
    "op10_fmindex": f"""
WITH i AS (SELECT item_id, {ALNUM_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 2), lambda k: array_to_string(w[k:k + 7], ' '))) AS s FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {ALNUM_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
l AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {{'k': k, 's': array_to_string(w[k:k + n - 1], ' ')}})) AS x FROM d, l WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.x.k AS k, x.n, p.item_id FROM x JOIN p ON p.s = x.x.s AND p.n = x.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY 1),
e AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(e.n_items, 0) AS n_items, sha256(coalesce(e.ids, '')) AS items_sha256, coalesce(e.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
}
