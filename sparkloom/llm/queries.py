"""Queries over the corpus tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_text import extract
from .importance import importance_resampling
from .infill import fill_in_middle, restored
from .jaccard_join import jaccard_join
from .licenses import NOTICES, PHRASES, licenses, needed
from .mixing import mix
from .neighbours import neighbours
from .packing import pack
from .sharding import shard
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents"), length=50)


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_read(spark, sf_dir, "documents"), shards=24)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"), width=3, least=90)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents"), length=400)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents"), rate=100, spm=50, seed=7)
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", restored("output", "form")))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_mix": op2_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_extract": op4_extract,
    "op5_shard": op5_shard,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_neighbours": op8_neighbours,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance": op11_importance,
    "op12_infill": op12_infill,
    "op13_licenses": op13_licenses,
}



def _runs(unit: str, sizes: list[int]) -> str:
    """SQL of ``runs (r, p, h, whole)``: a hash of the run of as many units as ``sizes`` (powers of two) add up to that starts at ``p`` in row ``r`` of ``u (r, p, <unit>)``. Hashes of runs are
    put together from those of their halves."""
    steps, width = [f"h1 AS (SELECT r, p, hash({unit}) AS h1 FROM u)"], 1
    while width < max(sizes):
        steps.append(f"h{2 * width} AS (SELECT *, hash(h{width}, lead(h{width}, {width}) OVER o) AS h{2 * width} FROM h{width} WINDOW o AS (PARTITION BY r ORDER BY p))")
        width *= 2
    parts = [f"lead(h{n}, {sum(sizes[:i])}) OVER o" for i, n in enumerate(sizes)]
    return ",\n".join(steps) + f",\nruns AS (SELECT r, p, hash({', '.join(parts)}) AS h, lead(p, {sum(sizes) - 1}) OVER o IS NOT NULL AS whole FROM h{width} WINDOW o AS (PARTITION BY r ORDER BY p))"


def _templates() -> str:
    """SQL rows ``(template, label, base, k, words, needed, gram list)`` of the phrases and notices."""
    rows = []
    for nth, (label, text) in enumerate((*PHRASES, *NOTICES)):
        words, base = text.split(), nth < len(PHRASES)
        k = 2 if base else min(3, len(words))
        grams = ", ".join(f"'{' '.join(words[i : i + k])}'" for i in range(len(words) - k + 1))
        rows.append(f"({nth}, '{label}', {base}, {k}, {len(words)}, {needed(len(words))}, [{grams}])")
    return ",\n".join(rows)


ORACLE_SQL: dict[str, str] = {
    "op2_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(r % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3.0 AS cap FROM s),
l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM f) * weight) AS target FROM w),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target / greatest(t.source_size, 1) AS ratio,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash % 4096, d.hash, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(ratio) + CASE WHEN run - size / 2.0 < (ratio - floor(ratio)) * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o""",
    "op6_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_importance": r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
x AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS (
  SELECT side, row, unnest(w) AS g FROM w
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
u AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM g)),
b AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
         lambda c, v: xor(tab[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM u, crc),
n AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM g JOIN b USING (g) GROUP BY 1),
a AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS s_all, CAST(sum(t) AS DOUBLE) + 10000 AS t_all FROM n),
k AS (SELECT bucket, CAST(floor(1000.0 * ln((CAST(t AS DOUBLE) + 1) * s_all / ((CAST(s AS DOUBLE) + 1) * t_all))) AS BIGINT) AS gain FROM n, a),
f AS (SELECT row, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM g JOIN b USING (g) JOIN k USING (bucket) WHERE side = 'd' GROUP BY 1),
e AS (
  SELECT doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN f USING (row) WHERE side = 'd'),
z AS (SELECT *, weight + CAST(floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * many // 100 THEN place END AS rank FROM r""",
    "op12_infill": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
l AS (SELECT doc_id, t, s, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l FROM d),
h AS (
  SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(l) + 1) AS c1, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(l) + 1) AS c2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS r3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS r4 FROM l),
p AS (
  SELECT doc_id, n, t, array_to_string(l[1 : least(c1, c2)], '') AS p, array_to_string(l[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m, array_to_string(l[greatest(c1, c2) + 1 : n], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 100 THEN 'plain' WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM p""",
    "op3_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
{_runs("word", [32, 16, 2])},
f AS (SELECT h, min(doc_id) AS first FROM runs JOIN d USING (r) WHERE whole GROUP BY h),
s AS (SELECT u.r, u.p, u.word, max(CASE WHEN whole AND first < doc_id THEN u.p END) OVER (PARTITION BY u.r ORDER BY u.p ROWS UNBOUNDED PRECEDING) AS last FROM u JOIN runs USING (r, p) LEFT JOIN f USING (h)),
k AS (
  SELECT r, count(*) FILTER (last > p - 50) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR last <= p - 50) AS kept FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 90 * (n + m - shared) UNION ALL SELECT b, a FROM c WHERE 100 * shared >= 90 * (n + m - shared)),
t(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN t USING (doc_id) GROUP BY ALL""",
    "op10_suffix_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, regexp_extract_all(x, '..') AS bytes FROM d),
u AS (SELECT r, unnest(bytes) AS byte, generate_subscripts(bytes, 1) AS p FROM b),
{_runs("byte", [256, 128, 16])},
f AS (SELECT h FROM runs WHERE whole GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, p, whole AND f.h IS NOT NULL AS dup FROM runs LEFT JOIN f USING (h)),
g AS (SELECT r, p, coalesce(max(CASE WHEN dup THEN p END) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) > p - 400, false) AS gone FROM s),
n AS (SELECT r, p, gone, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY r ORDER BY p) AS turn FROM g),
t AS (SELECT r, p, gone, lead(p) OVER (PARTITION BY r ORDER BY p) AS stop FROM n WHERE turn),
k AS (
  SELECT d.r, sum(coalesce(stop, length(x) // 2 + 1) - p) FILTER (gone) AS n_removed, count(*) FILTER (gone) AS n_spans,
         string_agg(substr(x, 2 * p - 1, 2 * (coalesce(stop, length(x) // 2 + 1) - p)), '' ORDER BY p) FILTER (NOT gone) AS kept
  FROM d JOIN t USING (r) GROUP BY d.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r)""",
    "op13_licenses": rf"""
WITH t(template, label, base, k, words, needed, grams) AS (VALUES {_templates()}),
a AS (SELECT template, unnest(grams) AS gram, generate_subscripts(grams, 1) - 1 AS spot FROM t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c, generate_subscripts(w, 1) - 1 AS pos FROM d),
g AS (SELECT r, pos, a || ' ' || b AS gram FROM u WHERE b IS NOT NULL UNION ALL SELECT r, pos, a || ' ' || b || ' ' || c FROM u WHERE c IS NOT NULL),
h AS (SELECT r, template, pos - spot AS diag, spot FROM g JOIN a USING (gram)),
v AS (SELECT r, template, diag, count(*) AS votes FROM h GROUP BY ALL),
b AS (SELECT r, label, diag AS start FROM v JOIN t USING (template) WHERE base AND votes = len(grams)),
f AS (SELECT r, template, diag, CASE WHEN diag - lag(diag) OVER o <= 3 THEN 0 ELSE 1 END AS far FROM v JOIN t USING (template) WHERE NOT base WINDOW o AS (PARTITION BY r, template ORDER BY diag)),
s AS (SELECT r, template, diag, sum(far) OVER (PARTITION BY r, template ORDER BY diag) AS span FROM f),
n AS (
  SELECT r, label, words, needed, count(DISTINCT spot + j) AS found, max(diag + spot + k) - min(diag + spot) AS long
  FROM s JOIN h USING (r, template, diag) JOIN t USING (template) JOIN range(3) j(j) ON j < k GROUP BY r, template, label, words, needed, span),
e AS (
  SELECT r, label, start, 1.0::DOUBLE AS share, true AS base FROM b
  UNION ALL SELECT r, CASE WHEN found >= needed AND (words >= 10 OR long = words) THEN label END, NULL, found / words, false FROM n),
z AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM e GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN z USING (r)""",
}
