"""The queries of the training-data operators and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import chat, decontam, html, jaccard, licenses, lines, mixing, pii, quality, suffixes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and the cascade's verdict for every document."""
    return quality.quality(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_read(spark, sf_dir, "pages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back and digested."""
    return chat.chat(_read(spark, sf_dir, "conversations"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, edited a little or not."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents."""
    return licenses.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sources share."""
    out = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", "clean_text")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    out = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii(_read(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word 4-grams overlap by 85 % or more."""
    out = jaccard.jaccard_components(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that stand elsewhere too."""
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_decontamination": op4_decontamination,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_pii": op8_pii,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_WORD}) AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, list_aggregate(ws[i:i + 4], 'string_agg', chr(31)) AS gram
        FROM (SELECT r, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - 3)) AS i FROM w WHERE len(ws) > 4)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
k AS (SELECT r, count(DISTINCT i + j) AS n FROM c, (SELECT unnest(range(5)) AS j) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN k ON w.r = k.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (100 * n_symbols > 6 * word_chars) AND NOT (word_chars > 40 * n_words)
  AND NOT (4 * n_dup_lines > n_words) AS kept FROM b""",
    "op3_chat_formatting": r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(t, '\', '\\'), '<|', '<\|') AS x,
  replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>') AS y FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, x) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(x) + length(y)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
l AS (SELECT r, doc_id, site, x.n AS n, x.l AS l, trim(x.l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, site, unnest(list_transform(string_split(text, chr(10)), lambda v, i: {'n': i, 'l': v})) AS x FROM d)),
b AS (SELECT key, min({'a': length(CAST(doc_id AS VARCHAR)), 'b': CAST(doc_id AS VARCHAR), 'n': n}) AS first
  FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.r, l.n, l.l, b.key IS NOT NULL
    AND {'a': length(CAST(l.doc_id AS VARCHAR)), 'b': CAST(l.doc_id AS VARCHAR), 'n': l.n} <> b.first AS gone
  FROM l LEFT JOIN b ON l.key = b.key),
s AS (SELECT r, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
  coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS clean_text FROM m GROUP BY r)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, s.clean_text
FROM d LEFT JOIN s ON d.r = s.r""",
    "op7_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS used, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING)),
v AS (SELECT coalesce(max((total - (caps - cap)) / (weights - (used - weight))) FILTER (WHERE cap >= (total - (caps - cap)) / (weights - (used - weight)) * weight), 0) AS level
  FROM (SELECT * FROM f WHERE cap >= (total - (caps - cap)) / (weights - (used - weight)) * weight ORDER BY cap / weight, rank LIMIT 1)),
t AS (SELECT source, rank, source_size, least(cap, level * weight) AS target, CAST(round(least(cap, level * weight)) AS BIGINT) AS goal,
  least(4096, greatest(16, CAST(ceil(source_size / 65536.0) AS BIGINT))) AS nb FROM w, v),
x AS (SELECT d.doc_id, d.size, d.h, t.*, d.h % nb AS block FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT rank, block, sum(size) AS words FROM x GROUP BY rank, block),
p AS (SELECT rank, block, words, coalesce(sum(words) OVER (PARTITION BY rank ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b),
y AS (SELECT x.*, start, goal // greatest(source_size, 1) AS passes, goal % greatest(source_size, 1) AS rest, words,
  coalesce(sum(size) OVER (PARTITION BY x.rank, x.block ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM x JOIN p ON x.rank = p.rank AND x.block = p.block)
SELECT doc_id, size, source_size, target, CAST(passes * size + CASE WHEN start + words <= rest THEN size
  WHEN start < rest THEN least(size, greatest(0, rest - start - before)) ELSE 0 END AS BIGINT) AS taken FROM y""",
    "op9_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, CAST(len(w) AS BIGINT) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
z(r, m) AS (SELECT r, r FROM d UNION SELECT z.r, e.b FROM z JOIN e ON z.m = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM z JOIN d ON z.r = d.r JOIN d o ON z.m = o.r LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id""",
    "op10_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, CAST(length(h) AS BIGINT) // 2 - 199)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM t),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
u AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY r, run),
q AS (SELECT r, b AS a, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000) AS b FROM u
  UNION ALL SELECT r, 0, min(a) FROM u GROUP BY r),
x AS (SELECT q.r, string_agg(substr(h, 2 * q.a + 1, 2 * (q.b - q.a)), '' ORDER BY q.a) AS kept FROM q JOIN d ON q.r = d.r GROUP BY q.r),
c AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM u GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN x ON d.r = x.r""",
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
