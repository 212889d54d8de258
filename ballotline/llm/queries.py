"""Queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extraction, licenses, linededup, mixing, quality, secrets, simhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_table(spark, sf_dir, "documents"), runs=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_licenses that its contract fixes."""
    return op1_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_quality that its contract fixes."""
    return op2_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_mixing that its contract fixes; targets to three decimals, since sums differ in their last bits."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_quality": op2_quality,
        "op3_secrets": op3_secrets,
        "op4_extraction": op4_extraction,
        "op5_toxicity": op5_toxicity,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_simhash": op10_simhash,
        "license_base": license_base,
        "quality_base": quality_base,
        "mixing_targets": mixing_targets,
    }


#: SHA-1 as base32: each 5 hex digits are 20 bits, which are 4 letters.
_BASE32 = (
    "list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda b: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 5 * g + 1, 5) AS BIGINT) >> b) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '')"
)

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""


_LICENSES = """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1:i + 4] = ['apache', 'license', 'version', '2']) AS a,
  list_filter(range(len(w)), lambda i: w[i + 1:i + 3] = ['cc', 'by', 'nc']) AS c, list_filter(range(len(w)), lambda i: w[i + 1:i + 4] = ['under', 'the', 'mit', 'license']) AS m FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(a) + len(c) + len(m) AS BIGINT) AS n_base, CAST(list_min(a || c || m) AS BIGINT) AS first_word, CAST(list_max(a || c || m) AS BIGINT) AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels
FROM p
"""

_QUALITY = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
d AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS three FROM d WHERE len(w) > 2),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS s(k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN rep USING (r)
"""

#: The words for a unit of weight: the sources that stop are those up to the last stop at which all together don't reach the total.
_TARGETS = """
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM t GROUP BY source),
whole AS (SELECT 1.5::DOUBLE * sum(n) AS total FROM s),
stops AS (SELECT 2.0::DOUBLE * k.n / k.weight AS rate, sum(least(2.0::DOUBLE * s.n, s.weight * (2.0::DOUBLE * k.n / k.weight))) AS reached FROM s AS k CROSS JOIN s GROUP BY k.source, k.n, k.weight),
last AS (SELECT coalesce(max(rate), -1) AS rate FROM stops, whole WHERE reached <= total),
unit AS (SELECT (any_value(total) - coalesce(sum(2.0::DOUBLE * n) FILTER (2.0::DOUBLE * n / weight <= rate), 0)) / sum(weight) FILTER (2.0::DOUBLE * n / weight > rate) AS u FROM s, whole, last)
SELECT doc_id, size, n AS source_size, round(least(2.0::DOUBLE * n, weight * coalesce(u, 1e300)), 3) AS target
FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source, unit
"""


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, trained models or rolling hashes: the other queries opN_ are tested against plain versions in tests/llm."""
    return {"op9_warc": _WARC, "license_base": _LICENSES, "quality_base": _QUALITY, "mixing_targets": _TARGETS}
