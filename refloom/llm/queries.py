"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, decontamination, licenses, line_dedup, mixing, near_dup, quality, rans, toxicity, url_rules
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("place")


def op3_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_language(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages")).drop("n_tried")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_token_files, op2_mix_sources, op3_language_scores, op4_toxicity, op5_license_scan, op6_near_duplicates, op7_quality_bands, op8_line_dedup, op9_url_rules, op10_decontaminate)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = {
    "op8_line_dedup": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos, len(ls) AS n FROM docs),
        keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
        repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM keyed k LEFT JOIN repeated r USING (key))
        SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_url_rules": r"""
        WITH parts AS (SELECT page_id, coalesce(url, '') AS u, """
    + _LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")
    + r""" AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(verdict, h, p) AS (VALUES """
    + ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in url_rules.HOST_RULES)
    + r"""), best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, CASE WHEN b.verdict IS NOT NULL THEN b.verdict WHEN """
    + " OR ".join(f"regexp_matches({_LOWER.format('u')}, {_quoted(p)})" for p in url_rules.PATTERN_RULES)
    + r""" THEN 'block' ELSE 'allow' END AS verdict FROM parts LEFT JOIN best b USING (page_id)""",
    "op10_decontaminate": f"""
        WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win, least(10, len(w)) AS k
            FROM (SELECT *, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        spots AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS win FROM
            (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        hits AS (SELECT doc_id, i, k, item_id FROM spots JOIN windows USING (win, k)),
        hit_words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
}
