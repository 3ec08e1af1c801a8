"""The corpus operators as registered queries, with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchplan.llm.decontaminate import decontaminate
from batchplan.llm.jaccard_join import jaccard_components
from batchplan.llm.packing import pack
from batchplan.llm.pii import pii_report
from batchplan.llm.quality_lm import quality_classifier
from batchplan.llm.quality_rules import BASE, POLICIES, RULES, mask, quality_rules
from batchplan.llm.suffix_dedup import deduplicated, digests
from batchplan.llm.token_counts import token_counts
from batchplan.llm.token_output import read_token_store, write_token_store
from batchplan.llm.tokens import vocabulary
from batchplan.llm.url_filter import parse_rule, url_filter

URL_RULES = [parse_rule("allow", "com/"), parse_rule("block", "example.com/en/"), parse_rule("allow", "www.example.com/en/"), parse_rule("block", "net/es/"), parse_rule("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality_classifier(_table(spark, sf_dir, "documents"), trusted)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(_table(spark, sf_dir, "documents"), length=400, words=51)
    return found.select(*digests(found), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "n_shared_words")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES, default="allow")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, _ = write_token_store(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_store(spark, uri)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality_classifier, op3_decontamination, op4_best_fit_packing, op5_jaccard_join, op6_suffix_dedup, op7_pii, op8_quality_rules, op9_url_filter, op10_token_output)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


_OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""

_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) t(s) WHERE len(w) >= 8),
again AS (SELECT doc_id, s FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM again, unnest(range(s, s + 8)) t(p) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_alpha FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {test} THEN {1 << k} ELSE 0 END" for k, (_, test) in enumerate(RULES))} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {mask(BASE)} <> 0 AS base_failed, failed & {mask(POLICIES["v1"])} = 0 AS kept, failed FROM f"""

_OP9 = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rule, action, rh, rp) AS (VALUES {", ".join(f"('{x.key}', '{x.action}', '{x.host}', '{x.path}')" for x in URL_RULES)}),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    """Token ids, perplexities, suffix order and the spans of personal data have no SQL form; their tests are in tests/llm."""
    return {"op3_decontamination": _OP3, "op5_jaccard_join": _OP5, "op8_quality_rules": _OP8, "op9_url_filter": _OP9}
