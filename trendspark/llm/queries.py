"""Queries of the text problems (p3, p6, p7, p8) and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, packing, pii, truncation
from ..sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.find_truncated(table(spark, d, "eval_results"), "result_id", "model", "answer")
    return found.where("evidence is not null").select("result_id").distinct()


def p3_share(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.find_truncated(table(spark, d, "eval_results"), "result_id", "model", "answer")
    return truncation.truncation_by_source(found)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a packing promises, counted over all containers and texts."""
    docs, limits = table(spark, d, "documents"), table(spark, d, "pack_limits")
    return packing.packing_checks(docs, packing.pack(docs, limits), limits)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a mixture promises, counted over all its uses of texts."""
    return mixing.mixture_checks(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders."""
    docs = table(spark, d, "documents")
    return pii.mask_personal(docs.select("doc_id", "text"), pii.fit(docs, table(spark, d, "given_names")))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Whether every masked text differs from its text in the mentions alone."""
    docs = table(spark, d, "documents")
    return pii.restored(docs.select("doc_id", "text"), pii.fit(docs, table(spark, d, "given_names")))


QUERIES = {f.__name__: f for f in (p3_found, p3_share, p6_pack, p6_fill, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_masked, p8_restored)}

#: Tokens cannot be counted in SQL; what holds of every packing and mixture can be said in it.
ORACLES: dict[str, str] = {
    "p8_restored": "SELECT doc_id, true AS restored FROM documents WHERE text IS NOT NULL",
    "p6_checks": """SELECT pack_name, capacity_tokens AS capacity, (SELECT count(DISTINCT doc_id) FROM documents) AS texts, 0::BIGINT AS lost, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS split
FROM (SELECT DISTINCT pack_name, capacity_tokens FROM pack_limits WHERE pack_name IS NOT NULL AND capacity_tokens > 0)""",
    "p7_checks": r"""SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s_\-]+', '-', 'g') AS source, 0::BIGINT AS off_budget, 0 AS over_repeated, 0::BIGINT AS gaps, 0 AS unequal_uses
FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats > 0""",
}
