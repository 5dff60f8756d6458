"""The queries of this subpackage over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_text, line_dedup, lm_score, near_dedup, pieces, pii, quality, secrets
from .spread import table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
PII_KEY = "spark.oxyframe.pii.key"
_session_keys: dict[str, bytes] = {}


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"), PIECES)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def pii_key(spark: SparkSession) -> bytes:
    """The key that the setting PII_KEY names; without one, a random key of this application.

    Pseudonyms are equal across applications, and can be reversed, only with a key set.
    """
    named = spark.conf.get(PII_KEY, None)
    return named.encode() if named else _session_keys.setdefault(spark.sparkContext.applicationId, token_bytes(32))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii_key(spark))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup,
        op2_quality_classifier,
        op3_lm_scoring,
        op4_sentencepiece,
        op5_html_extraction,
        op6_secret_scan,
        op7_line_dedup,
        op8_pii,
        op9_near_dedup,
        op10_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
