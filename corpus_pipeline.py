"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, tokens.

Every stage works on all rows that the one before kept. Between stages the rows are written as Parquet to the folder that the
cluster names in spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import bpe, pii
from wakeline.llm.common import dropped, staged, table
from wakeline.llm.decontaminate import decontamination_stage
from wakeline.llm.jaccard import near_duplicate_stage
from wakeline.llm.langid import language_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to typed placeholders; every row stays, whatever its id, and null and empty texts stay as they are.
    Other columns of any name pass through."""
    return pii.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of token ids and the SHA-256 of the ids and of the bytes that they decode to, a row for each row of docs.
    Null texts count as empty."""
    return bpe.encode(docs, *bpe.vocabulary(), hashed=True, keep=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("tokens", token_stage),
]

#: Learned profiles decide the first stage, so SQL can't give run()'s rows; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
