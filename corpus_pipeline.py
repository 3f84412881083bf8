"""The corpus pipeline over `documents`: each stage reads what the one before it has written.

Counted as part of the subpackage `tidemark.llm`.

    toxicity             documents that score 0.3 or more go
    exact dedup          of texts that are equal without white space one stays
    MinHash near-dedup   one document of each group of near copies stays
    secret scans         secrets in the texts that are left are masked; no document goes
    packing              the texts are cut and packed into sequences of 1024 ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.near_dedup import drop_near
from tidemark.llm.packing import pack
from tidemark.llm.secret_scan import mask_secrets
from tidemark.llm.shared import cut, table
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a model of the labels scores under the threshold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of texts that are equal without white space, the longest as written, then the smallest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of near copies."""
    return drop_near(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars, where there, follows the text."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place in a sequence."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("secret scans", secrets), ("packing", packing)]

#: A learned score decides in the first stage, which SQL can't express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
