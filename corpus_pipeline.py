"""The corpus pipeline: five operators in a row over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents; the last returns, for each row that
the mix takes, doc_id, the number of tokens and the ids, with their digests.

A stage writes tables of its own to the shared folder and needs them until its result is written; the
next stage of the application deletes them.

Defined results: a null text counts as empty. Language ID rejects texts without letters, so null and
empty ones go; a null language or source is no evidence. Of equal texts the row with the smallest doc_id
stays (null last), of rows equal in both one. Of a group of near-duplicates the same. A null source is
a source of its own. Texts have any length; an empty table gives an empty result. Extra columns of docs
are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exactdedup, langid, mixing, nearcopies
from corpusloom.llm.shared import documents, materialise
from corpusloom.storage import drop_materialised, scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exactdedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id stays."""
    return nearcopies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(docs.select("doc_id", "text"), bpe.vocabulary(), with_ids=True)
    return found.select(F.col("_row.doc_id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(number: int, stage: Stage) -> Stage:
    """The stage with tables in a scope of its own; those of the stages before it are deleted."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for before in range(number):
            drop_materialised(spark, f"pipeline-stage-{before}")
        with scope(f"pipeline-stage-{number}"):
            return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _numbered(number, stage))
    for number, (name, stage) in enumerate([
        ("language ID", identify_language),
        ("exact dedup", drop_copies),
        ("near dedup", drop_near_copies),
        ("mixing", mix_sources),
        ("encoding", encode),
    ])
]

#: SQL cannot express language identification, fingerprints or the encoding; tests hold run() against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with scope(f"pipeline-result-{i}"):
                docs = materialise(docs, "docs")
            if i:
                drop_materialised(spark, f"pipeline-result-{i - 1}")
    return docs
