"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, with whatever columns a table has
beside them, under any name. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, mixing, packing, quality_rules, simhash
from corpusmill.llm.common import discard, shared_dir, table
from corpusmill.llm.queries import MIX_WEIGHTS, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rule reject go; a null or empty text has no words, so it goes. Repeated rows share their verdict."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that of the smallest id (a null id is smaller than any); ties go by the text. Null texts count as empty."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays, the first by id, fingerprint and text; rows without an id stay. Null texts count as empty."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it was drawn, in a global shuffle; rows of one id are drawn alike. A null source is a source of its own; null texts have no size."""
    return mixing.mix(docs, MIX_WEIGHTS, added=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, each row on its own; a null text has its closing id alone, a null id stays null."""
    return packing.with_digest(packing.pack(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the compression ratios nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again. What a stage wrote goes when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
