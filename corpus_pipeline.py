"""A training corpus from ``documents``: five stages, each reading what the one before wrote.

All stages but the last return rows of ``documents`` with its columns; the last writes token
ids and returns where each row's ids stand.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import table
from broadsheet.llm.jaccard import one_of_each
from broadsheet.llm.leaks import without_leaks
from broadsheet.llm.mixing import mixed
from broadsheet.llm.tokens import read_digests, write_tokens
from broadsheet.llm.toxicity import learn, toxicity
from broadsheet.session import materialize, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC_AT = 0.7
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the model learns from all labels."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity(F.col("text"), model) < TOXIC_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: linked by
    five-word shingles with a Jaccard similarity of 0.8 or more."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes it."""
    return mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows in files; doc_id, start, n_tokens and ids_crc32 as read back."""
    folder = scratch_path(spark, "pipeline-tokens")
    write_tokens(docs, folder, TOKENIZER)
    return read_digests(spark, folder)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix),
    ("token_ids", write_ids),
]

# Learned weights, edit distances and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
