"""The operators of this folder as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import table
from broadsheet.llm.imatch import compare_edited
from broadsheet.llm.jaccard import jaccard_components
from broadsheet.llm.language import language, learn_profiles
from broadsheet.llm.leaks import find_leaks
from broadsheet.llm.mixing import mix_sources
from broadsheet.llm.packing import pack_documents
from broadsheet.llm.repeats import remove_repeats
from broadsheet.llm.structure import damage, repair_conversations, summaries
from broadsheet.llm.tokens import read_digests, write_tokens
from broadsheet.llm.toxicity import learn, toxicity
from broadsheet.llm.trie import rebuilt_trie
from broadsheet.llm.urls import judge_urls
from broadsheet.llm.warc import read_warc, write_warc
from broadsheet.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a document; one without an id is in none that teaches (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


TOXIC_AT = 0.7


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(
        fold_of(F.col("doc_id"), 3).isin(0, 2)
    )
    model = learn(docs, labels)
    return docs.select(
        "doc_id", (~fold_of(F.col("doc_id"), 3).isin(0, 2)).alias("held_out"),
        toxicity(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id"), 5) < 1
    profiles = learn_profiles(docs.where(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), language(F.col("text"), profiles).alias("p")
    ).select("doc_id", "held_out", "p.*")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).drop("url")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return read_digests(spark, folder)


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations")).drop("d1", "d2")


@query
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    ids = conversations.where("conv_id IS NOT NULL").select("conv_id").distinct()
    return summaries(repair_conversations(damage(conversations)), ids)
