"""Registered queries of the document operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm.alignment import align
from dosewise.llm.decontaminate import contamination
from dosewise.llm.id_files import read_ids, write_ids
from dosewise.llm.language_id import fit, is_held_out, predict
from dosewise.llm.mixing import mixture
from dosewise.llm.oracles import ORACLES
from dosewise.llm.phrases import collocations
from dosewise.llm.pseudo_likelihood import score
from dosewise.llm.sharding import record_size, write_shards
from dosewise.llm.shingle_join import jaccard_components
from dosewise.llm.substring_dedup import remove_repeats
from dosewise.llm.token_counts import token_counts
from dosewise.llm.vector_dedup import vector_links
from dosewise.llm.warc import read_bundles, write_bundles
from dosewise.session import scratch_dir, tune

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Tokens that a model reads at once.
CONTEXT = 1024
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "block", "copies")


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(_table(spark, sf_dir, "embeddings"))


@query
def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(tune(spark))
    write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), path)
    return read_ids(spark, path).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(tune(spark))
    write_shards(_table(spark, sf_dir, "documents"), path)
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(tune(spark))
    write_bundles(_table(spark, sf_dir, "pages"), path)
    records = read_bundles(spark, path, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(x) for x in (TOKENIZER, PIECES))
    return align(_table(spark, sf_dir, "documents"), *paths).documents.drop("groups")
