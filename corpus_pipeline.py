"""From raw documents to token ids: five operators in a row.

The mixing and encoding stages have results that SQL cannot express after the language model's
decisions, so ORACLE_SQL is None; tests/llm compares the stages with plain Python.

Rows are told apart by id and text, so null and repeated ids are neither lost nor multiplied. Columns
beside those of documents go along, also where an operator's own columns have their names. An empty
table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.chunk_dedup import exact_dedup
from offerloom.llm.common import ascii_lower, table, written
from offerloom.llm.ngram_quality import quality
from offerloom.llm.piece_codec import encode_decode
from offerloom.llm.source_mix import mix_sources, take
from offerloom.llm.token_combo_join import jaccard_components


#: Rejected keys are broadcast up to this many (8 bytes each); beyond, the anti join is shuffled.
MOST_BROADCAST = 2_000_000
#: Ids may be null or repeated, so a row is told by 64 bits of its id and text (and what else decides its fate).
ROW = lambda: F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("lang", F.lit("none")), F.coalesce("text", F.lit("")))
EXACT = lambda: F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of docs whose row_key is not in rejected."""
    gone = written(rejected.select(F.col("row_key").alias("_gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    return docs.join(gone, docs["row_key"] == F.col("_gone"), "left_anti").drop("row_key")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject.

    Null, empty and blank texts go; languages without trusted text stay whole; equal rows fare alike.
    """
    keyed = docs.withColumn("row_key", ROW())
    return _without(keyed, quality(keyed, table(spark, sf_dir, "labels"), key_col="row_key").where("not keep"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id (null is below all); of rows that repeat id and text, one.

    Null texts equal empty ones.
    """
    told = exact_dedup(docs).select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_sha256").alias("row_key"), "kept")
    told = written(told.groupBy("row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    keyed = docs.withColumn("row_key", EXACT())
    kept = _without(keyed, told)
    repeated = told.where("kept").select("row_key")
    if repeated.isEmpty():
        return kept
    # rows that repeat both id and text are one document
    again = keyed.join(repeated, "row_key", "left_semi").groupBy("row_key").agg(F.max(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("row"))
    return kept.unionByName(again.select("row.*").select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest id (a null id is above all).

    Texts without words link with nothing and stay.
    """
    keyed = docs.withColumn("row_key", ROW())
    found = jaccard_components(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    joined = written(found.where("row_key <> component_id").distinct())
    members = joined.union(joined.select("component_id", "component_id").distinct())
    ids = keyed.select(F.col("row_key").alias("_key"), F.col("doc_id").isNull().alias("none"), "doc_id")
    members = written(members.join(ids, F.col("row_key") == F.col("_key")).select("row_key", "component_id", F.struct("none", "doc_id", "row_key").alias("place")))
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    return _without(keyed, members.join(first, "component_id").where("row_key <> first.row_key"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and sampled until sources have their target shares.

    A null source is one source; texts without words weigh nothing and come as often as their source is taken whole.
    """
    return take(docs, mix_sources(docs, carry=True))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and what they decode to, as digests; a null text is empty. One row for each row."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mix", mixture),
    ("encode", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
