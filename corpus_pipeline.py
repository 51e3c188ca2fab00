"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm._storage import bound_batches, settle
from trackloom.llm.decontamination import find_phrases
from trackloom.llm.jaccard import near_duplicates
from trackloom.llm.packing import pack
from trackloom.llm.pii import find_personal_data, train_field
from trackloom.llm.quality import score_quality, train_quality


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id and text beside all columns as one, so that no column of an operator replaces one of the documents."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"], F.lit(0).alias("_")).alias("_document"))


def _unwrapped(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The documents' columns again, some of them changed."""
    return found.select(*[(changed[c] if c in changed else F.col("text") if c == "text" else F.col(f"_document.`{c}`")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    bound_batches(spark)
    ranking = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unwrapped(score_quality(_wrapped(docs), ranking).where("predicted = 1"), docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Rows are told apart by their place in a written copy, not by doc_id: of different texts with one
    doc_id each stays unless it is a near-duplicate itself, and rows without a doc_id are like others, but
    stay only where their group has no other. Texts without words all stay.
    """
    bound_batches(spark)
    rows = settle(docs.select(F.struct(*docs.columns).alias("document"), F.monotonically_increasing_id().alias("place")), "documents")
    found = near_duplicates(rows.select(F.col("place").alias("doc_id"), F.col("document.text").alias("text"))).withColumnRenamed("doc_id", "place")
    named = found.join(rows.select("place", F.col("document.doc_id").alias("own")), "place")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "place")).alias("first")).select("first.place")
    return rows.join(kept, "place", "left_semi").select("document.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of a benchmark item."""
    bound_batches(spark)
    found = find_phrases(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unwrapped(found.where("not contaminated"), docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows a text that changes."""
    bound_batches(spark)
    found = find_personal_data(_wrapped(docs), train_field(docs))
    changed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("masked").eqNullSafe(F.col("text")), F.col("_document.n_chars")).otherwise(F.char_length("masked").cast(docs.schema["n_chars"].dataType))
    return _unwrapped(found, docs.columns, **changed)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its place in a sequence of 4096."""
    bound_batches(spark)
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("packing", sequences),
]

#: The ranking, the field and the packing have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result before it is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
