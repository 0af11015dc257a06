"""The corpus pipeline: quality, near-duplicates, benchmark passages, source mix, token ids.

Each stage works on all that the one before kept. Its decisions are written as a small table of document keys (doc_id and
the text's hash) below the shared folder, and its scratch tables are deleted when it returns. What a run leaves is its
result, those small tables, and the token shards, which are its product; runs do not touch one another's files.

Defined cases: null and empty texts are scored as empty ones, are near-duplicates of nothing, hold no benchmark passage,
have no words for the mix (they are taken as often as the source's words are), and give the end id alone; texts of any length
are read whole; rows that are equal in doc_id and text are one document from the second stage on; of equal documents
the smallest doc_id stays; a null doc_id is kept as null and is never a duplicate; an empty table gives an empty result;
columns besides doc_id, text and source go along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from svloom.llm.common import Workspace
from svloom.llm.decontam import drop_contaminated
from svloom.llm.mixing import mix_documents
from svloom.llm.neardup import deduplicate
from svloom.llm.quality import keep_good
from svloom.llm.tokenids import token_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mix of their source wants, some not at all."""
    return mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to shard files; the result has each document's place in them."""
    return token_ids(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", tokenize),
]

#: SQL cannot express a trained classifier, MinHash or the tokenizer; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written to the shared folder and read again as the next one's docs.

    A stage's result is deleted when the next one is written.
    """
    space = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            space.drop(before)
        before = docs
    return docs
