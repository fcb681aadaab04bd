"""The corpus pipeline: five stages from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes what
a stage returns to the shared folder and rereads it as the next one's documents.

1. Quality rules: failing lines go, and documents that lose too much or fail the base rules.
2. N-gram Jaccard join (five words, 0.8): of each class of near copies one row stays, of the smallest id.
3. Suffix-array dedup: strings of 200 bytes that occur twice or more go, from all places;
   documents of which no word is left go.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Byte-level BPE: token ids in place of the text, checked by decoding them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbral.llm import bpe, decontaminate, jaccard, quality, repeats
from timbral.llm.common import read_table
from timbral.llm.shared import row_key, without, written

NEAR = jaccard.Settings(shingle=5, percent=80)
REPEATS = repeats.Settings(length=200)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.clean(docs, REPEATS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    found = written(decontaminate.find(keyed, read_table(spark, sf_dir, "benchmark"), id_col="__key").select("__key").distinct())
    return without(keyed, found, "__key").drop("__key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.replace_text(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", tokens),
]

#: No stage but the first could be said in SQL; tests compare the first two stages with brute force, the others by operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
