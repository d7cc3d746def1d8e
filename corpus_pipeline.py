"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes all that the one before it kept, as Parquet, and all but the last return
the columns of ``documents``. Null texts and texts without words pass the first three stages
unchanged and end at the fourth, which takes nothing of a document of no words; very long
texts are worked on whole; of repeated rows the second stage keeps one; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityframe.llm import bpe, common, mixing, ngram_join, suffix_dedup, toxicity
from entityframe.llm.queries import tokenizer_path


#: Rows of the Arrow batches of stages whose result is written by others: whole texts pass through them.
BATCH_ROWS = "1000"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; labels are learnt from the rows that are not held out."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.crc32_of("doc_id") % 3 != 1)
    return toxicity.reject(docs, toxicity.fit(docs, labels), threshold=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join.deduplicate(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start elsewhere too, ``n_chars`` counted anew."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    cut = suffix_dedup.apply(docs, length=200)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(cut.schema["n_chars"].dataType), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share takes it; source null is one source."""
    return mixing.apply(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of token ids and of the text that they decode to."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return bpe.digests(bpe.round_trip(docs, tokenizer_path()))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            common.discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
