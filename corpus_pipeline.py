"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
reads it back from Parquet.  All but the last return the columns of `documents`,
`n_chars` brought up to date where texts change.

What each stage does with odd rows (the operators' docstrings say more):

quality_rules   null and empty texts have no words and go; equal rows get equal verdicts.
line_dedup      null texts go, as do those without a word left; of equal passages the one of the
                smallest id stays, of rows with equal id and text an arbitrary one keeps it.
near_dedup      the smallest id of a group stays; rows of one id are one document; null texts and
                those without words would be near nothing and stay, but none are left here.
mix_sources     null sources are one source, the last; rows of a source with equal id and size are
                drawn together; a row without words is taken 0 words.
pack_sequences  null texts are empty, and an empty one is its end token; repeated rows are packed
                each time; only what is longer than a sequence is cut.

All take texts of any length whole, keep columns with clashing names, and give empty
tables for empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliloom.llm.linededup import dedup_documents
from cliloom.llm.mixing import mixed_documents
from cliloom.llm.neardup import drop_near_copies
from cliloom.llm.packing import pack_documents
from cliloom.llm.quality import clean_documents
from cliloom.llm.queries import tokenizer_path
from cliloom.llm.shared import written
from cliloom.shipping import ship


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go; so do documents that lose too much or fail as a whole."""
    ship(spark)
    return _counted(clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks stay where they occur first; documents without a word left go."""
    ship(spark)
    return _counted(dedup_documents(docs)).where(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    ship(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; a document is there as often as the mix takes it."""
    ship(spark)
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    ship(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Packing needs a tokenizer, which SQL has not; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, the rows between them in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
