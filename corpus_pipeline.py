"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one,
the last one the pieces of packed sequences. All stages take an empty table (no
rows come out), null values in any column, extra columns of any name (all but the
last stage return them as they are, unless said otherwise) and very long texts
(whole; from 2**27 bytes on the suffix stage raises ValueError).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, near_dedup, packing, quality_rules, suffix_dedup
from skein.llm.runtime import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Null, empty and blank texts go, as they have no words; a rate that ties with
    its limit stays; repeated rows are judged alike, so all of them stay or go.
    """
    return quality_rules.filter_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near duplicates, unchanged.

    The least doc_id is the first, null before all others; of rows that tie in it,
    repeated rows included, the one whose text has the least hash. Texts without a
    word are no one's duplicates and stay.
    """
    return near_dedup.keep_first(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of 100-byte strings that also start earlier.

    n_chars follows the new text, where there is such a column. A null text stays
    null and an empty one empty; rows that tie in doc_id, repeated rows included,
    count one after the other by a hash of the text, so the first keeps its text
    and the others become empty; bytes of a character that is cut apart go.
    """
    return suffix_dedup.strip_earlier(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without spans of benchmark windows.

    n_chars follows the new text, where there is such a column. Null, empty and
    wordless texts stay as they are; repeated rows, and rows that tie in doc_id,
    are cleaned one by one; an empty benchmark changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows, and rows that tie in
    doc_id, are packed one by one.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near), ("suffix_dedup", suffix), ("decontamination", benchmark), ("packing", pack)]

#: The tokenizer of the last stage is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
