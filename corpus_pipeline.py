"""Corpus pipeline: language, quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeframe.llm import decontam, dedup, langid, packing, quality
from edgeframe.llm.queries import tokenizer_path
from edgeframe.llm.scratch import Scratch, table


def _turn(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: null text, text without letters or with a score under 0.3 goes.

    The model learns from docs with a doc_id and a lang. Rows that repeat are judged each, null
    doc_ids stay if their text does, long texts are judged whole, further columns pass whatever
    their names. An empty table gives no rows.
    """
    model = langid.learn(docs.where(F.col("doc_id").isNotNull() & (_turn(4) != 2)).select("doc_id", "text", "lang"))
    return langid.accept(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of at least 0.3.

    Null text counts as empty, and empty text is scored like any other. Without any label the score
    is 0.5 and all rows stay. Rows that repeat, null doc_ids, long texts, further columns and empty
    tables as in :func:`language`.
    """
    trees = quality.learn(docs, table(spark, sf_dir, "labels").where(_turn(5) != 0))
    return quality.accept(docs, trees)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group (5-word shingles, 0.8).

    Rows with a null doc_id stay, and rows without words. Rows that repeat a doc_id are decided one by
    one by their texts: of those that are the kept document of one group, the smallest row stays.
    Further columns pass; an empty table gives no rows.
    """
    return dedup.one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 10 consecutive words (or all words) of a benchmark item.

    Null and empty texts hold none and stay. An empty benchmark drops nothing. Rows that repeat,
    null doc_ids, long texts, further columns and empty tables as in :func:`language`.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token lengths of the remaining documents packed into sequences.

    Every row is packed, also null ids and repeated ones; null text is its end id alone; texts longer
    than the largest sequence fall into pieces. Further columns are ignored; an empty table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
