"""Corpus pipeline: clean documents, without near copies and repeated passages, packed into training sequences.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all rows of docs; all
but the last return those columns, also ones that documents doesn't have. Models are trained from docs and labels at
each run. A table without rows passes every stage; a row without doc_id is nobody's copy and has no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldlog.llm import common, jaccard, packing, quality, substrings, toxicity
from foldlog.llm.store import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a toxicity score of 0.5 or more go. Null and empty texts have the score of no words; repeated rows fare alike."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the base rules or the isolation forests reject go, so also null and empty texts; repeated rows fare alike."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of linked documents, the one with the smallest doc_id stays; of repeated rows, one. Texts without words and rows without doc_id all stay."""
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: words of passages of 50 words and more that a document with a smaller doc_id has go; n_chars follows. Null texts stay null, rows without doc_id as they are."""
    return substrings.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of the documents, each with its sequence and place there. A null or empty text is one piece; equal lengths are ranked by task and row."""
    return packing.pack(docs, packing.default_spec())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality_rules", reject_low_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: Trained models, components and tokenization can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the checkpoint folder and read again, those of the stage before go then."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
