"""The training-data pipeline: five stages over documents, each written and read again.

A stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents. Decisions take effect: rejected
documents are gone, dropped lines are gone from the text, of a group of near copies one document is left, and
a document stands in the mix as often as it is taken. Columns beside doc_id, text, source and n_chars are carried along.

Null and empty texts are judged by their scores, have no lines and no copies; in the mix they have no words and are not taken. Equal rows are one
document after the third stage. Rows without an id are never copies. An empty table passes every stage and gives no rows. Texts are
read whole by every stage, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.llm import copy_classes, line_dedup, mixing, near_dedup, packing, quality_gam
from noticegrid.llm.base import fresh, read, stage
from noticegrid.llm.queries import fold, tokenizer_files

# Near copies: word shingles of five, similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is below the threshold; learned from the labelled rows outside the held-out fold."""
    model = quality_gam.learn(docs, read(spark, sf_dir, "labels"), fold(5) != 0)
    score = fresh(docs, "score")
    return quality_gam.scored(docs, model, score).filter(F.col(score) >= quality_gam.KEEP_AT).select(*docs.columns)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines, and without the documents that had nothing else. The limit does not grow with the table.

    A group of near copies counts as one document: which of them stays is for the next stage. DataFrame functions only.
    """
    copies = copy_classes.copied_texts(docs, width=NEAR_WORDS)
    lines, dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    cut = line_dedup.without_lines(docs, lines, dropped, copies=copies)
    return cut.filter((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_dedup.without_near_copies(docs, percent=NEAR_PERCENT, width=NEAR_WORDS).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of every document, with its sequence and its place there."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality_classifier", quality_classifier), ("line_templates", line_templates), ("near_copies", near_copies),
    ("mix_sources", mix_sources), ("pack_sequences", pack_sequences),
]
# The classifier is fitted by boosting; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
