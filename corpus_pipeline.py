"""A corpus pipeline of five operators: run(spark, sf_dir) applies STAGES to the documents table.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last its token digests. Parquet lies between stages.
Columns of docs besides those of documents are dropped, whatever their names. A null text is an empty one to every stage, rows that repeat a doc_id or
have none are rows of their own, an empty table gives an empty table, and texts are whole however long they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weir.llm import op2_secret_scan, op3_mixing, op4_simhash, op8_bpe, op9_language_mixture
from weir.llm.common import exists, removed, shared_folder, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language scores under this go.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too) or without one prevailing language go; lang becomes the predicted one.

    A null lang is not learned from. Repeated rows share their fate. Ties of languages go to the one that sorts first.
    """
    found = op9_language_mixture.identified(docs.select(*COLUMNS))
    kept = found.filter((found["_lang_pred"] != op9_language_mixture.UNDETERMINED) & (found["_score"] >= LEAST_SCORE))
    return kept.withColumn("lang", kept["_lang_pred"]).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of the least doc_id (a row without one only if none has), then of the least hash of its text.

    Groups are by text alone: rows that share a doc_id but not their texts' group each stand for their own. Null and blank texts are one
    group. Of rows equal in id and text the least in the other columns stays, nulls first.
    """
    return op4_simhash.representatives(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, nulls and repeated rows too; secrets in its text are masked, and n_chars follows a masked text."""
    return op2_secret_scan.redact(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by their calibrated probabilities stay. Rows of one doc_id are drawn together, rows without one by their text.

    Null sources and languages are "other"; documents without words have the overall rate. Topics are told by phrases here: clusters need
    Python workers, which after the stages before hold too much memory.
    """
    return op3_mixing.mixed(docs.select(*COLUMNS), topics=op3_mixing.PHRASES).filter("_drawn").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that is left; a null text has no tokens."""
    return op8_bpe.digests(docs.select(*COLUMNS))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]

ORACLE_SQL = None  # language models, hashes and merges are beyond SQL; the tests hold a plain version against it


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The digests of what the stages leave. A stage's table is removed once the next is written, the last one's when the driver's JVM ends.

    run_id: a run that broke off is taken up after its last finished stage, if it is called again with its name.
    """
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    base = f"{shared_folder(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    place = lambda i: f"{base}/{i}-{STAGES[i][0]}"
    last = len(STAGES) - 1
    begin = next((i + 1 for i in reversed(range(last)) if run_id and exists(spark, f"{place(i)}/_SUCCESS")), 0)
    if begin:
        docs = spark.read.parquet(place(begin - 1))
    for i in range(begin, last):
        if run_id:
            removed(spark, place(i))
        docs = written(STAGES[i][1](spark, docs, sf_dir), place(i), keep=bool(run_id))
        if i:
            removed(spark, place(i - 1))
    return STAGES[last][1](spark, docs, sf_dir)
