"""Corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents, further ones included; n_chars follows the text. A null id is in no group and leaks nothing found, so the
row stays in stages 2 and 3. Rows that repeat an id go or stay together. The last stage replaces a column named ids.

1. quality rules: documents that are rejected go; of the others, the lines that failed go.
2. n-gram Jaccard join: of each group of linked documents the one with the smallest id stays.
3. benchmark decontamination: documents that leak an item go.
4. secret scan: every stretch that a rule finds is replaced by a mark; all documents stay.
5. SentencePiece encoding: adds the piece ids of each text; all documents stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichaflow.llm import decontaminate, jaccard_join, pieces, quality_rules, secret_scan
from fichaflow.llm.queries import PIECES_FILE, prepared, table
from fichaflow.llm.storage import stored, tracked

#: No SQL can express the last stage.
ORACLE_SQL = None


def quoted(name: str):
    return F.col(f"`{name}`")


def stage(fn: Callable) -> Callable:
    """A stage; the tables that the stage before it stored on its way are deleted, as its result is written by now."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with tracked(prepared(spark)):
            return fn(spark, docs, sf_dir)

    return run_stage


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose ids are not listed; null ids stay.

    The ids are stored first, so their size is known when the join is planned: a short list goes to the texts.
    """
    ids = stored(ids.distinct(), "ids")
    return docs.join(ids, "doc_id", "left_anti").select(*map(quoted, docs.columns))


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # further columns travel as one, so that none has the name of a verdict
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    judged = quality_rules.clean_lines(docs.select(F.struct(*map(quoted, rest)).alias("rest"), "text")).filter("kept")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return judged.select(*(new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = jaccard_join.link_sets(docs).filter("component_id < id").select(F.col("id").alias("doc_id"))
    return without(docs, copies)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc").alias("doc_id")))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, PIECES_FILE)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
