"""A corpus pipeline of five stages over the documents table: each stage reads what the one before it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telescribe.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from telescribe.llm.common import PLAIN, delete, scratch_root, table
from telescribe.llm.queries import tokenizer_path

#: Near duplicates of the pipeline share four fifths of their shingles of five words.
COPIES = near_dedup.Params(shingle=5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, each row by its own text, null ids and repeated ids included; all others stay as they are."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, index)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a similar line comes before are cut; every document stays, with n_chars of what is left.

    Rows with a null id or text stay as they are, as do those of a repeated id that hold another text than its smallest.
    """
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays; rows with a null id all stay.

    All rows of a repeated id go or stay together, by its smallest text.
    """
    return near_dedup.one_of_each(docs, params=COPIES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go, each row by its own text."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_lines),
    ("near dedup", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL cannot state the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; what a stage has read is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{scratch_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.options(**PLAIN).parquet(path)
        if before is not None:
            delete(before, spark)
        docs, before = spark.read.parquet(path), path
    return docs
