"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

STAGES are (name, function); each takes (spark, docs, sf_dir).  run() writes what each
stage returns as Parquet in the shared checkpoint folder and gives the next one the rows
read again.  All but the last return the columns of documents.

Line dedup drops documents it leaves without words that had some: every passage of them
stands elsewhere.  SQL cannot express the mixture's seeded order and the packing, so there
is no ORACLE_SQL; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import ID_ROWS, cut, shared_dir, small, table
from auditlake.llm.op1_quality import quality_filter
from auditlake.llm.op2_neardup import near_duplicates
from auditlake.llm.op5_lines import line_filter
from auditlake.llm.op9_mixing import mixed_documents
from auditlake.llm.op10_packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_filter(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays.  Only ids are joined to the texts; rows of a kept doc_id all stay."""
    gone = small(cut(near_duplicates(docs).where("not kept").select("doc_id").distinct()), ID_ROWS)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
