"""The corpus pipeline: five stages from raw documents to packed bins.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

1. Quality rules: documents that the rules reject go.
2. Line dedup: repeated lines leave the texts (``n_chars`` follows).
3. SimHash near-dedup: five-word shingles, similarity 0.8; one document of each group stays, whether ids
   are null or repeated.
4. Mixing: each document as often as the mix takes it.
5. Best-fit packing: a row per piece with its bin and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.durable import Scratch
from weftgraph.llm.line_dedup import dedup_lines
from weftgraph.llm.packing import pack
from weftgraph.llm.quality_rules import keep_good
from weftgraph.llm.simhash_dedup import keep_one
from weftgraph.llm.source_mixing import mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    slim = dedup_lines(docs)
    count = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return (slim if count is None else slim.withColumn("n_chars", count)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, unique_ids=False)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the near-duplicate stage (XXH64 fingerprints) nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder.

    A stage's input goes as soon as its output is whole: beside the input at most two tables lie there at a time.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        written = Scratch(spark)
        docs = written.store(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = written
    return docs
