"""A corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing sources to target weights -> token ids.
All stages but the last return the columns of documents; the last returns doc_id, n_tokens, control, data,
position (0, 1, 2 and so on in training order) and, in one row, token_by_rank, with which all rows are decoded.

Defined cases: an empty table stays empty in every stage. Rows with a null doc_id are classified, never joined and never taken
for leaks. A null or empty text has no words: it is classified by its other features, is like no other text, leaks nothing,
takes the training position at which it stands and has no tokens. Repeated rows of a similar group become one; repeated rows
without words all stay. A doc_id on unlike texts is decided by text. Ties in the training order go by doc_id. Long texts are
whole in every stage. Other columns are carried to the last stage, whatever their names; what the stages add takes the place
of any of the same name there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, mixing, ngram_join, quality, token_output
from inkwell.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; a source is cut off or repeated as its target weights demand."""
    return mixing.curriculum(docs).select(*docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the rows' number in the order in which they were written. docs is a table read from Parquet
    files, whose names begin with the number of the task, a range of the sorted rows."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long")
    piece = F.regexp_extract("_file", r"-c(\d+)", 1).try_cast("long")
    # one row for each file
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    files = files.select("_file", (F.sum("_n").over(Window.orderBy(part, piece, "_file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(files), "_file").select("doc_id", "text", (F.col("_before") + F.col("_row")).alias("position"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document in binary, with its position in training order."""
    return token_output.encode(numbered(docs), keep=("position",))[0]


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_ids),
]

#: Several stages can't be expressed in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split("/")[0].strip().replace(" ", "-"))
    return docs
