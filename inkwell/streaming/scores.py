"""Scoring as documents arrive: the analysis has no shuffle and no state, so a stream runs the same plan as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import rules as R
from ..operators.analysis import analyze


def scored_stream(spark: SparkSession, path: str, schema: str, rules: R.Rules | None = None) -> DataFrame:
    """Analysed documents of Parquet files that appear in a folder."""
    return analyze(spark.readStream.schema(schema).parquet(path), rules)


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends results to a Parquet folder; once for what there is now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
