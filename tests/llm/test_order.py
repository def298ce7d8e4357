"""The pipeline's result carries the training order."""

import corpus_pipeline as P
from inkwell.llm import mixing
from inkwell.llm.shared import written


def test_positions_follow_the_curriculum(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(300).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # one file for each of the sort's ranges
    try:
        want = [r["doc_id"] for r in mixing.curriculum(d).collect()]
        table = written(P.source_mixing(spark, d, sf), "order")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(table.inputFiles()) > 1 and table.columns == d.columns
    out = written(P.token_ids(spark, table, sf), "ids").orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(len(want))) and [r["doc_id"] for r in out] == want
