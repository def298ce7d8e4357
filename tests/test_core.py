"""The engine's own operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from inkwell import rules as R
from inkwell.functions import text as T
from inkwell.operators import analysis as A
from inkwell.plans import evaluation as E


def column(spark, texts, make):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", make(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(got, key=lambda r: r["i"])]


def test_sentences(spark):
    got = column(spark, ["Pi is 3.14. Yes.", "See e.g. Smith. Done!", 'He said "yes." Then left.', "Wait... What? U.S. Army.", "", "one. two"], T.sentences)
    assert got == [["Pi is 3.14.", "Yes."], ["See e.g. Smith.", "Done!"], ['He said "yes.', "Then left."], ["Wait... What?", "U.S. Army."], [], ["one. two"]]


def test_code_and_front_matter(spark):
    got = column(spark, ["a\n```py\nx = 1\n```\nb `c` d", "~~~\nopen", "plain"], T.without_code)
    assert got == ["a\n\n\n\nb     d", "\n", "plain"]
    assert column(spark, ["---\na: 1\n---\nText", "---\nno end", "x\n---\n"], T.without_front_matter) == ["\n\n\nText", "---\nno end", "x\n---\n"]


def test_metric_prose(spark):
    text = "# Head\n\nFirst line\nsecond [link](u) **bold**.\n\n- item one\n- item two!\n\n| a | b |\n|---|---|\n> quoted\n\n---\nend"
    assert column(spark, [text], T.metric_prose) == ["First line second link bold.\nitem one.\nitem two!\nquoted\nend"]


def test_spans_count_code_points(spark):
    assert [tuple(x) for x in column(spark, ["\U0001f600 ab ab"], lambda c: T.spans(c, "ab"))[0]] == [(2, 4, "ab"), (5, 7, "ab")]
    assert column(spark, ["none"], lambda c: T.spans(c, "ab")) == [[]]


def test_hostile_texts_are_survived(spark):
    texts = [None, "", " ", "\x00\x01", "a" * 100_000, "-" * 5_000, "*" * 5_000, "\n" * 1000, "é" * 50, "﻿hi", "a\r\nb\rc", "```", "![](", "<!-- prose-check: ignore", "| | |\n" * 50, "日本語。テスト", "?!?!?!", "— — —"]
    out = A.analyze(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(8)).collect()
    assert len(out) == len(texts)
    by = {r["doc_id"]: r for r in out}
    assert by[0]["words"] == 0 and by[0]["score"] == 0.0 and by[0]["verdict"] == "clean"


def test_analysis_mutes_directives_and_protected_terms(spark):
    rows = [(0, "We delve here.", "technical"), (1, "We delve here. <!-- prose-check: ignore filler -->", "technical"), (2, "A test harness works.", "technical"), (3, "<!-- prose-check: ignore -->\nWe delve.\nWe delve.", "technical"), (4, "It may potentially work.", "academic"), (5, "It may potentially work.", "technical"), (6, "Colour and behaviour here.", "technical")]
    df = spark.createDataFrame(rows, "doc_id int, text string, register string").withColumn("dialect", F.lit("american"))
    by = {r["doc_id"]: [(h["category"], h["line"], h["col"]) for h in r["hits"]] for r in A.analyze(df).collect()}
    assert by[0] == [("filler", 1, 4)] and by[1] == [] and by[2] == [] and by[3] == [("filler", 3, 4)]
    assert by[4] == [] and [c for c, *_ in by[5]] == ["hedging"]
    assert by[6] == [("dialect", 1, 12)]  # a word at the very start of a text is let be


def test_autofix(spark):
    rows = [("We leverage it and DELVE — deep. 10–20 ok ✨ yes\n`leverage — x`",), ("word \U0001f680",), (None,)]
    got = [tuple(r) for r in A.autofix(spark.createDataFrame(rows, "text string")).select("fixed", "swaps", "emoji", "dashes").collect()]
    assert got == [("We use it and EXAMINE, deep. 10–20 ok yes\n`leverage — x`", 2, 1, 1), ("word", 0, 1, 0), (None, 0, 0, 0)]


def test_settings():
    r = R.load().overridden({"thresholds": {"ttr_floor": 0.5, "nope": 1, "ngram_sizes": 3}, "category_weights": {"filler": 3, "x": 1}, "score_bands": {"b": 9, "a": 1}, "protected_terms": ["delve"]})
    assert r.thresholds["ttr_floor"] == 0.5 and r.thresholds["ngram_sizes"] == (2, 3) and r.weights["filler"] == 3.0 and "x" not in r.weights
    assert r.bands == (("a", 1.0), ("b", 9.0)) and "delve" in r.protected
    assert len(R.load().phrases) == 483 and len(R.WEIGHTS) == 52
    assert len(R.warnings({"thresholds": {"nope": 1}, "protected_terms": 3})) == 2
    assert R.phrase_list({"a": {"suggestion": "b"}, "c": None}) == [("a", "b"), ("c", None)] and R.phrase_list(7) == []


def records(spark, rows):
    return spark.createDataFrame(rows, "label boolean, score double")


@pytest.mark.parametrize("rows,want", [([(True, 9.0), (False, 1.0)], 1.0), ([(True, 1.0), (False, 9.0)], 0.0), ([(True, 5.0), (False, 5.0)], 0.5), ([(True, 5.0)], None)])
def test_auc(spark, rows, want):
    assert E.auc(records(spark, rows)).first()["auc"] == want


def test_confusion_metrics_and_sweep(spark):
    r = records(spark, [(True, 9.0), (True, 1.0), (False, 5.0), (False, 2.0)])
    m = E.with_metrics(E.confusion(r, 5.0)).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 1) and m["f1"] == 0.5
    brute = {t["threshold"]: (sum(l and s >= t["threshold"] for l, s in [(x["label"], x["score"]) for x in r.collect()])) for t in E.candidate_thresholds(r).collect()}
    assert {x["threshold"]: x["tp"] for x in E.sweep(r).collect()} == brute
    best = E.best_threshold(records(spark, [(True, 9.0), (False, 1.0)])).first()
    assert best["f1"] == 1.0 and best["threshold"] == 5.0


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert A.analyze(docs).count() == 0 and E.auc(records(spark, [])).first()["auc"] is None


def test_entry_and_probes_fire(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    rows = q["pattern_hits"](spark, "/root/testdata/sf0.001").groupBy("category").count().collect()
    assert {r["category"] for r in rows} == set(R.PATTERNS)


def test_stream_equals_batch(spark, tmp_path):
    from inkwell.streaming.scores import scored_stream, start

    docs = spark.createDataFrame([(1, "We delve."), (2, "Plain words here.")], "doc_id int, text string")
    docs.write.parquet(str(tmp_path / "in"))
    start(scored_stream(spark, str(tmp_path / "in"), "doc_id int, text string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda d: sorted((r["doc_id"], r["score"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(A.analyze(docs))
