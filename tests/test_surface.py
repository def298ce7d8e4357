"""What users call besides the analysis: readers, sinks, rules of their own, and the tools of evaluation."""

import io
import json
import random

from pyspark.sql import functions as F

from inkwell import rules as R
from inkwell.operators import analysis as A
from inkwell.plans import evaluation as E
from inkwell.sources import documents as S


def test_files_folders_and_streams(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_bytes(b"\xef\xbb\xbfb\r\nline\xff")
    (tmp_path / "a.txt").write_text("a\x00 b")
    (tmp_path / "c.html").write_text("no")
    (tmp_path / "sub" / "d.markdown").write_text("d")
    names = lambda df: [(r["uri"].rsplit("/", 1)[1], r["text"]) for r in df.orderBy("uri").collect()]
    assert names(S.read_files(spark, str(tmp_path))) == [("a.txt", "a b"), ("b.md", "b\nline\ufffd")]
    assert [n for n, _ in names(S.read_files(spark, [str(tmp_path), str(tmp_path / "c.html"), str(tmp_path / "a.txt")], recursive=True))] == ["a.txt", "b.md", "c.html", "d.markdown"]
    assert S.read_stream(spark, io.BytesIO(b"x\ry")).first()["text"] == "x\ny"
    (tmp_path / "labels.json").write_text(json.dumps({"labels": {"a.txt": {"label": "ai", "register": "email"}, "sub/d.markdown": {"label": "human", "register": "casual", "group": "g"}, "gone.md": {"label": "ai", "register": "email"}}}))
    got = S.read_corpus(spark, str(tmp_path / "labels.json"), str(tmp_path)).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("a.txt", "ai", "email", "ai", "a b"), ("sub/d.markdown", "human", "casual", "g", "d")]


def analyzed(spark):
    rows = [(1, "We delve here. We delve there and leverage it."), (2, "Plain words stand here."), (3, "")]
    return A.analyze(spark.createDataFrame(rows, "doc_id int, text string"))


def test_report_comparison_gate_and_logs(spark, tmp_path):
    d = analyzed(spark).persist()
    r = S.report(A.long_hits(d), most=1).filter("category = 'filler'").collect()
    assert [(x["doc_id"], x["n"], x["example"]) for x in r] == [(1, sum(h["category"] == "filler" for h in d.filter("doc_id = 1").first()["hits"]), 1)]
    worst = d.agg(F.max("score")).first()[0]
    assert worst > 0 and S.gate(d, worst) and not S.gate(d, worst - 0.1) and S.gate(d.limit(0), 0.0)
    c = {x["doc_id"]: x["delta"] for x in S.compared(d, d.withColumn("score", F.lit(0.0))).collect()}
    assert c == {1: -worst, 2: -d.filter("doc_id = 2").first()["score"], 3: 0.0}
    S.write_sarif(d, str(tmp_path / "sarif"), most=2)
    logs = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "sarif")).collect()]
    n = A.long_hits(d).count()
    assert sum(len(x["runs"][0]["results"]) for x in logs) == n and all(0 < len(x["runs"][0]["results"]) <= 2 for x in logs)
    assert all({r["ruleId"] for r in x["runs"][0]["results"]} == {r["id"] for r in x["runs"][0]["tool"]["driver"]["rules"]} for x in logs)
    S.write_json(d, str(tmp_path / "json"))
    assert {json.loads(x["value"])["input"] for x in spark.read.text(str(tmp_path / "json")).collect()} == {1, 2, 3}
    d.unpersist()


def test_only_some_categories(spark):
    rows = spark.createDataFrame([(1, "We delve here. The the end result.")], "doc_id int, text string")
    cats = lambda **k: {h["category"] for h in A.analyze(rows, **k).first()["hits"]}
    everything = cats()
    assert {"filler", "doubled_word"} <= everything and cats(enable=("filler",)) == {"filler"} and cats(disable=("filler",)) == everything - {"filler"}


def test_rules_of_a_project(spark, tmp_path):
    own = R.from_lists({"filler": {"zork": "x", "ZORK": "y"}, "jargon": "blub", "hedging": 7, "false_agency": ["(?i)the fox decides"], "dialect": {"american": {"foo": "bar"}}, "thresholds": {"ttr_floor": 0.1}, "protected_terms": ["blub town"], "directive_marker": "lint"})
    rows = [(1, "A zork and a blub, not blub town. We delve. The fox decides. A foo here.\nzork <!-- lint: ignore -->")]
    d = A.analyze(spark.createDataFrame(rows, "doc_id int, text string").withColumn("dialect", F.lit("american")), own)
    found = [(h["category"], h["text"]) for h in d.first()["hits"]]
    assert {x for x in found if x[0] in ("filler", "jargon", "hedging", "false_agency", "dialect")} == {("filler", "zork"), ("jargon", "blub"), ("false_agency", "The fox decides"), ("dialect", "foo")}
    assert sum(x == ("filler", "zork") for x in found) == 1 and own.thresholds["ttr_floor"] == 0.1
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / ".inkwellrc").write_text('{"thresholds": {"ttr_floor": 0.2}}')
    assert R.find_settings(str(deep / "x.md")) == {"thresholds": {"ttr_floor": 0.2}} == R.find_settings(str(deep))
    (deep / ".inkwellrc").write_text("[1]")
    assert R.find_settings(str(deep / "x.md")) is None


def test_costume_binary_and_corpus_check(spark):
    h = "array<struct<category:string>>"
    d = spark.createDataFrame([(9.0, [("over_correction",)]), (1.0, [("filler",)])], f"score double, hits {h}")
    assert tuple(E.costume(d, 5.0).first()) == (2, 0.5, 0.5)
    r = spark.createDataFrame([("ai", 1.0), ("human", 2.0), ("other", 3.0)], "label string, score double")
    assert sorted(map(tuple, E.binary(r).collect())) == [(False, 2.0), (True, 1.0)]
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    labels = spark.createDataFrame([("b", "ai", "email"), ("c", "who", "email"), ("d", "ai", "")], "file string, label string, register string")
    assert sorted(map(tuple, E.unmatched(files, labels, "file", ("ai",), ("email",)).collect())) == [("a", "no label"), ("c", "bad label"), ("c", "no file"), ("d", "no file"), ("d", "unknown register")]


def test_golden_table(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    E.write_golden(a, str(tmp_path / "g"))
    assert E.against_golden(a, str(tmp_path / "g"), "k", ("s",), ("v",)).count() == 0
    b = spark.createDataFrame([(1, "z", 1.00001), (3, "y", 2.0)], "k int, s string, v double")
    assert sorted((r["k"], r["field"]) for r in E.against_golden(b, str(tmp_path / "g"), "k", ("s",), ("v",)).collect()) == [(1, "s"), (2, "s"), (2, "v"), (3, "s"), (3, "v")]


def brute_best(rows):
    s = sorted({x for _, x in rows})
    th = {t for t in [*s, *(__import__("math").floor((a + b) / 2 * 1000 + 0.5) / 1000 for a, b in zip(s, s[1:])), s[0] - 0.1, s[-1] + 0.1] if t >= 0}
    def at(t):
        tp, fp = sum(l and x >= t for l, x in rows), sum(not l and x >= t for l, x in rows)
        P, N = sum(l for l, _ in rows), sum(not l for l, _ in rows)
        f1 = 2 * tp / (2 * tp + fp + P - tp) if tp else 0.0
        return f1, -(fp / N if N else 0.0), (tp + N - fp) / (P + N), -t
    return max(map(at, th))


def test_sweep_and_auc_by_group_and_ablation(spark):
    r = random.Random(4)
    rows = [(g, r.random() < 0.4, round(r.uniform(0, 9) if r.random() < 0.8 else r.uniform(0, 400), 1)) for g in "ab" for _ in range(80)]
    d = spark.createDataFrame(rows, "g string, label boolean, score double")
    best = {x["g"]: (x["f1"], -x["fpr"], x["accuracy"], -x["threshold"]) for x in E.best_threshold(d, ("g",)).collect()}
    auc = {x["g"]: x["auc"] for x in E.auc(d, ("g",)).collect()}
    for g in "ab":
        own = [(l, s) for k, l, s in rows if k == g]
        assert best[g] == brute_best(own)
        p, n = [s for l, s in own if l], [s for l, s in own if not l]
        assert abs(auc[g] - sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)) < 1e-12
    records = spark.createDataFrame([(1, True, 100), (2, True, 50), (3, False, 100), (4, False, 100)], "doc_id int, label boolean, words int")
    hits = spark.createDataFrame([(1, "x", 1.0), (2, "x", 1.0), (2, "y", 0.5), (3, "y", 0.5)], "doc_id int, category string, weight double")
    out = [tuple(x) for x in E.ablation(records, hits, spark.createDataFrame([("x",), ("y",), ("z",)], "category string")).collect()]
    assert [x[0] for x in out] == ["x", "y", "z"] and out[0][1:5] == (0.625, 0.375, 0.75, 0.25) and out[1][2] == 0.0 and abs(out[0][5] - 30 / 40) < 1e-9


def test_bootstrap_has_auc(spark):
    d = spark.createDataFrame([(True, 9.0)] * 20 + [(False, 1.0)] * 30, "label boolean, score double")
    got = {r["statistic"]: (r["lo"], r["hi"]) for r in E.bootstrap(d, 5.0, iterations=200).collect()}
    assert got == {"auc": (1.0, 1.0), "recall": (1.0, 1.0), "fpr": (0.0, 0.0), "f1": (1.0, 1.0)}
    mixed = spark.createDataFrame([(i % 3 == 0, float(i % 7)) for i in range(60)], "label boolean, score double")
    lo, hi = next((r["lo"], r["hi"]) for r in E.bootstrap(mixed, 3.0, iterations=300).collect() if r["statistic"] == "auc")
    assert lo < E.auc(mixed).first()["auc"] < hi
