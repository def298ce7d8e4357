"""Each stage of the corpus pipeline against brute force on its own input; and run() against the stages."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import docs, grams, words
from test_mixing_by_force import brute

import corpus_pipeline as P
from inkwell.llm import decontaminate, quality, token_output
from inkwell.llm.shared import written

SF = "/root/testdata/sf0.001"


def groups(rows):
    """Indices of rows (doc_id, text) by connected groups of similar sets; rows without sets or doc_id alone."""
    sets = [frozenset(grams(t)) if t and i is not None else frozenset() for i, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b]) - 1e-9:
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))], sets


def test_stages_and_run(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [d]
    for name, stage in P.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), "test-stage"))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    assert all(t.columns == d.columns for t in tables[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in tables[:-1]]

    scores = {(r["doc_id"]): r["keep"] for r in quality.scores(d, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert Counter(rows[1]) == Counter(x for x in rows[0] if scores[x[0]]) and 0 < len(rows[1]) < len(rows[0])

    root, sets = groups(rows[1])
    least = {}
    for k, (i, _) in enumerate(rows[1]):
        if sets[k] and i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    assert Counter(rows[2]) == Counter({x for k, x in enumerate(rows[1]) if not sets[k] or least[root[k]] == x[0]}) and len(rows[2]) < len(rows[1])

    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {x for x in rows[2] if any(f" {i} " in f" {plain(x[1])} " for i in items)}
    leaks = {r["doc_id"] for r in decontaminate.leaks(tables[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {i for i, _ in whole} <= leaks and Counter(rows[3]) == Counter(x for x in rows[2] if x[0] not in leaks)
    # what goes without holding a whole item holds a run of one: six characters in ten of some window, in order
    near = [x for x in rows[2] if x[0] in leaks and x not in whole]
    assert all(any(set(plain(x[1])[k : k + 10] for k in range(len(plain(x[1])) - 9)) & set(i[k : k + 10] for k in range(len(i) - 9)) for i in items) for x in near)

    keyed = [(r["doc_id"], r["source"], len((r["text"] or "").split()), r["h"], r["text"]) for r in tables[3].withColumn("h", F.xxhash64("doc_id", "text")).collect()]
    supply = Counter()
    for _, s, n, *_ in keyed:
        supply[s] += n
    total, roots = sum(supply.values()), sum(n**0.5 for n in supply.values())
    want = brute(keyed, (0.0, 1.0), {s: (n / total, n**0.5 / roots) for s, n in supply.items() if n}, total)
    assert Counter(i for i, _ in rows[4]) == Counter(i for _, i, _ in want)

    out = sorted(tables[5].collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(want))) and [r["doc_id"] for r in out] == [i for _, i, _ in want]
    text = dict(rows[0])
    enc = token_output.tokenizer(token_output.VOCABULARY)[0]
    tokens = token_output.token_table(tables[5])
    ids = [enc.encode_ordinary(text[r["doc_id"]]) for r in out]
    assert all(token_output.decode(r["control"], r["data"], r["n_tokens"], tokens) == text[r["doc_id"]] and r["n_tokens"] == len(x) for r, x in zip(out, ids))
    counts = Counter(t for x in ids for t in x)
    assert [counts[t] for t in tokens.tolist()] == sorted(counts.values(), reverse=True)

    ran = P.run(spark, SF).collect()
    assert sorted(map(str, ran)) == sorted(map(str, out))


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stage_with_edges(spark, stage):
    """Nulls, empty and long texts, ties, repeated rows, other columns; and an empty table."""
    rows = [(1, words(60, 1)), (1, words(60, 1)), (2, words(60, 1)), (2, words(40, 2)), (None, words(60, 3)), (3, None), (4, ""), (5, "z " * 30_000), (6, words(50, 4))]
    d = docs(spark, rows).withColumn("position", F.lit("p")).withColumn("cls", F.lit(None).cast("string")).withColumn("kept", F.array(F.lit(1)))
    table = written(d, "test-edges")
    out = written(stage(spark, table, SF), "test-edges").collect()
    assert out and (stage is P.token_ids or set(out[0].asDict()) == set(table.columns))
    assert written(stage(spark, written(table.limit(0), "test-edges"), SF), "test-edges").count() == 0
