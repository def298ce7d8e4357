"""The curriculum against demand integrated and inverted number by number."""

import random

from pyspark.sql import functions as F

from inkwell.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, position string"


def demand(t, budget, knots, share):
    """Tokens demanded up to time t of a share that is linear between knots."""
    total = 0.0
    for k in range(len(knots) - 1):
        a, b = knots[k], min(knots[k + 1], t)
        if b > a:
            at = lambda x: share[k] + (share[k + 1] - share[k]) * (x - knots[k]) / (knots[k + 1] - knots[k])  # noqa: B023,E731
            total += budget * (at(a) + at(b)) / 2 * (b - a)
    return total


def inverse(c, *args):
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if demand(mid, *args) < c else (lo, mid)
    return hi


def brute(rows, knots, shares, budget, buckets=1):
    """[(position, doc_id, epoch)] of rows (doc_id, source, tokens, hash, text), in order of hash buckets and hashes."""
    out = []
    for s, share in shares.items():
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] % buckets, r[3], r[0] is not None, r[0], r[4] or ""))
        supply = sum(r[2] for r in own)
        want = demand(1.0, budget, knots, share)
        c = 0
        for r in own:
            e = 0
            while supply and c + e * supply < want:
                out.append((inverse(c + e * supply, budget, knots, share), r[0], e))
                e += 1
            c += r[2]
    return sorted(out, key=lambda x: (x[0], x[1] is not None, x[1], x[2]))


def hashed(d):
    return [(r["doc_id"], r["source"] if r["source"] is not None else None, len((r["text"] or "").split()), r["h"], r["text"]) for r in d.withColumn("h", F.xxhash64("doc_id", "text")).collect()]


def table(spark):
    r = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(r.choice((0, 1, 3, 40)))) or None, r.choice(["hot"] * 6 + ["a", "b", None]), "old") for i in range(150)]
    return spark.createDataFrame(rows + [(None, "x y", "a", ""), (7, "x y z", "empty", ""), (7, "x y z", "empty", ""), (8, "", "void", "")], SCHEMA).repartition(3)


def same(got, want):
    assert len(got) == len(want)
    assert all(abs(g["position"] - w[0]) < 1e-7 for g, w in zip(got, want))
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((g["doc_id"], g["epoch"]) for g in got), key=key) == sorted(((w[1], w[2]) for w in want), key=key)


def test_default_schedule(spark):
    d = table(spark)
    rows = hashed(d)
    supply = {}
    for _, s, n, *_ in rows:
        supply[s] = supply.get(s, 0) + n
    budget, roots = sum(supply.values()), sum(n**0.5 for n in supply.values())
    shares = {s: (n / budget, n**0.5 / roots) for s, n in supply.items() if n}
    got = mixing.curriculum(d).collect()
    same(got, brute(rows, (0.0, 1.0), shares, budget))
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)


def test_given_schedule_with_knots_and_a_hot_source_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 10**9)
    d = table(spark)
    rows = hashed(d)
    knots = (0.0, 0.3, 1.0)
    got = mixing.curriculum(d, schedule={"hot": [3, 1, 0], "a": [1, 1, 1]}, knots=knots, budget=5000).collect()
    same(got, brute(rows, knots, {"hot": (0.75, 0.5, 0.0), "a": (0.25, 0.5, 1.0)}, 5000))
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 7)
    many = mixing.curriculum(d, schedule={"hot": [3, 1, 0], "a": [1, 1, 1]}, knots=knots, budget=5000).collect()
    same(many, brute(rows, knots, {"hot": (0.75, 0.5, 0.0), "a": (0.25, 0.5, 1.0)}, 5000, len(rows) // 7))
