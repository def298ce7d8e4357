"""Source mixing where demand exceeds supply."""

import numpy as np

from inkwell.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def table(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "a b c d e f g h i j", s))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_rare_sources_are_repeated_as_often_as_demanded(spark):
    d = table(spark, {"hot": 2000, "rare": 1})
    out = mixing.curriculum(d).filter("source = 'rare'").collect()
    demand = 20010 * (10 / 20010 + 10**0.5 / (10**0.5 + 20000**0.5)) / 2
    assert len(out) == np.ceil(demand / 10) > 4 and [r["epoch"] for r in out] == list(range(len(out)))
    assert max(r["position"] for r in out) > 0.9


def test_bounded_demand_goes_to_the_others(spark):
    d = table(spark, {"a": 300, "b": 300, "c": 10})
    weights = {"a": [1, 1], "b": [1, 1], "c": [2, 2], "none": [1, 1]}
    out = mixing.curriculum(d, weights, max_epochs=4).collect()
    assert abs(len(out) - 610) <= 3  # the whole budget
    assert sum(r["source"] == "c" for r in out) == 40
    late = [r["source"] for r in out if r["position"] > 0.5]
    assert "c" not in late and abs(late.count("a") - late.count("b")) <= 2 and abs(len(late) - 305) <= 3
    short = {r["source"]: r for r in mixing.shortfall(d, weights, max_epochs=4).collect()}
    assert short["a"]["short"] == 0 and abs(short["c"]["short"] - (6100 * 0.4 - 400)) < 1e-6 and abs(short["none"]["short"] - 1220) < 1e-6
    assert abs(sum(r["placed"] for r in short.values()) - 6100) < 1e-6


def test_water_filling_meets_the_budget_exactly():
    r = np.random.default_rng(1)
    share = r.random((9, 4))
    supply = r.integers(1, 1000, 9).astype(float)
    segs, d = mixing.water_filled(supply, share / share.sum(0), (0.0, 0.2, 0.7, 1.0), supply.sum() * 2, 3)
    assert abs(d.sum() - supply.sum() * 2) < 1e-6 and (d <= supply * 3 + 1e-6).all() and (d == supply * 3).any()
    for s in segs:
        assert all(abs(x[1] - y[0]) < 1e-12 and x[5] == y[4] for x, y in zip(s, s[1:]))
