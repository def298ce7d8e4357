"""What grows with a text, its hits or the tables has to grow no faster than they do; results as before."""

import time

from inkwell import rules as R
from inkwell.functions import text as T
from inkwell.operators import hits
from pyspark.sql import functions as F


def test_one_search_for_all_phrases(spark):
    """Held against each phrase searched by itself; protected spans aren't made anew for every hit."""
    r = R.load()
    texts = ["We Delve\n into it. delve into the realm; undelve. Double-click here, win-win-win.", "the best-in-class TEST  HARNESS, harness it", "", "Kudos to you; ſtudies", "naïve delveé delve_ delve"] + [f"It {p.phrase.upper()} {p.phrase}x x{p.phrase} {p.phrase}." for p in r.phrases]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["h"] for x in d.select("i", hits.phrase_hits(F.col("t"), r, hits.protected(F.col("t"), r.protected)).alias("h")).collect()}
    rows = d.collect()
    keep = {x["i"]: x["k"] for x in d.select("i", F.flatten(F.array(*[T.spans(F.col("t"), R.phrase_regex(p)) for p in r.protected])).alias("k")).collect()}
    some = [p for p in r.phrases if p.category not in R.CITED | R.UNQUOTED]
    by = d.select("i", *[T.spans(F.col("t"), R.phrase_regex(p.phrase)).alias(f"p{n}") for n, p in enumerate(some[::6])]).collect()
    for x in by:
        want = sorted((p.category, s["start"], s["end"]) for n, p in enumerate(some[::6]) for s in x[f"p{n}"] if not any(s["start"] < k["end"] and k["start"] < s["end"] for k in keep[x["i"]]))
        names = {(p.category, " ".join(p.phrase.lower().split())) for p in some[::6]}
        low = rows[x["i"]]["t"]
        assert want == sorted((h["category"], h["start"], h["end"]) for h in got[x["i"]] if (h["category"], " ".join(low[h["start"] : h["end"]].lower().split())) in names), low


def test_hits_of_a_long_text(spark):
    text = "We delve into the old realm of it, plain and long.\n" * 1500
    d = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    h = d.select(F.transform(hits.phrase_hits(F.col("t"), R.load(), hits.protected(F.col("t"), R.load().protected)), lambda x: x["line"]).alias("h")).first()["h"]
    assert set(h) == set(range(1, 1501)) and time.time() - began < 60


def test_gaps_and_fixing(spark):
    texts = ["a1b22c", "1", "", "\u00041a\u0004", "no", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in d.select("t", T.gaps(F.col("t"), "[0-9]+").alias("g"), T.split(F.col("t"), "[0-9]+").alias("s")).collect():
        assert x["g"] == x["s"], x
    from inkwell.operators import analysis as A
    many = spark.range(4000).select(F.concat(F.lit("We UTILIZE it, Delve and leverage — deep `leverage` "), F.repeat(F.lit("plain words stand here. "), 40), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = {tuple(r) for r in A.autofix(many).select(F.substring("fixed", 1, 50), "swaps", "emoji", "dashes").collect()}
    assert len(got) == 1 and next(iter(got))[1:] == (3, 0, 1) and "EXAMINE" not in next(iter(got))[0] and "`leverage`" in next(iter(got))[0]
    assert time.time() - began < 40


def test_rounded_and_deviation_as_in_sql(spark):
    import duckdb

    c = duckdb.connect()
    rows = [(n, d) for d in range(640, 12000, 640) for n in range(1, 60)]
    want = c.execute("SELECT a, b, round(a / b * 1000, 6) FROM (SELECT unnest(?) AS a, unnest(?) AS b)", [[a for a, _ in rows], [b for _, b in rows]]).fetchall()
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", T.rounded(F.col("a") / F.col("b") * 1000, 6)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [tuple(r) for r in spark.sql("SELECT -0.25D x").select(T.rounded(F.col("x"), 1)).collect()] == [(-0.3,)]
    import random

    r = random.Random(7)
    lists = [[r.randrange(1, 60) for _ in range(r.randrange(2, 40))] for _ in range(400)]
    want = [c.execute("SELECT list_stddev_pop(?::BIGINT[]) / list_avg(?::BIGINT[])", [x, x]).fetchone()[0] for x in lists]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, a array<int>").select("i", T.cov(F.col("a")).alias("c")).collect()
    assert [x["c"] for x in sorted(got, key=lambda x: x["i"])] == want


def test_labelled_scores_are_kept(spark):
    """The sweep reads them five times; the texts are read once."""
    from inkwell.plans import registry

    d = registry.labelled(spark, "/root/testdata/sf0.001")
    assert d.storageLevel.useMemory
    d.unpersist()


def test_doubled_words_and_dashes_as_before(spark):
    from inkwell.operators import checks

    texts = ["the the cat", "THE the ſo so xthe the", "the\tthe the the", "a a b-- c — d–e 1–2 1 – 2 x--y -- z", "Kilo kilo é é it, it", "ıs is İs is", "one, two or three; alpha, beta and gamma", "big dogs, red cats, and old-", "big dogs, red cats, and old men", "alpha, beta, or gamma"]
    old = rf"(?iu){R.EDGE}([A-Za-z]{{2,}}){R.EDGE}[\t ]+\1{R.EDGE}"
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in d.select("t", T.spans(F.col("t"), old).alias("a"), T.spans(F.col("t"), checks.DOUBLED).alias("b")).collect():
        assert x["a"] == x["b"], x
    v = {"m": F.col("t"), "w": T.tokens(F.col("t"))}
    got = {x["i"]: x["x"] for x in d.select("i", F.size(checks.em_dash(v, R.THRESHOLDS)["hits"]).alias("x")).collect()}
    want = {x["i"]: len(x["x"]) for x in d.select("i", T.spans(F.col("t"), checks.DASHES).alias("x")).collect()}
    assert got[3] == want[3] == 4
    three = {x["i"]: x["x"] for x in d.select("i", F.transform(checks.rule_of_three(v, R.THRESHOLDS)["hits"], lambda h: h["text"]).alias("x")).collect()}
    assert three[6] == ["alpha, beta and gamma"] and three[9] == ["alpha, beta, or gamma"]
