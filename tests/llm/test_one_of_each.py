"""One row of each group, where rows repeat or doc_ids clash."""

import random

from inkwell.llm import ngram_join

r = random.Random(11)
text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))


def test_repeated_rows_and_clashing_ids(spark):
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, a, "x"), (1, a, "w"), (2, a + " end", "x"), (2, b, "x"), (3, c, "x"), (3, c, "x"), (None, a, "x"), (None, a, "x"), (4, "", "x"), (4, "", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(map(tuple, ngram_join.one_of_each(d).collect()), key=str)
    assert got == sorted([(1, a, "w"), (2, b, "x"), (3, c, "x"), (None, a, "x"), (None, a, "x"), (4, "", "x"), (4, "", "x")], key=str)
