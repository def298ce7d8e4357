"""Decontamination: runs of an item at whatever offset, against brute force over all windows."""

import random

import pyarrow as pa

from inkwell.llm import decontaminate as D

r = random.Random(8)
text = lambda n: "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(n)).replace("  ", "xy").strip() + "z"


def least(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return min(prev)


def test_runs_at_any_offset_equal_brute_force():
    item = text(226)
    n = len(item)
    runs = [item[57:170], item[20:112], item[130:222], item[60:130], item[60:100] + "#" + item[101:165], item[60:100] + item[104:165], item[3:80] + item[88:170]]
    docs = [text(80) + " " + x + " " + text(60) for x in runs] + [text(300), "", item[57:170]]
    ix = D.build_index([(5, item)], D.Q, D.RATE, D.SEGMENT, D.MIN_CHARS)
    got = {x[0]: x[1:] for x in D.find(pa.array(docs), ix)}
    for k, d in enumerate(docs):
        c, off = D.normalised(pa.array([d]))
        plain = "".join(map(chr, c))
        cost = [least(item[s : s + 96], plain) for s in range(n - 95)]
        found = [x for x in cost if x <= 5]
        assert got.get(k) == ((5, len(found), min(found)) if found else None), k
    assert 0 in got and 1 in got and 3 not in got
