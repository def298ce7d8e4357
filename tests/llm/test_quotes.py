"""Quotation linking against a version that compares every pair of messages."""

import random

from inkwell.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(text):
    return " ".join(text.lower().split())


def parts(rows):
    """(kind, normalised text) of a passage."""
    text = "\n".join(rows)
    paragraphs, block = [], []
    for row in [*rows, ""]:
        if row.strip(" \t"):
            block.append(row)
        elif block:
            paragraphs.append("\n".join(block))
            block = []
    out = {}
    for kind, some in ((1, rows), (2, paragraphs), (3, [text])):
        out |= {plain(x): kind for x in some if plain(x)}
    return out


def brute(rows):
    """{conv_id: (n_links, [(turn, role, text, reply_to, depth, quoted)])}"""
    out = {}
    said = sorted({(c, t, r if r is not None else "unknown", x or "") for c, t, r, x in rows if c is not None and t is not None})
    for conv in {c for c, *_ in said}:
        own, quoted, parent, m = [], [], [], [x[1:] for x in said if x[0] == conv]
        for n, (_, _, text) in enumerate(m):
            found = quotes.passages(text)
            own.append(parts([line for depth, lines in found if depth == 0 for line in lines]))
            links, first = 0, None
            for k, (depth, lines) in enumerate((x for x in found if x[0]), 1):
                best = max(((kind, own[o][u], o, -k) for u, kind in parts(lines).items() for o in range(n) if u in own[o]), default=None)
                if best:
                    links += 1
                    if depth == 1:
                        first = max(first or (0,), (best[0], -k, best[2]))
            quoted.append(links)
            parent.append(first[2] if first else n - 1)
        depth, order = {-1: -1}, []

        def walk(p):
            for n in range(len(m)):
                if parent[n] == p:
                    depth[n] = depth[p] + 1
                    order.append(n)
                    walk(n)

        walk(-1)
        out[conv] = (sum(quoted), [(m[n][0], m[n][1], quotes.without_quotes(m[n][2]), m[parent[n]][0] if parent[n] >= 0 else None, depth[n], quoted[n]) for n in order])
    return out


def got(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return {r["conv_id"]: (r["n_links"], [tuple(x) for x in r["messages"]]) for r in quotes.linked_conversations(d).collect()}


def test_random_conversations(spark):
    r = random.Random(6)
    lines = ["Yes.", "the same line", "", "Another  one here", "and more text", "why?", "On Monday, A wrote:", "ok"]
    rows = []
    for conv in range(40):
        said = []
        for turn in range(r.randint(1, 9)):
            text = []
            for _ in range(r.randint(0, 4)):
                if said and r.random() < 0.6:
                    q = r.choice(said).split("\n")
                    a = r.randrange(len(q))
                    text += ["> " * r.randint(1, 2) + x for x in q[a : a + r.randint(1, 4)]]
                else:
                    text += r.choices(lines, k=r.randint(1, 3))
            said.append("\n".join(text))
            rows += [(conv, turn // 2 if conv % 5 == 0 else turn, r.choice(["user", "assistant", None]), said[-1] or None)] * r.choice((1, 1, 2))
    r.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_one_line_in_every_message_and_a_long_text(spark):
    rows = [(1, t, "user", ("> same\n" if t else "") + "same\nmessage %d" % t) for t in range(300)]
    rows += [(2, 0, "user", "word " * 200_000 + "\nend"), (2, 1, "assistant", "> end\nyes"), (2, 1, "user", "> end\nyes")]
    assert got(spark, rows) == brute(rows)
