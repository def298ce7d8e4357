"""The site style tree against a recursion over all pages of a host at once, with paths in place of hashes."""

import math
import random

from inkwell.llm import style_tree as S


def analysed(found, gone):
    """(value, noisy) of an element that stands at found, [(page, node)]; gone: gets the nodes of the topmost noisy elements below."""
    m = len({p for p, _ in found})
    shapes, features = {}, {}
    for p, node in found:
        if not node.kids:
            if node.text:
                f = features.setdefault(node.text, {})
                f[p] = f.get(p, 0) + 1
            continue
        shape = []
        for kid in node.kids:
            if not shape or kid.sig != shape[-1]:
                shape.append(kid.sig)
        shapes.setdefault(tuple(shape), []).append((p, node))
    leaf = None
    if features:
        h = sum(math.log(sum(f.values())) - sum(n * math.log(n) for n in f.values()) / sum(f.values()) for f in features.values())
        leaf = 1 - h / math.log(m) / len(features) if m >= S.MIN_PAGES else 1.0
    if not shapes:
        value = leaf if leaf is not None else 0.0 if m >= S.MIN_PAGES else 1.0
        return value, value < S.LEAST
    pages = {s: len({p for p, _ in x}) for s, x in shapes.items()}
    total, inner, below_noisy, below = sum(pages.values()), 0.0, True, []
    for s, x in shapes.items():
        places = {}
        for p, node in x:
            at, last = 0, None
            for kid in node.kids:
                at += kid.sig != last
                last = kid.sig
                places.setdefault((at, kid.sig), []).append((p, kid))
        values = []
        for kids in places.values():
            deeper = []
            value, noisy = analysed(kids, deeper)
            values.append(value)
            below_noisy &= noisy
            below += [k for _, k in kids] if noisy else deeper
        inner += pages[s] / total * sum(values) / len(values)
    node = 1.0 if m < S.MIN_PAGES else min(1.0, -sum(n / total * math.log(n / total) for n in pages.values()) / math.log(m))
    if leaf is not None:
        inner = (inner + leaf) / 2
    decay = S.GAMMA ** len(shapes)
    value = (1 - decay) * node + decay * inner
    gone += below
    return value, value < S.LEAST and below_noisy and (leaf or 0) < S.LEAST


def said(node, gone):
    if node.tag == "#text":
        return node.text + " "
    if id(node) in gone or node.tag[0] == "#" and node.tag != "#page":
        return ""
    edge = "\n" if node.tag in S._BLOCK else ""
    return edge + "".join(said(k, gone) for k in node.kids if id(k) not in gone) + edge


def lines(text):
    return "\n".join(s for s in (" ".join(x.split()) for x in text.split("\n")) if s)


def page(r, host):
    word = lambda: r.choice("red green blue long short old new fast slow big".split())
    text = lambda n: " ".join(word() + str(r.randrange(50)) for _ in range(n))
    nav = "".join(f"<li><a href='/{i}'>Link {i}</a>" for i in range(4 + host))
    body = "".join(r.choice([f"<p>{text(6)}", f"<div class='ad {r.choice('ab')}'>Buy now</div>", f"<img src='{r.randrange(3)}.png'>", f"<h2 class=h>{text(2)}</h2>", "<br>", f"<p>{text(3)}<b>{word()}</b>"]) for _ in range(r.randint(1, 6)))
    foot = r.choice(["<footer>All the same</footer>", "<footer>All the same</footer>", f"<footer>Page {r.randrange(9)}</footer>"])
    return f"<html><body><ul class='nav'>{nav}</ul><div id=x>{body}</div>{foot}" if r.random() < 0.9 else r.choice(["", "<p>alone", f"<ul class='nav'>{nav}</ul>", "no markup"])


def test_extraction_equals_recursion(spark):
    r = random.Random(13)
    rows = [(k, f"http://h{k % 3}.example/{k}", page(r, k % 3)) for k in range(75)] + [(900 + k, f"https://two.example/{k}", page(r, 1)) for k in range(2)]
    rows += [(75 + k, rows[k][1], rows[k][2]) for k in range(5)]
    got = {x["page_id"]: (x["text"], x["n_removed"]) for x in S.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    removed = 0
    for host in sorted({u.split("/")[2] for _, u, _ in rows}):
        trees = {i: S.parse(h) for i, u, h in rows if u.split("/")[2] == host}
        gone = []
        noisy = analysed(list(trees.items()), gone)[1]
        nodes = {id(t) for t in trees.values()} if noisy else {id(n) for n in gone}
        for i, tree in trees.items():
            def count(n):
                return 1 if id(n) in nodes else sum(map(count, n.kids))

            text = lines("" if id(tree) in nodes else said(tree, nodes))
            want = (text, count(tree)) if text else (lines(said(tree, ())), 0)
            assert got[i] == want, (host, i)
            removed += want[1]
    assert len(got) == len(rows) and removed > 50
