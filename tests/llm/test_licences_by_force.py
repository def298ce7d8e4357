"""The licence scan against plain search and a recursive parser."""

import random
import re

from inkwell.llm import licenses as L

IDS = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "ISC", "LicenseRef-Own", "Foo-1.0", "Apache-2.0+"]


def value(tokens):
    """Permissive or not by recursive descent; None if malformed."""
    at = 0

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else None

    def look():
        return tokens[at] if at < len(tokens) else None

    def simple():
        t = take()
        if t == "(":
            x = either()
            if take() != ")":
                raise ValueError
            return x, False
        if t is None or t in ("AND", "OR", "WITH", ")"):
            raise ValueError
        return L.KNOWN.get(t.removesuffix("+"), False), True

    def excepted():
        x, plain = simple()
        while look() == "WITH":
            take()
            if not plain or not simple()[1]:
                raise ValueError
            plain = False
        return x

    def both():
        x = excepted()
        while look() == "AND":
            take()
            x = excepted() and x
        return x

    def either():
        x = both()
        while look() == "OR":
            take()
            x = both() or x
        return x

    try:
        x = either()
    except ValueError:
        return None
    return x if at == len(tokens) else None


def test_expressions_equal_recursive_descent():
    r = random.Random(2)
    good = 0
    for _ in range(20_000):
        tokens = [r.choice([*IDS, "AND", "OR", "WITH", "(", ")"]) if r.random() < 0.3 else r.choice(IDS) if k % 2 == 0 else r.choice(["AND", "OR"]) for k in range(r.randint(1, 9))]
        rpn = L.postfix(tokens)
        got = L.permissive(rpn) if rpn else None
        assert got == value(tokens), tokens
        good += got is not None
    assert good > 3000


def plain(text):
    """Licences of the notices: from the left, the longest phrase between word borders."""
    out, at, low = set(), 0, re.sub(r"\s+", " ", text.lower())
    while at < len(low):
        found = [p for p in L.NOTICES if low.startswith(p, at) and not (at and re.match(r"\w", low[at - 1])) and not re.match(r"\w", low[at + len(p) : at + len(p) + 1])]
        best = max(found, key=len, default=None)
        if best:
            out.add(L.NOTICES[best])
        at += len(best) if best else 1
    return sorted(out)


def test_notices_equal_plain_search():
    r = random.Random(3)
    phrases = sorted(L.NOTICES)
    for _ in range(300):
        text = "".join(r.choice([" ", ". ", "x", "\n", ", ", ""]) + (r.choice(phrases).title() if r.random() < 0.7 else r.choice(["version 2", "or later", "the", "license"])) for _ in range(r.randint(1, 6)))
        got = L.scan(text)
        assert (got[2] if got else []) == plain(text), text


def test_words_behind_an_expression():
    for text, rpn, ok in [
        ("SPDX-License-Identifier: MIT and see the docs", "MIT", True),
        ("SPDX-License-Identifier: Apache-2.0+", "Apache-2.0+", True),
        ("SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1-or-later", False),
        ("SPDX-License-Identifier: mit or (gpl-2.0 and isc)", "MIT GPL-2.0-only ISC AND OR", True),
        ("SPDX-License-Identifier: MIT AND", "invalid", False),
        ("SPDX-License-Identifier:", "invalid", False),
    ]:
        assert L.scan(text)[0] == [rpn] and L.scan(text)[3] == ok
    bsd = "Copyright X. All rights reserved.\nRedistribution and use in source and binary forms"
    assert L.scan(bsd)[3] and not L.scan("All rights reserved.")[3] and not L.scan("All rights reserved. GNU General Public License v2")[3]
    assert L.scan("GNU Lesser General Public License version 2.1")[2] == ["LGPL-2.1-only"]


def test_query_with_other_columns(spark):
    rows = [(1, "SPDX-License-Identifier: MIT", "a", "b"), (1, "SPDX-License-Identifier: ISC", "a", "b"), (None, "all rights reserved", None, None), (2, "", "c", "d")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, notices string, permissive string")
    assert sorted(map(str, L.licenses(d).collect())) == sorted(["Row(doc_id=1, expressions=['MIT'], expression_permissive=[True], notices=[], permissive=True)", "Row(doc_id=1, expressions=['ISC'], expression_permissive=[True], notices=[], permissive=True)", "Row(doc_id=None, expressions=[], expression_permissive=[], notices=['LicenseRef-Proprietary'], permissive=False)"])
