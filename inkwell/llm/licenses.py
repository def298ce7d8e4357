"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates the
and/or/with expressions that follow the tags.

A document's findings: the expression of each tag, in reverse Polish form and as permissive or not, and the licences that its
notice phrases name (the longest phrase at a place; "all rights reserved" counts against a text that names no licence only). An
expression is permissive if the grammar says so: A OR B if one is, A AND B if both are, A WITH e as A.
A + behind an id is read as or later. Unknown identifiers count as not permissive; a malformed expression is kept as `invalid`.

Defined cases: null and empty texts have no findings; documents without findings give no row; null doc_ids are scanned and
keep the null; repeated rows give repeated rows; a tag at the end of a line without identifier is `invalid`; matching ignores
ASCII case; for notices, runs of white space count as one space, with the comment marks around a line break; phrases may not start or end inside a word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import csv
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import only, ready

TAGS = ("spdx-license-identifier:", "license-expression:", "license-identifier:")
#: Licences: permissive or not. The list of ids is data; what isn't in it counts as not permissive.
with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "spdx.tsv"), encoding="utf-8", newline="") as _f:
    KNOWN = {r["id"]: r["permissive"] == "1" for r in csv.DictReader(_f, delimiter="\t")}
PROPRIETARY = "LicenseRef-Proprietary"
KNOWN |= {PROPRIETARY: False, "LicenseRef-LGPL": False, "LicenseRef-AGPL": False, "LicenseRef-GPL": False}
ALIASES = {}
for _k in [k for k in KNOWN if k.endswith("-only")]:  # the ids of old: GPL-2.0, GPL-2.0+
    ALIASES |= {_k.removesuffix("-only").lower(): _k, _k.removesuffix("-only").lower() + "+": _k.removesuffix("only") + "or-later"}
NOTICES = {
    "released under the mit license": "MIT", "licensed under the mit license": "MIT", "permission is hereby granted, free of charge": "MIT",
    "licensed under the apache license, version 2.0": "Apache-2.0", "apache license, version 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0",
    "gnu general public license": "LicenseRef-GPL", "gnu lesser general public license": "LicenseRef-LGPL", "gnu library general public license": "LicenseRef-LGPL", "gnu affero general public license": "LicenseRef-AGPL",
    "mozilla public license": "MPL-2.0", "mozilla public license version 1.1": "MPL-1.1", "mozilla public license, version 1.1": "MPL-1.1", "eclipse public license": "EPL-2.0", "eclipse public license v1.0": "EPL-1.0", "eclipse public license, version 1.0": "EPL-1.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by-nd 4.0": "CC-BY-ND-4.0", "cc by 4.0": "CC-BY-4.0", "cc0 1.0": "CC0-1.0",
    "creative commons attribution 4.0": "CC-BY-4.0", "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0", "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0", "creative commons attribution-noncommercial-sharealike 4.0": "CC-BY-NC-SA-4.0",
    "redistribution and use in source and binary forms": "BSD-3-Clause", "all rights reserved": PROPRIETARY, "permission to use, copy, modify, and/or distribute": "ISC", "boost software license": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense", "do what the fuck you want to public license": "WTFPL", "sil open font license": "OFL-1.1", "python software foundation license": "PSF-2.0", "postgresql license": "PostgreSQL", "server side public license": "SSPL-1.0", "business source license": "BUSL-1.1",
}
for _name, _id, _versions in (("gnu general public license", "GPL", ("1", "2", "3")), ("gnu lesser general public license", "LGPL", ("2.1", "3")), ("gnu library general public license", "LGPL", ("2",)), ("gnu affero general public license", "AGPL", ("3",))):
    for _v in _versions:
        _full = f"{_id}-{_v if '.' in _v else _v + '.0'}"
        for _num in {_v, _v if "." in _v else _v + ".0"}:
            for _mid in (", version ", " version ", " v", ", v", " as published by the free software foundation, version ", " as published by the free software foundation; version ", " as published by the free software foundation version "):
                NOTICES[f"{_name}{_mid}{_num}"] = f"{_full}-only"
            for _mid in (" as published by the free software foundation, either version ", " as published by the free software foundation; either version ", " as published by the free software foundation either version "):
                NOTICES[f"{_name}{_mid}{_num}"] = f"{_full}-or-later"
            for _mid in (", version ", " version ", " v"):
                for _end in (" or later", ", or (at your option) any later version", " or any later version"):
                    NOTICES[f"{_name}{_mid}{_num}{_end}"] = f"{_full}-or-later"
_FOLD = {k.lower(): k for k in KNOWN} | ALIASES
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_MARK = r"(?:[*#/;%|!>]++|<!--+|--++>?|(?:dnl|rem)\b)"
_GAP = re.compile(rf"(?:[^\S\n]++{_MARK}|\*/)?[^\S\n]*+\n\s*+(?:{_MARK}\s*+)*+|\s++")
_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def is_id(token: str, exception: bool = False) -> bool:
    """Whether a word may be a licence's id (or an exception's): a known one, one of its own kind, or of such a form."""
    t = token.rstrip(".:").lower()
    return t in _FOLD or t.rstrip("+") in _FOLD or t.startswith(("licenseref-", "documentref-")) or bool(re.search(r"-.*\d", t)) or (exception and "-" in t)


def _goes_on(text: str, at: int, operator: str) -> bool:
    """Whether an operand follows an operator: words like and, or, with also stand in the sentence behind an expression."""
    while (m := _TOKEN.match(text, at)) and m[1] == "(":
        at = m.end()
    return bool(m) and is_id(m[1], operator == "WITH")


def expression_at(text: str, at: int) -> list[str]:
    """Tokens of the expression that begins at a position: identifiers, operators, parentheses, to where it can't go on. An operator
    in small letters is part of it only if an id follows."""
    out, depth, operand = [], 0, True
    while m := _TOKEN.match(text, at):
        t = m[1]
        up = t.upper()
        if operand:
            if t == "(":
                depth += 1
            elif t == ")" or up in _RANK:
                break
            else:
                operand = False
        elif t == ")":
            if not depth:
                break
            depth -= 1
        elif up in _RANK and (t == up or _goes_on(text, m.end(), up)):
            t, operand = up, True
        else:
            break
        out.append(t)
        at = m.end()
    return out


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting yard: reverse Polish form, or None if malformed."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            t = t.rstrip(".:") if t.lower() not in _FOLD else t
            base = _FOLD.get(t.rstrip("+").lower())
            out.append(_FOLD.get(t.lower()) or (f"{base}+" if base and t.endswith("+") else t))
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def permissive(rpn: list[str]) -> bool | None:
    """Value of an expression; None if it isn't one (WITH takes a licence and an exception's name)."""
    stack: list = []
    for t in rpn:
        if t not in _RANK:
            stack.append((KNOWN.get(t.removesuffix("+"), False), True))
            continue
        (b, plain), (a, left) = stack.pop(), stack.pop()
        if t == "WITH" and not (plain and left):
            return None
        stack.append(((a or b, False) if t == "OR" else (a and b, False) if t == "AND" else (a, False)))
    return stack[0][0]


_state: dict = {}


def automata():
    """Of the tags, and of the notices."""
    if "a" not in _state:
        import ahocorasick

        _state["a"] = []
        for words in ({t: None for t in TAGS}, NOTICES):
            a = ahocorasick.Automaton()
            for p, x in words.items():
                a.add_word(p, (p, x))
            a.make_automaton()
            _state["a"].append(a)
    return _state["a"]


def scan(text: str | None):
    """(expressions in reverse Polish form, permissive by expression, licences of notices, whether all allow) or None."""
    if not text:
        return None
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    rpns, values, notices = [], [], set()
    of_tags, of_notices = automata()
    for end, (phrase, _) in of_tags.iter(low):
        start = end - len(phrase) + 1
        if start and low[start - 1] in _WORD or phrase == TAGS[2] and low.endswith("spdx-", 0, start):
            continue
        rpn = postfix(expression_at(text, end + 1))
        value = permissive(rpn) if rpn else None
        rpns.append(" ".join(rpn) if value is not None else "invalid")
        values.append(bool(value))
    view = _GAP.sub(" ", low.replace("\r\n", "\n").replace("\r", "\n"))
    last, found = 0, []
    for end, (phrase, licence) in of_notices.iter(view):
        start = end - len(phrase) + 1
        if not (start and view[start - 1] in _WORD) and (end + 1 >= len(view) or view[end + 1] not in _WORD):
            found.append((start, -end, licence))
    # the longest phrase at a place stands for those within it
    for start, end, licence in sorted(found):
        if -end >= last:
            notices.add(licence)
            last = -end + 1
    if not rpns and not notices:
        return None
    # who names a licence may still say that all rights are reserved
    named = notices - {PROPRIETARY} if len(notices) > 1 or any(v != "invalid" for v in rpns) else notices
    return rpns, values, sorted(notices), all(values) and all(KNOWN[x] for x in named)


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, expressions, expression_permissive, notices, permissive) for each document with a finding."""
    ready(docs.sparkSession)
    schema = "doc_id bigint, expressions array<string>, expression_permissive array<boolean>, notices array<string>, permissive boolean"

    def run(batches):
        for b in batches:
            ids, out = [], []
            for n, t in enumerate(b.column(1)):
                x = scan(t.as_py())
                if x:
                    ids.append(n)
                    out.append(x)
            e, p, s, ok = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(e, pa.list_(pa.string())), pa.array(p, pa.list_(pa.bool_())), pa.array(s, pa.list_(pa.string())), pa.array(ok, pa.bool_())], ["doc_id", "expressions", "expression_permissive", "notices", "permissive"])

    return only(docs, "doc_id", "text").mapInArrow(run, schema)
