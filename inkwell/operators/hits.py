"""Findings. A hit is a struct (category, line, text, suggestion, col, end_line, end_col, start, end, line_basis); line 0 is the
whole document. Each check is a function of the view columns (functions.text.views) that gives an array of hits and its
metrics, so a document's analysis is one projection: no shuffle, the same in batch and in streams."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T

HIT = "struct<category:string,line:int,text:string,suggestion:string,col:int,end_line:int,end_col:int,start:int,end:int,line_basis:string>"


def none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def hit(category, text, suggestion, source=None, start=None, end=None, basis: str = "document") -> Column:
    """A hit; with basis source its columns are those of the text, with metric only its line counts."""
    null = F.lit(None).cast("int")
    line = F.lit(0) if start is None else T.line_of(source, start)
    exact = basis == "source" and end is not None
    cell = lambda f, x: f(source, x).cast("int") if exact else null
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(category).cast("string").alias("category"), line.cast("int").alias("line"), lit(text).cast("string").alias("text"), lit(suggestion).cast("string").alias("suggestion"),
        cell(T.column_of, start).alias("col"), cell(T.line_of, end).alias("end_line"), cell(T.column_of, end).alias("end_col"),
        (start if exact else null).cast("int").alias("start"), (end if exact else null).cast("int").alias("end"), F.lit(basis).alias("line_basis"),
    ).cast(HIT)


def one_if(condition: Column, h: Column) -> Column:
    return F.when(condition, F.array(h)).otherwise(none())


def each_if(condition: Column | None, found: Column, make, most: int | None = None) -> Column:
    """Hits made of the (first) spans found where the condition holds."""
    some = F.slice(found, 1, most) if most else found
    out = F.transform(some, make)
    return out if condition is None else F.when(condition, out).otherwise(none())


def snippet(text: Column, most: int = 70) -> Column:
    return F.translate(F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text), "\n", " ")


# Phrase lists, pattern families, dialect


def protected(text: Column, phrases: tuple) -> Column:
    """Spans of the phrases in which a flagged word is a fixed expression."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    if not phrases:
        return empty
    # one search for all of them, as most texts hold none
    start = f"(?<![{R.WORD}])" if all(p[:1].isalnum() for p in phrases) else ""
    low = F.lower(F.regexp_replace(text, f"[{R.SPACE}]+", " "))
    found = T.let(low, lambda t: F.flatten(F.array(*[F.when(t.contains(p.lower()), T.spans(text, R.quick(p))).otherwise(empty) for p in phrases])))
    return F.when(text.rlike(start + R.any_of(p.lower() for p in phrases)), found).otherwise(empty)


def free(x: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda p: (x["start"] < p["end"]) & (p["start"] < x["end"]))


ROW = "struct<category:string,regex:string,suggestion:string,plain:string,anchor:string>"
CITATION = r"\[\^?\d|\(\d{4}\)|\([" + R.SPACE + r"]*[A-Z][" + R.WORD + r"\-&.]+,?[" + R.SPACE + r"]*(?:et al\.?,?[" + R.SPACE + r"]*)?\d{4}|doi:|https?://"


def phrase_hits(text: Column, rules: R.Rules, keep: Column, categories=None) -> Column:
    """Hits of all phrase lists on a text without code; keep: protected spans.

    One expression finds the phrases that begin at any word; only those, and phrases that they begin with, are searched by their
    own. Their numbers come from a literal map, so there is neither a join nor a shuffle, and the cost follows the text and the
    phrases that occur rather than all there are.
    """
    phrases = [p for p in rules.phrases if categories is None or p.category in categories]
    plain = [" ".join(p.phrase.lower().split()) for p in phrases]
    rows = [{"category": p.category, "regex": R.quick(p.phrase), "suggestion": p.suggestion or "cut", "plain": t, "anchor": p.anchor} for p, t in zip(phrases, plain)]
    # foldable, so a literal in the plan
    table = F.from_json(F.lit(json.dumps(rows)), f"array<{ROW}>")
    single = lambda t: F.lower(F.regexp_replace(t, f"[{R.SPACE}]+", " "))
    begun: dict[str, list[int]] = {plain[n]: [] for n, p in enumerate(phrases) if p.anchor}
    for t, own in begun.items():
        own += [n for n, p in enumerate(phrases) if p.anchor and t.startswith(plain[n])]
    likely = F.array().cast(f"array<{ROW}>")
    if begun:
        lookup = F.from_json(F.lit(json.dumps(begun)), "map<string,array<int>>")
        regex = f"(?<![{R.WORD}])(?=({R.any_of(begun)}))"
        anchor = f"(?<![{R.WORD}])(?:{R.any_of({p.anchor for p in phrases if p.anchor})})(?![{R.WORD}])"
        def ordered(numbers):
            # by where a phrase's first word is first found
            place = lambda words: F.transform(numbers, lambda n: F.struct(F.array_position(words, F.get(table, n)["anchor"]).alias("at"), n.alias("n")))
            placed = T.let(F.array_distinct(F.transform(F.array_distinct(T.extract(text, anchor)), F.lower)), place)
            return F.transform(F.sort_array(F.filter(placed, lambda x: x["at"] > 0)), lambda x: F.get(table, x["n"]))
        numbers = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(F.array_distinct(T.extract(text, regex, 1)), single)), lambda w: F.element_at(lookup, w))))
        likely = T.let(numbers, lambda x: F.when(F.size(x) > 0, ordered(x)).otherwise(likely))
    always = [n for n, p in enumerate(phrases) if not p.anchor]
    if always:
        likely = F.concat(likely, T.let(single(text), lambda t: F.filter(F.transform(F.array(*map(F.lit, always)), lambda n: F.get(table, n)), lambda r: F.contains(t, r["plain"]))))

    def of(r):
        return F.transform(T.spans(text, r["regex"]), lambda x: F.struct(r["category"].alias("category"), r["suggestion"].alias("suggestion"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))

    def kept(x, spans):
        cited = F.rlike(F.substring(text, x["end"] + 1, F.lit(45)), F.lit(CITATION))
        before = F.substring_index(F.substring(text, F.lit(1), x["start"]), "\n", -1)
        line = F.concat(before, F.substring_index(F.substring(text, x["start"] + 1, F.lit(200)), "\n", 1))
        quoted = line.rlike(T.HEADING) | line.rlike(T.QUOTE) | (F.length(F.regexp_replace(before, '[^"]', "")) % 2 == 1)
        return free(x, spans) & ~(x["category"].isin(*R.CITED) & cited) & ~(x["category"].isin(*R.UNQUOTED) & quoted)

    def live(found):
        # keep is bound here: the optimizer would move it into kept(), and so make it anew for every hit
        rest = T.let(keep, lambda spans: F.filter(found, lambda x: kept(x, spans)))
        return F.transform(rest, lambda x: hit(x["category"], x["text"], x["suggestion"], text, x["start"], x["end"], "source"))

    return T.let(F.flatten(F.transform(likely, of)), lambda found: F.when(F.size(found) > 0, live(found)).otherwise(none()))


def _pattern_hit(category: str, text: Column):
    return lambda x: hit(category, snippet(x["text"]), R.ADVICE[category], text, x["start"], x["end"], "source")


def pattern_hits(text: Column, keep: Column, categories=None, rules: R.Rules | None = None) -> Column:
    """Hits of the pattern families on a text without code; an expression runs where the text holds one of its needed words."""
    own = (rules.families if rules else None) or {}
    def of(x):
        out = []
        for category, family in (R.PATTERNS | own).items():
            for short in family if categories is None or category in categories else ():
                need = [] if category in own else R.needs(short)
                f = T.spans(text, short if category in own else R.pattern(short, search=True))
                f = f if category in R.IGNORES_PROTECTED else F.filter(f, lambda s: free(s, x["keep"]))
                f = F.transform(f, _pattern_hit(category, text))
                out.append(F.when(functools.reduce(Column.__or__, [x["low"].contains(w) for w in need]), f).otherwise(none()) if need else f)
        return F.flatten(F.array(*out)) if out else none()
    # bound once: lower-casing costs more than the search for a word
    return T.let(F.struct(F.lower(text).alias("low"), keep.alias("keep")), of)


def _dialect_hit(table: Column, text: Column):
    return lambda x: hit("dialect", x["text"], F.concat(F.lit("use '"), F.element_at(table, F.lower(x["text"])), F.lit("' for consistent dialect")), text, x["start"], x["end"], "source")


def dialect_hits(text: Column, dialect: Column, rules: R.Rules) -> Column:
    """Words spelled against the chosen dialect; identifiers, and words at a text's very start or end, are let be."""
    out = none()
    for name, words in rules.dialect.items():
        table = F.create_map(*[x for a, b in words.items() for x in (F.lit(a.lower()), F.lit(b))])
        regex = "(?iu)(?<!^)(?<![_.$])" + R.EDGE + "(?:" + "|".join(map(R.quoted, sorted(words, key=lambda w: (-len(w), w)))) + ")" + R.EDGE + r"(?![_.(])(?!\z)"
        some = F.filter(T.spans(text, regex), lambda x: ~((F.upper(x["text"]) == x["text"]) & (F.length(x["text"]) > 1)))
        out = F.when(dialect == name, F.transform(some, _dialect_hit(table, text))).otherwise(out)
    return out
