"""Texts as column expressions: cleaning, views of the prose, words, sentences, spans. All row-local and JVM-side, no shuffle."""

from __future__ import annotations

import functools
from string import ascii_letters

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import EDGE, SPACE, WORD

#: [A-Za-z][A-Za-z\-'’]*; characters one by one are looked up at once, ranges one after the other.
WORDS = rf"[{ascii_letters}][{ascii_letters}\-'’]*+"
FENCE = r"(?dm)^[\t ]*(([`~])\2{2,})[^\n]*?(?:\n(?s:.*?))?(?:\n[\t ]*\1[\t ]*$|\z)"
INLINE = r"`+[^\n`]*+`+"
HEADING, LIST, QUOTE = r"^[\t ]*#{1,6}[\t ]+", r"^[\t ]*(?:\d+[.)]|[-+*])[\t ]+", r"^[\t ]*>+[\t ]?"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2700}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{FE0F}]"
SPANS = "array<struct<start:int,end:int,text:string>>"
_NUL = "\u0003"  # not U+0000, which translate() takes as nothing


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body, also where body uses it many times or inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def extract(text: Column, regex: str | Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex) if isinstance(regex, str) else regex, F.lit(group))


def split(text: Column, regex: str | Column) -> Column:
    return F.split(text, F.lit(regex) if isinstance(regex, str) else regex, F.lit(-1))


def gaps(text: Column, regex: str) -> Column:
    """split() by an expression that never matches nothing. Spark's split compiles an expression anew for every text, its replacement
    once; texts that hold the mark are split."""
    mark = "\u0004"
    return F.when(text.contains(mark), split(text, regex)).otherwise(split(F.regexp_replace(text, regex, mark), mark))


def count(text: Column, regex: str) -> Column:
    return F.regexp_count(text, F.lit(regex))


def splice(text: Column, regex: str, change) -> Column:
    """text with each match m of regex, which never matches nothing, replaced by change(m)."""
    return F.array_join(F.zip_with(gaps(text, regex), extract(text, regex), lambda g, m: F.concat(g, F.when(m.isNull(), F.lit("")).otherwise(change(m)))), "")


def clean(text: Column, most: int | None = None) -> Column:
    """Line feeds only, no byte order mark, no control characters; the whole text, or its first `most` characters."""
    t = F.regexp_replace(text if most is None else F.substring(text, 1, most), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "^\ufeff", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def without_front_matter(text: Column) -> Column:
    """A leading block between --- or +++ lines as blank lines."""
    def blank(lines):
        ends = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x).isin("---", "...") | (F.trim(x) == F.substring(text, 1, 3)))
        return let(F.array_position(ends, True), lambda k: F.when(k > 0, F.array_join(F.transform(lines, lambda x, i: F.when(i <= k, F.lit("")).otherwise(x)), "\n")).otherwise(text))
    return F.when(text.startswith("---\n") | text.startswith("+++\n"), let(split(text, "\n"), blank)).otherwise(text)


def without_code(text: Column) -> Column:
    """Fenced code as its line feeds, inline code as as many spaces."""
    fenced = splice(text, FENCE, lambda m: F.repeat(F.lit("\n"), F.length(F.regexp_replace(m, r"[^\n]", ""))))
    out = splice(F.when(text.rlike("(?m)^[\t ]*(?:```|~~~)"), fenced).otherwise(text), INLINE, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.when(text.contains("`") | text.contains("~~~"), out).otherwise(text)


def masked_code(text: Column) -> Column:
    """Code as as many spaces, so that every offset stays."""
    fenced = splice(text, FENCE, lambda m: F.regexp_replace(m, r"[^\n]", " "))
    out = splice(F.when(text.rlike("(?m)^[\t ]*(?:```|~~~)"), fenced).otherwise(text), INLINE, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.when(text.contains("`") | text.contains("~~~"), out).otherwise(text)


def without_markup(line: Column, gap: str = " ", tag: str = " ") -> Column:
    """Anchor texts for links, gaps for addresses, footnotes and tags, no emphasis marks; each is looked for where its marks are."""
    def of(x):
        t = F.when(x.contains("["), F.regexp_replace(x, r"!?[\[]([^\]]*+)\][(][^)]*+[)]", "$1")).otherwise(x)
        t = F.regexp_replace(t, rf"(?:www\.|(?:ftp|https?)://)[^{SPACE}]+", gap)
        t = F.regexp_replace(t, r"\[\^[^\]]++\]", gap)
        t = F.regexp_replace(t, r"<[^\n>]++>", tag)
        t = F.regexp_replace(t, r"\*{1,3}|_{1,3}|~~", "")
        return F.when(functools.reduce(Column.__or__, [x.contains(m) for m in ("[", "www.", "://", "<", "*", "_", "~~")]), t).otherwise(x)
    return let(line, of)


def stripped(text: Column) -> Column:
    """Without white space at its ends; the expression would look at every space within."""
    ends = F.substring(text, 1, 1).rlike(f"[{SPACE}]") | F.substring(text, -1, 1).rlike(f"[{SPACE}]")
    return F.when(ends, F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")).otherwise(text)


def is_rule(line: Column) -> Column:
    """Three or more of the same of - * _ and blanks; the blanks go first, as an expression with them would recurse."""
    return line.rlike(r"^[\t ]*[-_*]") & F.regexp_replace(line, "[\t ]", "").rlike(r"^(?:-{3,}|_{3,}|\*{3,})$")


def is_structure(line: Column) -> Column:
    return line.rlike(HEADING) | line.rlike("^[\t ]*(?:-+|=+)[\t ]*$") | is_rule(line) | line.rlike(r"^[\t ]*\|")


def metric_prose(code_stripped: Column) -> Column:
    """Paragraphs with their lines joined, list items as sentences of their own, nothing else: one a line."""
    def line(raw):
        breaks = F.trim(raw).rlike(rf"^[{SPACE}]*$") | is_structure(raw) | (raw.rlike(rf"^[{SPACE}:|\-]*$") & raw.rlike("[-:]")) | raw.rlike(r"^[\t ]*\[\^[^\]]++\]:")
        def of(bare):
            item = F.concat(F.lit("\u0001"), bare, F.when(bare.rlike("[.!?]$"), F.lit("")).otherwise(F.lit(".")), F.lit("\u0001"))
            return F.when(bare == "", F.lit(None).cast("string")).when(raw.rlike(LIST), item).otherwise(F.concat(bare, F.lit("\u0002")))
        bare = let(without_markup(F.regexp_replace(F.regexp_replace(raw, QUOTE, ""), LIST, "")), stripped)
        return F.when(breaks, F.lit("\u0001")).otherwise(let(bare, of))
    marked = F.array_join(F.transform(split(code_stripped, "\n"), line), "")
    paragraphs = F.transform(split(marked, "\u0001"), lambda p: F.replace(F.regexp_replace(p, "\u0002$", ""), F.lit("\u0002"), F.lit(" ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n")


def adjacency_prose(text: Column) -> Column:
    """Lines without markers and markup; what was code, address or footnote is the word x."""
    fenced = F.when(text.rlike("(?m)^[\t ]*(?:```|~~~)"), splice(text, FENCE, lambda m: F.repeat(F.lit("\n"), F.length(F.regexp_replace(m, r"[^\n]", ""))))).otherwise(text)
    def line(raw):
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, HEADING, ""), QUOTE, ""), LIST, "")
        return without_markup(let(t, lambda x: F.when(x.contains("`"), F.regexp_replace(x, INLINE, "x")).otherwise(x)), "x", "")
    return F.array_join(F.transform(split(fenced, "\n"), line), "\n")


def tokens(text: Column) -> Column:
    return F.transform(extract(text, WORDS), F.lower)


def first_word(sentence: Column) -> Column:
    """Lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(sentence, WORDS, 0)), F.lit(""))


_SHORT = sorted("al approx ca cf ch co corp dept dr e.g est etc fig i.e inc jr ltd mr mrs ms no ph.d pp prof sr st u.k u.s vol vs".split(), key=lambda w: (-len(w), w))


def sentences(prose: Column) -> Column:
    """Split after . ! ? and white space before a capital, digit, quote or bracket; not inside numbers, ellipses and abbreviations."""
    t = F.regexp_replace(prose, r"(\d)\.(\d)", "$1" + _NUL + "$2")
    # each splice only where its marks are; what shortens the search stands first
    t = let(t, lambda t: F.when(t.contains("..."), splice(t, r"\.{3,}", lambda m: F.repeat(F.lit(_NUL), F.length(m)))).otherwise(t))
    t = let(t, lambda t: F.when(t.rlike(r"[A-Za-z]\.[A-Za-z]\."), splice(t, EDGE + r"(?:[A-Za-z]\.){2,}", lambda m: F.translate(m, ".", _NUL))).otherwise(t))
    t = F.regexp_replace(t, rf"(?iu)\.(?<=(?<![{WORD}])(?:" + "|".join(w.replace(".", r"\.") for w in _SHORT) + r")\.)", _NUL)
    parts = split(t, rf"""(?<=[!?.])[\])"'’”]?[{SPACE}]+(?=["'(“A-Z0-9])""")
    return F.filter(F.transform(parts, lambda p: let(F.replace(p, F.lit(_NUL), F.lit(".")), stripped)), lambda p: p != "")


def paragraphs(code_stripped: Column, lists: bool = False, setext: bool = True) -> Column:
    """Texts between blank lines, without structural lines (and list items) and markup; those without words are left out."""
    def text(block):
        def kept(x):
            drop = x.rlike(HEADING) | is_rule(x) | x.rlike(r"^[\t ]*\|")
            drop = drop | x.rlike("^[\t ]*(?:-+|=+)[\t ]*$") if setext else drop
            return ~(drop if lists else drop | x.rlike(LIST))
        return F.trim(without_markup(F.array_join(F.filter(split(block, "\n"), kept), " ")))
    return F.filter(F.transform(split(code_stripped, "\n[\t ]*\n"), text), lambda p: p.rlike("[A-Za-z]"))


def spans(text: Column, regex: str | Column) -> Column:
    """array<struct<start, end, text>> of the matches, from 0; from the pieces between them, so without a UDF."""
    pair = F.struct((gaps if isinstance(regex, str) else split)(text, regex).alias("g"), extract(text, regex).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("out")))
    out = let(pair, lambda p: F.aggregate(F.arrays_zip(p["g"].alias("g"), p["m"].alias("m")), zero, step)["out"])
    return F.when(text.rlike(regex), out).otherwise(zero["out"]) if isinstance(regex, str) else out


def line_of(text: Column, offset: Column) -> Column:
    return let(F.substring(text, F.lit(1), offset), lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def counted(values: Column) -> Column:
    """array<struct<value, n>> of the distinct values of an array, by a sort: n log n however many there are."""
    def runs(s):
        begin = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(begin, lambda b: F.transform(b, lambda p, j: F.struct(F.get(s, p - 1).alias("value"), (F.coalesce(F.get(b, j + 1), F.size(s) + 1) - p).alias("n"))))
    # sorted once: values may be a long expression, and size() would make it again
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, runs(s)))


def longest_run(flags: Column) -> Column:
    """The longest run of true in an array of booleans."""
    s = F.aggregate(flags, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, f: let(F.when(f, a["now"] + 1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(n, a["most"]).alias("most"))))
    return s["most"]


def cov(numbers: Column) -> Column:
    """Population deviation over mean; null for fewer than two. Deviations are added as in SQL's stddev_pop (Welford), so that the
    last digit is the same."""
    def of(a):
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("d"))
        def step(s, x):
            return let(s["mean"] + (x - s["mean"]) / (s["n"] + 1), lambda mean: F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["d"] + (x - mean) * (x - s["mean"])).alias("d")))
        deviation = F.sqrt(F.aggregate(a, zero, step)["d"] / F.size(a))
        return let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), lambda m: F.when(m > 0, deviation / m))
    return F.when(F.size(numbers) >= 2, let(numbers, of))


def rounded(x: Column, digits: int) -> Column:
    """As SQL's round() of a double: the nearest whole number of 10^-digits in doubles, halves away from zero. Spark's round() takes
    the decimal digits that a double is shown with, and so differs near halves."""
    def of(y):
        return F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)
    return let(x, lambda v: F.signum(v) * (let(F.abs(v) * 10.0**digits, of) / 10.0**digits))


def views(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the views that checks read: t (source), c (no code), m (metric prose), a (adjacency prose), w (words), s (sentences)."""
    d = docs.withColumn("t", without_front_matter(clean(F.coalesce(F.col(text), F.lit("")))))
    d = d.withColumn("c", without_code(F.col("t")))
    d = d.withColumns({"m": metric_prose(F.col("c")), "a": adjacency_prose(F.col("t"))})
    return d.withColumns({"w": tokens(F.col("m")), "s": sentences(F.col("m"))})

