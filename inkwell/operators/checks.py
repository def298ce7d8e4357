"""Structure, rhythm and density checks: each takes the view columns and thresholds and gives (metrics, hits)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from .hits import each_if, hit, none, one_if

W = R.WORD
S_ = f"[{R.SPACE}]"
NUMBER_DASH = rf"(?<=\d){S_}{{0,4}}–{S_}{{0,4}}(?=\d)"
DASHES = rf"{S_}?—{S_}?|(?!{NUMBER_DASH})(?<!\d{S_})(?<!\d)(?:{S_}?–{S_}?)|(?:(?<=\d)|(?<=\d{S_})){S_}?–{S_}?(?!{S_}?\d)|(?<=[{W}])--(?=[{W}])|{S_}--{S_}"
WH = ("how", "what", "when", "where", "which", "who", "why")
SUBJECTS = ("a", "an", "he", "her", "his", "i", "it", "its", "our", "she", "that", "the", "their", "these", "they", "this", "those", "we", "you")
STOP = tuple(sorted(set("about an and are as at a be been being but by can could did do does for from had has have he here how i if in into is it its may might not of on or our over she should so than that the their then there these they this those to under was we were what when where which who whom why will with would you your".split())))
DOUBLE_OK = ("bye", "blah", "din", "ha", "had", "hear", "no", "now", "ok", "really", "so", "that", "tut", "very", "yeah")


def per_1k(n: Column, words: Column) -> Column:
    return F.when(words > 0, n / words * 1000).otherwise(0.0)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def em_dash(v, th):
    n = F.size(v["w"])
    def of(found):
        count = F.size(found)
        rate = per_1k(count, n)
        def tight(pairs):
            many = (rate > th["em_dash_per_1k_words"]) & (count >= 2)
            def near(x):
                return F.trim(F.translate(F.substring(v["m"], F.greatest(x["start"] - 15, F.lit(0)) + 1, F.least(x["start"], F.lit(15)) + 15), "\n", " "))
            first = each_if(None, found, lambda x: hit("em_dash", near(x), "a comma, a full stop or brackets", v["m"], x["start"], basis="metric"), 8)
            second = each_if(F.size(pairs) >= 2, pairs, lambda x: hit("em_dash", F.trim(F.translate(x["text"], "\n", " ")), "make the aside a sentence", v["m"], x["start"], basis="metric"), 6)
            return F.struct(rate.alias("em_dash_per_1k"), F.size(F.filter(found, lambda x: x["text"].contains("—") | x["text"].contains("--"))).alias("em_dash_count"), F.size(F.filter(found, lambda x: x["text"].contains("–"))).alias("en_dash_count"), F.size(pairs).alias("paired_dash_asides"), F.when(many, first).otherwise(second).alias("hits"))
        return T.let(T.spans(v["m"], rf"[—–]{S_}?[^—–\n]{{1,50}}?{S_}?[—–]"), tight)
    some = v["m"].contains("—") | v["m"].contains("–") | v["m"].contains("--")
    # each begins with a dash or with one blank and a dash: that is looked at before the five ways
    return T.let(F.when(some, T.spans(v["m"], rf"(?={S_}?(?:[—–]|--))(?:{DASHES})")).otherwise(F.array().cast(T.SPANS)), of)


def bold_bullets(v, th):
    bullets = T.count(v["t"], r"(?dm)^[\t ]*[-+*][\t ]+[^" + R.SPACE + "]")
    def of(bold):
        fires = (bullets > 0) & (F.size(bold) / bullets >= th["bold_bullet_ratio"]) & (F.size(bold) >= 3)
        return F.struct(bullets.alias("bullets"), F.size(bold).alias("bold_lead_bullets"), each_if(fires, bold, lambda x: hit("bold_bullets", F.trim(x["text"]), "write some as prose", v["t"], x["start"], x["end"], "source"), 8).alias("hits"))
    return T.let(T.spans(v["t"], r"(?dm)^[\t ]*[-+*][\t ]+(?:__[^\n_]++__|\*\*[^\n*]++\*\*)[\t ]*:?"), of)


def rule_of_three(v, th):
    word = rf"{R.BEGIN}([A-Za-z]++){S_}*+,{S_}+([A-Za-z]++){S_}*,?{S_}+(?:or|and){S_}+([A-Za-z]+){R.END}"
    member = rf"[A-Za-z][\-{W}]*+(?:{S_}++[\-{W}]++){{0,2}}+"  # nothing of it can be given back before a comma
    noun = rf"{R.BEGIN}({member}),{S_}+({member}),{S_}+and{S_}+([A-Za-z][\-{W}]*(?:{S_}+[\-{W}]+){{0,2}}){R.EDGE}"
    part = lambda x, rx, k: F.regexp_extract(x["text"], rx.replace(R.EDGE, "").replace(R.BEGIN, "").replace(R.END, ""), k)
    capital = lambda x, rx: part(x, rx, 2).rlike(r"^\p{Lu}") | part(x, rx, 3).rlike(r"^\p{Lu}")
    singles = F.filter(T.spans(v["m"], word), lambda x: (F.length(part(x, word, 1)) > 3) & (F.length(part(x, word, 2)) > 3) & (F.length(part(x, word, 3)) > 3) & ~capital(x, word))
    triads = F.filter(T.spans(v["m"], noun), lambda x: ~capital(x, noun) & (part(x, noun, 1).rlike(S_) | part(x, noun, 2).rlike(S_) | part(x, noun, 3).rlike(S_)))
    cut = lambda t: F.when(F.length(t) > 63, F.concat(F.substring(t, 1, 60), F.lit("..."))).otherwise(t)
    a = F.transform(singles, lambda x: hit("rule_of_three", x["text"], "two or four of them, or a clause", v["m"], x["start"], basis="metric"))
    b = T.let(triads, lambda f: each_if(F.size(f) >= 2, f, lambda x: hit("rule_of_three", cut(x["text"]), "two or four of them, or a clause", v["m"], x["start"], basis="metric"), 6))
    return F.struct(F.concat(a, b).alias("hits"))


def openers(v, th):
    def of(o):
        def counts(c):
            n = F.size(o)
            top = F.array_max(F.transform(c, lambda x: x["n"]))
            word = F.element_at(F.array_sort(F.transform(F.filter(c, lambda x: x["n"] == top), lambda x: F.struct(F.array_position(o, x["value"]), x["value"].alias("w")))), 1)["w"]
            entropy = -F.aggregate(c, F.lit(0.0), lambda s, x: s + x["n"] / n * F.log2(x["n"] / n))
            enough = n >= 4
            said = F.concat(top.cast("string"), F.lit(" of "), n.cast("string"), F.lit(' sentences begin with "'), word, F.lit('"'))
            return F.struct(F.when(enough, top / n).otherwise(0.0).alias("opener_repeat_ratio"), F.when(enough, entropy).alias("opener_entropy"), one_if(enough & (top / n >= th["uniform_opener_ratio"]), hit("uniform_openers", said, "begin sentences in other ways")).alias("hits"))
        return T.let(T.counted(o), counts)
    return T.let(F.filter(F.transform(v["s"], T.first_word), lambda w: w.isNotNull()), of)


def wh_openers(v, th):
    def of(o):
        flags = F.transform(o, lambda w: F.coalesce(w.isin(*WH), F.lit(False)))
        total, n, run = F.size(F.filter(o, lambda w: w.isNotNull())), F.size(F.filter(flags, lambda f: f)), T.longest_run(flags)
        fires = (total >= 4) & ((n / total >= th["wh_opener_ratio"]) | (run >= int(th["wh_opener_run"])))
        return F.struct(n.alias("wh_opener_count"), F.when(total >= 4, n / total).alias("wh_opener_ratio"), run.alias("wh_opener_run"), one_if(fires, hit("wh_opener", F.concat(n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" sentences begin with a question word")), "begin with the subject")).alias("hits"))
    return T.let(F.transform(v["s"], T.first_word), of)


def formatting(v, th):
    most = int(th["section_rule_max"])
    emoji = T.count(v["t"], T.EMOJI)
    start = F.length(F.element_at(T.split(v["t"], T.EMOJI), 1))
    first = one_if(emoji > 0, hit("formatting", F.concat(F.lit("emoji ("), emoji.cast("string"), F.lit(")")), "remove the emoji", v["t"], start, start + 1, "source"))
    def of(lines):
        numbered = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: T.is_rule(p["x"]))
        def rules(found):
            def make(p):
                at = F.aggregate(F.slice(lines, F.lit(1), p["i"]), F.lit(0), lambda s, x: s + F.length(x) + 1)
                return hit("formatting", "horizontal rule", "fewer rules", v["t"], at, at + F.length(p["x"]), "source")
            return F.struct(emoji.alias("emoji"), F.size(found).alias("section_rules"), F.concat(first, F.when(F.size(found) > most, F.transform(F.slice(found, most + 1, 6), make)).otherwise(none())).alias("hits"))
        return T.let(numbered, rules)
    return T.let(T.split(v["t"], "\n"), of)


def burstiness(v, th):
    def of(n):
        c = T.cov(n)
        return F.struct(F.when(F.size(n) >= 5, c).alias("burstiness_cov"), F.when(F.size(n) > 0, mean(n)).otherwise(0.0).alias("mean_sentence_len"), one_if((F.size(n) >= 5) & (c < th["burstiness_cov_floor"]), hit("burstiness", F.format_string("sentence lengths vary by %.2f", c), "mix short and long sentences")).alias("hits"))
    return T.let(F.filter(F.transform(v["s"], lambda s: T.count(s, T.WORDS)), lambda n: n > 0), of)


def mattr(words: Column, window: int = 50) -> Column:
    """Mean share of distinct words in windows of 50 at every word, however long the text.

    A word at p counts in the windows that hold it but not its previous occurrence; sorting words with their positions puts that
    next to it. So n log n, not n windows of 50."""
    def of(w):
        n = F.size(w)
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("p"))))
        def total(a):
            before = F.concat(F.slice(a, 1, 1), F.slice(a, F.lit(1), n - 1))
            def windows(x, y):
                prev = F.when((x["w"] == y["w"]) & (y["p"] < x["p"]), y["p"]).otherwise(-1)
                return F.greatest(F.lit(0), F.least(x["p"], n - window) - F.greatest(prev + 1, x["p"] - (window - 1), F.lit(0)) + 1)
            return F.aggregate(F.zip_with(a, before, windows), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return T.let(placed, total) / ((n - window + 1).cast("bigint") * window)
    return F.when(F.size(words) >= window, T.let(words, of))


def yules_k(words: Column) -> Column:
    n = F.size(words).cast("double")
    squares = F.aggregate(T.counted(words), F.lit(0.0), lambda s, x: s + x["n"].cast("double") * x["n"])
    return F.when(F.size(words) >= 2, 1e4 * (squares - n) / (n * n))


def lexical_diversity(v, th):
    return T.let(mattr(v["w"]), lambda r: F.struct(r.alias("ttr"), F.when(F.size(v["w"]) >= 50, yules_k(v["w"])).alias("yules_k"), one_if(r < th["ttr_floor"], hit("lexical_diversity", F.format_string("type-token ratio %.2f", r), "vary the words")).alias("hits")))


def repeated_grams(words: Column, n: int, least: int) -> Column:
    """array<struct<value, n>> of word n-grams, not all stopwords, that occur least times or more."""
    empty = F.array().cast("array<struct<value:string,n:int>>")
    def of(w, stop):
        tail = lambda a, i: F.slice(a, F.lit(i + 1), F.size(w) - (n - 1))
        # a gram is null where all its words are stopwords; words hold no spaces
        grams, plain = tail(w, 0), tail(stop, 0)
        for i in range(1, n):
            grams = F.zip_with(grams, tail(w, i), lambda x, y: F.concat(x, F.lit(" "), y))
            plain = F.zip_with(plain, tail(stop, i), lambda x, y: x & y)
        grams = F.filter(F.zip_with(grams, plain, lambda g, p: F.when(~p, g)), lambda g: g.isNotNull())
        return F.filter(T.counted(grams), lambda x: x["n"] >= least)
    stops = lambda w: T.let(F.transform(w, lambda x: x.isin(*STOP)), lambda stop: of(w, stop))
    return F.coalesce(F.when(F.size(words) >= n, T.let(words, stops)), empty)


def ngram_repetition(v, th):
    out = [F.transform(repeated_grams(v["w"], n, int(th["ngram_min_count"])), lambda x: hit("ngram_repetition", F.concat(F.lit('"'), x["value"], F.lit('" x'), x["n"].cast("string")), "say it another way")) for n in th["ngram_sizes"]]
    return F.struct(F.concat(*out).alias("hits"))


def headings(v, th):
    def style(x):
        title = F.trim(F.regexp_replace(F.regexp_replace(x["text"], "^[\t ]*#{1,6}[\t ]+", ""), "[\t ]*#*$", ""))
        words = F.filter(T.split(title, S_ + "+"), lambda w: w.rlike(r"\p{L}"))
        caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        return F.struct(x["start"].alias("start"), title.alias("title"), F.size(words).alias("n"), (caps >= F.greatest(F.lit(2), F.size(words) - 1)).alias("upper"))
    found = F.filter(F.transform(T.spans(v["t"], r"(?dm)^[\t ]*#{1,6}[\t ]+[^\n]+$"), style), lambda x: x["n"] >= 2)
    def of(f):
        up = F.size(F.filter(f, lambda x: x["upper"]))
        other = F.size(f) - up
        major = F.when(up == other, F.get(f, 0)["upper"]).otherwise(up > other)
        odd = F.filter(f, lambda x: x["upper"] != major)
        return F.struct(F.transform(odd, lambda x: hit("heading_case", x["title"], F.when(major, "match the other headings (title)").otherwise("match the other headings (sentence)"), v["t"], x["start"])).alias("hits"))
    return T.let(found, of)


def _density(name, category, n, v, limit):
    words = F.size(v["w"])
    rate = per_1k(n, words)
    fires = (words >= 150) & (rate > limit) & (n >= 3)
    return F.struct(rate.alias(name), one_if(fires, hit(category, F.format_string("%.0f in 1000 words", rate), "fewer of them")).alias("hits"))


PASSIVE = rf"(?iu){R.BEGIN}(?:are|be|been|being|gets|got|is|was|were){S_}+(?:[{W}]+ly{S_}+)?(?:[{W}]+ed|" + "|".join(sorted("built chosen done drawn found given grown held kept known lost made met paid put read seen sent set shown taken told won written".split())) + f"){R.END}"
NOMINAL = rf"(?iu){R.BEGIN}[{W}]{{4,}}(?:ance|ence|isation|ity|ization|ment|tion)s?{R.END}"


def passive_voice(v, th):
    return _density("passive_per_1k", "passive_voice", T.count(v["m"], PASSIVE), v, th["passive_per_1k"])


def adverbs(v, th):
    return _density("adverb_per_1k", "adverbs", F.size(F.filter(v["w"], lambda w: (F.length(w) > 3) & w.endswith("ly"))), v, th["adverb_per_1k"])


def nominalization(v, th):
    return _density("nominalization_per_1k", "nominalization", T.count(v["m"], NOMINAL), v, th["nominalization_per_1k"])


def rhetorical(v, th):
    return _density("rhetorical_per_1k", "rhetorical", F.size(F.filter(v["s"], lambda s: s.endswith("?"))), v, th["rhetorical_per_1k"])


def colon_summary(v, th):
    heads = "answer|bottom line|catch|key|point|problem|reality|reason|result|short of it|takeaway|truth|upshot"
    def of(f):
        return F.struct(F.size(f).alias("colon_summary"), each_if(F.size(f) >= 3, f, lambda x: hit("colon_summary", F.trim(F.translate(x["text"], "\n", " ")), "vary the lead-in", v["m"], x["start"], basis="metric"), 6).alias("hits"))
    return T.let(T.spans(v["m"], rf"(?iu){R.EDGE}(?:the{S_}+)?(?:{heads}){S_}+(?:here{S_}+)?is:{S_}*[^{R.SPACE}]"), of)


def paragraph_uniformity(v, th):
    def of(n):
        c = T.cov(n)
        return F.struct(c.alias("paragraph_len_cov"), one_if((F.size(n) >= 4) & (c < th["paragraph_cov_floor"]), hit("paragraph_uniformity", F.format_string("paragraph lengths vary by %.2f", c), "vary paragraph lengths")).alias("hits"))
    return T.let(F.transform(T.paragraphs(v["c"]), lambda p: T.count(p, T.WORDS)), of)


def list_uniformity(v, th):
    items = F.filter(T.split(v["c"], "\n"), lambda x: x.rlike(T.LIST))
    def of(n):
        c = T.cov(n)
        return F.struct(c.alias("list_item_cov"), one_if((F.size(n) >= 4) & (c < th["list_item_cov_floor"]), hit("list_uniformity", F.format_string("item lengths vary by %.2f", c), "vary the items")).alias("hits"))
    return T.let(F.filter(F.transform(items, lambda x: T.count(T.without_markup(F.regexp_replace(x, T.LIST, "")), T.WORDS)), lambda n: n > 0), of)


def overlap_of_ends(paragraphs: Column) -> Column:
    """Jaccard of the first and last paragraph's words without stopwords; null for fewer than three paragraphs or an empty end."""
    def words(p):
        return F.array_distinct(F.filter(T.tokens(p), lambda w: ~w.isin(*STOP)))
    def of(p):
        a, b = words(F.element_at(p, 1)), words(F.element_at(p, -1))
        return T.let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), F.size(F.array_intersect(x["a"], x["b"])) / F.size(F.array_union(x["a"], x["b"]))))
    return T.let(paragraphs, lambda p: F.when(F.size(p) >= 3, of(p)))


def circular_conclusion(v, th):
    return T.let(overlap_of_ends(T.paragraphs(v["c"], lists=True, setext=False)), lambda j: F.struct(one_if(j >= 0.5, hit("circular_conclusion", F.format_string("the end repeats the start (%.2f)", j), "end on the last point")).alias("hits")))


def parallel_structure(v, th):
    def of(h):
        third = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i >= 2) & (F.get(h, i) == F.get(h, i - 1)) & (F.get(h, i - 1) == F.get(h, i - 2)) & ~F.coalesce(F.get(h, i - 2) == F.when(i > 2, F.get(h, i - 3)), F.lit(False)))
        return F.when(F.size(h) >= 3, F.transform(third, lambda i: hit("parallel_structure", F.concat(F.lit('three or more sentences begin "'), F.get(h, i), F.lit(' ..."')), "vary the sentences"))).otherwise(none())
    def head(s):
        return T.let(T.tokens(s), lambda w: F.when(F.size(w) >= 2, F.concat_ws(" ", F.get(w, 0), F.get(w, 1))))
    return F.struct(T.let(F.transform(v["s"], head), of).alias("hits"))


def five_paragraph_shape(v, th):
    ends = rf"(?iu)^{S_}*(?:all in all|in (?:closing|conclusion|short|summary)|to (?:conclude|sum up|summari[sz]e)|overall,|ultimately,){R.EDGE}"
    def of(p):
        n = F.size(p)
        return F.struct(n.alias("prose_paragraphs"), one_if((n >= 4) & (n <= 9) & F.element_at(p, -1).rlike(ends), hit("five_paragraph_shape", F.concat(n.cast("string"), F.lit(" paragraphs that close on a summary")), "end on the last point")).alias("hits"))
    return T.let(T.paragraphs(v["c"]), of)


ANSWER = rf"(?iu)^{S_}*(?:because|here'?s why|it'?s{R.EDGE}|no{R.EDGE}|short answer|simple\.|that'?s because|the answer|the reason|turns out|yes{R.EDGE}){R.EDGE}"


def hypophora(v, th):
    def of(s):
        n = F.when(F.size(s) > 1, F.size(F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.get(s, i).endswith("?") & F.get(s, i + 1).rlike(ANSWER)))).otherwise(0)
        return F.struct(n.alias("hypophora"), one_if(n >= 2, hit("hypophora", F.concat(n.cast("string"), F.lit(" questions answered at once")), "state the point")).alias("hits"))
    return T.let(v["s"], of)


SUPERLATIVE = rf"(?iu){R.EDGE}(?:the{S_}+)?(?:" + "|".join(sorted("best biggest fastest finest foremost game-?changing greatest largest most perfect premier ultimate unmatched unparalleled unprecedented world-?class worst".split()) + ["never before", "second to none", "the only"]) + f"){R.EDGE}"


def superlatives(v, th):
    words = F.size(v["w"])
    def of(f):
        rate = per_1k(F.size(f), words)
        fires = (words >= 150) & (rate > th["superlative_per_1k"]) & (F.size(f) >= 3)
        return F.struct(rate.alias("superlative_per_1k"), each_if(fires, f, lambda x: hit("superlative_creep", F.trim(x["text"]), "give the number"), 6).alias("hits"))
    return T.let(F.filter(T.spans(v["m"], SUPERLATIVE), lambda x: ~F.substring(v["m"], x["end"] + 1, F.lit(40)).rlike(r"\d")), of)


def subject_runs(v, th):
    run = T.longest_run(F.transform(v["s"], lambda s: F.coalesce(T.first_word(s).isin(*SUBJECTS), F.lit(False))))
    enough = F.size(v["s"]) >= 8
    return T.let(run, lambda r: F.struct(F.when(enough, r).alias("subject_opener_run"), one_if(enough & (r >= 6), hit("svo_monotony", F.concat(r.cast("string"), F.lit(" sentences in a row begin with a subject")), "break the run")).alias("hits")))


def names(v, th):
    doctors = T.count(v["c"], rf"{R.EDGE}Dr\.{S_}+[A-Z]")
    def of(found):
        def counts(c):
            top = F.array_max(F.transform(c, lambda x: x["n"]))
            who = F.element_at(F.array_sort(F.transform(F.filter(c, lambda x: x["n"] == top), lambda x: F.struct(F.array_position(found, x["value"]), x["value"].alias("w")))), 1)["w"]
            a = one_if(top >= 2, hit("name_selection", F.concat(F.lit('"'), who, F.lit('" '), top.cast("string"), F.lit(" times")), "pick names that fit"))
            b = one_if(doctors >= 3, hit("name_selection", F.concat(doctors.cast("string"), F.lit(" times Dr.")), "use names after the first mention"))
            return F.struct(F.size(found).alias("default_names"), doctors.alias("dr_titles"), F.concat(a, b).alias("hits"))
        return T.let(T.counted(found), counts)
    return T.let(T.extract(v["c"], f"{R.EDGE}(?:Elena|Emily|Jacob|Maya|Michael|Sarah){R.EDGE}"), of)


def over_correction(v, th):
    slang = T.count(v["m"], rf"(?iu){R.EDGE}(?:fr|idk|iirc|imo|lmao|lol|ngl|smh|tbh){R.EDGE}")
    def of(s):
        share = F.size(F.filter(s, lambda c: c.rlike("[a-z]"))) / F.size(s)
        enough = F.size(s) >= 6
        a = one_if(enough & (share >= 0.5), hit("over_correction", F.format_string("%.0f%% of sentences begin in lower case", share * 100), "write in a real register"))
        b = one_if(slang >= 3, hit("over_correction", F.concat(slang.cast("string"), F.lit(" chat words")), "drop them"))
        return F.struct(slang.alias("costume_slang"), F.when(enough, share).alias("lowercase_sentence_share"), F.concat(a, b).alias("hits"))
    return T.let(T.extract(v["m"], rf"(?:\A|[!?.]{S_}+)([A-Za-z])", 1), of)


def dash_style(v, th):
    tight, spaced = T.count(v["a"], f"[{W}]—[{W}]"), T.count(v["a"], f"[{W}]{S_}—{S_}[{W}]")
    mixed = (tight > 0) & (spaced > 0)
    def of(x):
        a = each_if(None, x["d"], lambda y: hit("dash_style", F.coalesce(F.nullif(F.trim(y["text"]), F.lit("")), F.lit("--")), "use a dash", v["a"], y["start"]), 6)
        b = each_if(None, x["h"], lambda y: hit("dash_style", F.trim(F.translate(F.substring(v["a"], F.greatest(y["start"] - 8, F.lit(0)) + 1, y["end"] + 8 - F.greatest(y["start"] - 8, F.lit(0))), "\n", " ")), "a hyphen is no dash", v["a"], y["start"]), 6)
        return F.struct(F.size(x["d"]).alias("dash_ascii_double"), F.size(x["h"]).alias("dash_spaced_hyphen"), mixed.alias("em_dash_spacing_mixed"), F.concat(a, b, one_if(mixed, hit("dash_style", "dashes with and without spaces", "pick one"))).alias("hits"))
    return T.let(F.struct(T.spans(v["a"], rf"{S_}--{S_}|(?<=[{W}])--(?=[{W}])").alias("d"), T.spans(v["a"], r"(?<=[a-z]) - (?=[a-z])").alias("h")), of)


#: [A-Za-z] in any case, one by one: they are looked up at once.
DOUBLED = rf"{R.BEGIN}([{string.ascii_letters}\u017f\u0131\u0130\u212a]{{2,}}+){R.END}[\t ]+(?iu:\1){R.END}"


def doubled_words(v, th):
    found = F.filter(T.spans(v["a"], DOUBLED), lambda x: ~F.lower(F.regexp_extract(x["text"], "^[A-Za-z]+", 0)).isin(*DOUBLE_OK))
    return T.let(found, lambda f: F.struct(F.size(f).alias("doubled_words"), each_if(None, f, lambda x: hit("doubled_word", F.translate(x["text"], "\n", " "), "remove one", v["a"], x["start"]), 8).alias("hits")))


def mechanics(v, th):
    def of(x):
        a = each_if(None, x["p"], lambda y: hit("mechanics", F.trim(F.translate(F.substring(v["a"], F.greatest(y["start"] - 6, F.lit(0)) + 1, y["end"] + 4 - F.greatest(y["start"] - 6, F.lit(0))), "\n", " ")), F.concat(F.lit("no space before "), F.substring(y["text"], -1, 1)), v["a"], y["start"]), 6)
        b = each_if(None, x["r"], lambda y: hit("mechanics", y["text"], "one mark is enough", v["a"], y["start"]), 6)
        return F.struct(F.size(x["p"]).alias("space_before_punct"), F.size(x["r"]).alias("multi_terminal_punct"), F.concat(a, b).alias("hits"))
    return T.let(F.struct(T.spans(v["a"], rf"[{W}][\t ]+[!,:;?]").alias("p"), T.spans(v["a"], r"!{2,}|\?{2,}|[?!]{3,}").alias("r")), of)


def punctuation(v, th):
    n = F.size(v["w"])
    rate = lambda ch: F.when(n > 0, (F.length(v["m"]) - F.length(F.replace(v["m"], F.lit(ch), F.lit("")))) / n * 1000)
    return F.struct(*[rate(ch).alias(f"{k}_per_1k") for k, ch in (("semicolon", ";"), ("colon", ":"), ("question", "?"), ("exclaim", "!"), ("paren", "("))], none().alias("hits"))


#: All checks in report order, with their metrics.
CHECKS = {
    em_dash: "em_dash_per_1k em_dash_count en_dash_count paired_dash_asides", bold_bullets: "bullets bold_lead_bullets", rule_of_three: "", openers: "opener_repeat_ratio opener_entropy",
    wh_openers: "wh_opener_count wh_opener_ratio", formatting: "emoji section_rules", burstiness: "burstiness_cov mean_sentence_len", lexical_diversity: "ttr yules_k", ngram_repetition: "", headings: "",
    colon_summary: "colon_summary", passive_voice: "passive_per_1k", adverbs: "adverb_per_1k", nominalization: "nominalization_per_1k", rhetorical: "rhetorical_per_1k", paragraph_uniformity: "paragraph_len_cov",
    list_uniformity: "list_item_cov", circular_conclusion: "", parallel_structure: "", five_paragraph_shape: "prose_paragraphs", hypophora: "hypophora", superlatives: "superlative_per_1k", subject_runs: "subject_opener_run",
    names: "default_names dr_titles", over_correction: "costume_slang lowercase_sentence_share", dash_style: "dash_ascii_double dash_spaced_hyphen em_dash_spacing_mixed", doubled_words: "doubled_words",
    mechanics: "space_before_punct multi_terminal_punct", punctuation: "semicolon_per_1k colon_per_1k question_per_1k exclaim_per_1k paren_per_1k",
}
