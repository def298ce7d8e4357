"""Rules as data: phrase lists, dialect words, pattern families, weights, mutes and thresholds, with their regular expressions in
the JVM's dialect. Everything is read on the driver and travels inside plans as small literals."""

from __future__ import annotations

import csv
import json
import os
import re
import string
from dataclasses import dataclass, field, replace

HERE = os.path.dirname(os.path.abspath(__file__))
#: What a word character, its edge and white space are in every expression: Unicode's, whatever the JVM's default.
#: Letters, digits and _ (\p{L}\p{N}_); a category is looked up for what isn't ASCII only.
WORD = rf"[{string.digits}{string.ascii_letters}_][\x80-\x{{10ffff}}&&[\p{{L}}\p{{N}}]]"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
#: One-sided edges, for where the side within is a word character anyway.
BEGIN, END = f"(?<![{WORD}])", f"(?![{WORD}])"
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _rows(name: str) -> list[dict]:
    with open(os.path.join(HERE, name), encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))


def quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def phrase_regex(phrase: str) -> str:
    """A phrase as an expression: any white space between its words, edges only next to letters and digits, any case."""
    body = rf"[{SPACE}]+".join(quoted(w) for w in phrase.split(" "))
    return "(?iu)" + (EDGE if phrase[:1].isalnum() else "") + body + (EDGE if phrase[-1:].isalnum() else "")


def _cases(c: str) -> str:
    """A character of a lower-cased phrase, as whatever becomes it when a text is lower-cased."""
    if c == " ":
        return f"[{SPACE}]++"
    both = {c, c.upper()} if len(c.upper()) == 1 else {c}
    both |= {"\u212a"} if c == "k" else set()
    return quoted(c) if len(both) == 1 else "[" + "".join(map(quoted, sorted(both))) + "]"


def any_of(phrases) -> str:
    """One expression for many lower-cased phrases, in any case and with any white space between words: it matches the longest that
    begins at a place. Phrases share their beginnings, so a text is searched once, however many there are."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}
    def of(node: dict) -> str:
        ways = [_cases(c) + of(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return one + "?" * ("" in node)
    return of(tree)


def anchors(phrase: str) -> str | None:
    """The first word of a phrase, which a text must hold if it holds the phrase; None where the left end has no edge."""
    m = re.match(r"[^\W]+", phrase)
    return m[0].lower() if m and phrase[:1].isalnum() else None


def quick(phrase: str) -> str:
    """phrase_regex() for a search: next to a letter or digit an edge is that no word character stands on its other side. The first
    letter is looked for before that."""
    return phrase_regex(phrase).replace("(?iu)" + EDGE, f"(?iu)(?={quoted(phrase[:1])})(?<![{WORD}])").replace(EDGE, f"(?![{WORD}])")


def _any(words: str, tail: str = "") -> str:
    return "(?:" + "|".join(w + tail for w in sorted(words.split())) + ")"


def pattern(short: str, search: bool = False) -> str:
    """Shorthand for the pattern families: ~ white space, < and > edges, @n any text up to n, #n text of one sentence up to n. For a
    search the edges look at one side only, as < stands before and > behind word characters."""
    out = re.sub(r"@(\d+)", r".{1,\1}?", short)
    out = re.sub(r"#(\d+)", r"[^\\n!.?]{1,\1}", out)
    begin, end = (f"(?_![{WORD}])", f"(?![{WORD}])") if search else (EDGE, EDGE)
    return "(?dui)" + out.replace("~", rf"[{SPACE}]+").replace("<", begin).replace(">", end).replace("(?_", "(?<").replace("¤", rf"[{WORD}]")


def needs(short: str) -> list[str]:
    """Words of which a text must hold one to match a pattern: the longest plain alternation or word in it."""
    groups = [g.split("|") for g in re.findall(r"\(\?:([a-z|]+)\)", short)]
    plain = re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", " ", short)
    words = [[w] for w in re.findall(r"(?<![a-z?\]@#0-9¤'])[a-z]{4,}(?![a-z?'+*])", plain)]
    return _HELD.get(short) or max(words + [g for g in groups if min(map(len, g)) >= 3], key=lambda g: min(map(len, g)), default=[])


_BE = "(?:are|is|was|were)"
_WHO = "(?:he|it|she|that|they|this|we)"
_END = "[!.?]~"
PATTERNS = {
    "antithesis": [
        "<not only>@60<but also>", "<it'?s not (?:just|merely|only|simply)>@60,~it'?s>", "<this (?:is not|isn'?t|wasn'?t)>@50,~it'?s>",
        ",~" + _any("demonstrating emphasizing highlighting reflecting reinforcing showcasing underscoring") + "~(?:its|their)~" + _any("ability commitment dedication focus importance role value") + ">",
        "<it'?s not about>@50,?~it'?s about>", "<less about>@40<more about>", f"<forget>#40{_END}(?:here|that|this)'?s>", f"<stop~¤+ing>#40{_END}start~¤+ing>",
        "<while>#40?<might seem>#40?,~¤+~actually>", f"<¤+~is dead{_END}¤+~is the future>", "<whether you(?: are|'?re)>#40?<or>#30?,",
    ],
    "false_agency": [
        "<the~" + _any("algorithm code dashboard data feature market markets metric metrics model number numbers platform process product report software spreadsheet system") + "~" + _any("agree believe care choose decide demand expect feel hope insist know prefer punish realise realize remember reward tell think understand want", "s?") + ">",
        "<the~" + _any("complaint consensus conversation culture decision insight momentum narrative realisation realization truth") + "~(?:becomes?|became|crystalli[sz]es?|emerge(?:d|s)?|move(?:d|s)?|sets~in|shift(?:ed|s)?|takes~hold)>",
        "<(?:a|the)~¤+~lives?~(?:or~dies?|and~dies)>",
        "<(?:an?|my|our|that|the|this|your)~(?:¤+~){0,2}" + _any("brief code complexity config configuration content context conversation deadline knowledge logic magic project state truth value") + "~(?:hides?|lives?|living|lurks?)>",
    ],
    "negative_listing": [f"<{_WHO}~{_BE}(?:~not|n'?t)~#45{_END}{_WHO}~{_BE}(?:~not|n'?t)>", f"<not~(?:about|an?|just|only|the)>#40{_END}not~(?:about|an?|just|only|the)>"],
    "dramatic_fragmentation": [r"<that'?s it\.~that'?s (?:how|our|the|what|why|your)>", r"\.~(?:and|but|or)~¤+\.~(?:and|but|or)~¤+\.", r"<this (?:breaks|changes|fixes|unlocks) (?:everything|something)\.~¤+\."],
}
PATTERNS["false_agency"][2] = "<(?:a|the)~¤+~(?:lives?~or~dies?|lives~and~dies)>"
#: What needs() doesn't see in a pattern.
_HELD = {PATTERNS["false_agency"][2]: ["live"], PATTERNS["negative_listing"][0]: ["not", "n't", "nt"], PATTERNS["negative_listing"][1]: ["not"]}
ADVICE = {
    "antithesis": "say the point itself, without the contrast",
    "false_agency": "name who acts",
    "negative_listing": "say what it is",
    "dramatic_fragmentation": "join the fragments into a sentence",
}
IGNORES_PROTECTED = frozenset({"antithesis"})
CITED, UNQUOTED = frozenset({"vague_attribution"}), frozenset({"redundancy"})

_BY_WEIGHT = {
    4.0: "self_identifying",
    2.0: "aidiolect antithesis bold_bullets burstiness chatbot_scaffold em_dash five_paragraph_shape sycophancy",
    1.5: "circular_conclusion cliche_metaphor false_agency lexical_diversity meta_commentary paragraph_uniformity puffery significance_inflation vague_attribution vague_declarative",
    1.0: "colon_summary cowardly_passive doubled_word filler formatting hedging hypophora internet_tells jargon list_uniformity narrator_distance negative_listing ngram_repetition over_correction parallel_structure redundancy rule_of_three superlative_creep svo_monotony uniform_openers",
    0.5: "adverbs dash_style dialect dramatic_fragmentation heading_case mechanics name_selection nominalization passive_voice rhetorical soft_filler transitions wh_opener",
}
WEIGHTS = {c: w for w, names in _BY_WEIGHT.items() for c in names.split()}
BANDS = (("clean", 5.0), ("watch", 15.0), ("strong-tell", 1e6))
_FICTION = "burstiness dramatic_fragmentation hypophora internet_tells over_correction rhetorical"
MUTES = {
    "technical": "name_selection", "business": "name_selection", "email": "name_selection",
    "marketing": "hypophora name_selection rhetorical superlative_creep",
    "academic": "false_agency five_paragraph_shape hedging name_selection narrator_distance nominalization passive_voice",
    "casual": _FICTION, "creative": _FICTION + " cliche_metaphor dash_style em_dash superlative_creep svo_monotony",
    "release_notes": "burstiness dramatic_fragmentation name_selection", "ux_microcopy": "burstiness dramatic_fragmentation name_selection",
    "tutorial": "five_paragraph_shape hypophora name_selection rhetorical",
}
EXCEPTIONS = (
    "authentication realm", "foundation model", "foundation models", "ibeacon", "in landscape", "kerberos realm", "landscape mode", "landscape orientation", "navigate away", "navigate back",
    "navigate through", "navigate to", "resonant frequency", "security realm", "test harness", "test harnesses", "vital organs", "vital sign", "vital signs", "web beacon",
)
THRESHOLDS = {
    "em_dash_per_1k_words": 1.5, "superlative_per_1k": 12.0, "rhetorical_per_1k": 18.0, "passive_per_1k": 45.0, "adverb_per_1k": 55.0, "nominalization_per_1k": 60.0,
    "list_item_cov_floor": 0.22, "paragraph_cov_floor": 0.3, "ttr_floor": 0.38, "burstiness_cov_floor": 0.4, "uniform_opener_ratio": 0.3, "wh_opener_ratio": 0.3, "wh_opener_run": 3,
    "bold_bullet_ratio": 0.5, "section_rule_max": 2, "ngram_min_count": 4, "ngram_sizes": (2, 3),
}
#: What a comment in a text begins with that exempts lines: <!-- prose-check: ignore filler -->. A project sets its own.
MARKER = "prose-check"
FIXABLE = ("filler", "soft_filler", "jargon", "redundancy")


@dataclass(frozen=True)
class Phrase:
    category: str
    phrase: str
    suggestion: str | None
    regex: str
    anchor: str | None


@dataclass(frozen=True)
class Rules:
    """All that analysis is steered by. `overridden` gives a copy with a project's settings on top."""

    phrases: tuple[Phrase, ...]
    dialect: dict = field(default_factory=dict)
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    bands: tuple = BANDS
    mutes: dict = field(default_factory=lambda: {r: frozenset(v.split()) for r, v in MUTES.items()})
    protected: tuple = EXCEPTIONS
    marker: str = MARKER
    #: Regular expressions by family, in the JVM's dialect, in place of PATTERNS.
    families: dict | None = None

    def overridden(self, settings: dict) -> Rules:
        """Thresholds and weights merge by key (unknown categories are ignored), bands are replaced, protected terms are added."""
        th = {k: float(v) for k, v in settings.get("thresholds", {}).items() if k in self.thresholds and k != "ngram_sizes" and isinstance(v, (int, float))}
        w = {k: float(v) for k, v in settings.get("category_weights", {}).items() if k in self.weights and isinstance(v, (int, float))}
        b = settings.get("score_bands")
        bands = tuple(sorted(((k, float(v)) for k, v in b.items()), key=lambda x: x[1])) if isinstance(b, dict) and b else self.bands
        more = tuple(p for p in [*settings.get("protected_terms", []), *settings.get("context_exceptions", [])] if isinstance(p, str) and p.strip())
        marker = settings.get("directive_marker")
        marker = marker.strip() if isinstance(marker, str) and marker.strip() else self.marker
        return replace(self, marker=marker, thresholds=self.thresholds | th, weights=self.weights | w, bands=bands, protected=self.protected + more)


def phrase_list(value) -> list[tuple[str, str | None]]:
    """Dict, list or string to (phrase, suggestion); anything else is nothing."""
    if isinstance(value, str):
        value = [value]
    if isinstance(value, dict):
        pairs = [(k, v.get("suggestion") if isinstance(v, dict) else v) for k, v in value.items()]
    elif isinstance(value, list):
        pairs = [(v, None) for v in value]
    else:
        return []
    return [(k, s if isinstance(s, str) and s.strip() else None) for k, s in pairs if isinstance(k, str) and k.strip()]


def load() -> Rules:
    seen, out = set(), []
    for r in sorted(_rows("lexicon.tsv"), key=lambda r: (r["category"], int(r["ord"]))):
        key = r["category"], r["phrase"].lower()
        if key not in seen:
            seen.add(key)
            out.append(Phrase(r["category"], r["phrase"], r["suggestion"] or None, phrase_regex(r["phrase"]), anchors(r["phrase"])))
    dialect: dict = {}
    for r in _rows("dialect.tsv"):
        dialect.setdefault(r["dialect"], {})[r["wrong"]] = r["right"]
    return Rules(tuple(out), dialect)


def from_lists(data: dict) -> Rules:
    """Rules of a project's own patterns: an object with a phrase list for a category (object, list or text), lists of expressions
    for a pattern family, `protected_terms`, `dialect` and the settings of overridden(). What is missing is as in load()."""
    base = load()
    lists = {p.category for p in base.phrases}
    own = {c: phrase_list(data[c]) for c in lists if c in data}
    phrases = [p for p in base.phrases if p.category not in own]
    for c in sorted(own):
        seen = set()
        for phrase, suggestion in own[c]:
            if phrase.lower() not in seen:
                seen.add(phrase.lower())
                phrases.append(Phrase(c, phrase, suggestion, phrase_regex(phrase), anchors(phrase)))
    families = {c: tuple(x for x in data[c] if isinstance(x, str) and x) for c in PATTERNS if isinstance(data.get(c), list)}
    dialect = data.get("dialect")
    dialect = {d: {a: b for a, b in w.items() if isinstance(b, str)} for d, w in dialect.items() if isinstance(w, dict)} if isinstance(dialect, dict) else base.dialect
    return replace(base, phrases=tuple(phrases), dialect=dialect, families=families or None).overridden(data)


def find_settings(start: str, name: str = ".inkwellrc") -> dict | None:
    """The settings of the nearest file of that name in the folder of start or above; None without one, or where it isn't an object."""
    at = os.path.abspath(start)
    at = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        path = os.path.join(at, name)
        if os.path.isfile(path):
            try:
                return read_settings(path)
            except (OSError, ValueError):
                return None
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def read_settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path} is not a JSON object")
    return value


def warnings(settings: dict) -> list[str]:
    """What in a project's settings has no effect or isn't understood; never raises."""
    out = []
    for key, known in (("thresholds", THRESHOLDS), ("category_weights", WEIGHTS)):
        value = settings.get(key, {})
        if not isinstance(value, dict):
            out.append(f"{key} should be an object")
            continue
        for k, v in value.items():
            if k not in known:
                out.append(f"{key}: unknown key {k}")
            elif not isinstance(v, (int, float)) or isinstance(v, bool):
                out.append(f"{key}: {k} is not a number")
    if not isinstance(settings.get("score_bands", {}), dict):
        out.append("score_bands should be an object")
    for k in ("protected_terms", "context_exceptions"):
        if not isinstance(settings.get(k, []), list):
            out.append(f"{k} should be a list")
    return out


def severity(weight: float) -> str:
    return "high" if weight >= 2 else "medium" if weight >= 1.5 else "low"
