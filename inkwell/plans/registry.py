"""Named queries over the given tables, and the SQL that gives the same rows.

Queries on `raw` texts see them as they are; those on `probed` texts see each text with one of PROBES behind it, since the given
texts are free of most of the marks that the checks look for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..operators import analysis, checks, hits
from ..sources import documents as sources
from . import evaluation as E

_R = R.load()
PROBES = (
    "Let us delve into the robust tapestry. Moreover, studies show that a seamless plan works! Studies suggest [1] the end result is close proximity.",
    "The dash — long — is here - there and everywhere -- again. Years 10–20 count; 5 – 6 too. word—word and yes — no.",
    "It is what it is. It is what we have. It is what they want. The the cat sat, and and so on.\n\nIn conclusion the cat sat.",
    "# First Big Heading\n\n- **Bold**: one thing here\n- **Bolder**: two things here\n- **Boldest**: three things here\n- plain item of words\n\n# second big heading here\n\n## Third Big Heading\n\n---\n***\n___\n- - -\n",
    "Why does this matter? Because it does. What now? The answer is near. How so? Yes we can !! Really?? Stop ,now.",
    "✨ Great news \U0001f680 for colour and behaviour, not color.organise or ORGANISE or behaviour_x today.",
    "Emily met Sarah. Emily met Dr. Smith and Dr. Jones and Dr. Brown. lol idk tbh this is fr real.",
    "The best plan, the worst plan and the greatest plan by 12 percent. Fast, cheap, and simple things. Quick, dirty, or clean work. See the test harness.",
    "It's not just a tool, it's a way. Not only fast but also cheap. The data tells us. The decision emerges. That's it. That's the trade.",
    "<!-- prose-check: ignore filler -->\nWe delve and leverage here.\nWe leverage there. <!-- prose-check: ignore -->\nWe delve.\n<!-- prose-check: ignore-start jargon -->\nsynergy inside\n<!-- prose-check: ignore-end -->\nsynergy outside\n<!-- prose-check: ignore-start -->\nouter\n<!-- Prose-Check: ignore-start filler, puffery -->\ninner <!-- prose-check: ignore-end --> too\n<!-- prose-check: ignore-end --><!-- prose-check: ignore-end -->\n<!-- prose-check: ignored -->\n<!-- prose-check: ignore-start jargon -->\nleft open",
    "The key is: time. The answer is: money. The point here is: both. It was written and was made and is seen quickly.",
    "As an ai language model, I hope this helps. We may potentially see past history and \"added bonus\" items.\n> the final outcome of it",
    # a phrase of every list
    "; ".join(next(p.phrase for p in _R.phrases if p.category == c) for c in sorted({p.category for p in _R.phrases})) + ".",
)
_REGISTERS = ("technical", "marketing", "academic", "casual", "creative")


#: Documents of fewer bytes are spread over all cores before they are analysed: a small file is one row group, so one task. Larger
#: tables have row groups enough, and aren't shuffled.
SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        d = d.repartition(spark.sparkContext.defaultParallelism, "doc_id") if size < SPREAD_BYTES else d
    return d


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir).select("doc_id", "text")
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.pmod("doc_id", F.lit(len(PROBES))) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), probe).alias("text"))


def raw_views(d: DataFrame) -> DataFrame:
    """The view columns, all of the text as it is."""
    d = d.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumns({k: F.col("t") for k in "cma"})
    return d.withColumns({"w": T.tokens(F.col("m")), "s": T.sentences(F.col("m"))})


def checked(check, use_probes: bool, *columns: str, digits: int | None = None):
    """A query of one check's metrics and its number of hits."""
    def run(spark, sf_dir):
        d = raw_views(probed(spark, sf_dir) if use_probes else table(spark, sf_dir))
        d = d.select("doc_id", check({k: F.col(k) for k in "tcmaws"}, R.THRESHOLDS).alias("x"))
        cell = lambda c: T.rounded(F.col(f"x.{c}"), digits) if digits is not None and dict(d.select("x.*").dtypes)[c] == "double" else F.col(f"x.{c}")
        return d.select("doc_id", *[cell(c).alias(c) for c in columns], F.size("x.hits").alias("n_hits"))
    return run


def _hits(spark, sf_dir, source=None) -> DataFrame:
    """(doc_id, h) of the lexical hits of the probed texts."""
    d = source if source is not None else probed(spark, sf_dir)
    r = R.load()
    d = d.withColumn("p", hits.protected(F.col("text"), r.protected))
    return d.withColumn("hits", hits.phrase_hits(F.col("text"), r, F.col("p")))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


# SQL pieces


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOKENS = r"list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z\-''’]*'), lambda x: lower(x))"
PROBE_SQL = "(SELECT doc_id, coalesce(text, '') || chr(10) || chr(10) || list_extract([" + ", ".join(q(p) for p in PROBES) + f"], (doc_id % {len(PROBES)} + 1)::INT) AS text FROM documents)"
RAW_SQL = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sentence_sql(source: str) -> str:
    """(doc_id, k, s): the sentences of a source."""
    t = r"regexp_replace(text, '(\d)\.(\d)', '\1' || chr(2) || '\2', 'g')"
    t = rf"regexp_replace({t}, '\.{{3,}}', chr(2) || chr(2) || chr(2), 'g')"
    short = "|".join(w.replace(".", r"\.") for w in T._SHORT)
    t = rf"regexp_replace({t}, '(?i)(^|[^\p{{L}}\p{{N}}_])({short})\.', '\1\2' || chr(2), 'g')"
    t = rf"""regexp_replace({t}, '([!?.])[\])"''’”]?{_WS}+(["''(“A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
    return f"(SELECT doc_id, k, trim(replace(s, chr(2), '.'), ' ' || chr(10) || chr(9)) AS s FROM (SELECT doc_id, unnest(string_split({t}, chr(1))) AS s, generate_subscripts(string_split({t}, chr(1)), 1) AS k FROM {source}) WHERE trim(s, ' ' || chr(10) || chr(9)) <> '')"


def opener_sql(source: str) -> str:
    return rf"(SELECT doc_id, k, nullif(lower(regexp_extract(s, '[A-Za-z][A-Za-z\-''’]*')), '') AS o FROM {sentence_sql(source)})"


def words_sql(source: str) -> str:
    return f"(SELECT doc_id, unnest({TOKENS.format('text')}) AS w, generate_subscripts({TOKENS.format('text')}, 1) AS k FROM {source})"


def names_sql(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def run_sql(flag: str) -> str:
    """Longest run of sentences whose opener o fulfils a condition."""
    return f"""SELECT d.doc_id, coalesce(max(c), 0)::INT AS run FROM documents d LEFT JOIN (SELECT doc_id, g, count(*) c FROM
        (SELECT doc_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, f ORDER BY k) AS g FROM (SELECT doc_id, k, coalesce({flag}, false) AS f FROM {opener_sql(RAW_SQL)}))
        WHERE f GROUP BY ALL) USING (doc_id) GROUP BY d.doc_id"""


def count_sql(regex: str, source: str = PROBE_SQL, name: str = "n") -> str:
    return f"SELECT doc_id, len(regexp_extract_all(text, {q(regex)}))::INT AS {name} FROM {source}"


# Words and sentences


@query("token_count", f"SELECT doc_id, len({TOKENS.format('coalesce(text, $$$$)')})::INT AS words FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir).select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("words"))


@query("sentence_count", f"SELECT d.doc_id, count(s)::INT AS sentences FROM documents d LEFT JOIN {sentence_sql(RAW_SQL)} USING (doc_id) GROUP BY d.doc_id")
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir).select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).alias("sentences"))


query("sentence_length_cov", rf"""WITH n AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z][A-Za-z\-''’]*')) AS n FROM {sentence_sql(RAW_SQL)}),
    a AS (SELECT doc_id, count(*) c, stddev_pop(n) / avg(n) v, avg(n) m FROM n WHERE n > 0 GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN c >= 5 THEN round(v, 6) END AS burstiness_cov, coalesce(round(m, 6), 0) AS mean_sentence_len, CASE WHEN c >= 5 AND v < 0.4 THEN 1 ELSE 0 END AS n_hits FROM documents d LEFT JOIN a USING (doc_id)""")(checked(checks.burstiness, False, "burstiness_cov", "mean_sentence_len", digits=6))

query("opener_entropy", f"""WITH c AS (SELECT doc_id, o, count(*) c FROM {opener_sql(RAW_SQL)} WHERE o IS NOT NULL GROUP BY ALL), t AS (SELECT doc_id, sum(c) n, max(c) m FROM c GROUP BY doc_id),
    e AS (SELECT doc_id, -sum(c / n * log2(c / n)) h FROM c JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN n >= 4 THEN round(m / n, 6) ELSE 0 END AS opener_repeat_ratio, CASE WHEN n >= 4 THEN round(h, 6) END AS opener_entropy, CASE WHEN n >= 4 AND m / n >= 0.3 THEN 1 ELSE 0 END AS n_hits
    FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)""")(checked(checks.openers, False, "opener_repeat_ratio", "opener_entropy", digits=6))


@query("wh_opener_runs", run_sql(f"o IN {names_sql(checks.WH)}"))
def wh_opener_runs(spark, sf_dir):
    return checked(checks.wh_openers, False, "wh_opener_run")(spark, sf_dir).select("doc_id", F.col("wh_opener_run").alias("run"))


_SUBJECT_RUN = run_sql(f"o IN {names_sql(checks.SUBJECTS)}")
query("subject_opener_runs", f"""SELECT d.doc_id, CASE WHEN n >= 8 THEN run END AS subject_opener_run, CASE WHEN n >= 8 AND run >= 6 THEN 1 ELSE 0 END AS n_hits
    FROM ({_SUBJECT_RUN}) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {sentence_sql(RAW_SQL)} GROUP BY doc_id) USING (doc_id)""")(checked(checks.subject_runs, False, "subject_opener_run"))


query("parallel_runs", f"""WITH h AS (SELECT doc_id, k, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS h FROM (SELECT doc_id, k, {TOKENS.format('s')} AS w FROM {sentence_sql(PROBE_SQL)})),
    l AS (SELECT doc_id, h, lag(h) OVER w a, lag(h, 2) OVER w b, lag(h, 3) OVER w c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY k))
    SELECT doc_id, count(*) FILTER (h = a AND a = b AND coalesce(b <> c, true))::INT AS n_hits FROM l GROUP BY doc_id""")(checked(checks.parallel_structure, True))


@query("mattr", f"""WITH w AS {words_sql(RAW_SQL)}, p AS (SELECT doc_id, k - 1 AS p, coalesce(lag(k) OVER (PARTITION BY doc_id, w ORDER BY k) - 1, -1) AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM w)
    SELECT doc_id, round(sum(greatest(0, least(p, n - 50) - greatest(prev + 1, p - 49, 0) + 1)) / (50 * (any_value(n) - 49)), 6) AS ttr FROM p WHERE n >= 50 GROUP BY doc_id""")
def mattr(spark, sf_dir):
    return raw_views(table(spark, sf_dir)).select("doc_id", F.explode_outer(F.array(T.rounded(checks.mattr(F.col("w")), 6))).alias("ttr")).filter("ttr is not null")  # the generator keeps the filter above it


@query("yules_k", f"""SELECT doc_id, round(1e4 * (sum(c * c)::DOUBLE - sum(c)) / (sum(c)::DOUBLE * sum(c)), 6) AS yules_k FROM (SELECT doc_id, w, count(*) c FROM {words_sql(RAW_SQL)} GROUP BY ALL) GROUP BY doc_id HAVING sum(c) >= 2""")
def yules_k(spark, sf_dir):
    return raw_views(table(spark, sf_dir)).select("doc_id", F.explode_outer(F.array(T.rounded(checks.yules_k(F.col("w")), 6))).alias("yules_k")).filter("yules_k is not null")  # the generator keeps the filter above it


@query("ngram_repetition", " UNION ALL ".join(f"""SELECT doc_id, {n} AS n, gram, count(*)::INT AS times FROM (SELECT doc_id, {" || ' ' || ".join(f"lead(w, {i}) OVER w" for i in range(n))} AS gram,
    {" AND ".join(f"lead(w, {i}) OVER w IN {names_sql(checks.STOP)}" for i in range(n))} AS stop FROM {words_sql(RAW_SQL)} WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE gram IS NOT NULL AND NOT stop GROUP BY doc_id, gram HAVING count(*) >= 4""" for n in (2, 3)))
def ngram_repetition(spark, sf_dir):
    d = raw_views(table(spark, sf_dir))
    both = F.concat(*[F.transform(checks.repeated_grams(F.col("w"), n, 4), _with_n(n)) for n in (2, 3)])
    return d.select("doc_id", F.explode(both).alias("g")).select("doc_id", "g.n", "g.gram", "g.times")


def _with_n(n: int):
    return lambda x: F.struct(F.lit(n).alias("n"), x["value"].alias("gram"), x["n"].alias("times"))


# Densities and structure

query("adverb_density", f"""SELECT doc_id, CASE WHEN len(w) > 0 THEN round(a / len(w) * 1000, 6) ELSE 0 END AS adverb_per_1k, CASE WHEN len(w) >= 150 AND a >= 3 AND a / len(w) * 1000 > 55 THEN 1 ELSE 0 END AS n_hits
    FROM (SELECT doc_id, {TOKENS.format('text')} AS w, len(list_filter({TOKENS.format('text')}, lambda x: len(x) > 3 AND suffix(x, 'ly'))) AS a FROM {RAW_SQL})""")(checked(checks.adverbs, False, "adverb_per_1k", digits=6))

_WORD = r"[\p{L}\p{N}_]"
query("nominalization_density", rf"""SELECT doc_id, CASE WHEN n > 0 THEN round(c / n * 1000, 6) ELSE 0 END AS nominalization_per_1k, CASE WHEN n >= 150 AND c >= 3 AND c / n * 1000 > 60 THEN 1 ELSE 0 END AS n_hits
    FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n, len(list_filter(regexp_extract_all(text, '{_WORD}+'), lambda x: regexp_full_match(x, '(?i){_WORD}{{4,}}(ance|ence|isation|ity|ization|ment|tion)s?'))) AS c FROM {RAW_SQL})""")(checked(checks.nominalization, False, "nominalization_per_1k", digits=6))

_PARTS = "|".join(sorted("built chosen done drawn found given grown held kept known lost made met paid put read seen sent set shown taken told won written".split()))
query("passive_density", rf"""SELECT doc_id, CASE WHEN n > 0 THEN round(c / n * 1000, 6) ELSE 0 END AS passive_per_1k, CASE WHEN n >= 150 AND c >= 3 AND c / n * 1000 > 45 THEN 1 ELSE 0 END AS n_hits
    FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n, len(regexp_extract_all(text, '(?i)\b(are|be|been|being|gets|got|is|was|were){_WS}+({_WORD}+ly{_WS}+)?({_WORD}+ed|{_PARTS})\b')) AS c FROM {PROBE_SQL})""")(checked(checks.passive_voice, True, "passive_per_1k", digits=6))



def markup_sql(x: str) -> str:
    """A line without links, addresses, footnotes, tags and emphasis."""
    for regex, to in ((r"!?\[([^\]]*)\]\([^)]+\)", r"\1"), (rf"(?:www\.|(?:ftp|https?)://)[^{_WS[1:-1]}]+", " "), (r"\[\^[^\]]+\]", " "), (r"<[^\n>]+>", " "), (r"\*{1,3}|_{1,3}|~~", "")):
        x = f"regexp_replace({x}, {q(regex)}, {q(to)}, 'g')"
    return x


def paragraphs_sql(structure: str) -> str:
    """List of paragraphs of text: blocks between blank lines, without lines of the given structure and rules."""
    lines = rf"list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '{structure}') AND NOT regexp_matches(regexp_replace(x, '[\t ]', '', 'g'), '^(-{{3,}}|_{{3,}}|\*{{3,}})$'))"
    return rf"list_filter(list_transform(regexp_split_to_array(text, '\n[\t ]*\n'), lambda b: trim({markup_sql(f'array_to_string({lines}, chr(32))')})), lambda p: regexp_matches(p, '[A-Za-z]'))"


_PROSE = r"^[\t ]*#{1,6}[\t ]+|^[\t ]*\||^[\t ]*(?:-+|=+)[\t ]*$|^[\t ]*(?:\d+[.)]|[-+*])[\t ]+"
_LEN = r"lambda p: len(regexp_extract_all(p, '[A-Za-z][A-Za-z\-''’]*'))"
query("paragraph_cov", f"""SELECT doc_id, CASE WHEN len(p) >= 2 THEN round(list_stddev_pop(p) / list_avg(p), 6) END AS paragraph_len_cov, CASE WHEN len(p) >= 4 AND list_stddev_pop(p) / list_avg(p) < 0.3 THEN 1 ELSE 0 END AS n_hits
    FROM (SELECT doc_id, list_transform({paragraphs_sql(_PROSE)}, {_LEN}) AS p FROM {PROBE_SQL})""")(checked(checks.paragraph_uniformity, True, "paragraph_len_cov", digits=6))


_CONTENT = "list_distinct(list_filter(" + TOKENS.format("{}") + f", lambda w: w NOT IN {names_sql(checks.STOP)}))"


query("circular_conclusion", f"""WITH p AS (SELECT doc_id, {paragraphs_sql(_PROSE.split('|^[\\t ]*(?:-+')[0])} AS p FROM {PROBE_SQL}), e AS (SELECT doc_id, len(p) AS n, {_CONTENT.format('p[1]')} AS a, {_CONTENT.format('p[-1]')} AS b FROM p)
    SELECT doc_id, CASE WHEN n >= 3 AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.5 THEN 1 ELSE 0 END AS n_hits FROM e""")(checked(checks.circular_conclusion, True))


_MARKS = {"semicolon": ";", "colon": ":", "question": "?", "exclaim": "!", "paren": "("}
query("punctuation_profile", "SELECT doc_id, " + ", ".join(f"CASE WHEN n > 0 THEN round((len(text) - len(replace(text, '{c}', ''))) / n * 1000, 6) END AS {k}_per_1k" for k, c in _MARKS.items()) + f", 0 AS n_hits FROM (SELECT *, len({TOKENS.format('text')}) AS n FROM {PROBE_SQL})")(checked(checks.punctuation, True, *[f"{k}_per_1k" for k in _MARKS], digits=6))

_MULTI = r"(?i)(?:!{2,}|\?{2,}|[?!]{3,})"
query("mechanics", f"SELECT doc_id, p AS space_before_punct, r AS multi_terminal_punct, least(p, 6) + least(r, 6) AS n_hits FROM (SELECT doc_id, len(regexp_extract_all(text, {q(_WORD + '[' + chr(9) + ' ]+[!,:;?]')}))::INT AS p, len(regexp_extract_all(text, {q(_MULTI)}))::INT AS r FROM {PROBE_SQL})")(checked(checks.mechanics, True, "space_before_punct", "multi_terminal_punct"))

query("emoji_and_rules", rf"""SELECT doc_id, e::INT AS emoji, r::INT AS section_rules, (CASE WHEN e > 0 THEN 1 ELSE 0 END + least(greatest(r - 2, 0), 6))::INT AS n_hits FROM (SELECT doc_id,
    len(regexp_extract_all(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2700}}-\x{{27BF}}\x{{1F1E6}}-\x{{1F1FF}}\x{{FE0F}}]')) AS e, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(regexp_replace(x, '[\t ]', '', 'g'), '^(-{{3,}}|_{{3,}}|\*{{3,}})$'))) AS r FROM {PROBE_SQL})""")(checked(checks.formatting, True, "emoji", "section_rules"))

query("bold_bullets", rf"""SELECT doc_id, a AS bullets, b AS bold_lead_bullets, CASE WHEN b >= 3 AND b / a >= 0.5 THEN least(b, 8) ELSE 0 END::INT AS n_hits FROM (SELECT doc_id, len(regexp_extract_all(text, '(?m)^[\t ]*[-+*][\t ]+\S'))::INT AS a,
    len(regexp_extract_all(text, '(?m)^[\t ]*[-+*][\t ]+(__[^\n_]+__|\*\*[^\n*]+\*\*)'))::INT AS b FROM {PROBE_SQL})""")(checked(checks.bold_bullets, True, "bullets", "bold_lead_bullets"))

query("colon_summary", rf"""SELECT doc_id, n AS colon_summary, CASE WHEN n >= 3 THEN least(n, 6) ELSE 0 END::INT AS n_hits FROM ({count_sql(rf"(?i)\b(?:the{_WS}+)?(?:answer|bottom line|catch|key|point|problem|reality|reason|result|short of it|takeaway|truth|upshot){_WS}+(?:here{_WS}+)?is:\s*\S")})""")(checked(checks.colon_summary, True, "colon_summary"))

query("stock_names", rf"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '\b(Elena|Emily|Jacob|Maya|Michael|Sarah)\b') AS n, len(regexp_extract_all(text, '\bDr\.{_WS}+[A-Z]')) AS d FROM {PROBE_SQL})
    SELECT doc_id, len(n)::INT AS default_names, d::INT AS dr_titles, (CASE WHEN len(n) > 0 AND list_max(map_values(list_histogram(n))) >= 2 THEN 1 ELSE 0 END + CASE WHEN d >= 3 THEN 1 ELSE 0 END)::INT AS n_hits FROM x""".replace("list_histogram(n)", "list_aggregate(n, 'histogram')"))(checked(checks.names, True, "default_names", "dr_titles"))

query("chat_slang", rf"""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(fr|idk|iirc|imo|lmao|lol|ngl|smh|tbh)\b')) AS c, regexp_extract_all(text, '(\A|[!?.]{_WS}+)([A-Za-z])', 2) AS s FROM {PROBE_SQL}),
    y AS (SELECT *, len(list_filter(s, lambda c: c BETWEEN 'a' AND 'z')) / len(s) AS h FROM x)
    SELECT doc_id, c::INT AS costume_slang, CASE WHEN len(s) >= 6 THEN round(h, 6) END AS lowercase_sentence_share, (CASE WHEN c >= 3 THEN 1 ELSE 0 END + CASE WHEN len(s) >= 6 AND h >= 0.5 THEN 1 ELSE 0 END)::INT AS n_hits FROM y""")(checked(checks.over_correction, True, "costume_slang", "lowercase_sentence_share", digits=6))

query("hypophora", rf"""WITH s AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM {sentence_sql(PROBE_SQL)}),
    x AS (SELECT doc_id, count(*) FILTER (suffix(s, '?') AND regexp_matches(nxt, '(?i)^\s*(because|here''?s why|it''?s\b|no\b|short answer|simple\.|that''?s because|the answer|the reason|turns out|yes\b)\b')) AS n FROM s GROUP BY doc_id)
    SELECT doc_id, n::INT AS hypophora, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS n_hits FROM x""")(checked(checks.hypophora, True, "hypophora"))

query("doubled_words", rf"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[\t ]+|[^\p{{L}}\p{{N}}_\t ]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[\t ]+|[^\p{{L}}\p{{N}}_\t ]+'), 1) AS k FROM {PROBE_SQL}),
    y AS (SELECT doc_id, k, p, lead(p) OVER w AS gap, lead(p, 2) OVER w AS nxt FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
    z AS (SELECT *, coalesce(regexp_full_match(p, '[A-Za-z]{{2,}}') AND regexp_full_match(gap, '[\t ]+') AND lower(p) = lower(nxt), false) AS hit FROM y),
    r AS (SELECT doc_id, k, p, k - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM z WHERE hit),
    u AS (SELECT doc_id, lower(p) AS p, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS i FROM r),
    c AS (SELECT doc_id, count(*) AS n FROM u WHERE i % 2 = 1 AND p NOT IN {names_sql(checks.DOUBLE_OK)} GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::INT AS doubled_words, least(coalesce(n, 0), 8)::INT AS n_hits FROM documents d LEFT JOIN c USING (doc_id)""")(checked(checks.doubled_words, True, "doubled_words"))

for _name, _check, _cols in (("em_dash_density", checks.em_dash, ("em_dash_count", "en_dash_count", "paired_dash_asides")), ("dash_style", checks.dash_style, ("dash_ascii_double", "dash_spaced_hyphen", "em_dash_spacing_mixed")), ("heading_case", checks.headings, ()), ("rule_of_three", checks.rule_of_three, ()), ("five_paragraph", checks.five_paragraph_shape, ("prose_paragraphs",)), ("superlatives", checks.superlatives, ("superlative_per_1k",)), ("rhetorical_density", checks.rhetorical, ("rhetorical_per_1k",))):
    query(_name)(checked(_check, True, *_cols))
query("list_uniformity")(checked(checks.list_uniformity, True, "list_item_cov", digits=6))

SQL["dash_style"] = rf"""SELECT doc_id, a::INT AS dash_ascii_double, h::INT AS dash_spaced_hyphen, t > 0 AND s > 0 AS em_dash_spacing_mixed, (least(a, 6) + least(h, 6) + CASE WHEN t > 0 AND s > 0 THEN 1 ELSE 0 END)::INT AS n_hits FROM (SELECT doc_id,
    len(regexp_extract_all(text, '{_WS}--{_WS}|{_WORD}--{_WORD}')) AS a, len(regexp_extract_all(text, '[a-z] - [a-z]')) AS h, len(regexp_extract_all(text, '{_WORD}—{_WORD}')) AS t, len(regexp_extract_all(text, '{_WORD}{_WS}—{_WS}{_WORD}')) AS s FROM {PROBE_SQL})"""
_DASH_SQL = rf"""(SELECT *, em + en AS n FROM (SELECT doc_id, len({TOKENS.format('text')}) AS words, len(text) - len(replace(text, '—', '')) + len(regexp_extract_all(text, '{_WS}--{_WS}')) + len(regexp_extract_all(text, '{_WORD}--{_WORD}')) AS em,
    len(text) - len(replace(text, '–', '')) - len(regexp_extract_all(text, '[0-9]{_WS}{{0,4}}–{_WS}{{0,4}}[0-9]')) AS en, len(regexp_extract_all(text, '[—–]{_WS}?[^—–\n]{{1,50}}?{_WS}?[—–]')) AS pairs FROM {PROBE_SQL}))"""
SQL["em_dash_density"] = f"""SELECT doc_id, em::INT AS em_dash_count, en::INT AS en_dash_count, pairs::INT AS paired_dash_asides, CASE WHEN words > 0 AND n / words * 1000 > 1.5 AND n >= 2 THEN least(n, 8) WHEN pairs >= 2 THEN least(pairs, 6) ELSE 0 END::INT AS n_hits FROM {_DASH_SQL}"""
SQL["list_uniformity"] = rf"""SELECT doc_id, CASE WHEN len(n) >= 2 THEN round(list_stddev_pop(n) / list_avg(n), 6) END AS list_item_cov, CASE WHEN len(n) >= 4 AND list_stddev_pop(n) / list_avg(n) < 0.22 THEN 1 ELSE 0 END AS n_hits FROM (SELECT doc_id,
    list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\t ]*(?:\d+[.)]|[-+*])[\t ]+')), lambda x: len(regexp_extract_all({markup_sql("regexp_replace(x, '^[\\t ]*(?:[0-9]+[.)]|[-+*])[\\t ]+', '')")}, '[A-Za-z][A-Za-z\-''’]*'))), lambda n: n > 0) AS n FROM {PROBE_SQL})"""
SQL["heading_case"] = rf"""WITH h AS (SELECT doc_id, k, regexp_replace(trim(regexp_replace(line, '^[\t ]*#{{1,6}}[\t ]+', '')), '[\t ]*#*$', '') AS title FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {PROBE_SQL}) WHERE regexp_matches(line, '^[\t ]*#{{1,6}}[\t ]+[^\n]+$')),
    w AS (SELECT doc_id, k, list_filter(regexp_split_to_array(title, '{_WS}+'), lambda w: regexp_matches(w, '\p{{L}}')) AS w FROM h), c AS (SELECT doc_id, k, len(list_filter(w, lambda w: regexp_matches(w, '^\p{{Lu}}'))) >= greatest(2, len(w) - 1) AS up FROM w WHERE len(w) >= 2),
    n AS (SELECT doc_id, count(*) FILTER (up) AS a, count(*) FILTER (NOT up) AS b, arg_min(up, k) AS first FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(CASE WHEN a = b THEN a ELSE least(a, b) END, 0)::INT AS n_hits FROM documents d LEFT JOIN n USING (doc_id)"""
SQL["rhetorical_density"] = f"""SELECT d.doc_id, CASE WHEN n > 0 THEN coalesce(r, 0) / n * 1000 ELSE 0 END AS rhetorical_per_1k, CASE WHEN n >= 150 AND r >= 3 AND r / n * 1000 > 18 THEN 1 ELSE 0 END AS n_hits FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM {PROBE_SQL}) d
    LEFT JOIN (SELECT doc_id, count(*) FILTER (suffix(s, '?')) AS r FROM {sentence_sql(PROBE_SQL)} GROUP BY doc_id) USING (doc_id)"""
SQL["five_paragraph"] = rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[\t ]*\n'), lambda b: trim(array_to_string(list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '^[\t ]*#{{1,6}}[\t ]+|^[\t ]*(?:-+|=+)[\t ]*$|^[\t ]*\||^[\t ]*(?:\d+[.)]|[-+*])[\t ]+') AND NOT regexp_matches(regexp_replace(x, '[\t ]', '', 'g'), '^(-{{3,}}|_{{3,}}|\*{{3,}})$')), ' '))), lambda p: regexp_matches(regexp_replace(p, '<[^\n>]+>', ' ', 'g'), '[A-Za-z]')) AS p FROM {PROBE_SQL})
    SELECT doc_id, len(p)::INT AS prose_paragraphs, CASE WHEN len(p) BETWEEN 4 AND 9 AND regexp_matches(p[-1], '(?i)^\s*(all in all|in (closing|conclusion|short|summary)|to (conclude|sum up|summari[sz]e)|overall,|ultimately,)\b') THEN 1 ELSE 0 END AS n_hits FROM p"""

# Lexical hits


def _re2(regex: str) -> str:
    return regex.replace("(?iu)", "(?i)").replace(R.EDGE, r"\b").replace(f"[{R.SPACE}]", _WS)


LEXICON_SQL = "(VALUES " + ", ".join(f"({q(p.category)}, {q(p.phrase)}, {q(p.anchor or '')}, {q(_re2(p.regex))}, {_R.weights.get(p.category, 1.0)})" for p in _R.phrases) + ") AS lexicon(category, phrase, anchor, regex, weight)"
_EXCEPT = r"(?i)\b(?:" + "|".join(sorted(_R.protected, key=lambda p: (-len(p), p))).replace(" ", _WS + "+") + r")\b"
PHRASE_SQL = f"""(SELECT doc_id, category, phrase, weight, regexp_extract_all(text, regex) AS found FROM (SELECT doc_id, regexp_replace(text, {q(_EXCEPT)}, '§', 'g') AS text, lower(text) AS low FROM {PROBE_SQL}), {LEXICON_SQL}
    WHERE category NOT IN ('vague_attribution', 'redundancy') AND contains(low, anchor) AND len(regexp_extract_all(text, regex)) > 0)"""


_PLAIN = sorted({p.category for p in _R.phrases} - {"vague_attribution", "redundancy"})


def _plain(h):
    return ~h["category"].isin("vague_attribution", "redundancy")


@query("lexicon_hits", f"SELECT doc_id, category, lower(unnest(found)) AS text FROM {PHRASE_SQL}")
def lexicon_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.explode(F.filter("hits", _plain)).alias("h")).select("doc_id", "h.category", F.lower("h.text").alias("text"))


@query("lexicon_hits_by_category", f"SELECT category, count(DISTINCT doc_id) AS documents, sum(len(found))::BIGINT AS hits FROM {PHRASE_SQL} GROUP BY category")
def lexicon_hits_by_category(spark, sf_dir):
    x = _hits(spark, sf_dir).select("doc_id", F.explode(F.filter("hits", _plain)).alias("h"))
    return x.groupBy("h.category").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("hits"))


_VAGUE = "(VALUES " + ", ".join(f"({q(_re2(p.regex))})" for p in _R.phrases if p.category == "vague_attribution") + ") AS v(regex)"
_CITE = r"\[\^?\d|\(\d{4}\)|\(" + _WS + r"*[A-Z][\p{L}\p{N}_\-&.]+,?" + _WS + r"*(?:et al\.?,?" + _WS + r"*)?\d{4}|doi:|https?://"


@query("vague_attribution", f"""WITH m AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?s)(' || regex || ')(.{{0,45}})', 1))) AS text, unnest(regexp_extract_all(text, '(?s)(' || regex || ')(.{{0,45}})', 2)) AS after FROM {PROBE_SQL}, {_VAGUE})
    SELECT doc_id, text FROM m WHERE NOT regexp_matches(after, {q(_CITE)})""")
def vague_attribution(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.explode(F.filter("hits", lambda h: h["category"] == "vague_attribution")).alias("h")).select("doc_id", F.lower("h.text").alias("text"))


_REDUNDANT = "(VALUES " + ", ".join(f"({q(_re2(p.regex))})" for p in _R.phrases if p.category == "redundancy") + ") AS v(regex)"


@query("redundancy_unquoted", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {PROBE_SQL}), m AS (SELECT doc_id, line, unnest(regexp_extract_all(line, '(?s)^(.*?)(' || regex || ')', 1)) AS before, unnest(regexp_extract_all(line, '(?s)^(.*?)(' || regex || ')', 2)) AS text FROM l, {_REDUNDANT})
    SELECT doc_id, lower(text) AS text FROM m WHERE (len(before) - len(replace(before, '"', ''))) % 2 = 0 AND NOT regexp_matches(line, '^[\\t ]*(#{{1,6}}[\\t ]+|>+)')""")
def redundancy_unquoted(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.explode(F.filter("hits", lambda h: h["category"] == "redundancy")).alias("h")).select("doc_id", F.lower("h.text").alias("text"))


_FAMILIES = "(VALUES " + ", ".join(f"({q(c)}, {q(_re2(R.pattern(p)).replace('(?dui)', '(?i)').replace(f'[{R.WORD}]', _WORD))})" for c, f in R.PATTERNS.items() for p in f) + ") AS f(category, regex)"


@query("pattern_hits", f"SELECT doc_id, category, unnest(regexp_extract_all(CASE WHEN category IN {names_sql(R.IGNORES_PROTECTED)} THEN text ELSE regexp_replace(text, {q(_EXCEPT)}, '§', 'g') END, regex)) AS text FROM {PROBE_SQL}, {_FAMILIES}")
def pattern_hits(spark, sf_dir):
    d = probed(spark, sf_dir).withColumn("p", hits.protected(F.col("text"), _R.protected))
    x = d.select("doc_id", "text", F.explode(hits.pattern_hits(F.col("text"), F.col("p"))).alias("h"))
    return x.select("doc_id", "h.category", F.substring("text", F.col("h.start") + 1, F.col("h.end") - F.col("h.start")).alias("text"))


_BRITISH = _R.dialect["american"]


@query("dialect_drift", rf"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS k FROM {PROBE_SQL}),
    y AS (SELECT doc_id, p, lag(p) OVER w AS a, lead(p) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k))
    SELECT doc_id, p AS text FROM y WHERE lower(p) IN {names_sql(_BRITISH)} AND upper(p) <> p AND a IS NOT NULL AND b IS NOT NULL AND right(a, 1) NOT IN ('.', '$') AND b[1] NOT IN ('.', '(')""")
def dialect_drift(spark, sf_dir):
    x = probed(spark, sf_dir).select("doc_id", F.explode(hits.dialect_hits(F.col("text"), F.lit("american"), _R)).alias("h"))
    return x.select("doc_id", "h.text")


# Suppression and scores

_REGISTER = f"list_extract([{', '.join(q(r) for r in _REGISTERS)}], (doc_id % {len(_REGISTERS)} + 1)::INT)"
_MUTE_SQL = "(VALUES " + ", ".join(f"({q(r)}, {q(c)})" for r in _REGISTERS for c in sorted(_R.mutes[r])) + ") AS mute(register, category)"


def registered(d: DataFrame) -> DataFrame:
    return d.withColumn("register", F.element_at(F.array(*map(F.lit, _REGISTERS)), (F.pmod("doc_id", F.lit(len(_REGISTERS))) + 1).cast("int")))


@query("muted_hits", f"SELECT register, category, sum(len(found))::BIGINT AS hits FROM (SELECT *, {_REGISTER} AS register FROM {PHRASE_SQL}) WHERE (register, category) NOT IN (SELECT register, category FROM {_MUTE_SQL}) GROUP BY ALL")
def muted_hits(spark, sf_dir):
    d = registered(_hits(spark, sf_dir)).withColumn("muted", analysis.muted(F.col("register"), _R))
    x = d.select("register", F.explode(F.filter("hits", lambda h: _plain(h) & ~F.array_contains("muted", h["category"]))).alias("h"))
    return x.groupBy("register", "h.category").agg(F.count("*").alias("hits"))


@query("directive_lines")
def directive_lines(spark, sf_dir):
    x = probed(spark, sf_dir).select("doc_id", F.explode(analysis.directives(F.col("text"))).alias("d"))
    return x.select("doc_id", "d.first", "d.last", F.array_join("d.categories", ",").alias("categories"))


_DIRECTIVE = rf"(?i)<!--{_WS}*{_R.marker}:{_WS}*(ignore-start|ignore-end|ignore)\b([^>]*?)-->"
#: Events in order; an end closes the last start of its level, levels begin anew below an end that closes nothing.
SQL["directive_lines"] = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {PROBE_SQL}),
    e AS (SELECT doc_id, k, line, unnest(regexp_extract_all(line, {q(_DIRECTIVE)}, 0)) AS whole, lower(unnest(regexp_extract_all(line, {q(_DIRECTIVE)}, 1))) AS kind, unnest(regexp_extract_all(line, {q(_DIRECTIVE)}, 2)) AS said, generate_subscripts(regexp_extract_all(line, {q(_DIRECTIVE)}), 1) AS j FROM l),
    c AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(said, '[,\s]+'), lambda x: x <> ''), ',') AS categories, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i FROM e),
    s AS (SELECT *, sum(CASE kind WHEN 'ignore-start' THEN 1 WHEN 'ignore-end' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM c),
    m AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS m FROM s),
    v AS (SELECT *, s - m AS level, coalesce(lag(s) OVER w, 0) - coalesce(lag(m) OVER w, 0) AS before FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, CASE WHEN trim(replace(line, whole, '')) = '' THEN k + 1 ELSE k END::INT AS first, CASE WHEN trim(replace(line, whole, '')) = '' THEN k + 1 ELSE k END::INT AS last, categories FROM v WHERE kind = 'ignore'
    UNION ALL SELECT z.doc_id, max_by(a.k, a.i)::INT, any_value(z.k)::INT, max_by(a.categories, a.i) FROM v z JOIN v a ON a.doc_id = z.doc_id AND a.kind = 'ignore-start' AND a.i < z.i AND a.level = z.before WHERE z.kind = 'ignore-end' AND z.before > 0 GROUP BY z.doc_id, z.i"""

_LEX_SCORE = f"""(SELECT d.doc_id, n AS words, coalesce(sum(weight * len(found)), 0) AS points, coalesce(sum(len(found)), 0) AS hits FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM {PROBE_SQL}) d LEFT JOIN {PHRASE_SQL} USING (doc_id) GROUP BY ALL)"""


@query("lexical_scorecard", f"WITH x AS (SELECT *, CASE WHEN words > 0 THEN round_even(points / words * 1000, 1) ELSE 0 END AS score FROM {_LEX_SCORE}) SELECT doc_id, words::INT AS words, hits::INT AS hits, score, CASE WHEN score < 5 THEN 'clean' WHEN score < 15 THEN 'watch' ELSE 'strong-tell' END AS verdict FROM x")
def lexical_scorecard(spark, sf_dir):
    d = _hits(spark, sf_dir).select("doc_id", F.filter("hits", _plain).alias("found"), F.size(T.tokens(F.col("text"))).alias("words"))
    d = d.withColumn("score", analysis.score_of(F.col("found"), F.col("words"), _R))
    return d.select("doc_id", "words", F.size("found").alias("hits"), "score", analysis.verdict_of(F.col("score"), _R).alias("verdict"))


@query("verdict_counts", f"SELECT verdict, count(*) AS documents, sum(words)::BIGINT AS words FROM ({SQL['lexical_scorecard']}) GROUP BY ROLLUP (verdict)")
def verdict_counts(spark, sf_dir):
    return lexical_scorecard(spark, sf_dir).rollup("verdict").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


@query("scorecard")
def scorecard(spark, sf_dir):
    """The full analysis of the documents; its results are held against labelled files in tests."""
    d = analysis.analyze(registered(probed(spark, sf_dir)), _R)
    return d.select("doc_id", "register", "words", "sentences", "score", "verdict", "metrics.*", F.size("hits").alias("n_hits"))


@query("all_hits")
def all_hits(spark, sf_dir):
    return analysis.long_hits(analysis.analyze(probed(spark, sf_dir), _R), rules=_R)


@query("line_hotspots")
def line_hotspots(spark, sf_dir):
    d = analysis.analyze(probed(spark, sf_dir), _R)
    return d.select("doc_id", F.explode(analysis.hotspots(d)).alias("x")).select("doc_id", "x.line", "x.n")


@query("text_views")
def text_views(spark, sf_dir):
    return T.views(probed(spark, sf_dir)).select("doc_id", "c", "m", "a")


@query("fixed_texts")
def fixed_texts(spark, sf_dir):
    return analysis.autofix(probed(spark, sf_dir), _R).select("doc_id", "fixed", "swaps", "emoji", "dashes")


@query("json_payload")
def json_payload(spark, sf_dir):
    d = analysis.analyze(probed(spark, sf_dir), _R)
    return d.select("doc_id", sources.payload(d, rules=_R).alias("payload"))


@query("sarif_results")
def sarif_results(spark, sf_dir):
    return sources.sarif_results(analysis.analyze(probed(spark, sf_dir), _R), rules=_R)


# The score as a classifier: words a sentence against the quality labels

_LABELLED = f"(SELECT quality = 1 AS label, lang, score FROM (SELECT doc_id, round(n / greatest(s, 1), 3) AS score, lang FROM (SELECT d.doc_id, d.lang, len({TOKENS.format('text')}) AS n, len(regexp_extract_all(text, '[.!?]')) AS s FROM documents d)) JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir).select("doc_id", "lang", T.rounded(F.size(T.tokens(F.col("text"))) / F.greatest(T.count(F.col("text"), "[.!?]"), F.lit(1)), 3).alias("score"))
    y = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") == 1).alias("label"))
    # thresholds, sums and counts read it again and again: the texts are read once, and a row is kept as a few numbers
    return d.join(y, "doc_id").select("label", "lang", "score").persist()


def _counts_sql(source: str, th: str, by: str = "") -> str:
    return f"SELECT {by + ', ' if by else ''}count(*) FILTER (score >= {th} AND label) AS tp, count(*) FILTER (score >= {th} AND NOT label) AS fp, count(*) FILTER (score < {th} AND NOT label) AS tn, count(*) FILTER (score < {th} AND label) AS fn FROM {source}" + (f" GROUP BY {by}" if by else "")


_METRICS_SQL = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, (tp + tn) / (tp + fp + tn + fn) AS accuracy, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1"
_AUC_SQL = "sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*)"
_THRESHOLDS_SQL = f"""(SELECT DISTINCT threshold FROM (SELECT score AS threshold FROM {_LABELLED} UNION ALL SELECT floor((score + lead(score) OVER (ORDER BY score)) / 2 * 1000 + 0.5) / 1000 FROM (SELECT DISTINCT score FROM {_LABELLED}) UNION ALL SELECT min(score) - 0.1 FROM {_LABELLED} UNION ALL SELECT max(score) + 0.1 FROM {_LABELLED}) WHERE threshold >= 0)"""


@query("confusion_at_threshold", f"SELECT *, {_METRICS_SQL} FROM ({_counts_sql(_LABELLED, '8')})")
def confusion_at_threshold(spark, sf_dir):
    return E.with_metrics(E.confusion(labelled(spark, sf_dir), 8.0))


_SWEEP = _counts_sql(f"{_LABELLED}, {_THRESHOLDS_SQL} AS th", "threshold", "threshold")


@query("threshold_sweep", f"SELECT *, {_METRICS_SQL} FROM ({_SWEEP})")
def threshold_sweep(spark, sf_dir):
    return E.sweep(labelled(spark, sf_dir))


@query("best_threshold", f"SELECT *, {_METRICS_SQL} FROM ({_SWEEP}) ORDER BY f1 DESC, fpr, accuracy DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return E.best_threshold(labelled(spark, sf_dir))


@query("roc_auc", f"SELECT round({_AUC_SQL}, 9) AS auc FROM (SELECT * FROM {_LABELLED} WHERE label) p, (SELECT * FROM {_LABELLED} WHERE NOT label) n")
def roc_auc(spark, sf_dir):
    return E.auc(labelled(spark, sf_dir)).select(T.rounded(F.col("auc"), 9).alias("auc"))


@query("metrics_by_group", f"""SELECT c.*, {_METRICS_SQL}, auc, auc IS NULL AS single_class FROM ({_counts_sql(_LABELLED, '8', 'lang')}) c LEFT JOIN
    (SELECT p.lang, round({_AUC_SQL}, 9) AS auc FROM (SELECT * FROM {_LABELLED} WHERE label) p JOIN (SELECT * FROM {_LABELLED} WHERE NOT label) n USING (lang) GROUP BY p.lang) USING (lang)""")
def metrics_by_group(spark, sf_dir):
    return E.by_group(labelled(spark, sf_dir), "lang", 8.0).withColumn("auc", T.rounded(F.col("auc"), 9))


@query("false_positive_rate", f"SELECT lang, count(*) AS n, count(*) FILTER (score >= 8) AS flagged, count(*) FILTER (score >= 8) / count(*) AS rate FROM {_LABELLED} WHERE NOT label GROUP BY lang")
def false_positive_rate(spark, sf_dir):
    return E.flagged_rate(labelled(spark, sf_dir), 8.0, ("lang",))


@query("category_mass", f"WITH m AS (SELECT category, sum(len(found) * weight * 1000 / n) AS mass FROM {PHRASE_SQL} JOIN (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM {PROBE_SQL}) USING (doc_id) GROUP BY category) SELECT category, round(mass, 6) AS mass, round(mass / sum(mass) OVER (), 6) AS share FROM m")
def category_mass(spark, sf_dir):
    d = _hits(spark, sf_dir).select(F.size(T.tokens(F.col("text"))).alias("words"), F.explode(F.filter("hits", _plain)).alias("h"))
    x = E.score_mass(d.select("h.category", "words", analysis.weight_of(F.col("h.category"), _R).alias("weight")))
    return x.select("category", T.rounded(F.col("mass"), 6).alias("mass"), T.rounded(F.col("share"), 6).alias("share"))


_ABLATED = f"""WITH d AS (SELECT doc_id, quality = 1 AS label, n FROM (SELECT doc_id, len({TOKENS.format('text')}) AS n FROM {PROBE_SQL}) JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    h AS MATERIALIZED (SELECT doc_id, category, sum(len(found) * weight) AS w FROM {PHRASE_SQL} GROUP BY ALL), c AS (SELECT unnest([{', '.join(map(q, _PLAIN))}, '']) AS category),
    s AS MATERIALIZED (SELECT c.category, d.doc_id, label, round(coalesce(sum(CASE WHEN h.category <> c.category THEN w END), 0) / any_value(n) * 1000, 6) AS score FROM d CROSS JOIN c LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY ALL),
    a AS (SELECT p.category, {_AUC_SQL} AS auc FROM (SELECT * FROM s WHERE label) p JOIN (SELECT * FROM s WHERE NOT label) n ON p.category = n.category GROUP BY p.category),
    u AS (SELECT DISTINCT category, score FROM s), t AS (SELECT DISTINCT category, threshold FROM (SELECT category, score AS threshold FROM u UNION ALL SELECT category, floor((score + lead(score) OVER (PARTITION BY category ORDER BY score)) / 2 * 1000 + 0.5) / 1000 FROM u UNION ALL SELECT category, min(score) - 0.1 FROM u GROUP BY category UNION ALL SELECT category, max(score) + 0.1 FROM u GROUP BY category) WHERE threshold >= 0),
    k AS (SELECT category, threshold, count(*) FILTER (score >= threshold AND label) AS tp, count(*) FILTER (score >= threshold AND NOT label) AS fp, count(*) FILTER (score < threshold AND NOT label) AS tn, count(*) FILTER (score < threshold AND label) AS fn FROM s JOIN t USING (category) GROUP BY ALL),
    b AS (SELECT category, max_by((tp + tn) / (tp + fp + tn + fn), (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, -CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, (tp + tn) / (tp + fp + tn + fn), -threshold)) AS acc FROM k GROUP BY category),
    m AS (SELECT category, sum(w * 1000 / n) AS mass FROM h JOIN d USING (doc_id) WHERE label GROUP BY category)"""


@query("ablation", f"""{_ABLATED} SELECT category, round(a.auc, 9) AS auc, round((SELECT auc FROM a WHERE category = '') - a.auc, 9) AS auc_drop, b.acc AS best_f1_acc, (SELECT acc FROM b WHERE category = '') - b.acc AS acc_drop, round(coalesce(mass / (SELECT sum(mass) FROM m), 0), 6) AS share
    FROM a JOIN b USING (category) LEFT JOIN m USING (category) WHERE category <> ''""")
def ablation(spark, sf_dir):
    # the analysis is read several times, by AUC and by the sweep: kept as categories
    d = _hits(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("words"), F.transform(F.filter("hits", _plain), lambda h: F.struct(h["category"].alias("category"))).alias("hits")).persist()
    h = d.select("doc_id", F.explode_outer("hits").alias("h")).filter("h is not null").select("doc_id", "h.category", analysis.weight_of(F.col("h.category"), _R).alias("weight"))
    y = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") == 1).alias("label"))
    x = E.ablation(d.select("doc_id", "words").join(y, "doc_id"), h, spark.createDataFrame([(c,) for c in _PLAIN], "category string"))
    return x.select("category", T.rounded(F.col("auc"), 9).alias("auc"), T.rounded(F.col("auc_drop"), 9).alias("auc_drop"), "best_f1_acc", "acc_drop", T.rounded(F.col("share"), 6).alias("share"))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    return E.bootstrap(labelled(spark, sf_dir), 8.0)


@query("unlabelled_documents", """SELECT doc_id, 'no label' AS problem FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT doc_id, 'no file' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id) UNION ALL SELECT doc_id, 'bad label' FROM labels WHERE quality IS NULL UNION ALL SELECT doc_id, 'unknown register' FROM labels WHERE toxic IS NULL""")
def unlabelled_documents(spark, sf_dir):
    """The corpus check, with quality as label and toxicity as register."""
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"), F.col("toxic").cast("string").alias("register"))
    return E.unmatched(table(spark, sf_dir).select("doc_id"), y, "doc_id", ("0", "1"), ("0", "1"))


@query("spearman", f"""WITH x AS (SELECT lang, avg(score) AS a, count(*) AS b FROM {_LABELLED} GROUP BY lang), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS b FROM x) SELECT round(corr(a, b), 9) AS rho FROM r""")
def spearman(spark, sf_dir):
    x = labelled(spark, sf_dir).groupBy("lang").agg(F.avg("score").alias("a"), F.count("*").alias("b"))
    return E.spearman(x, "a", "b").select(T.rounded(F.col("rho"), 9).alias("rho"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the full analysis of each document."""
    return scorecard(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
