"""Queries on rules: placeholders, numbers, currency, heuristics and the grammar adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..config import MINIMAL, STRICT
from ..functions import text as T
from ..operators import grammar, heuristics, placeholders
from ..operators.issues import unnest
from ..operators.report import gate
from ..sources import tables
from . import duck
from .registry import query
from .text_queries import docs, long, table, text


#: Texts with placeholders, numbers and quotes, made of the columns of part; the same expression in both dialects.
MADE = """SELECT p_partkey AS id, CASE p_partkey % 10
    WHEN 0 THEN concat('Hi {{name', p_size, '}} and ${x', p_size, '} %s of ', p_brand)
    WHEN 1 THEN concat('Use { } or {', p_size, 'st} or {} for ', p_type)
    WHEN 2 THEN concat('<b>', p_name, '</b> <span>y <i>z</span> <br/> <em>')
    WHEN 3 THEN concat('Price €', p_size, '00 today and ', p_size, '€  or 5 $ {ok}')
    WHEN 4 THEN concat('Precio ', p_size, ' € hoy, $', p_size, ',50 :code_', p_partkey, ' [item] []')
    WHEN 5 THEN concat('1.234,56 and 2,345.67 of ', p_name, '; v', p_size)
    WHEN 6 THEN concat('He said "', p_brand, '" and ''', p_type, ''' ok.  ')
    WHEN 7 THEN concat('tab', chr(9), 'and space', chr(13), chr(10), 'x', chr(10), p_name, ' ¿que? ')
    WHEN 8 THEN concat('READ THIS NOW ', p_name, ' :go {tab} {click} <hr> <em>', p_type, '</em>')
    ELSE concat('Plain text about ', p_name, '. End.Start here,ok. ¿Cómo estás? Bien. Qué bueno! https://a.b/c') END AS text FROM part"""


def made(spark, sf_dir) -> DataFrame:
    tables.spread(table(spark, sf_dir, "part")).createOrReplaceTempView("part")
    return spark.sql(MADE)


def rows(df: DataFrame, found: Column, *columns: str, key: str = "id") -> DataFrame:
    """A row of flat columns for each issue."""
    flat = unnest(df, found, key).withColumns({"s": long("s"), "e": long("e")})
    return flat.select(key, "s", "e", *columns)


def find_made(pattern: str) -> str:
    return duck.find(MADE, "id", "text", pattern)


# placeholders

WHITE = duck.in_list(lexicon.PLACEHOLDER_WHITELIST)
FAMILIES = " UNION ALL ".join(f"SELECT id, '{f}' AS family, s, e, v, regexp_extract(v, {duck.quoted(p)}, 1) AS content FROM ({find_made(p)})" for f, (p, _) in lexicon.PLACEHOLDERS.items())
UNLISTED = f"SELECT * FROM ({FAMILIES}) WHERE NOT list_contains({WHITE}, v)"


def all_families(spark, sf_dir, whitelist) -> DataFrame:
    found = F.concat(*[_named(f, whitelist) for f in lexicon.PLACEHOLDERS])
    return unnest(made(spark, sf_dir), found, "id").withColumns({"s": long("s"), "e": long("e")})


def _named(family: str, whitelist) -> Column:
    return F.transform(placeholders.matches(text(), family, whitelist), lambda m: F.struct(F.lit(family).alias("family"), m["s"].alias("s"), m["e"].alias("e"), m["v"].alias("v"), placeholders.content(m["v"], family).alias("content")))


@query("find_placeholders", FAMILIES)
def find_placeholders(spark, sf_dir):
    return all_families(spark, sf_dir, ())


@query("placeholder_matches", UNLISTED)
def placeholder_matches(spark, sf_dir):
    return all_families(spark, sf_dir, tuple(lexicon.PLACEHOLDER_WHITELIST))


SYNTAX = f"""WITH p AS ({UNLISTED}) SELECT id, s, e, 'EMPTY_PLACEHOLDER' AS rule_id FROM p WHERE family = 'curly_braces' AND content <> '' AND NOT regexp_matches(content, '\\S')
    UNION ALL SELECT id, s, e, 'INVALID_VARIABLE_NAME' FROM p WHERE family IN ('curly_braces', 'dollar_braces') AND regexp_matches(content, '\\S') AND NOT regexp_matches(content, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND NOT regexp_matches(content, '^[a-zA-Z_]')
    UNION ALL SELECT id, s, e, 'MIXED_BRACKET_STYLES' FROM p WHERE family = 'curly_braces' AND contains(v, '{{{{')"""


@query("placeholder_syntax", SYNTAX)
def placeholder_syntax(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.syntax(text()), "rule_id")


@query("placeholder_mixed", f"SELECT id, string_agg(DISTINCT family, ', ' ORDER BY family) AS families FROM ({UNLISTED}) GROUP BY id HAVING count(DISTINCT family) > 2")
def placeholder_mixed(spark, sf_dir):
    used = placeholders.families(text())
    return made(spark, sf_dir).withColumn("f", T.once(used)).filter(F.size("f") > 2).select("id", F.array_join("f", ", ").alias("families"))


TAG_PAIRS = f"""WITH RECURSIVE tags AS (SELECT id, s, e, {duck.strip('content')} AS name, row_number() OVER (PARTITION BY id ORDER BY s) AS i FROM ({UNLISTED}) WHERE family = 'angle_brackets'),
    run AS (SELECT DISTINCT id, 0::BIGINT AS i, []::STRUCT(s BIGINT, e BIGINT, v VARCHAR)[] AS open, NULL::STRUCT(s BIGINT, e BIGINT, v VARCHAR) AS wrong FROM tags
        UNION ALL SELECT r.id, t.i,
            CASE WHEN starts_with(name, '/') THEN CASE WHEN len(open) > 0 AND open[len(open)].v = substring(name, 2) THEN open[1:len(open) - 1] ELSE open END WHEN ends_with(name, '/') THEN open ELSE list_append(open, {{'s': t.s, 'e': t.e, 'v': name}}) END,
            CASE WHEN starts_with(name, '/') AND NOT coalesce(len(open) > 0 AND open[len(open)].v = substring(name, 2), FALSE) THEN {{'s': t.s, 'e': t.e, 'v': substring(name, 2)}} END
        FROM run r JOIN tags t ON t.id = r.id AND t.i = r.i + 1)
    SELECT id, wrong.s AS s, wrong.e AS e, 'UNMATCHED_CLOSING_TAG' AS rule_id FROM run WHERE wrong IS NOT NULL
    UNION ALL SELECT id, x.s, x.e, 'UNMATCHED_OPENING_TAG' FROM (SELECT id, unnest(open) AS x FROM (SELECT id, arg_max(open, i) AS open FROM run GROUP BY id))"""


@query("tag_pairing", TAG_PAIRS)
def tag_pairing(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.tag_pairs(text()), "rule_id")


US, EU = find_made(lexicon.US_NUMBER), find_made(lexicon.EU_NUMBER)


@query("number_format_mixed", f"WITH us AS ({US}), eu AS (SELECT * FROM ({EU}) x WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.id = x.id AND us.s <= x.s AND x.s < us.e)) SELECT id, s, e, 'INCORRECT_NUMBER_FORMAT_EN' AS rule_id FROM eu WHERE id IN (SELECT id FROM us)")
def number_format_mixed(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.numbers_mixed(text(), "en"), "rule_id")


@query("number_format_base", f"SELECT id, s, e, 'INCORRECT_NUMBER_FORMAT_EN' AS rule_id FROM ({find_made(lexicon.EU_IN_US)}) UNION ALL SELECT id, s, e, 'INCORRECT_NUMBER_FORMAT_ES' FROM ({find_made(lexicon.US_IN_EU)})")
def number_format_base(spark, sf_dir):
    return rows(made(spark, sf_dir), F.concat(placeholders.numbers_foreign(text(), "en"), placeholders.numbers_foreign(text(), "es")), "rule_id")


NUMBERS = "SELECT p_partkey AS id, concat(CASE p_partkey % 4 WHEN 0 THEN '1.234,' WHEN 1 THEN '1,234.' WHEN 2 THEN '12,' ELSE '1.2.3,4,' END, p_size) AS v FROM part"


def swap_sql(decimal: str, thousand: str) -> str:
    return f"CASE WHEN contains(v, ',') AND contains(v, '.') AND len(string_split(v, '{decimal}')) = 2 THEN concat(replace(string_split(v, '{decimal}')[1], '{thousand}', '{decimal}'), '{thousand}', string_split(v, '{decimal}')[2]) ELSE replace(v, '{thousand}', '{decimal}') END"


@query("number_suggestion", f"SELECT id, v, {swap_sql(',', '.')} AS en, {swap_sql('.', ',')} AS es FROM ({NUMBERS})")
def number_suggestion(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    v = F.col("v")
    return spark.sql(NUMBERS).select("id", "v", placeholders.number_suggestion(v, "en").alias("en"), placeholders.number_suggestion(v, "es").alias("es"))


def currency_sql(target: str) -> str:
    wants = "TRUE" if target == "en" else "sign <> '€'"
    group = [f"regexp_extract(v, {duck.quoted(lexicon.CURRENCY)}, {i})" for i in range(5)]
    return f"""SELECT id, s, e, 'CURRENCY_PLACEMENT_{target.upper()}' AS rule_id, {duck.strip("CASE WHEN wants THEN concat(sign, amount) ELSE concat(amount, sign) END")} AS suggestion
        FROM (SELECT *, {wants} AS wants FROM (SELECT *, {group[1]} <> '' AS before, CASE WHEN {group[1]} <> '' THEN {group[1]} ELSE {group[4]} END AS sign, CASE WHEN {group[1]} <> '' THEN {group[2]} ELSE {group[3]} END AS amount FROM ({find_made(lexicon.CURRENCY)}))) WHERE before <> wants"""


@query("currency_placement", " UNION ALL ".join(currency_sql(x) for x in lexicon.LANGUAGES))
def currency_placement(spark, sf_dir):
    return rows(made(spark, sf_dir), F.concat(*[placeholders.currency(text(), x) for x in lexicon.LANGUAGES]), "rule_id", "suggestion")


@query("straight_quotes", f"SELECT id, s, e, v FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({duck.find(MADE, 'id', 'text', chr(91) + chr(34) + chr(39) + chr(93))})) WHERE n >= 2")
def straight_quotes(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.straight_quotes(text()), "message").withColumn("v", F.substring("message", -1, 1)).drop("message")


GENERAL = f"""SELECT id, s, e, 'MULTIPLE_SPACES' AS rule_id FROM ({find_made('  +')})
    UNION ALL SELECT id, 0, length(text), 'MIXED_TABS_SPACES' FROM ({MADE}) WHERE contains(text, chr(9)) AND contains(text, ' ')
    UNION ALL SELECT id, 0, length(text), 'MIXED_LINE_ENDINGS' FROM ({MADE}) WHERE contains(text, chr(13) || chr(10)) AND contains(replace(text, chr(13) || chr(10), ''), chr(10))"""


@query("general_consistency", GENERAL)
def general_consistency(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.general(text()), "rule_id")


@query("punctuation_spacing", f"SELECT id, s, e, 'MULTIPLE_SPACES' AS rule_id FROM ({find_made('  +')}) UNION ALL SELECT id, s, e, 'SPANISH_PUNCTUATION_SPACING' FROM ({find_made(' +[¿¡]')}) UNION ALL SELECT id, length(text) - length(tail), length(text), 'TRAILING_PUNCTUATION_SPACE' FROM (SELECT *, regexp_extract(text, '[.!?] +$') AS tail FROM ({MADE})) WHERE tail <> ''")
def punctuation_spacing(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.punctuation_spacing(text(), "es"), "rule_id")


BASE = {f: p for f, (p, _) in lexicon.PLACEHOLDERS.items()} | {"square_brackets": lexicon.SQUARE_BRACKETS}


@query("base_placeholder_check", f"""SELECT id, 0::BIGINT AS s, length(text) AS e, 'MIXED_PLACEHOLDER_STYLES' AS rule_id FROM ({MADE}) WHERE {' + '.join(f'regexp_matches(text, {duck.quoted(p)})::INT' for p in BASE.values())} > 2
    UNION ALL SELECT id, s, e, 'NESTED_PLACEHOLDER' FROM ({find_made(BASE['curly_braces'])}) WHERE contains(v, '{{{{') UNION ALL SELECT id, s, e, 'EMPTY_PLACEHOLDER' FROM ({find_made(BASE['curly_braces'])} UNION ALL {find_made(BASE['square_brackets'])}) WHERE length(v) <= 2""")
def base_placeholder_check(spark, sf_dir):
    return rows(made(spark, sf_dir), placeholders.base_check(text()), "rule_id")


ALL = f"SELECT id, s, e, rule_id FROM ({SYNTAX}) UNION ALL SELECT id, s, e, rule_id FROM ({GENERAL}) UNION ALL SELECT id, s, e, rule_id FROM ({currency_sql('en')}) UNION ALL SELECT id, 0, length(text), 'MIXED_PLACEHOLDER_STYLES' FROM ({MADE}) WHERE id IN (SELECT id FROM ({UNLISTED}) GROUP BY id HAVING count(DISTINCT family) > 2) UNION ALL SELECT id, s, e, rule_id FROM ({TAG_PAIRS})"


@query("placeholder_all", f"SELECT rule_id, count(*) AS n FROM ({ALL}) GROUP BY rule_id")
def placeholder_all(spark, sf_dir):
    """All rules for English in one projection."""
    found = rows(made(spark, sf_dir), placeholders.check(text(), "en"), "rule_id")
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# heuristics

WORDS = f"SELECT doc_id, text, {duck.heuristic_words('text')} AS words FROM documents"


@query("heuristic_words", f"SELECT doc_id, len(words) AS n, md5(array_to_string(words, ' ')) AS words FROM ({WORDS})")
def heuristic_words(spark, sf_dir):
    """A digest of all words."""
    return docs(spark, sf_dir).withColumn("w", T.once(T.heuristic_words(text()))).select("doc_id", long(F.size("w")).alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


EVIDENCE = f"SELECT doc_id, {', '.join(f'{duck.evidence("text", "words", x)} AS {x}' for x in lexicon.LANGUAGES)}, len(words) AS n_words FROM ({WORDS})"


def evidence(spark, sf_dir) -> DataFrame:
    words = docs(spark, sf_dir).withColumn("w", T.once(T.heuristic_words(text())))
    return words.select("doc_id", *[T.evidence(text(), F.col("w"), x).alias(x) for x in lexicon.LANGUAGES], F.size("w").alias("n_words"))


@query("language_evidence", f"SELECT doc_id, {', '.join(f'round({x}, 6) AS {x}' for x in lexicon.LANGUAGES)} FROM ({EVIDENCE})")
def language_evidence(spark, sf_dir):
    return evidence(spark, sf_dir).select("doc_id", *[F.round(x, 6).alias(x) for x in lexicon.LANGUAGES])


@query("language_confidence", f"SELECT doc_id, {', '.join(f'round(least(1, 2 * {x}), 6) AS {x}' for x in lexicon.LANGUAGES)} FROM ({EVIDENCE}) WHERE n_words > 0")
def language_confidence(spark, sf_dir):
    return evidence(spark, sf_dir).filter("n_words > 0").select("doc_id", *[F.round(F.least(F.lit(1.0), F.col(x) * 2), 6).alias(x) for x in lexicon.LANGUAGES])


def leak_sql(target: str, threshold: float, least: int) -> str:
    others = [x for x in lexicon.LANGUAGES if x != target]
    return " UNION ALL ".join(f"SELECT doc_id, 'LANGUAGE_LEAK_{x.upper()}' AS rule_id, round(least(0.95, 2 * {x}), 6)::DOUBLE AS confidence FROM ({EVIDENCE}) WHERE round({x}, 9) >= {threshold} AND n_words >= {least}" for x in others)


def leak(spark, sf_dir, target: str, threshold: float, least: int) -> DataFrame:
    words = docs(spark, sf_dir).withColumn("w", T.once(T.heuristic_words(text())))
    return unnest(words, heuristics.leaks(text(), target, threshold, least, words=F.col("w")), "doc_id").select("doc_id", "rule_id", F.round("confidence", 6).alias("confidence"))


@query("language_leak_heuristic", leak_sql("en", 0.08, 3))
def language_leak_heuristic(spark, sf_dir):
    return leak(spark, sf_dir, "en", 0.08, 3)


@query("leak_minimal", leak_sql("es", MINIMAL["leak_threshold"], MINIMAL["min_words"]))
def leak_minimal(spark, sf_dir):
    return leak(spark, sf_dir, "es", MINIMAL["leak_threshold"], MINIMAL["min_words"])


@query("leak_strict", leak_sql("nl", STRICT["leak_threshold"], STRICT["min_words"]))
def leak_strict(spark, sf_dir):
    return leak(spark, sf_dir, "nl", STRICT["leak_threshold"], STRICT["min_words"])


@query("sentence_capitalization", rf"""WITH x AS (SELECT doc_id, text, {duck.strip('s')} AS s FROM (SELECT doc_id, text, unnest(string_split_regex(text, '[.!?]+[\s\p{{Z}}]*')) AS s FROM documents)), w AS (SELECT *, regexp_extract(s, '^[^\s\p{{Z}}]+') AS word FROM x WHERE s <> '')
    SELECT doc_id, instr(text, s) - 1 AS s, instr(text, s) - 1 + length(word) AS e, upper(word[1]) || lower(word[2:]) AS suggestion FROM w WHERE regexp_matches(word, '^\p{{Ll}}') AND NOT list_contains({duck.in_list(lexicon.CAPITAL_EXCEPTIONS['en'])}, lower(word))""")
def sentence_capitalization(spark, sf_dir):
    return rows(docs(spark, sf_dir), heuristics.sentence_capitals(text(), "en"), "suggestion", key="doc_id")


#: A stand-in for letters outside ASCII keeps their places and makes `\\b` treat them as letters.
ASCII = "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g') AS text FROM documents"


@query("all_caps_title", f"SELECT doc_id, s, e FROM ({duck.find(ASCII, 'doc_id', 'text', chr(92) + 'b[A-Z][A-Z' + chr(92) + 's]+[A-Z]' + chr(92) + 'b')}) WHERE {duck.count_words('v')} > 1")
def all_caps_title(spark, sf_dir):
    return rows(docs(spark, sf_dir), heuristics.all_caps(text()), key="doc_id")


DOCS = "SELECT doc_id, text FROM documents"


@query("missing_space", f"SELECT doc_id, s, e, v[1] || ' ' || v[2] AS suggestion FROM ({duck.find(DOCS, 'doc_id', 'text', '[.!?,:;][a-zA-Z]')})")
def missing_space(spark, sf_dir):
    return rows(docs(spark, sf_dir), heuristics.missing_space(text()), "suggestion", key="doc_id")


MARKS = [("¿", r"\?", "MISSING_SPANISH_QUESTION_MARK"), ("¡", "!", "MISSING_SPANISH_EXCLAMATION_MARK")]
MARKED = f"SELECT doc_id, text FROM documents UNION ALL SELECT -id, text FROM ({MADE})"


@query("spanish_inverted_marks", " UNION ALL ".join(f"SELECT doc_id, s, e, '{rule}' AS rule_id FROM ({duck.find(MARKED, 'doc_id', 'text', f'[^{a}]{duck.SPACE}*[A-ZÁÉÍÓÚÑÜ][^.!?]*{b}')})" for a, b, rule in MARKS))
def spanish_inverted_marks(spark, sf_dir):
    both = docs(spark, sf_dir).unionAll(made(spark, sf_dir).select((-F.col("id")).alias("id"), "text"))
    return rows(both, heuristics.inverted_marks(text()), "rule_id", key="doc_id")


@query("inconsistent_quotes", f"SELECT id, array_to_string(list_sort(list_distinct(q)), ', ') AS kinds FROM (SELECT id, regexp_extract_all(concat(text, ' “', id, '”'), '[\"''“”]') AS q FROM ({MADE})) WHERE len(q) >= 4 AND len(list_distinct(q)) > 2")
def inconsistent_quotes(spark, sf_dir):
    """With typographic quotes among the kinds."""
    df = made(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" “"), F.col("id").cast("string"), F.lit("”")))
    return rows(df, heuristics.quote_kinds(text(), "\"'“”"), "message").select("id", F.substring_index("message", ": ", -1).alias("kinds"))


@query("heading_case", "SELECT page_id, pos, heading FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1) AS h FROM pages)) WHERE regexp_matches(heading, '[a-z].*[A-Z]|[A-Z].*[a-z].*[A-Z]')")
def heading_case(spark, sf_dir):
    """All plain headings of each page."""
    heads = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))).alias("pos", "text"))
    return heads.filter(F.size(heuristics.heading_case(text(), F.lit("h1"))) > 0).select("page_id", long("pos").alias("pos"), F.col("text").alias("heading"))


# verification gate and grammar adapter

GATED = f"SELECT id, CASE id % 4 WHEN 0 THEN 'https://a.b/c' WHEN 1 THEN concat('me@', id, '.example') WHEN 2 THEN '  ab ' ELSE text END AS text FROM ({MADE})"


@query("verify_gate", rf"SELECT id, length({duck.strip('text')}) >= 3 AND (NOT regexp_matches({duck.strip('text')}, 'https?://\S+') OR length({duck.strip(f'regexp_replace({duck.strip("text")}, ' + duck.quoted('https?://' + chr(92) + 'S+') + ", '', 'g')")}) >= 3) AND (NOT regexp_matches({duck.strip('text')}, '\S+@\S+\.\S+') OR length({duck.strip(f'regexp_replace({duck.strip("text")}, ' + duck.quoted(chr(92) + 'S+@' + chr(92) + 'S+' + chr(92) + '.' + chr(92) + 'S+') + ", '', 'g')")}) >= 3) AS verify FROM ({GATED})")
def verify_gate(spark, sf_dir):
    made(spark, sf_dir)
    return spark.sql(GATED).select("id", gate(text()).alias("verify"))


MATCHES = "SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'TYPOS' WHEN 1 THEN 'GRAMMAR' WHEN 2 THEN 'STYLE' WHEN 3 THEN 'TYPOGRAPHY' WHEN 4 THEN 'PUNCTUATION' WHEN 5 THEN 'CASING' WHEN 6 THEN 'REPETITION' WHEN 7 THEN 'MISC' ELSE 'OTHER' END AS category, o_custkey % 150 AS priority, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 / 100.0 END AS confidence FROM orders"


@query("lt_map", f"SELECT id, CASE {' '.join(f'WHEN category = {duck.quoted(k)} THEN {duck.quoted(v)}' for k, v in lexicon.GRAMMAR_TYPES.items())} ELSE 'grammar' END AS type, CASE WHEN category = 'TYPOS' THEN 'error' WHEN category IN ('GRAMMAR', 'PUNCTUATION', 'CASING') THEN 'warning' WHEN category IN ('STYLE', 'TYPOGRAPHY', 'REPETITION', 'REDUNDANCY') THEN 'info' WHEN priority >= 100 THEN 'error' WHEN priority >= 50 THEN 'warning' ELSE 'info' END AS severity, round(CASE WHEN c IS NULL THEN b ELSE (b + c) / 2 END, 6) AS confidence FROM (SELECT *, confidence::DOUBLE AS c, (CASE WHEN category = 'TYPOS' THEN 0.9 WHEN category IN ('STYLE', 'TYPOGRAPHY') THEN 0.6 ELSE 0.8 END)::DOUBLE AS b FROM ({MATCHES}))")
def lt_map(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    c = F.col("category")
    return spark.sql(MATCHES).select("id", grammar.issue_type(c).alias("type"), grammar.severity(c, F.col("priority")).alias("severity"), F.round(grammar.confidence(c, F.col("confidence").cast("double")), 6).alias("confidence"))


@query("split_sentences", rf"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS sentences FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+[\s\p{{Z}}]*|[^.!?]+$'), lambda x: {duck.strip('x')}), lambda x: x <> '') AS s FROM documents)")
def split_sentences(spark, sf_dir):
    """A digest of all sentences."""
    s = docs(spark, sf_dir).withColumn("s", T.once(grammar.sentences(text())))
    return s.select("doc_id", long(F.size("s")).alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("sentences"))


#: A checker's matches on blocks, some without rule, length or replacement.
FOUND = """SELECT o_custkey AS page_id, CAST(o_orderkey % 5 AS INT) AS block_idx, CAST(o_orderkey % 40 AS INT) AS place, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 6 AS INT) END AS length,
    CASE o_orderkey % 10 WHEN 0 THEN 'TYPOS' WHEN 1 THEN 'GRAMMAR' WHEN 2 THEN 'STYLE' WHEN 3 THEN 'TYPOGRAPHY' WHEN 4 THEN 'PUNCTUATION' WHEN 5 THEN 'CASING' WHEN 6 THEN 'REPETITION' WHEN 7 THEN 'MISC' WHEN 8 THEN 'OTHER' END AS category,
    CASE WHEN o_orderkey % 11 > 0 THEN concat('RULE_', o_orderkey) END AS rule_id, concat('Match ', o_orderkey) AS message, CASE WHEN o_orderkey % 3 > 0 THEN concat('fix ', o_orderkey % 13) END AS better, CAST(o_orderkey % 150 AS INT) AS priority,
    CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS confidence FROM orders"""
TYPES = f"CASE {' '.join(f'WHEN category = {duck.quoted(k)} THEN {duck.quoted(v)}' for k, v in lexicon.GRAMMAR_TYPES.items())} ELSE 'grammar' END"
MATCHED = f"""SELECT page_id, block_idx, {TYPES} AS type, coalesce(rule_id, 'UNKNOWN_RULE') AS rule_id, message, better AS suggestion, place AS s, place + coalesce(length, 1) AS e,
    CASE WHEN category = 'TYPOS' THEN 'error' WHEN category IN ('GRAMMAR', 'PUNCTUATION', 'CASING') THEN 'warning' WHEN category IN ('STYLE', 'TYPOGRAPHY', 'REPETITION', 'REDUNDANCY') THEN 'info' WHEN priority >= 100 THEN 'error' WHEN priority >= 50 THEN 'warning' ELSE 'info' END AS own_severity,
    least(1, CASE WHEN confidence IS NULL THEN base ELSE (base + confidence) / 2 END) AS confidence FROM (SELECT *, (CASE WHEN category = 'TYPOS' THEN 0.9 WHEN category IN ('STYLE', 'TYPOGRAPHY') THEN 0.6 ELSE 0.8 END)::DOUBLE AS base FROM ({FOUND}))"""


def matched(spark, sf_dir, target: str = "en") -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    found = spark.sql(FOUND).withColumnRenamed("place", "offset")
    return grammar.match_issues(found.withColumn("replacements", F.when(F.col("better").isNotNull(), F.array("better", F.lit("other")))), target)


@query("grammar_issues", f"SELECT page_id, block_idx::BIGINT AS block_idx, type, rule_id, message, suggestion, s::BIGINT AS s, e::BIGINT AS e, own_severity, round(confidence, 6)::DOUBLE AS confidence, row_number() OVER (PARTITION BY page_id, block_idx ORDER BY s, e, rule_id, message) - 1 AS seq FROM ({MATCHED})")
def grammar_issues(spark, sf_dir):
    found = matched(spark, sf_dir).withColumns({c: long(c) for c in ("block_idx", "s", "e", "seq")})
    return found.withColumn("confidence", F.round("confidence", 6)).drop("source")


@query("grammar_facets", " UNION ALL ".join(f"SELECT '{x}' AS facet, count(*) AS n FROM ({MATCHED}) WHERE type = '{x}'" for x in ("grammar", "spelling", "style")))
def grammar_facets(spark, sf_dir):
    found = matched(spark, sf_dir).withColumn("facet", F.col("type")).filter(F.col("facet").isin("grammar", "spelling", "style"))
    return found.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


@query("grammar_stats", f"SELECT type, own_severity, count(*) AS issues, count(DISTINCT rule_id) AS rules, round(avg(confidence), 6) AS confidence FROM ({MATCHED}) GROUP BY type, own_severity")
def grammar_stats(spark, sf_dir):
    return grammar.match_stats(matched(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("grammar_codes", f"SELECT * FROM (VALUES {', '.join(f'({duck.quoted(k)}, {duck.quoted(v)})' for k, v in lexicon.GRAMMAR_CODES.items())}) v(lang, code)")
def grammar_codes(spark, sf_dir):
    return spark.createDataFrame([(x, grammar.code(x)) for x in lexicon.LANGUAGES], "lang string, code string")


@query("chunk_text")
def chunk_text(spark, sf_dir):
    """Chunks of at most 2000 code points."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(grammar.chunks(text(), 2000)).alias("i", "c")).select("doc_id", "i", "c.start", F.length("c.text").alias("n"))
