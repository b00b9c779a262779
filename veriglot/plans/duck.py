"""Pieces of DuckDB SQL that several oracle queries share."""

from __future__ import annotations

from .. import lexicon

SPACE = r"[\s\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def count_words(t: str) -> str:
    return f"len(list_filter(string_split_regex({t}, '{SPACE}+'), lambda w: w <> ''))"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {quoted(pattern)}))"


def preprocess(t: str) -> str:
    for p in (r"https?://\S+", r"www\.\S+", r"\S+@\S+\.\S+"):
        t = f"regexp_replace({squeeze(t) if p.startswith('https') else t}, '{p}', '', 'g')"
    return f"substring({squeeze(t)}, 1, 10000)"


def tokens(t: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({t}, '[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]+'), lambda w: length(w) >= 2 AND (upper(w) <> w OR length(w) <= 3)), lambda w: lower(w))"


def share(words: str, listed) -> str:
    return f"coalesce(len(list_filter({words}, lambda w: list_contains({in_list(listed)}, w)))::DOUBLE / nullif(len({words}), 0), 0)"


def detect(source: str, keys: str) -> str:
    """keys, text, tokens, lang, lang_confidence and alternatives of a source's blocks that aren't blank."""
    ratios = ", ".join(f"{share('toks', lexicon.STOPWORDS[lang])} AS r_{lang}" for lang in lexicon.LANGUAGES)
    return f"""
        SELECT {keys}, text, tokens, CASE WHEN sure THEN best_lang ELSE 'unknown' END AS lang, CASE WHEN sure THEN best / total ELSE 0 END AS lang_confidence,
            CASE WHEN length({strip('text')}) >= 20 AND total > 0 THEN list_sort(list_filter([{", ".join(f"{{'c': -r_{x} / total, 'lang': '{x}'}}" for x in lexicon.LANGUAGES)}], lambda a: a.c < 0 AND a.lang <> best_lang)) ELSE [] END AS alternatives
        FROM (SELECT *, coalesce(length({strip('text')}) >= 20 AND total > 0 AND best / nullif(total, 0) >= 0.5, FALSE) AS sure FROM (
            SELECT *, r_es + r_en + r_nl AS total, greatest(r_es, r_en, r_nl) AS best, CASE WHEN r_es = greatest(r_es, r_en, r_nl) THEN 'es' WHEN r_en = greatest(r_es, r_en, r_nl) THEN 'en' ELSE 'nl' END AS best_lang
            FROM (SELECT {keys}, text, {count_words('text')} AS tokens, {ratios} FROM (SELECT {keys}, text, {tokens(preprocess('text'))} AS toks FROM ({source}) WHERE {strip('text')} <> ''))))
    """


LINES = "SELECT doc_id, pos AS block_idx, line AS text FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"


def find(source: str, keys: str, text: str, pattern: str) -> str:
    """keys, s, e, v of each match of a pattern in a source's text."""
    p = quoted(pattern)
    return f"""
        SELECT {keys}, s, s + length(v) AS e, v FROM (
            SELECT {keys}, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT {keys}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM ({source})) WHERE len(m) > 0))
    """


#: Heuristic words: `\\b` knows ASCII only here, so whole runs of word characters are tested.
def heuristic_words(t: str) -> str:
    word = r"[\p{L}\p{N}_]"
    t = f"regexp_replace({t}, '({word})\\.(com|org|net)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\3', 'g')"
    t = f"regexp_replace({t}, '[a-zA-Z]+@[a-zA-Z]+\\.[a-zA-Z]+', ' ', 'g')"
    return f"list_filter(regexp_extract_all({t}, '{word}+'), lambda w: regexp_full_match(w, '[a-zA-ZáéíóúüñÁÉÍÓÚÜÑëïöüÿ]{{2,}}') AND NOT regexp_full_match(w, '[A-Z]{{2,}}') AND NOT list_contains(['http', 'https', 'www'], w))"


def evidence(t: str, words: str, lang: str, whitelist=tuple(lexicon.EVIDENCE_WHITELIST)) -> str:
    """Evidence score; endings are counted on whole runs of word characters with a character before the ending."""
    listed = [w for w in lexicon.EVIDENCE_WORDS[lang] if w not in whitelist]
    runs = f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+')"
    ends = f"len(list_filter({runs}, lambda w: regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]+({'|'.join(lexicon.ENDINGS[lang])})')))"
    ij = f" + len(list_filter({runs}, lambda w: w = 'ij'))" if lang == "nl" else ""
    articles = f"len(regexp_extract_all(regexp_replace(' ' || {t}, '([^\\p{{L}}\\p{{N}}_])(({'|'.join(lexicon.ARTICLES[lang])})[\\s\\p{{Z}}]+[\\p{{L}}\\p{{N}}_]+)', '\\1' || chr(1), 'g'), chr(1)))"
    n = f"greatest(len({words}), 1)"
    return f"CASE WHEN len({words}) > 0 THEN {count(t, lexicon.EVIDENCE_CHARS[lang])} / greatest(length({t}), 1)::DOUBLE * 0.3 + len(list_filter({words}, lambda w: list_contains({in_list(listed)}, lower(w)))) / {n}::DOUBLE * 0.5 + ({articles} + {ends}{ij}) / {n}::DOUBLE * 0.2 END"
