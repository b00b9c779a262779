"""Heuristic rules: language leaks, capitals, punctuation and consistency. Each returns an array of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from ..config import AuditConfig
from ..functions import text as T
from .issues import ISSUE, issue, none, one_if

SOURCE = "heuristic"


def leaks(t: Column, target: str, threshold: float = 0.08, min_words: int = 3, whitelist=tuple(lexicon.EVIDENCE_WHITELIST), words: Column | None = None) -> Column:
    """An issue for each other language whose evidence reaches the threshold. words: a column that already holds
    heuristic_words(t)."""
    words = T.heuristic_words(t) if words is None else words

    def of(lang: str) -> Column:
        return T.bind(F.when(F.size(words) >= min_words, T.evidence(t, words, lang, whitelist)), lambda score: F.when(F.round(score, 9) >= threshold, T.bind(T.evidence_words(words, lang, whitelist), lambda seen: F.array(leak(lang, score, seen)))).otherwise(none()))

    def leak(lang: str, score: Column, seen: Column) -> Column:
        more = F.when(F.size(seen) > 5, F.concat(F.lit(" (+"), (F.size(seen) - 5).cast("string"), F.lit(" more)"))).otherwise("")
        message = F.when(F.size(seen) > 0, F.concat(F.lit(f"Possible {lang.upper()} words: "), F.array_join(F.slice(seen, 1, 5), ", "), more)).otherwise(f"Possibly {lang.upper()} text")
        return issue(SOURCE, "language_leak", f"LANGUAGE_LEAK_{lang.upper()}", message, f"Expected {target.upper()} text", F.lit(0), F.length(t), F.least(F.lit(0.95), score * 2))

    return F.concat(*[of(lang) for lang in lexicon.LANGUAGES if lang != target])


def sentence_capitals(t: Column, target: str) -> Column:
    """Sentences whose first word begins in lower case and is no listed function word, at the place where their text
    first occurs."""
    small = F.filter(F.split(t, r"(?U)[.!?]+\s*"), lambda s: s.rlike(rf"^[{T.SPACES}]*+\p{{Ll}}"))
    sentences = F.transform(small, T.strip)

    def of(s: Column) -> Column:
        word = F.regexp_extract(s, r"(?U)^\S+", 0)
        at = F.call_function("locate", s, t) - 1
        return one_if(~F.lower(word).isin(*lexicon.CAPITAL_EXCEPTIONS[target]), issue(SOURCE, "capitalization", "SENTENCE_CAPITALIZATION", F.concat(F.lit("Lower case at the start: "), word), T.capitalized(word), at, at + F.length(word), 0.7))

    return F.flatten(F.transform(sentences, of))


def all_caps(t: Column) -> Column:
    """Runs of at least two words in capitals."""
    found = F.filter(T.find_all(t, r"(?U)\b[A-Z][A-Z\s]+[A-Z]\b"), lambda m: T.count_words(m["v"]) > 1)
    return F.transform(found, lambda m: issue(SOURCE, "capitalization", "ALL_CAPS_TITLE", F.concat(F.lit("All capitals: "), m["v"]), F.initcap(T.squeeze(F.lower(m["v"]))), m["s"], m["e"], 0.4))


def missing_space(t: Column) -> Column:
    return F.transform(T.find_all(t, "[.!?,:;][a-zA-Z]"), lambda m: issue(SOURCE, "punctuation", "MISSING_SPACE_AFTER_PUNCT", F.concat(F.lit("Missing space: "), m["v"]), F.concat(F.substring(m["v"], 1, 1), F.lit(" "), F.substring(m["v"], 2, 1)), m["s"], m["e"], 0.8))


def inverted_marks(t: Column) -> Column:
    """Questions and exclamations without their opening mark."""

    def of(opening: str, closing: str, rule: str) -> Column:
        pattern = rf"(?U)[^{opening}]\s*[A-ZÁÉÍÓÚÑÜ][^.!?]*{closing}"
        return F.transform(T.find_all(t, pattern), lambda m: issue(SOURCE, "punctuation", rule, f"Missing {opening}", f"Add {opening}", m["s"], m["e"], 0.6))

    return F.concat(of("¿", r"\?", "MISSING_SPANISH_QUESTION_MARK"), of("¡", "!", "MISSING_SPANISH_EXCLAMATION_MARK"))


def quote_kinds(t: Column, kinds: str = "\"'") -> Column:
    """At least four quotes of more than two kinds. The default set has two kinds, so only a wider one finds any."""
    found = F.regexp_extract_all(t, F.lit(f"[{kinds}]"), F.lit(0))
    used = F.array_sort(F.array_distinct(found))
    return one_if((F.size(found) >= 4) & (F.size(used) > 2), issue(SOURCE, "consistency", "INCONSISTENT_QUOTES", F.concat(F.lit("Kinds of quotes: "), F.array_join(used, ", ")), "Use one kind", F.lit(0), F.length(t), 0.5))


def heading_case(t: Column, tag: Column) -> Column:
    end = "\n\r\x85\u2028\u2029"  # a small letter with a capital behind it in its line; tried at the first small one of each line only
    mixed = tag.isin("h1", "h2", "h3", "h4", "h5", "h6") & t.rlike(f"(?:^|[{end}])[^a-z{end}]*+[a-z][^A-Z{end}]*+[A-Z]")
    return one_if(mixed, issue(SOURCE, "capitalization", "INCONSISTENT_HEADING_CASE", "Mixed case in a heading", "Use title or sentence case", F.lit(0), F.length(t), 0.4))


def check(t: Column, config: AuditConfig, tag: Column | None = None, words: Column | None = None, heard: Column | None = None) -> Column:
    """All rules in their order. heard: the text as evidence of other languages sees it, where phrases are blanked."""
    target = config.target
    listed = tuple(config.whitelist) or tuple(lexicon.EVIDENCE_WHITELIST)
    parts = [leaks(t if heard is None else heard, target, config.leak_threshold, config.min_words, listed, words)]
    if config.check_capitals:
        parts += [sentence_capitals(t, target)] + [all_caps(t)] * (target == "en")
    parts += [missing_space(t)] + [inverted_marks(t)] * (target == "es") + [quote_kinds(t)] + ([heading_case(t, tag)] if tag is not None else [])
    return F.concat(none(), *parts).cast(f"array<{ISSUE}>")
