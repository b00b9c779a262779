"""Rules on placeholders, numbers, currency, quotes and spacing. Each returns an array of issues for a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import SPANS, bind, find_all, only, until
from .issues import ISSUE, issue, none, one_if

SOURCE = "placeholder"
#: What a text needs to hold for any match of a family.
SIGNS = {"curly_braces": "{", "double_curly": "{{", "printf_style": "%", "dollar_braces": "${", "colon_params": ":", "angle_brackets": "<"}
#: What their matches end with; behind the last one, each opening sign would be followed to the end of the text.
CLOSINGS = {"curly_braces": "}", "double_curly": "}}", "dollar_braces": "}", "angle_brackets": ">"}


def matches(t: Column, family: str, whitelist=tuple(lexicon.PLACEHOLDER_WHITELIST)) -> Column:
    """Places of a family, without whitelisted ones."""
    found = bind(until(t, CLOSINGS[family]) if family in CLOSINGS else t, lambda v: find_all(v, lexicon.PLACEHOLDERS[family][0]))
    return F.when(t.contains(SIGNS[family]), only(found, "x.v", whitelist, without=True)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def content(v: Column, family: str) -> Column:
    return F.regexp_extract(v, lexicon.PLACEHOLDERS[family][0], 1)


def syntax(t: Column, whitelist=tuple(lexicon.PLACEHOLDER_WHITELIST)) -> Column:
    """Empty, badly named and doubly bracketed placeholders, by family and place."""

    def of(family: str) -> Column:
        def check(m: Column) -> Column:
            c = content(m["v"], family)
            wrong = (c != "") & ~c.rlike(lexicon.PLACEHOLDERS[family][1])
            empty = wrong & F.lit(family == "curly_braces") & ~c.rlike(r"(?U)\S")
            named = wrong & ~empty & ~c.rlike("^[a-zA-Z_]")
            first = F.when(empty, F.array(issue(SOURCE, "placeholder", "EMPTY_PLACEHOLDER", "Empty placeholder", "Name the variable: {variable_name}", m["s"], m["e"], 0.9)))
            first = first.when(named, F.array(issue(SOURCE, "placeholder", "INVALID_VARIABLE_NAME", F.concat(F.lit("Invalid variable name: "), c), "Begin names with a letter or underscore", m["s"], m["e"], 0.8))).otherwise(none())
            if family != "curly_braces":
                return first
            mixed = one_if(m["v"].contains("{{"), issue(SOURCE, "placeholder", "MIXED_BRACKET_STYLES", F.concat(F.lit("Mixed bracket styles: "), m["v"]), "Use one style of brackets", m["s"], m["e"], 0.8))
            return F.concat(first, mixed)

        return F.flatten(F.transform(matches(t, family, whitelist), check))

    return F.concat(of("curly_braces"), of("dollar_braces"))


def families(t: Column, whitelist=tuple(lexicon.PLACEHOLDER_WHITELIST)) -> Column:
    """Sorted names of the families that a text uses."""
    names = [F.when(F.size(matches(t, f, whitelist)) > 0, f) for f in sorted(lexicon.PLACEHOLDERS)]
    return F.filter(F.array(*names), lambda n: n.isNotNull())


def mixed_styles(t: Column) -> Column:
    used = families(t)
    return one_if(F.size(used) > 2, issue(SOURCE, "placeholder", "MIXED_PLACEHOLDER_STYLES", F.concat(F.lit("Mixed placeholder styles: "), F.array_join(used, ", ")), "Use one placeholder style", F.lit(0), F.length(t), 0.7))


def tag_pairs(t: Column) -> Column:
    """Closing tags that don't match the last open one, then open tags left over."""
    tag = "struct<s: int, e: int, v: string>"
    start = F.struct(F.expr(f"cast(array() as array<{tag}>)").alias("open"), F.expr(f"cast(array() as array<{tag}>)").alias("wrong"))

    def step(acc: Column, m: Column) -> Column:
        name = F.regexp_replace(content(m["v"], "angle_brackets"), r"(?U)^\s+|\s+$", "")
        here = F.struct(m["s"].alias("s"), m["e"].alias("e"), name.alias("v"))
        closes, alone = name.startswith("/"), name.endswith("/")
        shut = F.substring(name, F.lit(2), F.length(name))
        pairs = closes & (F.size(acc["open"]) > 0) & F.coalesce(F.try_element_at(acc["open"], F.lit(-1))["v"] == shut, F.lit(False))
        opened = F.when(pairs, F.slice(acc["open"], F.lit(1), F.greatest(F.lit(0), F.size(acc["open"]) - 1))).when(~closes & ~alone, F.concat(acc["open"], F.array(here))).otherwise(acc["open"])
        wrong = F.when(closes & ~pairs, F.concat(acc["wrong"], F.array(F.struct(m["s"].alias("s"), m["e"].alias("e"), shut.alias("v"))))).otherwise(acc["wrong"])
        return F.struct(opened.alias("open"), wrong.alias("wrong"))

    ended = F.aggregate(matches(t, "angle_brackets"), start, step)
    closing = F.transform(ended["wrong"], lambda m: issue(SOURCE, "placeholder", "UNMATCHED_CLOSING_TAG", F.concat(F.lit("Unmatched closing tag: </"), m["v"], F.lit(">")), F.concat(F.lit("Open it with <"), m["v"], F.lit(">")), m["s"], m["e"], 0.7))
    opening = F.transform(ended["open"], lambda m: issue(SOURCE, "placeholder", "UNMATCHED_OPENING_TAG", F.concat(F.lit("Unmatched opening tag: <"), m["v"], F.lit(">")), F.concat(F.lit("Close it with </"), m["v"], F.lit(">")), m["s"], m["e"], 0.7))
    return F.concat(closing, opening)


def _outside(found: Column, spans: Column) -> Column:
    """Places that begin in none of the spans. Both are read once, in order; few places are expected to be left."""
    kind = lambda a, k: F.transform(a, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["v"].alias("v")))
    start = F.struct(F.lit(0).alias("to"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        span, place = m["k"] == 0, F.struct(*[m[c].alias(c) for c in ("s", "e", "v")])
        to, out = F.when(span, F.greatest(acc["to"], m["e"])).otherwise(acc["to"]), F.when(~span & (m["s"] >= acc["to"]), F.concat(acc["out"], F.array(place))).otherwise(acc["out"])
        return F.struct(to.alias("to"), out.alias("out"))

    return F.aggregate(F.array_sort(F.concat(kind(spans, 0), kind(found, 1))), start, step)["out"]


def numbers_mixed(t: Column, target: str) -> Column:
    """Numbers written the other way, where both ways occur. A number that begins inside one in US style counts as US,
    and the patterns overlap so much that no text has both; see numbers_foreign()."""

    def both(us: Column, other: Column) -> Column:
        return F.when((F.size(us) > 0) & (F.size(other) > 0), made(other if target == "en" else us)).otherwise(none())

    made = lambda wrong: F.transform(wrong, lambda m: issue(SOURCE, "consistency", f"INCORRECT_NUMBER_FORMAT_{target.upper()}", F.concat(F.lit("Number format: "), m["v"]), number_suggestion(m["v"], target), m["s"], m["e"], 0.8))
    others = lambda us: _outside(find_all(t, rf"(?U){lexicon.EU_NUMBER}"), us)
    found = bind(find_all(t, rf"(?U){lexicon.US_NUMBER}"), lambda us: bind(others(us), lambda other: both(us, other)))
    return F.when(t.rlike(r"\p{Nd}"), found).otherwise(none())


def number_suggestion(v: Column, target: str) -> Column:
    """The number in the target's style: decimal and thousands signs change places."""
    decimal, thousand = (",", ".") if target == "en" else (".", ",")
    parts = F.split(v, f"[{decimal}]")
    both = v.contains(",") & v.contains(".") & (F.size(parts) == 2)
    swapped = F.concat(F.translate(F.get(parts, F.lit(0)), thousand, decimal), F.lit(thousand), F.get(parts, F.lit(1)))
    return F.when(both, swapped).otherwise(F.translate(v, thousand, decimal))


def numbers_foreign(t: Column, target: str) -> Column:
    """Numbers with thousands and decimal signs of the other style."""
    pattern = lexicon.EU_IN_US if target == "en" else lexicon.US_IN_EU
    return F.transform(find_all(t, pattern), lambda m: issue(SOURCE, "consistency", f"INCORRECT_NUMBER_FORMAT_{target.upper()}", F.concat(F.lit("Foreign number format: "), m["v"]), F.lit("1,234.56" if target == "en" else "1.234,56"), m["s"], m["e"], 0.8))


def currency(t: Column, target: str) -> Column:
    """Currency signs on the wrong side of the amount: behind it for the euro in es and nl, else before it."""

    def check(m: Column) -> Column:
        group = [F.regexp_extract(m["v"], f"(?U){lexicon.CURRENCY}", i) for i in range(5)]
        before = group[1] != ""
        sign, amount = F.when(before, group[1]).otherwise(group[4]), F.when(before, group[2]).otherwise(group[3])
        wants_before = (sign != "€") | F.lit(target == "en")
        better = F.regexp_replace(F.when(wants_before, F.concat(sign, amount)).otherwise(F.concat(amount, sign)), r"(?U)^\s+|\s+$", "")
        return one_if(before != wants_before, issue(SOURCE, "consistency", f"CURRENCY_PLACEMENT_{target.upper()}", F.concat(F.lit("Currency placement: "), m["v"]), better, m["s"], m["e"], 0.7))

    return F.when(t.rlike("[€$£¥₹]"), F.flatten(F.transform(find_all(t, f"(?U){lexicon.CURRENCY}"), check))).otherwise(none())


def straight_quotes(t: Column) -> Column:
    found = find_all(t, "[\"']")
    made = F.transform(found, lambda m: issue(SOURCE, "style", "STRAIGHT_QUOTES", F.concat(F.lit("Straight quote: "), m["v"]), "Use typographic quotes", m["s"], m["e"], 0.3))
    return F.when(F.size(found) >= 2, made).otherwise(none())


def spaces(t: Column, source: str = SOURCE) -> Column:
    return F.transform(find_all(t, "  +"), lambda m: issue(source, "punctuation", "MULTIPLE_SPACES", F.concat(F.length(m["v"]).cast("string"), F.lit(" spaces")), "Use one space", m["s"], m["e"], 0.8))


def general(t: Column) -> Column:
    """Several spaces, tabs beside spaces, and line ends of both kinds."""
    tabs = one_if(t.contains("\t") & t.contains(" "), issue(SOURCE, "consistency", "MIXED_TABS_SPACES", "Mixed tabs and spaces", "Indent with tabs or with spaces", F.lit(0), F.length(t), 0.4))
    ends = one_if(t.contains("\r\n") & F.replace(t, F.lit("\r\n"), F.lit("")).contains("\n"), issue(SOURCE, "consistency", "MIXED_LINE_ENDINGS", "Mixed line endings", "Use one kind of line end", F.lit(0), F.length(t), 0.6))
    return F.concat(spaces(t), tabs, ends)


def punctuation_spacing(t: Column, target: str) -> Column:
    """Several spaces, spaces before inverted marks (es), and spaces behind the last sentence."""
    inverted = F.transform(find_all(t, " +[¿¡]"), lambda m: issue(SOURCE, "punctuation", "SPANISH_PUNCTUATION_SPACING", F.concat(F.lit("Space before mark: "), m["v"]), "No space before ¿ or ¡", m["s"], m["e"], 0.8)) if target == "es" else none()
    tail = F.regexp_extract(t, r"[.!?] +$", 0)
    return F.concat(spaces(t), inverted, one_if(tail != "", issue(SOURCE, "punctuation", "TRAILING_PUNCTUATION_SPACE", "Spaces at the end", "Remove them", F.length(t) - F.length(tail), F.length(t), 0.8)))


def base_check(t: Column) -> Column:
    """The looser check with square brackets: nested and empty placeholders, and more than two families."""
    patterns = {f: p for f, (p, _) in lexicon.PLACEHOLDERS.items()} | {"square_brackets": lexicon.SQUARE_BRACKETS}
    used = F.filter(F.array(*[F.when(t.rlike(p), f) for f, p in patterns.items()]), lambda n: n.isNotNull())
    many = one_if(F.size(used) > 2, issue(SOURCE, "placeholder", "MIXED_PLACEHOLDER_STYLES", F.lit("Several placeholder styles"), "Use one placeholder style", F.lit(0), F.length(t), 1.0))
    nested = F.transform(F.filter(find_all(t, patterns["curly_braces"]), lambda m: m["v"].contains("{{")), lambda m: issue(SOURCE, "placeholder", "NESTED_PLACEHOLDER", F.concat(F.lit("Nested placeholder: "), m["v"]), None, m["s"], m["e"], 1.0))
    empty = [F.transform(F.filter(find_all(t, patterns[f]), lambda m: F.length(m["v"]) <= 2), lambda m: issue(SOURCE, "placeholder", "EMPTY_PLACEHOLDER", F.concat(F.lit("Empty placeholder: "), m["v"]), None, m["s"], m["e"], 1.0)) for f in ("curly_braces", "square_brackets")]
    return F.concat(many, nested, *empty)


def check(t: Column, target: str, quotes: bool = False) -> Column:
    """All rules in their order."""
    return F.concat(syntax(t), mixed_styles(t), tag_pairs(t), numbers_mixed(t, target), currency(t, target), straight_quotes(t) if quotes else none(), general(t)).cast(f"array<{ISSUE}>")
