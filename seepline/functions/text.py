"""Column expressions over source text. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..rules.languages import LANGUAGES, NEVER, Language

LINE_BREAK = r"\r\n|\n|\r"


def required_literals(pattern: str) -> list[str] | None:
    """Plain substrings of which any match of ``pattern`` must hold at least one.

    A cheap byte-wise ``contains`` on them spares most lines the regex engine.
    """
    from re import _constants as op, _parser

    if "(?i" in pattern:
        return None
    def read(items) -> list[str] | None:
        best: list[str] | None = None
        run = ""
        for code, value in list(items) + [(None, None)]:
            if code is op.LITERAL:
                run += chr(value)
                continue
            if len(run) >= 2 and (best is None or len(run) > min(map(len, best))):
                best = [run]
            run = ""
            inner = None
            if code is op.SUBPATTERN:
                inner = read(value[-1])
            elif code is op.BRANCH:
                parts = [read(b) for b in value[1]]
                inner = [x for p in parts for x in p] if all(parts) else None
            elif code is op.MAX_REPEAT and value[0] >= 1:
                inner = read(value[2])
            if inner and best is None:
                best = inner
        return best

    found = read(_parser.parse(re.sub(r"\\z", r"\\Z", pattern)))
    return found if found and len(found) <= 12 else None


def may_match(col: Column, pattern: str, most: int = 12) -> Column:
    """Does the text hold a literal that any match of ``pattern`` needs? True where there are none, or more than `most`."""
    literals = required_literals(pattern)
    if not literals or len(literals) > most:
        return F.lit(True)
    out = F.lit(False)
    for x in dict.fromkeys(literals):
        out = out | col.contains(x)
    return out


def holds(col: Column, pattern: str, marks: str) -> Column:
    """Does the text hold one of the marks of which any match of ``pattern`` needs one? Only those that the pattern names are looked for."""
    return reduce(or_, (col.contains(m) for m in marks if m in pattern))


def matches(col: Column, pattern: str) -> Column:
    """``rlike`` that folds to false for the never-matching pattern, behind its literals if they are few."""
    return F.lit(False) if pattern.startswith(NEVER) else may_match(col, pattern, 3) & col.rlike(pattern)


def by_language(lang: Column, build: Callable[[Language], Column], langs: Iterable[str] | None = None) -> Column:
    """One expression per language; a bare expression when only one language is asked for."""
    names = list(langs) if langs is not None else [n for n in LANGUAGES if n != "webconfig"]
    if len(names) == 1:
        return build(LANGUAGES[names[0]])
    chosen = None
    for name in names:
        value = build(LANGUAGES[name])
        chosen = F.when(lang == name, value) if chosen is None else chosen.when(lang == name, value)
    return chosen


def split_lines(content: Column) -> Column:
    """Text to an array of lines; a final line break does not open another line. Text of plain breaks needs no regular expression."""
    plain = F.when(content.endswith("\n"), F.left(content, F.length(content) - 1)).otherwise(content)
    mixed = F.split(F.regexp_replace(content, r"(?:\r\n|\n|\r)\z", ""), LINE_BREAK)
    return F.when(content.contains("\r"), mixed).otherwise(F.split(plain, "\n"))


def strip_literals(text: Column, lang: Column, langs: Iterable[str] | None = None) -> Column:
    """Blank string literals so that words inside them are not read as names."""
    return by_language(lang, lambda l: F.regexp_replace(text, l.literal, '""'), langs)


def interpolations(text: Column, lang: Column, langs: Iterable[str] | None = None) -> Column:
    """Expressions inside interpolated strings."""

    def build(l: Language) -> Column:
        if not l.interpolation:
            return F.array().cast("array<string>")
        return F.regexp_extract_all(text, F.lit(l.interpolation), F.lit(1))

    return by_language(lang, build, langs)


def identifiers(text: Column, lang: Column, langs: Iterable[str] | None = None) -> Column:
    """Distinct identifiers used by an expression, literals blanked, interpolations kept."""

    def build(l: Language) -> Column:
        # a text without a quote has no literal, and one without a brace interpolates nothing
        blanked = F.when(holds(text, l.literal, "\"'`"), F.regexp_replace(text, l.literal, '""')).otherwise(text)
        bare = F.regexp_extract_all(blanked, F.lit(l.token), F.lit(1))
        if not l.interpolation:
            return F.array_distinct(bare)
        inner = F.array_join(F.regexp_extract_all(text, F.lit(l.interpolation), F.lit(1)), " ")
        return F.when(text.contains("{"), F.array_union(bare, F.regexp_extract_all(inner, F.lit(l.token), F.lit(1)))).otherwise(F.array_distinct(bare))

    return by_language(lang, build, langs)


QUALIFIED = r"([A-Za-z_]\w*(?:(?:\.|->)[A-Za-z_]\w*)+)"


def qualified_names(text: Column) -> Column:
    """Compound names such as a.b.c or this->x."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(QUALIFIED), F.lit(1)))


# An assignment sign before any bracket or quote; what follows is group 1.
RIGHT_HAND = r"""^[^=("'`]*[^=!<>("'`]=([^=>].*)$"""


def right_hand_side(text: Column) -> Column:
    """Text right of an assignment sign; the whole text for conditions, calls with named
    arguments and lines that assign nothing."""
    part = F.regexp_extract(text, RIGHT_HAND, 1)
    return F.when(text.rlike(r"^\s*(?:if|while)\b") | (part == ""), text).otherwise(part)


# Shapes of assembled strings, bound placeholders and numeric formats.
DYNAMIC = r"""["'`]\s*[+.]\s*[$\w]|[\w)\]]\s*[+.]\s*["'`]|\$\{|#\{|\bf["']|\$"|\.format\s*\(|sprintf\s*\(|Sprintf\s*\(|%\s*\(|["']\s*%\s*\w"""
PLACEHOLDER = r"""\?|[=(,\s]:[A-Za-z_]\w*|\$[0-9]+|@[A-Za-z_]\w*|%s"""


def is_dynamic(text: Column) -> Column:
    """Is a string assembled from parts?"""
    return text.rlike(DYNAMIC)


def is_parameterised(text: Column) -> Column:
    """A query literal with placeholders, followed by bound arguments."""
    return text.rlike(r"""["'`][^"'`]*(?:""" + PLACEHOLDER + r""")[^"'`]*["'`]\s*,\s*[\[(\w$]""")


def format_risk(text: Column) -> Column:
    """NUMERIC when every format specifier is a number, STRING otherwise, null without any."""
    specs = F.regexp_extract_all(text, F.lit(r"%[-+0 #]*[0-9.]*([a-zA-Z])"), F.lit(1))
    return F.when(F.size(specs) == 0, F.lit(None).cast("string")).when(
        F.forall(specs, lambda s: s.isin("d", "i", "u", "x", "o", "f", "e", "g")), "NUMERIC"
    ).otherwise("STRING")


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROTATED = LETTERS[13:26] + LETTERS[:13] + LETTERS[39:] + LETTERS[26:39]


def rot13(text: Column) -> Column:
    return F.translate(text, LETTERS, ROTATED)


def from_codes(codes: Column) -> Column:
    """Array of decimal code points (as text) to a string."""
    return F.array_join(F.transform(codes, lambda c: F.chr(c.cast("int"))), "")


def fold_constant(rhs: Column) -> Column:
    """Plain text hidden behind hex, base64, rot13, reversal, character codes or concatenation."""
    quoted = r"""\(\s*b?["']([^"']*)["']"""

    def arg(name: str) -> Column:
        return F.regexp_extract(rhs, name + r"\s*" + quoted, 1)

    return (
        F.when(rhs.rlike(r"\bfromhex\s*\(|\bhex2bin\s*\("), F.decode(F.try_to_binary(arg(r"\b(?:fromhex|hex2bin)"), F.lit("hex")), "UTF-8"))
        .when(rhs.rlike(r"\b(?:b64decode|base64_decode|atob)\s*\("),
              F.decode(F.try_to_binary(arg(r"\b(?:b64decode|base64_decode|atob)"), F.lit("base64")), "UTF-8"))
        .when(rhs.rlike(r"\bcodecs\.decode\s*\(.*rot|\bstr_rot13\s*\("), rot13(arg(r"\b(?:codecs\.decode|str_rot13)")))
        .when(rhs.rlike(r"\bstrrev\s*\("), F.reverse(arg(r"\bstrrev")))
        .when(rhs.rlike(r"\bchr\s*\("), from_codes(F.regexp_extract_all(rhs, F.lit(r"\bchr\s*\(\s*(\d+)\s*\)"), F.lit(1))))
        .when(rhs.rlike(r"\bfromCharCode\s*\("),
              from_codes(F.regexp_extract_all(F.regexp_extract(rhs, r"fromCharCode\s*\(([^)]*)\)", 1), F.lit(r"(\d+)"), F.lit(1))))
        .when(rhs.rlike(r"""^\s*["'][^"']*["'](?:\s*[+.]\s*["'][^"']*["'])*\s*$"""),
              F.array_join(F.regexp_extract_all(rhs, F.lit(r"""["']([^"']*)["']"""), F.lit(1)), ""))
        .when(rhs.rlike(r"""["']\s*\.join\s*\(\s*\["""),
              F.array_join(F.regexp_extract_all(F.regexp_extract(rhs, r"join\s*\(\s*\[([^\]]*)\]", 1), F.lit(r"""["']([^"']*)["']"""), F.lit(1)), ""))
    )
