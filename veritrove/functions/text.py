"""Text helpers as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrove.functions.vocabulary import BLANK_SIGNS, BLANKS, java


def strip(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANK_SIGNS))


def found(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(group))


def numbers(strings: Column, kind: str = "double") -> Column:
    """The strings that are numbers, as such."""
    return F.filter(F.transform(strings, lambda s: s.try_cast(kind)), lambda v: v.isNotNull())


def any_of(lowered: Column, phrases: Iterable[str]) -> Column:
    """Whether a lower-cased text contains one of the phrases."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(lowered, F.lit(phrase))
    return out


def literals(pattern: str) -> list[str]:
    """Stretches of three or more plain letters that every match of a pattern without alternation holds."""
    plain = re.sub(r"\\[sSdDwWb][+*?]?|\\.|\.[*+?]?|[+*?]", "\n", pattern)
    return [x for x in re.findall(r"[a-z ]+", plain) if len(x) >= 3]


def in_line(pattern: str) -> str:
    """A pattern with ``.*`` between parts, so that a line is read once: each part from where the one before first ends.

    Whether a line holds the parts in order does not depend on which of their places are taken, so the first ones will do.
    """
    parts = re.split(r"\.\*\??", pattern)
    return pattern if len(parts) == 1 else "(?m)^" + "".join(f"(?>.*?(?:{part}))" for part in parts)


def matches(text: Column, phrases: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found in the text, without regard to case.

    A pattern is tried only on texts whose ``phrases`` hold its literal parts.
    """
    out = F.lit(False)
    for pattern in (q for p in patterns for q in p.split("|")):
        needed = F.lit(True)
        for literal in literals(pattern):
            needed = needed & F.array_contains(phrases, literal)
        out = out | (needed & text.rlike(java(in_line(pattern))))
    return out


def pieces_with(text: Column, markers: Iterable[str], least: int) -> Column:
    """Pieces of at least ``least`` characters that contain one of the markers, without regard to case."""
    both = F.transform(pieces(text), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    kept = F.filter(both, lambda x: (F.length(x["s"]) >= least) & any_of(x["low"], markers))
    return F.transform(kept, lambda x: x["s"])


def pieces(text: Column) -> Column:
    """What stands between full stops, exclamation and question marks, without outer blanks."""
    return F.transform(F.split(text, "[.!?]", -1), strip)


def word_count(text: Column) -> Column:
    """Number of words between blanks."""
    return F.regexp_count(text, F.lit(rf"[^{BLANKS}]+"))
