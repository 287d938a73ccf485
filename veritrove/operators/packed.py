"""Several values packed in one field: one row per value, with its position and an error flag.

A field is read by a small parsing expression grammar, its alternatives tried in this order::

    field   <- '[' list ']' / '(' list ')' / '{' list '}' / list
    list    <- slot (SEP slot)*
    slot    <- quoted / bare / empty
    quoted  <- Q (doubled Q / any)* Q  followed by SEP, "et al" or the end   (else back to bare)
    bare    <- (bracketed / any but SEP)+
    bracketed <- '(' ... ')' / '[' ... ']'                                   (else back to any)

``list`` is itself ordered: the grammar in which a comma is part of a name is tried first and holds
if it meets a separator other than comma, ampersand and "and"; otherwise the comma separates.

Defined results: null, empty, blank and separator-only fields hold no values.  Empty slots and
"et al." are no values and take no position.  Repeated values count each.  A placeholder that
holds a separator itself (``N/A``) is one value.  ``flag`` is null, ``quote`` (a quote that never
closes; it is left out of the value), ``bracket`` (a bracket that never closes) or, of names,
``placeholder`` (the value stands for a missing author).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "`": "`"}
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_NAMES_STRONG = re.compile(r"[;|\n\r&]|/(?!(?<=\bN/)A\b)|(?<!\S)and(?!\S)", re.I)
_NAMES_WEAK = re.compile(r"[,;|\n\r&]|/(?!(?<=\bN/)A\b)|(?<!\S)and(?!\S)", re.I)
_CODES = re.compile(r"[,;|/&+\s]")
_STRONG = frozenset(";|/\n\r")
_ET_AL = re.compile(r"(?:^|(?<=\s))(?:and\s+)?et\.?\s*al(?:ii|\b)\.?\s*$", re.I)
_AFTER_QUOTE = re.compile(r"\s*(?:$|[,;|/\n\r&+]|et\.?\s*al\b|and\s)", re.I)
_OUTER = "".join(map(chr, range(9, 14))) + " \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200E))) + "    ⁠　﻿" + ",;|/&+"
_PLACEHOLDER = re.compile(
    r"unknown(?:\s+authors?)?|n\s*(?:[./]\s*)?a|none|null|nil|anon|anonymous|not\s+(?:available|given|stated|known)|no\s+authors?(?:\s+(?:listed|given))?|missing|tba|tbd|various",
    re.I,
)
_SIGNS = re.compile(r"\W*")
_OPENED = re.compile(r"[(\[{]")


def is_placeholder(value: str) -> bool:
    """Whether an author value stands for a missing author: no letter at all, or a stock phrase between other signs."""
    low, high = _SIGNS.match(value).end(), len(value)
    while high > low and not (value[high - 1].isalnum() or value[high - 1] == "_"):
        high -= 1
    return low == high or _PLACEHOLDER.fullmatch(value, low, high) is not None


class _Reader:
    """The quotes, brackets and separators of one field, each looked for once whatever the field holds.

    What is remembered is where no quote of a kind closes any more, where the last bracket of a kind
    closes, and the next separator; so a field is read in time that grows with its length.
    """

    def __init__(self, text: str, sep: re.Pattern) -> None:
        self.text, self.sep = text, sep
        self.last = {b: text.rfind(b) for b in _BRACKETS.values()}
        self.dead: dict[str, int] = {}
        self.next: re.Match | None = None
        self.sought = -1

    def separator(self, at: int) -> re.Match | None:
        """The first separator at ``at`` or behind it; ``at`` never falls."""
        if self.sought < 0 or (self.next is not None and self.next.start() < at):
            self.next = self.sep.search(self.text, at)
            self.sought = at
        return self.next

    def quoted(self, at: int) -> tuple[str, int] | None:
        """The quoted value that opens at ``at`` and the place behind it, or None to go back to bare."""
        text, close = self.text, _QUOTES[self.text[at]]
        here, dead = at + 1, self.dead.get(close, len(text))
        while (end := text.find(close, here)) >= 0:
            if end > here and end >= dead:
                return None
            if text.startswith(close * 2, end) and end + 2 < len(text) and not _AFTER_QUOTE.match(text, end + 1):
                here = end + 2
            elif _AFTER_QUOTE.match(text, end + 1):
                return text[at + 1 : end].replace(close * 2, close), end + 1
            else:
                here = end + 1
        self.dead[close] = min(dead, at + 1)
        return None

    def bare(self, at: int) -> tuple[int, int, str | None]:
        """End of a bare value, end of the separator behind it, and an error."""
        text, error, here = self.text, None, at
        while True:
            found = self.separator(here)
            stop = found.start() if found else len(text)
            opened = _OPENED.search(text, here, stop)
            if opened is None:
                return stop, found.end() if found else len(text) + 1, error
            close = _BRACKETS[opened.group()]
            if self.last[close] < opened.start():
                error, here = "bracket", opened.end()
            else:
                here = text.find(close, opened.start()) + 1


def _parse(text: str, sep: re.Pattern) -> tuple[list[tuple[str, str | None]], set[str]]:
    values: list[tuple[str, str | None]] = []
    met: set[str] = set()
    reader = _Reader(text, sep)
    at, end = 0, len(text)
    while at < end:
        if text[at].isspace() and text[at] not in "\n\r":
            at += 1
            continue
        error = None
        if text[at] in _QUOTES:
            if (got := reader.quoted(at)) is not None:
                if value := got[0].strip(_OUTER):
                    values.append((value, None))
                at = got[1]
                if (found := reader.separator(at)) is None:
                    break
                if text[at : found.start()].strip() == "":
                    met.add(found.group())
                    at = found.end()
                continue
            error = "quote"
        stop, behind, bracket = reader.bare(at)
        value = text[at:stop]
        if behind <= end:
            met.add(text[stop:behind])
        if error:
            value = value.replace(text[at], "", 1)
        value = _ET_AL.sub("", value).strip(_OUTER)
        if value:
            values.append((value, error or bracket))
        at = behind
    return values, met


@lru_cache(maxsize=20_000)
def split_packed(text: str | None, kind: str = "names") -> tuple[tuple[str, str | None], ...]:
    """The values of one field as (value, flag), in order.  ``kind`` is ``names`` or ``codes``."""
    if text is None or not (body := text.strip()).strip(_OUTER):
        return ()
    for _ in range(2):
        if len(body) > 1 and body[0] in _BRACKETS and body[-1] == _BRACKETS[body[0]] and body.find(_BRACKETS[body[0]]) == len(body) - 1:
            body = body[1:-1].strip()
    if kind == "codes":
        return tuple(_parse(body, _CODES)[0])
    if not body.strip(_OUTER):
        return ()
    if is_placeholder(body):
        return ((body.strip(_OUTER), "placeholder"),)
    values, met = _parse(body, _NAMES_STRONG)
    if not met & _STRONG:
        values, _ = _parse(body, _NAMES_WEAK)
    return tuple((value, "placeholder" if is_placeholder(value) else flag) for value, flag in values)


def unpack(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """One row per value: ``id_col``, ``field_name``, ``pos`` (INT, from 1), ``n_values`` (INT, of
    that field), ``item_value``, ``flag``.

    ``fields`` gives the kind of each packed column.  Only ``id_col`` and those columns are read,
    so further columns and clashing names do no harm.  The work is row by row without a shuffle:
    a row's fields stay in one Arrow batch.  An empty table gives no rows.
    """
    names = list(fields)
    source = df.select(F.col(id_col).alias("_id"), *(F.col(c).cast("string").alias(f"_f{k}") for k, c in enumerate(names)))
    source = source.where(" or ".join(f"_f{k} is not null" for k in range(len(names))))
    id_type = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            take: list[int] = []
            for k, name in enumerate(names):
                kind = fields[name]
                for at, text in enumerate(batch.column(k + 1).to_pylist()):
                    if text is None:
                        continue
                    got = split_packed(text, kind)
                    for pos, (value, flag) in enumerate(got, 1):
                        take.append(at)
                        rows[0].append(name)
                        rows[1].append(pos)
                        rows[2].append(len(got))
                        rows[3].append(value)
                        rows[4].append(flag)
            if take:
                ids = batch.column(0).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())],
                    names=["_id", "field_name", "pos", "n_values", "item_value", "flag"],
                )

    return source.mapInArrow(run, f"_id {id_type}, field_name string, pos int, n_values int, item_value string, flag string").withColumnRenamed("_id", id_col)


def authors_of(papers: DataFrame, id_col: str = "record_id", column: str = "authors") -> DataFrame:
    """``id_col`` and ``author``: every author value of ``papers`` without placeholders."""
    values = unpack(papers, id_col, {column: "names"})
    return values.where("flag is null or flag <> 'placeholder'").select(id_col, F.col("item_value").alias("author"))
