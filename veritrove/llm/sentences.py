"""Sentence units of texts in any language or script, with their places (problem 4).

Each paragraph is read once by a pushdown automaton.  Its stack holds the levels of lists, quotations and
brackets that are open, so a terminator within a quotation or bracket doesn't end the unit around it; one that
never closes in its paragraph is left off the stack.  Where a terminator stands at the bottom level
(or right before the sign that closes the last level), the automaton decides by what is before it,
looked up in a trie of abbreviations read from the right, and by what comes next.  Thai, which has
no terminators, is divided at blanks between its letters.  A list item that begins a line begins a unit; an item
of another kind of label opens a level within the item before it, and one of a kind that is open closes the levels in between.

Defined results: null, empty and blank texts give no rows.  Blank lines (also with blanks in them) and
paragraph separators end a unit.  A paragraph without a terminator at its end is a title or heading, one unit, if it is one
clause or a question (or call) with what belongs to it; full stops within it divide it as any other, whatever its
length.  Offsets count code points, ends are exclusive; zero-width characters at either end of a unit count as blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TERMINATORS = ".!?…。！？।॥؟۔｡．"
_WIDE = "。！？।॥؟۔｡"  # end a sentence whatever follows, without a blank
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "‘": "’", "«": "»", "„": "“”", "‚": "‘’", "‹": "›"}
_CLOSERS = frozenset("".join(_PAIRS.values()) + '"')
_SIGNS = re.compile(r"[.!?…．]+|[。！？।॥؟۔｡]+|[()\[\]{}（）［］【】「」『』《》〈〉“”‘’«»„‚‹›\"]")
_BREAK = re.compile(r"(?:\r\n|[\n\r\v\x85 ])(?:[^\S\n\r\v]*(?:\r\n|[\n\r\v\x85 ]))+| |\f")
_BLANKS = "".join(map(chr, range(9, 14))) + " \x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200E))) + "    ⁠　﻿"
_ITEM = re.compile(r"(?:^|[\n\r])[^\S\n\r]*(?:[-•*‣▪◦–]|\d{1,3}\.|\(?(?:\d{1,3}|[a-zA-Z])\))[^\S\n\r]+")
_LABEL = re.compile(r"(?P<bullet>[-•*‣▪◦–])|(?P<number>\d+)(?P<point>\.)|\(?(?:(?P<digits>\d+)|(?P<upper>[A-Z])|(?P<lower>[a-z]))\)")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"(?<=[฀-๏๚-๿])\s+(?=[฀-๏๚-๿A-ZÀ-Þ“«‘\"(])|(?<=[^\W\d_])\s+(?=[เ-ไก-ฮ])")
_WORD_BEFORE = re.compile(r"\S*$")
_URL = re.compile(r"(?:https?:|www\.|doi:|@|/)")
_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Mal Male Jahrhundert Tag Tage Woche Quartal Semester Lebensjahr Lebenswoche Tagung Auflage Stock Platz"
_ORDINAL_NEXT = frozenset(_MONTHS.split())

#: Abbreviations that never end a sentence: something must follow.
_NEVER = """dr prof mr mrs ms mme mlle mm st ste sr sra srta dra dres drs hr fr frl hon rev gen col lt capt sgt messrs pres gov sen rep
e.g i.e e.g., i.e., cf vs viz approx ca c.-à-d c-à-d z.b bzw vgl d.h u.a s.o s.u p.ej p.ex aprox env resp sog evtl ggf inkl max min
fig figs tab tabl tbl abb abs eq eqs ref refs sec sect ch chap vol vols no nos nr núm num n° pág págs pp p art kap bd suppl app apdo
jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic okt dez
т.е т.к т.д т.п см рис табл гл стр проф акад д-р г-н г-жа им ул св
डॉ श्री प्रो дир al-b véase cap ed eds esp est ext hrsg lic ing arq ud uds av avda c/ ctra blvd ave rd mt ft""".split()
#: Abbreviations that may end one: they do if what follows begins like a sentence.
_MAYBE = """al etc usw inc ltd corp co bros llc gmbh u.s u.k u.n e.u a.m p.m a.d b.c ph.d m.d b.sc m.sc jr sr. ff f et.al г гг в вв и.др др и.т.д и.т.п тыс млн млрд руб
etcétera ee.uu s.a cía cia ibid op.cit loc.cit id seq sqq o.ä o.g u.v.m usf n.chr v.chr div dept univ assn""".split()
#: Words after which a single letter is a label, not the initial of a name.
_LABELS = frozenset("ward part type vitamin group class phase figure table panel arm plan hepatitis site room block appendix section stage grade unit level cohort option category gebäude station gruppe teil typ groupe partie grupo parte tipo sala".split())
_STARTERS = frozenset("the a an in it its we this that these those there to for from as at by on of our each both all no if when while whereas however to".split())


def _trie(words: list[str], kind: str, root: dict) -> dict:
    """Adds words, read from the right, to a trie; the kind is kept under the empty key."""
    for word in words:
        node = root
        for ch in reversed(word):
            node = node.setdefault(ch, {})
        node.setdefault("", kind)
    return root


_ABBREVIATIONS = _trie(_MAYBE, "maybe", _trie(_NEVER, "never", {}))


def _abbreviation(text: str, low: int, dot: int) -> str | None:
    """Kind of the longest abbreviation that ends at ``dot`` and begins a word, or None.

    Blanks behind inner dots don't count ("z. B.", "d. h.").
    """
    node, at, kind = _ABBREVIATIONS, dot - 1, None
    while at >= low:
        ch = text[at].lower()
        if ch.isspace():
            # a blank within, only right behind a dot
            back = at
            while back >= low and text[back].isspace():
                back -= 1
            if back < low or text[back] != "." or "." not in node:
                break
            at = back
            ch = "."
        node = node.get(ch)
        if node is None:
            break
        at -= 1
        if "" in node and (at < low or not (text[at].isalnum() or text[at] in "-./")):
            kind = node[""]
    return kind


def _pairs(text: str, low: int, high: int, signs: list[re.Match]) -> dict[int, int]:
    """Place of the closing sign for every opening sign that has one in the paragraph."""
    stack: list[tuple[str, int]] = []
    found: dict[int, int] = {}
    for m in signs:
        ch, at = m.group()[0], m.start()
        if ch == '"':
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if k is None:
                stack.append(('"', at))
            else:
                found[stack[k][1]] = at
                del stack[k:]
            continue
        if ch == "’" and at + 1 < high and text[at + 1].isalpha() and at > low and text[at - 1].isalpha():
            continue  # an apostrophe
        k = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][0]), None) if ch in _CLOSERS else None
        if k is not None:
            found[stack[k][1]] = at
            del stack[k:]
        elif ch in _PAIRS:
            stack.append((_PAIRS[ch], at))
        elif ch == "»" and at + 1 < high and text[at + 1].isalnum():
            stack.append(("«", at))
    return found


def _starts_sentence(text: str, at: int, high: int) -> bool:
    """Whether what begins at ``at`` looks like the begin of a sentence."""
    ch = text[at]
    if ch.isupper() or ch.istitle() or ch.isdigit():
        return True
    if ch in "¿¡":
        return True
    if ch in "([{（“‘«„‚‹\"「『【'*_-–—•":
        after = at + 1
        while after < high and (text[after].isspace() or text[after] in "([“‘«„\"'*_"):
            after += 1
        return after < high and (text[after].isupper() or text[after] in "¿¡" or (text[after].isalpha() and not text[after].islower()) or (text[after].isdigit() and ch not in "([{（"))
    if not ch.isalpha():
        return ord(ch) > 0x2190 and not ch.isspace()
    if not ch.islower() or ord(ch) >= 0x1D400:
        return True  # a script without cases, or a mathematical letter
    # a symbol in lower case: "p values", "pH", "mTOR"
    end = at
    while end < high and (text[end].isalnum() or text[end] in "-'"):
        end += 1
    word = text[at:end]
    return (len(word) == 1 and word not in "aeouyàéèwvси") or any(c.isupper() for c in word)


def _ends_here(text: str, low: int, begin: int, dot: int, stop: int, high: int) -> bool:
    """Whether the terminators ``text[dot:stop]``, with closing signs up to ``stop``, end the unit."""
    run = text[dot]
    after = stop
    while after < high and text[after] in _BLANKS:
        after += 1
    if after >= high:
        return True
    spaced = after > stop
    following = text[after]
    if run in _WIDE:
        return True
    closed = text[stop - 1] in _CLOSERS
    ellipsis = text.startswith("...", dot) or run == "…"
    if not spaced:
        if following in ",;:)]}»”’/" or not (following.isupper() or following in "¿¡“«„‘(" or not following.isascii() and following.isalpha() and not following.islower()):
            return False
        before = text[dot - 1] if dot > low else " "
        word = _WORD_BEFORE.search(text, begin, dot).group() if dot > begin else ""
        if _URL.search(word) or not (before.isalnum() or before in ")]%°”»’") or before.isupper() and following.isupper():
            return False
        if following.isascii() and following.isupper() and not (after + 1 < high and (text[after + 1].islower() or text[after + 1].isspace() or text[after + 1].isupper() and before.islower())):
            return False
    if following in ",;:)]}»”’—–،؛，；":
        return False
    if not _starts_sentence(text, after, high):
        return False
    if ellipsis or run != "." or closed:
        return True
    # a full stop: is what it follows an abbreviation, an initial or a number?
    kind = _abbreviation(text, begin, dot)
    if kind == "never":
        return False
    if kind == "maybe":
        return not (following in "([" and after + 1 < high and (text[after + 1].isdigit() or text[after + 1].islower())) and not following.isdigit()
    word = _WORD_BEFORE.search(text, begin, dot).group().lstrip("([{“‘«„\"'")
    if word.isdigit() or re.fullmatch(r"[IVX]+|\d+(?:\.\d+)*", word):
        if not text[begin : dot - len(word)].strip(_BLANKS + "([{“‘«„\"'"):
            return False  # the number of a heading or item
        if word.isdigit() and len(word) <= 2:
            end = after
            while end < high and text[end].isalpha():
                end += 1
            return text[after:end] not in _ORDINAL_NEXT
        if word.isdigit():
            return True
    if len(word) == 1 and word.isalpha():
        if word.islower():
            return False
        if following in "([“«":
            return True
        head = text[begin : dot - 1].rstrip(_BLANKS)
        if not head or head[-1] == "." or head[-1] in ",;([&-/":
            return False
        previous = _WORD_BEFORE.search(head).group().strip("([{“‘«„\"'")
        if previous.lower() in _LABELS:
            return True
        if not previous[:1].isupper():
            return not previous[:1].isalpha() or previous.lower() not in ("and", "und", "et", "y", "by", "von", "par", "de", "with", "to", "и")
        end = after
        while end < high and text[end].isalpha():
            end += 1
        return text[after:end].lower() in _STARTERS
    return True


def _levels(text: str, low: int, items: list[re.Match]) -> list[int]:
    """Places of the items of lists in a paragraph, by a stack of the kinds of labels that are open.

    A kind is a list if it has two items, or if its first label opens a level within an item; a list begins with its
    paragraph, behind a colon or within an item.
    """
    kinds: list[str] = []
    firsts: list[bool] = []
    for m in items:
        label = _LABEL.search(m.group())
        kinds.append(m.group().strip() if label.lastgroup == "bullet" else "number." if label["point"] else label.lastgroup)
        firsts.append(label.group().strip("().") in ("1", "a", "A"))
    count = {k: kinds.count(k) for k in set(kinds)}
    stack: list[str] = []
    out = []
    for m, kind, first in zip(items, kinds, firsts, strict=True):
        if kind in stack:
            del stack[stack.index(kind) + 1 :]
        elif (count[kind] >= 2 and (stack or m.start() == low or text[low : m.start()].rstrip(_BLANKS).endswith((":", "：")))) or (stack and first):
            stack.append(kind)
        else:
            continue
        out.append(m.start())
    return out


def _paragraph(text: str, low: int, high: int, out: list[tuple[int, int]]) -> None:
    """Units of the paragraph ``text[low:high]``, which has no blanks at its ends."""
    before = len(out)
    plain = _units(text, low, high, out)
    last = high - 1
    while last > low and text[last] in _CLOSERS:
        last -= 1
    # A title: a question or call and what belongs to it, without a terminator.
    if plain and len(out) == before + 2 and text[last] not in _TERMINATORS and text[last] not in ":;," and text[out[-2][1] - 1] in "?!？！؟":
        out[before:] = [(low, high)]


def _units(text: str, low: int, high: int, out: list[tuple[int, int]]) -> bool:
    """The units by the automaton; gives whether there is neither a list nor Thai."""
    signs = list(_SIGNS.finditer(text, low, high))
    thai = _THAI.search(text, low, high) is not None
    items = _levels(text, low, list(_ITEM.finditer(text, low, high)))
    listed = bool(items)
    gaps = {m.start(): m.end() for m in _THAI_GAP.finditer(text, low, high)} if thai else {}
    marks = [(m.start(), m.end(), m.group()) for m in signs]
    if gaps:
        marks += [(a, b, " ") for a, b in gaps.items()]
    if listed:
        marks += [(at, at + 1, "\n") for at in items if at > low]
    if gaps or listed:
        marks.sort()
    matching = _pairs(text, low, high, [m for m in signs if m.group()[0] not in _TERMINATORS])
    stack: list[tuple[int, bool, bool]] = []  # place of the closing sign, at the unit's begin, after a colon
    begin = low
    skip = -1

    def cut(at: int) -> int:
        out.append((begin, at))
        while at < high and text[at] in _BLANKS:
            at += 1
        return at

    for at, end, sign in marks:
        if at < skip:
            continue
        if at < begin:
            continue
        if sign in (" ", "\n"):
            if not stack and at > begin:
                begin = cut(at)
            continue
        first = sign[0]
        if first not in _TERMINATORS:
            if stack and at == stack[-1][0]:
                _, whole, colon = stack.pop()
                if stack or text[at - 1] not in _TERMINATORS:
                    continue
                stop = at + 1
                while stop < high and text[stop] in _CLOSERS and stop not in matching:
                    stop += 1
                after = stop
                while after < high and text[after] in _BLANKS:
                    after += 1
                if after >= high:
                    break
                following = text[after]
                wide = following > "⿿" or text[at] in "」』）】》"
                if wide:
                    if following in "，、；：,。．.!！?？)）」』" or (following in "とってにのはがをで" and text[at] in "」』"):
                        continue
                    if whole and not colon and re.match(r"[他她它我你您们咱]*[^，。！？]{0,6}?[问問說说道答喊写記记]", text[after : after + 10]):
                        continue
                    if not whole and not colon and text[at] in ")）]】":
                        continue
                    begin = cut(stop)
                    skip = stop
                elif whole or text[at] not in ")]}":
                    if following in _TERMINATORS or not _ends_here(text, low, begin, at - 1 if text[at - 1] in "!?…" else at, stop, high):
                        continue
                    begin = cut(stop)
                    skip = stop
                continue
            if (close := matching.get(at)) is not None:
                head = text[begin:at].rstrip(_BLANKS)
                stack.append((close, not head, head.endswith((":", "："))))
            continue
        if stack:
            continue
        stop = end
        while stop < high and text[stop] in _CLOSERS and stop not in matching and text[stop] != '"':
            stop += 1
        if first in _WIDE:
            begin = cut(stop)
            skip = stop
        elif _ends_here(text, low, begin, at, stop, high):
            begin = cut(stop)
            skip = stop
    if begin < high:
        out.append((begin, high))
    return not thai and not listed


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every unit of ``text``, in order."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    low, size = 0, len(text)
    edges = [(m.start(), m.end()) for m in _BREAK.finditer(text)] + [(size, size)]
    for stop, after in edges:
        a, b = low, stop
        while a < b and text[a] in _BLANKS:
            a += 1
        while b > a and text[b - 1] in _BLANKS:
            b -= 1
        if a < b:
            _paragraph(text, a, b, out)
        low = after
    return out


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``sent_no`` (from 1), ``start_at`` and ``end_at`` of every unit; no shuffle."""
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null and _text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, number, starts, ends = [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(sentence_spans(text), 1):
                    take.append(at)
                    number.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["_id", "sent_no", "start_at", "end_at"]
            )

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, sent_no int, start_at int, end_at int").withColumnRenamed("_id", id_col)
