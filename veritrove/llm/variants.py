"""Variant spellings of names typed by people, linked (problem 5).

1. Every distinct string is read into plain tokens: a person's family name, given name (told by
   a lexicon, one slip of the pen allowed; nicknames stand for the name) and initials in any order; of journals
   and groups the words that carry meaning.  Strings with the same tokens are one form; only forms are compared.
2. MinHash over padded q-grams: of persons the 3-grams of the family name, each joined with the first
   initial; of titles those of the words' beginnings, so that abbreviations share them.  Forms with one and
   the same set of q-grams have one key, and only distinct keys are banded.  ``BANDS`` bands of ``ROWS`` rows follow
   from the collision curve 1 - (1 - s^r)^b, at least ``RECALL`` at similarity ``LEAST``, which one slip in a
   family name of six letters still keeps.  Buckets with very many keys are split.
3. Forms of one key, and of two keys that share a bucket, are compared where they have a probe in common: a
   beginning of the given name (of titles, of a word) or what is left of it without one letter.  Every
   pair that verification can accept has one, so nothing is lost, and no two names are compared for having
   a popular family name only.
4. Pairs are verified by Monge-Elkan similarity, each way, with a graded similarity of words.
5. Star clustering by rank within a key: a form is a centre unless a centre of higher rank verifies it; all centres
   that can be told are told in one round, so rounds follow chains of slips and not the number of people of a name.
   Then a star joins the best larger star of another key.  Where the two differ by a slip in a
   word and both spellings of it also stand in stars that no slip explains, they are two names and stay apart.

Defined results: nulls, empty strings and placeholders are no names.  Strings that differ only in case,
accents, order or punctuation are variants.  A string of initials only joins the person of highest rank
of that family name and initial.  Ties are broken by the string itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.llm.pii import GIVEN
from veritrove.sources.scratch import Scratch

LEAST = 0.33
RECALL = 0.985
ROWS = 3
#: Bands needed for RECALL at LEAST, from the collision curve.
BANDS = math.ceil(math.log(1 - RECALL) / math.log(1 - LEAST**ROWS))
#: Least Monge-Elkan similarity.
THRESHOLD = 0.85

#: Rows of a bucket or cluster that meet in one task; larger ones are split.
SPLIT = 1_000

#: Common short forms of given names; a fixed table.
NICKNAMES = {
    short: name
    for name, shorts in {
        "alexander": "alex sasha sacha xander alec", "anne-marie": "annemarie", "benjamin": "ben benny benji", "katherine": "kate kathy katie kathe kit", "ekaterina": "katya katia",
        "dmitri": "dima dimitri mitya", "eduardo": "lalo edu", "elizabeth": "liz beth betty lizzie eliza bess libby", "francisco": "paco pancho fran", "giuseppe": "beppe peppe pino",
        "gwendolyn": "gwen", "henrietta": "hetty etta", "jean-luc": "jeanluc luc", "johannes": "hans jan hannes", "leonora": "nora lea", "margaret": "meg peggy maggie greta marge",
        "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie", "samuel": "sam sammy", "theodora": "dora thea", "tobias": "toby tobi", "william": "bill will billy willy liam",
        "michael": "mike mick", "thomas": "tom tommy", "james": "jim jimmy jamie", "joseph": "joe", "charles": "charlie chuck", "edward": "ed eddie ted", "anthony": "tony",
        "daniel": "dan danny", "david": "dave", "matthew": "matt", "nicolas": "nick", "patricia": "pat patty", "peter": "pete", "stephen": "steve", "susan": "sue", "victor": "vic",
        "christopher": "chris kit", "nicholas": "nico", "timothy": "tim", "lawrence": "larry", "frederick": "fred freddy", "walter": "walt", "theodore": "ted teddy", "catherine": "cathy cath", "virginia": "ginny",
        "rebecca": "becky", "deborah": "debbie", "jennifer": "jenny", "jacob": "jake", "andrew": "andy drew", "gregory": "greg", "maria": "masha", "mary": "molly polly", "philip": "phil",
    }.items()
    for short in shorts.split()
}
_PARTICLES = frozenset("de la le van der den von del della di da dos du ter ten zu bin ibn al el las los".split())
_GROUP = re.compile(r"\b(?:consorti?\w*|consort|groups?|collaborat\w*|network|committee|team|initiative|investigators?|society|association|study|trialists?|working|institute|university|cent(?:re|er)|project|alliance|registry|panel|board|task)\b", re.I)
#: Words that stand in the name of a group, but in no person's.
_BETWEEN = re.compile(r"(?<![\w.])(?:of|for|the|in|on|and)(?![\w.])")
_EMPTY = frozenset("in of the and for on a an de la le les des du der die das und et y di online print international".split())
_LETTERS = str.maketrans("øłđßæœıðþ", "oldsaoidt")


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(_LETTERS).replace("’", "'")


def one_slip(a: str, b: str) -> bool:
    """Whether one letter added, dropped, replaced, or two neighbours swapped lead from ``a`` to ``b``."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    if len(a) < len(b):
        return a[k:] == b[k + 1 :]
    return a[k + 1 :] == b[k + 1 :] or (k + 1 < len(a) and a[k] == b[k + 1] and a[k + 1] == b[k] and a[k + 2 :] == b[k + 2 :])


@lru_cache(maxsize=1)
def _slips() -> dict[str, list[str]]:
    """Given names by what is left of them without one letter."""
    out: dict[str, list[str]] = {}
    for name in sorted(GIVEN):
        for k in range(len(name)):
            out.setdefault(name[:k] + name[k + 1 :], []).append(name)
    return out


@lru_cache(maxsize=100_000)
def is_given(token: str) -> bool:
    """Whether a plain token is a known given name, or one slip away from one."""
    if token in NICKNAMES or token in GIVEN:
        return True
    if len(token) < 4:
        return False
    near = set(_slips().get(token, ()))
    for k in range(len(token)):
        rest = token[:k] + token[k + 1 :]
        if rest in GIVEN:
            near.add(rest)
        near.update(_slips().get(rest, ()))
    return any(n[0] == token[0] and len(n) > 3 and one_slip(n, token) for n in near)


@lru_cache(maxsize=100_000)
def _shortened(word: str) -> frozenset[str]:
    """What is left of a word, and of its beginning, without one letter."""
    return frozenset({word[:k] + word[k + 1 :] for k in range(len(word))} | {word})


class Name:
    """A string as it is compared: ``key`` (equal for equal sketches), ``words``, ``given``, ``initials``, ``full``, ``form``."""

    __slots__ = ("form", "full", "given", "initials", "key", "person", "words")

    def __init__(self, kind: str, text: str) -> None:
        self.given, self.initials, self.person = "", "", False
        body = unicodedata.normalize("NFKC", text).strip()
        if kind == "author" and not _GROUP.search(body) and not _BETWEEN.search(body):
            self._person(body)
        else:
            self._title(body)

    def _title(self, text: str) -> None:
        words = re.findall(r"[^\W_]+", plain(text.replace("-", " ")))
        words = [w for w in words if w not in _EMPTY] or words
        self.words = sorted("journal" if w in ("j", "jour", "jnl") else w for w in words)
        self.full = not re.search(r"\w\.(?:\s|,|$)", text)
        self.key = "t|" + " ".join(sorted(w[:3] for w in self.words))
        self.form = "t|" + " ".join(self.words)

    def _person(self, text: str) -> None:
        left, comma, right = text.partition(",")
        tokens: list[str] = []
        side: list[bool] = []  # before the comma
        letters: list[str] = []
        for part, before in ((left, True), (right, False)):
            for raw in part.replace(".", ". ").split():
                bare = raw.strip(".,;:()[]\"'")
                if not bare:
                    continue
                if len(bare) > 1 and not raw.rstrip(",;").endswith(".") and plain(bare) in _PARTICLES:
                    tokens.append(plain(bare))
                    side.append(before)
                elif (len(bare) <= 2 or not re.search(r"[aeiouyáéíóúöäü]", bare.lower()) and len(bare) <= 3) and bare.isupper() and bare.isalpha():
                    letters.append(bare)
                else:
                    tokens.append(plain(bare))
                    side.append(before)
        for k in range(len(tokens) - 1, 0, -1):
            if side[k] == side[k - 1] and f"{tokens[k - 1]}-{tokens[k]}" in GIVEN:
                tokens[k - 1 : k + 1] = [f"{tokens[k - 1]}-{tokens[k]}"]
                del side[k]
        particles = [t for t in tokens if t in _PARTICLES]
        side = [s for t, s in zip(tokens, side, strict=True) if t not in _PARTICLES]
        tokens = [t for t in tokens if t not in _PARTICLES]
        at = None
        if comma and len(set(side)) == 2:
            at = side.index(False)
        elif len(tokens) > 1:
            exact = [k for k, t in enumerate(tokens) if t in GIVEN or t in NICKNAMES]
            close = exact or [k for k, t in enumerate(tokens) if is_given(t)]
            at = close[0] if close else (None if letters else 0 if not text.split()[0].isupper() else len(tokens) - 1)
        if at is not None:
            # a slip of the pen stays: it is verified against what others write
            self.given = NICKNAMES.get(tokens[at], tokens[at])
            tokens = tokens[:at] + tokens[at + 1 :]
        self.initials = plain("".join(letters))
        self.person = True
        self.words = [re.sub(r"[^\w]", "", t) for t in particles + sorted(tokens)]
        self.words = [w for w in self.words if w] or [plain(text)]
        first = self.given[:1] or self.initials[:1]
        self.full = bool(self.given)
        self.key = f"p|{first}|" + " ".join(self.words)
        self.form = f"{self.key}|{self.given}"

    def probes(self, across: bool) -> list[str]:
        """What a form of the same key (or, ``across``, of another one) that verification accepts has in common with this one."""
        if self.person:
            words = [self.given] if self.given else []
        else:
            # within a key the words of the first beginning have their counterparts among themselves
            least = min((w[:3] for w in self.words), default="")
            words = self.words if across else [w for w in self.words if w[:3] == least]
        return sorted({p for w in words for p in ({w} | {w[:k] for k in range(3, len(w))} | {w[:k] + w[k + 1 :] for k in range(len(w))})})

    def grams(self) -> list[str]:
        """Padded 3-grams of the sketch."""
        if self.person:
            first = self.key.split("|")[1]
            body = f"##{''.join(self.words)}##"
            return sorted({f"{first}|{body[k : k + 3]}" for k in range(len(body) - 2)})
        return sorted({f"##{w}"[k : k + 3] for w in self.words for k in range(min(3, len(w)))})


@lru_cache(maxsize=200_000)
def read_name(kind: str, text: str) -> Name:
    """The string as it is compared."""
    return Name(kind, text)


def _alike(a: str, b: str, title: bool) -> float:
    """Similarity of two words: 1 if equal, less for a slip the shorter the words are, 0 for different words.

    In words of three letters another letter makes another word, so there only a letter more or less is a slip.
    """
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if title and len(short) >= 3 and long.startswith(short):
        return 0.95
    if len(short) >= 3 and (len(short) >= 4 or len(long) > len(short)) and one_slip(a, b):
        return 1.0 - 0.5 / len(long)
    return 0.0


def _one_way(a: list[str], b: list[str], title: bool) -> float:
    best = [max(_alike(x, y, title) for y in b) for x in a]
    return sum(best) / len(best) if min(best) > 0 else 0.0


def slips(a: Name, b: Name) -> list[str]:
    """Words of ``a`` whose best counterpart in ``b`` is one slip away."""
    return [x for x in a.words if 0.0 < max((_alike(x, y, not a.person) for y in b.words), default=0.0) < 1.0 and not any(y.startswith(x) or x.startswith(y) for y in b.words if not a.person and min(len(x), len(y)) >= 3)]


def similarity(a: Name, b: Name) -> float:
    """Monge-Elkan similarity, the smaller of both ways; 0 where a word has no counterpart."""
    if a.person != b.person or not a.words or not b.words:
        return 0.0
    words = min(_one_way(a.words, b.words, not a.person), _one_way(b.words, a.words, not a.person)) if len(a.words) == len(b.words) or not a.person else 0.0
    if not a.person:
        return words if len(a.words) == len(b.words) else 0.0
    if a.given and b.given:
        # two names that both are known are two names
        known = a.given != b.given and all(g in GIVEN or g in NICKNAMES.values() for g in (a.given, b.given))
        given = 0.0 if known else _alike(a.given, b.given, False)
        if not given and (a.given.startswith(b.given) or b.given.startswith(a.given)) and min(len(a.given), len(b.given)) >= 3:
            given = 0.9
    else:
        x, y = a.given[:1] or a.initials[:1], b.given[:1] or b.initials[:1]
        given = 0.95 if x == y else 0.0
    return (words * len(a.words) + given) / (len(a.words) + 1) if words and given else 0.0


def _may(a: Name, b: Name) -> bool:
    """Whether names of the two keys can be variants: every word of a person, every beginning of a title's words, has a counterpart a slip away."""
    if a.person != b.person or len(a.words) != len(b.words):
        return False
    if a.person:
        return _one_way(a.words, b.words, False) > 0 and _one_way(b.words, a.words, False) > 0
    x, y = ([w[:3] for w in n.words] for n in (a, b))
    near = lambda p, q: p == q or p.startswith(q) or q.startswith(p) or not _shortened(p).isdisjoint(_shortened(q))
    return all(any(near(p, q) for q in y) for p in x) and all(any(near(p, q) for p in x) for q in y)


def _shingle_hashes(grams: list[str], seeds: np.ndarray) -> np.ndarray:
    x = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)
    mixed = (x[:, None] * seeds[0] + seeds[1]) % np.uint64(4_294_967_311)
    return mixed.min(axis=0)


def _seeds() -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**31, size=(2, BANDS * ROWS), dtype=np.uint64)


def _parsed(strings: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_name(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([g.form for g in got], pa.string()), pa.array([g.key for g in got], pa.string()), pa.array([g.full for g in got], pa.bool_())],
                names=["kind", "name", "n", "form", "key", "full"],
            )

    return strings.mapInArrow(run, "kind string, name string, n bigint, form string, key string, full boolean")


def _with(df: DataFrame, shape: str, made) -> DataFrame:
    """``df`` with further columns; ``made`` gives their arrays from a dict of the batch's columns as lists."""
    names = df.columns
    more = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = made({n: batch.column(k).to_pylist() for k, n in enumerate(names) if n in ("kind", "top", "other_top")})
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], names=[*names, *more])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", " + shape)


_STRINGS = pa.list_(pa.string())


def _probed(df: DataFrame, across: bool) -> DataFrame:
    """``df`` (kind, top, ...) with its ``probe``s, a row each."""
    shown = _with(df, "probes array<string>", lambda c: [pa.array([read_name(k, t).probes(across) for k, t in zip(c["kind"], c["top"], strict=True)], _STRINGS)])
    return shown.withColumn("probe", F.explode("probes")).drop("probes")


def _scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (kind, top, other_top, ...) that verification accepts, with ``score`` and the words of either that are a slip from the other's."""

    def made(c: dict[str, list]) -> list[pa.Array]:
        both = [(read_name(k, a), read_name(k, b)) for k, a, b in zip(c["kind"], c["top"], c["other_top"], strict=True)]
        return [pa.array([similarity(a, b) for a, b in both], pa.float64()), pa.array([slips(a, b) for a, b in both], _STRINGS), pa.array([slips(b, a) for a, b in both], _STRINGS)]

    return _with(pairs, "score double, own_slips array<string>, other_slips array<string>", made).where(F.col("score") >= THRESHOLD)


def _banded(keys: DataFrame) -> DataFrame:
    """``keys`` (kind, top, ...) with the hashes of their ``bands``, a row each."""
    seeds = _seeds()

    def made(c: dict[str, list]) -> list[pa.Array]:
        weight = np.random.default_rng(6).integers(1, 2**62, size=ROWS, dtype=np.int64)
        bands = []
        for k, t in zip(c["kind"], c["top"], strict=True):
            low = _shingle_hashes(read_name(k, t).grams(), seeds).astype(np.int64).reshape(BANDS, ROWS)
            bands.append((low * weight).sum(axis=1) * BANDS + np.arange(BANDS))
        return [pa.array(bands, pa.list_(pa.int64()))]

    return _with(keys, "bands array<bigint>", made).withColumn("band", F.explode("bands")).drop("bands")


def _met(rows: DataFrame, by: list[str], member: str, condition: str) -> DataFrame:
    """``rows`` with themselves on ``by`` (the second time as ``other_...``) where ``condition`` holds.

    Rows that are alone go first.  Groups of more than ``SPLIT`` rows are split: the one side is spread over parts, the
    other goes to all of them.
    """
    renamed = {c: f"other_{c}" for c in rows.columns if c not in by}
    sizes = rows.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1")
    few = rows.join(sizes.where(F.col("_n") <= SPLIT), by, "left_semi")
    many = rows.join(sizes.where(F.col("_n") > SPLIT), by).withColumn("_parts", F.ceil(F.col("_n") / SPLIT).cast("int")).drop("_n")
    one = many.withColumn("_part", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int")).drop("_parts")
    two = many.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").withColumnsRenamed(renamed)
    met = few.join(few.withColumnsRenamed(renamed), by).where(condition)
    return met.unionByName(one.join(two, [*by, "_part"]).where(condition).drop("_part"))


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``kind``, ``form`` and its ``centre``, for every form that joins one, from ``edges`` (kind, form, other_form, score, other_rank) to forms of higher rank.

    Each round tells every form without an open edge upwards to be a centre, and lets those it verifies join the best.
    """
    edges, path = scratch.keep(edges)
    joined = edges.sparkSession.createDataFrame([], "kind string, form string, centre string")
    while not edges.isEmpty():
        lower = edges.select("kind", F.col("form").alias("other_form")).distinct()
        told = edges.join(lower, ["kind", "other_form"], "left_anti").groupBy("kind", "form").agg(F.max_by("other_form", F.struct("score", "other_rank")).alias("centre"))
        told, _ = scratch.keep(told)
        joined = joined.unionByName(told)
        gone = told.select("kind", "form")
        rest = edges.join(gone, ["kind", "form"], "left_anti").join(gone.withColumnRenamed("form", "other_form"), ["kind", "other_form"], "left_anti")
        rest, rest_path = scratch.keep(rest.select(*edges.columns))
        scratch.drop(path)
        edges, path = rest, rest_path
    return joined


def clusters(strings: DataFrame, label: str = "variants") -> DataFrame:
    """``kind``, ``name`` and ``centre`` (the string its cluster is named by) for every distinct string.

    ``strings`` has ``kind`` (``author`` or ``journal``) and ``name``, with repeats.
    """
    scratch = Scratch(strings.sparkSession, label)
    counted = strings.where("kind is not null and name is not null and trim(name) <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    parsed, _ = scratch.keep(_parsed(counted))
    best = F.max_by("name", F.struct("full", "n", "name"))
    forms = parsed.groupBy("kind", "form").agg(F.first("key").alias("key"), best.alias("top"), F.count("*").alias("strings"), F.sum("n").alias("n"), F.max("full").alias("full"))
    read = lambda c: [read_name(k, t) for k, t in zip(c["kind"], c["top"], strict=True)]
    shown = _with(forms, "words array<string>, given string", lambda c: [pa.array([x.words for x in read(c)], _STRINGS), pa.array([x.given for x in read(c)], pa.string())])
    shown, _ = scratch.keep(shown)
    # How many distinct strings hold a word: a slip is in few, a word of a name in many.
    words = shown.select("kind", "form", "strings", F.explode(F.array_distinct(F.concat("words", F.array("given")))).alias("word"))
    support = words.groupBy("kind", "word").agg(F.sum("strings").alias("s"))
    weak = words.join(support, ["kind", "word"]).groupBy("kind", "form").agg(F.min("s").alias("support"))
    ranked = shown.join(weak, ["kind", "form"]).withColumn("rank", F.struct("full", "support", "n", "top")).drop("full", "support")
    ranked, _ = scratch.keep(ranked)

    # Within a key.  Initials alone join the person of highest rank; the others the star that verifies them.
    person = F.col("key").startswith("p|")
    initials = ranked.where(person & (F.col("given") == "")).select("kind", "key", "form")
    head = ranked.where(person & (F.col("given") != "")).groupBy("kind", "key").agg(F.max_by("form", "rank").alias("centre"))
    alone = initials.join(head, ["kind", "key"]).select("kind", "form", "centre")
    probes = _probed(ranked.where(~person | (F.col("given") != "")).select("kind", "key", "form", "top", "rank"), False)
    near = _met(probes, ["kind", "key", "probe"], "form", "other_rank > rank").select("kind", "form", "top", "other_form", "other_top", "other_rank").distinct()
    told = _stars(_scored(near).select("kind", "form", "other_form", "score", "other_rank"), scratch)
    chain = told.select("kind", F.col("form").alias("centre"), F.col("centre").alias("further"))
    first = told.unionByName(alone.join(chain, ["kind", "centre"], "left").select("kind", "form", F.coalesce("further", "centre").alias("centre")))
    members, _ = scratch.keep(ranked.select("kind", "form", "strings", "n").join(first, ["kind", "form"], "left").select("kind", "form", F.coalesce("centre", "form").alias("centre"), "strings", "n"))
    sizes = members.groupBy("kind", "centre").agg(F.sum("strings").alias("strings"), F.sum("n").alias("n")).withColumnRenamed("centre", "form")
    stars, _ = scratch.keep(ranked.select("kind", "form", "key", "top", "words", "given").join(sizes, ["kind", "form"]).withColumn("rank", F.struct("strings", "n", "top")))

    # Between keys that share a bucket.
    keys = stars.groupBy("kind", "key").agg(F.max_by("top", "rank").alias("top"), F.max_by("form", "rank").alias("head"))
    keys, _ = scratch.keep(keys)
    # Bands hold numbers of keys only; two keys of one number would be compared with what either meets.
    numbered = keys.select("kind", "key", "top", F.xxhash64("kind", "key").alias("number"))
    bands, _ = scratch.keep(_banded(numbered).select("band", "number"))
    shared = _met(bands, ["band"], "number", "number < other_number").select("number", "other_number").distinct()
    named = numbered.withColumnsRenamed({"kind": "other_kind", "key": "other_key", "top": "other_top", "number": "other_number"})
    both = shared.join(numbered, "number").join(named, "other_number").where("kind = other_kind").select("kind", "key", "top", "other_key", "other_top")
    met = both.unionByName(both.select("kind", F.col("other_key").alias("key"), F.col("other_top").alias("top"), F.col("key").alias("other_key"), F.col("top").alias("other_top")))
    may = lambda c: [pa.array([_may(read_name(k, a), read_name(k, b)) for k, a, b in zip(c["kind"], c["top"], c["other_top"], strict=True)], pa.bool_())]
    met, _ = scratch.keep(_with(met, "may boolean", may).where("may").select("kind", "key", "other_key"))
    shape = ["kind", "key", "form", "top", "rank"]
    # A star without given name meets the star of highest rank of the other key, by an empty probe.
    headed = stars.join(keys.select("kind", "key", "head"), ["kind", "key"])
    empty = headed.where(F.col("key").startswith("p|") & ((F.col("given") == "") | (F.col("form") == F.col("head")))).select(*shape, F.lit("").alias("probe"))
    star_probes, _ = scratch.keep(_probed(stars.select(*shape), True).unionByName(empty))
    other = star_probes.withColumnsRenamed({c: f"other_{c}" for c in shape[1:]})
    found = met.join(star_probes, ["kind", "key"]).join(other, ["kind", "other_key", "probe"]).where("other_rank > rank").select("kind", "form", "top", "other_form", "other_top", "other_rank").distinct()
    verified, _ = scratch.keep(_scored(found))
    # A spelling stands by itself if a star holds it that is in no pair as a slip of it, on either side.
    own = verified.select("kind", "form", "other_form", F.explode("own_slips").alias("word"))
    others = verified.select("kind", "form", "other_form", F.explode("other_slips").alias("word"))
    slipped = own.select("kind", "form", "word").unionByName(others.select("kind", F.col("other_form").alias("form"), "word")).distinct()
    held = stars.select("kind", "form", F.explode("words").alias("word"))
    standing = held.join(slipped, ["kind", "form", "word"], "left_anti").select("kind", "word").distinct()
    pair = ["kind", "form", "other_form"]
    two = own.join(standing, ["kind", "word"], "left_semi").select(pair).join(others.join(standing, ["kind", "word"], "left_semi").select(pair), pair, "left_semi")
    kept = verified.join(two, pair, "left_anti")
    joined, path = scratch.keep(kept.groupBy("kind", "form").agg(F.max_by("other_form", F.struct("score", "other_rank")).alias("to")))
    # A star that was joined may itself have joined another.  Ranks rise along such a chain, so it ends, and each
    # round doubles the steps.
    while True:
        step = joined.select("kind", F.col("form").alias("to"), F.col("to").alias("further"))
        followed, followed_path = scratch.keep(joined.join(step, ["kind", "to"], "left").select("kind", "form", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        scratch.drop(path)
        joined, path = followed.select("kind", "form", "to"), followed_path
        if followed.where("moved").isEmpty():
            break
    last = members.join(joined.withColumnRenamed("form", "centre"), ["kind", "centre"], "left").select("kind", "form", F.coalesce("to", "centre").alias("last"))
    named = last.join(stars.select("kind", F.col("form").alias("last"), F.col("top").alias("centre")), ["kind", "last"]).select("kind", "form", "centre")
    return parsed.select("kind", "name", "form").join(named, ["kind", "form"]).select("kind", "name", "centre")


def variant_pairs(found: DataFrame) -> DataFrame:
    """``name_kind``, ``name_a``, ``name_b``: all pairs of spellings of one entity, ``name_a`` < ``name_b``."""
    pairs = _met(found.select("kind", "centre", "name"), ["kind", "centre"], "name", "name < other_name")
    return pairs.select(F.col("kind").alias("name_kind"), F.col("name").alias("name_a"), F.col("other_name").alias("name_b"))
