"""Encoding of texts by a public tokenizer, and back (problem 7).

The tokenizers library runs over Arrow batches, without special tokens; a string that looks like
one is ordinary text.  A batch's distinct texts, and a worker's distinct words, are encoded once.

Defined results: null and empty texts have an empty list of ids (of offsets, too).  Ids are INT.
Token offsets are code points of the text, ends exclusive; a character split over several tokens is
covered by each of them.  ``decode`` reverses the byte table: lists of ids that end within a
character give U+FFFD for the broken part, ids outside the vocabulary give null for the whole row,
null lists null, empty lists an empty text.
"""

from __future__ import annotations

import importlib.util
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_NAME = "byte_bpe_50k.json"
#: Texts encoded by one call.
CHUNK = 256
#: Words a worker remembers (some 100 MB when full), and the longest that it does.
REMEMBERED, LONGEST = 400_000, 64
#: One new word in so many is too much, and for how many chunks words are not split then.
FRESH, WHOLE = 5, 16
#: How byte-level vocabularies split a text into words (fixed value, published with them).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = DEFAULT_NAME, folder: str | None = None) -> str:
    """Where the vocabulary file lies: in ``folder``, or in the installed package of vocabularies."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return str(Path(folder) / name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=1)
def _same_everywhere() -> frozenset[str]:
    """Characters that every Unicode version since 3.2 takes for the same: letter, number, blank or other.

    Characters that have become letters or numbers since, are not assigned yet, or are blanks by some
    definitions only, are left out.
    """
    def kind(category: str) -> str:
        return category[0] if category[0] in "LNZ" else "C" if category == "Cn" else "other"

    old = unicodedata.ucd_3_2_0
    odd = set("\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff")
    kinds = ((chr(c), kind(unicodedata.category(chr(c))), kind(old.category(chr(c)))) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(ch for ch, now, then in kinds if ch not in odd and now != "C" and (now == then or now == "other"))


class _Coder:
    """Ids of texts by one tokenizer, which splits every distinct word once.

    A byte-level vocabulary never joins tokens over the edges of words, so the ids of a text are those
    of its words.  Texts with characters that the library may class otherwise, and vocabularies of
    another kind, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.made = _tokenizer(path)
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        split = data.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and data.get("normalizer") is None
        plain = plain and not any(t.get("content") and not t.get("special") for t in data.get("added_tokens", []))  # such tokens are cut out of the text first
        self.words = _words_pattern() if plain and data["model"].get("type", "BPE") == "BPE" else None
        self.safe = _same_everywhere() if self.words else frozenset()
        self.memo: dict[str, tuple[int, ...]] = {}
        self.fresh = self.whole = 0

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        fresh = [w for w in dict.fromkeys(words) if w not in self.memo]
        self.fresh += len(fresh)
        got = {w: tuple(e.ids) for w, e in zip(fresh, self.made.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        long = {w: v for w, v in got.items() if len(w) > LONGEST}
        if len(self.memo) + len(got) > REMEMBERED:
            self.memo = {w: self.memo[w] for w in dict.fromkeys(words) if w in self.memo}
        self.memo.update((w, v) for w, v in got.items() if len(w) <= LONGEST)
        return long

    def add(self, texts: list[str], lists: _Lists) -> None:
        """The ids of ``texts``, in order, to ``lists``.

        Where more than one word in ``FRESH`` is a new one, splitting words does not pay, and the next chunks of texts go to
        the library whole; the ids are the same.
        """
        self.whole -= 1
        whole = [k for k, t in enumerate(texts) if self.words is None or self.whole >= 0 or not self.safe.issuperset(t)]
        total = self.fresh = 0
        direct = dict(zip(whole, self.made.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True))
        for k, text in enumerate(texts):
            if k in direct:
                lists.add(direct[k].ids)
                continue
            words = self.words.findall(text)
            total += len(words)
            try:
                ids = list(chain.from_iterable(map(self.memo.__getitem__, words)))
            except KeyError:
                known = self._learn(words)
                ids = list(chain.from_iterable(self.memo[w] if w in self.memo else known[w] for w in words))
            lists.add(ids)
        if self.fresh * FRESH > total:
            self.whole = WHOLE


def _words_pattern():
    try:
        import regex
    except ImportError:  # without it all texts go to the library whole
        return None
    return regex.compile(WORDS)


@lru_cache(maxsize=4)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def byte_table() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> dict[int, bytes]:
    table = byte_table()
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    return {i: bytes(table[c] for c in token) for token, i in data["model"]["vocab"].items() if i not in special} | special


class _Lists:
    """Lists of integers gathered in flat buffers, without a Python object for each integer kept."""

    def __init__(self) -> None:
        self.flat = array("i")
        self.sizes: list[int] = [0]

    def add(self, values: list[int]) -> None:
        self.flat.extend(values)
        self.sizes.append(len(values))

    def done(self) -> pa.Array:
        ends = np.cumsum(np.array(self.sizes, np.int64))
        if ends[-1] >= 2**31:
            raise ValueError("more than 2^31 tokens in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(self.flat, np.int32) if len(self.flat) else np.empty(0, np.int32)))


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, offsets: bool = False) -> DataFrame:
    """``id_col`` and ``ids``; with ``offsets`` also ``starts`` and ``ends`` of the tokens."""
    path = path or tokenizer_path()
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, coder = _tokenizer(path), None if offsets else _coder(path)
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            lists = [_Lists() for _ in range(3 if offsets else 1)]
            for low in range(0, len(texts), CHUNK):
                if offsets:
                    for e in made.encode_batch(texts[low : low + CHUNK], add_special_tokens=False):
                        lists[0].add(e.ids)
                        lists[1].add([x for x, _ in e.offsets])
                        lists[2].add([y for _, y in e.offsets])
                else:
                    coder.add(texts[low : low + CHUNK], lists[0])
            for gathered in lists:
                gathered.add([])  # for null texts
            at = pc.fill_null(coded.indices, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(x.done().take(at) for x in lists)], names=["_id", *(["ids", "starts", "ends"] if offsets else ["ids"])])

    kind = source.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return source.mapInArrow(run, shape).withColumnRenamed("_id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` from lists of ids of a byte-level vocabulary."""
    path = path or tokenizer_path()
    source = df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                parts = None if ids is None else [table.get(i) for i in ids]
                texts.append(None if parts is None or None in parts else b"".join(parts).decode("utf-8", errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
