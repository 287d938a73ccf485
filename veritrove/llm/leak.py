"""Evaluation texts that leaked into training texts (problem 8).

A positional inverted index of the training texts, distributed by document and stored once in the shared
folder.  Each row is a shard: its terms, the ascending positions of each (the postings), and where its
documents begin.  A second table has the number of positions of every term in the whole corpus.  New
items ask the stored index; no text is read again.

Every window of six consecutive item words is a phrase query.  It starts from the rarest of its terms in
the corpus, shifts that term's postings by the term's place in the window, and intersects them with
the other terms' postings, the next rarest first; whether a shifted position is in a term's list
is read from the shard's position array.  Windows found side by side make runs, runs that rise in both
the document and the item are chained, and the longest chain counts.

The items are the stated query set.  They are asked in blocks of about ``BLOCK`` items, one after the other, so what
the driver holds and sends is bounded by the block; the hits of a block are written before the next one.

Defined results: null and blank documents and items match nothing; items with fewer than six words
are never found; an item given twice under two ids is found as both.  Words are runs of letters and
digits without regard to letter case; markup tags, comments and entities are left out, whatever their length, and
hyphens, apostrophes and invisible signs within a word are dropped.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.sources.scratch import Scratch

RUN = 6
SHARE = 1 / 3
#: Items sent to the tasks at once (about half of it in each of several blocks).
BLOCK = 5_000
#: Positions of a shard after which the next one begins; a document is never divided.
SHARD = 1_000_000
#: Positions looked at in one step of a search.
STEP = 4_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_JOIN = re.compile(r"(?<=[^\W_])(?:[-‐‑­​‌‍⁠﻿'’ʼ]+(?:[ \t]*\r?\n[ \t]*)?|­)(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def _without_comments(text: str) -> str:
    parts, at = [], 0
    while (low := text.find("<!--", at)) >= 0 and (high := text.find("-->", low + 4)) >= 0:
        parts.append(text[at:low])
        at = high + 3
    return "".join([*parts, text[at:]])


def words(text: str) -> list[str]:
    """The words of ``text`` as they are compared."""
    if "<" in text:
        text = _TAG.sub("", _without_comments(text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_JOIN.sub("", text.lower()))


class _Codes(dict):
    """Numbers of terms in the order they come up."""

    def __missing__(self, term: str) -> int:
        self[term] = code = len(self)
        return code


class Shard:
    """Postings of some documents: the positions of each term, one after the other, and the ends of the terms' lists.

    Documents stand one after the other with a position between them that no term has.
    """

    def __init__(self, ids: list[int], starts: np.ndarray, terms: list[str], ends: np.ndarray, places: np.ndarray, size: int) -> None:
        self.ids, self.starts, self.terms, self.ends, self.places, self.size = ids, starts, terms, ends, places, size

    @staticmethod
    def of(ids: list[int], coded: list[np.ndarray], terms: list[str]) -> Shard:
        """The shard of documents given as numbers of ``terms``."""
        sizes = np.array([len(c) + 1 for c in coded], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.concatenate([np.empty(0, np.int32), *coded])
        at = np.arange(len(flat)) + np.repeat(np.arange(len(coded)), sizes - 1)
        order = np.argsort(flat, kind="stable")
        return Shard(ids, starts, terms, np.cumsum(np.bincount(flat, minlength=len(terms))), at[order], int(sizes.sum()))


def _shards(pairs: Iterator[tuple[int, str | None]]) -> Iterator[Shard]:
    ids, coded, size, codes = [], [], 0, _Codes()
    for doc, text in pairs:
        listed = words(text) if text else []
        if not listed:
            continue
        if size and size + len(listed) > SHARD:
            yield Shard.of(ids, coded, list(codes))
            ids, coded, size, codes = [], [], 0, _Codes()
        ids.append(doc)
        coded.append(np.fromiter(map(codes.__getitem__, listed), np.int32, len(listed)))
        size += len(listed) + 1
    if ids:
        yield Shard.of(ids, coded, list(codes))


_INDEX = "doc_ids array<bigint>, starts array<int>, terms array<string>, ends array<int>, places array<int>, size int"


def build_index(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label: str = "postings") -> tuple[DataFrame, DataFrame]:
    """The stored postings of ``docs``, a row a shard, and ``term``, ``n``: how often each term stands in the corpus."""
    source = docs.select(F.col(doc_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for s in _shards(pairs):
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [one(s.ids, pa.int64()), one(s.starts.astype(np.int32), pa.int32()), one(s.terms, pa.string()), one(s.ends.astype(np.int32), pa.int32()), one(s.places.astype(np.int32), pa.int32()), pa.array([s.size], pa.int32())],
                names=["doc_ids", "starts", "terms", "ends", "places", "size"],
            )

    scratch = Scratch(docs.sparkSession, label)
    index, _ = scratch.keep(source.mapInArrow(run, _INDEX))
    # The length of a term's list is where it ends less where the one before it ends.
    lists = F.transform("terms", lambda t, k: F.struct(t.alias("term"), (F.get("ends", k) - F.coalesce(F.get("ends", k - 1), F.lit(0))).alias("n")))
    counts, _ = scratch.keep(index.select(F.explode(lists).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n")))
    return index, counts


class Queries:
    """Windows of a block of items over a vocabulary of their words; number 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.need = np.array([-(-len(t) // 3) for t in texts] or [0], np.int64)
        self.size = [len(t) for t in texts]
        rows, owner, place = [], [], []
        for k, t in enumerate(texts):
            coded = [self.vocabulary[w] for w in t]
            for at in range(len(coded) - RUN + 1):
                rows.append(coded[at : at + RUN])
                owner.append(k)
                place.append(at)
        self.windows = np.array(rows, np.int64).reshape(-1, RUN)
        self.owner = np.array(owner, np.int64)
        self.place = np.array(place, np.int64)


def chain(runs: list[tuple[int, int, int]]) -> int:
    """Most item words in runs (item place, document place, words) that rise in both without overlap."""
    if len(runs) == 1:
        return runs[0][2]
    rows = np.array(sorted(runs), np.int64)
    item, doc, size = rows.T
    best = size.copy()
    for j in range(1, len(rows)):
        over = np.maximum(np.maximum(item[:j] + size[:j] - item[j], doc[:j] + size[:j] - doc[j]), 0)
        ok = (item[:j] < item[j]) & (doc[:j] < doc[j]) & (over < size[j])
        if ok.any():
            best[j] += max(0, int((best[:j] - over)[ok].max()))
    return int(best.max())


def search(q: Queries, shard: Shard, often: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(document of the shard, item, words held, longest run, first and last word place) for every document that holds enough.

    ``often`` has the number of positions of every term of ``q`` in the corpus.
    """
    if not len(q.windows) or not shard.size:
        return []
    known = np.array([q.vocabulary.get(t, 0) for t in shard.terms], np.int64)
    begins = np.concatenate([[0], shard.ends[:-1]])
    begin, count = np.zeros(len(q.vocabulary) + 1, np.int64), np.zeros(len(q.vocabulary) + 1, np.int64)
    at_term = np.flatnonzero(known)
    begin[known[at_term]], count[known[at_term]] = begins[at_term], (shard.ends - begins)[at_term]
    ask = np.flatnonzero(count[q.windows].min(axis=1))
    if not len(ask):
        return []
    # The shard's position array, of the terms that are asked for.
    term_at = np.zeros(shard.size + RUN, np.int64)
    term_at[shard.places] = np.repeat(known, shard.ends - begins)
    rank = np.argsort(often[q.windows[ask]], axis=1, kind="stable")
    anchor = rank[:, 0]
    n = count[q.windows[ask, anchor]]
    hits, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    low = 0
    total = np.cumsum(n)
    while low < len(ask):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + STEP, side="right")))
        own, part = np.arange(low, high), n[low:high]
        which = np.repeat(own, part)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(part) - part, part)
        at = shard.places[begin[q.windows[ask[which], anchor[which]]] + nth] - anchor[which]
        keep = at >= 0
        which, at = which[keep], at[keep]
        for k in range(1, RUN):
            shift = rank[which, k]
            keep = term_at[at + shift] == q.windows[ask[which], shift]
            which, at = which[keep], at[keep]
        hits.append(ask[which])
        places.append(at)
        low = high
    window, at = np.concatenate(hits), np.concatenate(places)
    if not len(at):
        return []
    starts = shard.starts
    text = np.searchsorted(starts, at, side="right") - 1
    item, place = q.owner[window], q.place[window]
    by = np.lexsort((place, at - place, item, text))
    text, item, place, at = text[by], item[by], place[by], at[by]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(at))) + RUN - 1
    out = []
    pair = text[first] * (len(q.ids) + 1) + item[first]
    edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(pair)), strict=True):
        k, i = int(text[first[a]]), int(item[first[a]])
        longest = int(size[a:b].max())
        if int(size[a:b].sum()) < q.need[i]:
            continue
        held = longest if longest >= q.size[i] else chain([(int(place[f]), int(at[f]), int(s)) for f, s in zip(first[a:b], size[a:b], strict=True)])
        if held >= q.need[i]:
            begin_at = int(at[first[a:b]].min()) - int(starts[k])
            end_at = int((at[first[a:b]] + size[a:b]).max()) - int(starts[k])
            out.append((k, i, held, longest, begin_at, end_at))
    return out


_MATCH = "doc_id bigint, item_id bigint, held int, item_words int, longest int, word_from int, word_to int"


def matches(index: DataFrame, counts: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", label: str = "matches") -> DataFrame:
    """What the stored index has of the items: see ``leaks``."""
    spark = index.sparkSession
    scratch = Scratch(spark, label)
    listed, _ = scratch.keep(items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct())
    n = listed.count()
    blocks = 1 if n <= BLOCK else -(-2 * n // BLOCK)

    def found(block: list[tuple[int, str]]) -> DataFrame:
        q = Queries(block)
        asked = spark.createDataFrame([(t, k) for t, k in q.vocabulary.items()], "term string, code int")
        often = np.zeros(len(q.vocabulary) + 1, np.int64)
        # As many rows as the block has terms.
        for row in counts.join(F.broadcast(asked), "term").collect():
            often[row.code] = row.n
        sent = spark.sparkContext.broadcast((block, often))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, frequency = sent.value
            q = Queries(rows)
            for batch in batches:
                out: list[tuple] = []
                for k in range(batch.num_rows):
                    ids, starts, terms, ends, places = (batch.column(c)[k].values for c in range(5))
                    shard = Shard(ids.to_pylist(), starts.to_numpy().astype(np.int64), terms.to_pylist(), ends.to_numpy().astype(np.int64), places.to_numpy().astype(np.int64), batch.column(5)[k].as_py())
                    out += [(shard.ids[d], q.ids[i], held, q.size[i], longest, a, b) for d, i, held, longest, a, b in search(q, shard, frequency)]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], names=["doc_id", "item_id", "held", "item_words", "longest", "word_from", "word_to"])

        return index.mapInArrow(run, _MATCH)

    if blocks == 1:
        return found([tuple(r) for r in listed.sort("item_id", "text").collect()])
    out = spark.createDataFrame([], _MATCH)
    for k in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).sort("item_id", "text").collect()
        out = out.unionByName(scratch.keep(found([tuple(r) for r in block]))[0])
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``held`` and ``item_words`` (words held, of how many), ``longest`` (run),
    ``word_from`` and ``word_to`` (the stretch of document words that holds them): the exact
    phrases in ``held`` and their proximity in the stretch."""
    index, counts = build_index(docs, doc_col, text_col)
    return matches(index, counts, items, item_col, item_text)
