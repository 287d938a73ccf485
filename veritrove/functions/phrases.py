"""All fixed phrases of a text in one pass.

The analyzers ask for some three hundred phrases.  Looked for one by one, each is a pass over the text; an automaton finds
them all in one, in Arrow batches.  Where the automaton's library is missing they are looked for one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrove.functions import vocabulary as V
from veritrove.functions.text import literals

_PATTERNS = (*V.CODE_LINK, *V.DATA_LINK, *V.SOFTWARE_VERSION, *V.PREREGISTRATION, V.ON_REQUEST)
#: Every phrase of the lists, and the literal parts of the patterns, in their order.
PHRASES = tuple(
    dict.fromkeys(
        [
            *V.RESULT_WORDS, *V.CLAIM_MARKERS, *V.LLM_PHRASES, *V.CAUSATION, *V.WEAK_DESIGNS, *V.LONG_TERM, *V.METHOD_MARKERS, *V.RCT, *V.SELF_REPORT, *V.STRONG_CLAIM, *V.SHORT_TERM, *V.TREATMENT, *V.EFFECT_CLAIM, *V.CONTROL,
            *V.BROAD_CLAIM, *V.LIMITED_SAMPLE, *V.NOVELTY_SIGNALS, *V.INCREMENTAL_SIGNALS, *V.DOMAIN_KEYWORDS, *V.STAT_SOFTWARE, *V.ETHICS, *V.CONFLICT, *V.SAMPLE_SIZE_REASONS, *V.COMPUTATIONAL, *V.EMPIRICAL, *V.QUANTITATIVE,
            *V.EXPERIMENTAL, *V.HUMANS, *(x for p in _PATTERNS for q in p.split("|") for x in literals(q)),
        ]
    )
)


@lru_cache(maxsize=1)
def _automaton():
    try:
        import ahocorasick
    except ImportError:
        return None
    made = ahocorasick.Automaton()
    for phrase in PHRASES:
        made.add_word(phrase, phrase)
    made.make_automaton()
    return made


def phrases_of(text: str | None) -> list[str]:
    """The phrases that a lower-cased text contains, each once."""
    if not text:
        return []
    if (made := _automaton()) is None:
        return [p for p in PHRASES if p in text]
    return list({p for _, p in made.iter(text)})


def with_phrases(df: DataFrame) -> DataFrame:
    """``df`` with ``phrases``, those that its ``text`` holds in any letter case; as it is if it has them."""
    if "phrases" in df.columns:
        return df

    def found(texts: pa.Array) -> pa.Array:
        return pa.array([phrases_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return df.withColumn("phrases", F.arrow_udf(found, "array<string>")(F.lower("text")))


def marked(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with a column of phrases for each of some texts, all in one pass of Arrow batches that nothing is folded into.

    Where many analyzers follow each other in one plan, an expression would be copied into each of its uses.
    """
    names, keys = df.columns, list(texts)
    wide = df.select("*", *(F.lower(t).alias(f"_text_{k}") for k, t in texts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([phrases_of(t) for t in batch.column(k).to_pylist()], pa.list_(pa.string())) for k in range(len(names), len(names) + len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], names=[*names, *keys])

    shape = T.StructType([*df.schema.fields, *(T.StructField(k, T.ArrayType(T.StringType())) for k in texts)])
    return wide.mapInArrow(run, shape)


def named(phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases is among those of the text."""
    return F.arrays_overlap(F.array(*map(F.lit, phrases)), F.col("phrases"))


def held(phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that the text holds, in list order."""
    return F.array_intersect(F.array(*map(F.lit, phrases)), F.col("phrases"))
