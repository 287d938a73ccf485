"""Analyzers of language: novelty and machine-written style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions import vocabulary as V
from veritrove.functions.scoring import flag, flags, level, rounded, summary, told
from veritrove.functions.phrases import held, with_phrases
from veritrove.functions.text import found, strip, word_count


def key_terms(text: Column, title: Column) -> Column:
    """Up to six terms: words of the title, then domain keywords, then pairs of capitalised words."""
    words = F.slice(found(title, V.TITLE_WORD, 0, False), 1, 5)
    domain = held(V.DOMAIN_KEYWORDS)
    # Keywords are added until there are six terms; the first is added in any case.
    both = F.concat(words, F.slice(domain, F.lit(1), F.greatest(F.lit(6) - F.size(words), F.lit(1))))
    pairs = F.slice(found(text, V.CAPITAL_PAIR, 0, False), 1, 3)
    return F.when(F.size(both) < 3, F.concat(both, pairs)).otherwise(both)


def once(terms: Column) -> Column:
    """The first six of the terms that differ in more than letter case."""
    none = F.struct(F.array().cast("array<string>").alias("low"), F.array().cast("array<string>").alias("kept"))
    fold = F.aggregate(terms, none, lambda acc, t: F.when(F.array_contains(acc["low"], F.lower(t)), acc).otherwise(F.struct(F.array_append(acc["low"], F.lower(t)).alias("low"), F.array_append(acc["kept"], t).alias("kept"))))
    return F.slice(fold["kept"], 1, 6)


def novelty(df: DataFrame, literature: DataFrame | None = None) -> DataFrame:
    """Signs of novelty and of incremental work.

    ``literature`` may give ``id``, ``related_title``, ``related_year`` and ``related_authors`` of found
    works; each lowers the score.  Without it none is accessible.
    """
    df = with_phrases(df)
    read = df.select("id", once(key_terms(F.col("text"), F.col("title"))).alias("key_terms_extracted"), F.size(held(V.NOVELTY_SIGNALS)).alias("signals"), held(V.INCREMENTAL_SIGNALS).alias("incremental"), F.array_distinct(found(F.lower("title"), r"\w+", 0, False)).alias("asked"))
    base = rounded(F.least(F.greatest(0.5 + 0.08 * F.col("signals") - 0.06 * F.size("incremental"), F.lit(0.05)), F.lit(0.95)), 3)
    if literature is None:
        read = read.withColumn("related_works_found", F.array().cast("array<struct<title:string,year:int,authors:array<string>,similarity_signal:string>>"))
    else:
        works = literature.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("related_title", "related_year", "related_authors"))), 1, 5).alias("works"))
        read = read.join(works, "id", "left")
        shared = lambda w: F.size(F.array_intersect("asked", F.array_distinct(found(F.lower(w["related_title"]), r"\w+", 0, False))))
        signal = lambda w: F.when(shared(w) > 4, "high").when(shared(w) > 2, "moderate").otherwise("low")
        read = read.withColumn("related_works_found", F.transform(F.coalesce("works", F.array().cast("array<struct<related_title:string,related_year:int,related_authors:array<string>>>")), lambda w: F.struct(w["related_title"].alias("title"), w["related_year"].alias("year"), w["related_authors"].alias("authors"), signal(w).alias("similarity_signal"))))
    n = F.size("related_works_found")
    final = F.when(n > 0, rounded(F.greatest(base - F.least(n * 0.08, F.lit(0.4)), F.lit(0.1)), 3)).otherwise(base)
    rated = read.withColumns({"novelty_score": final, "literature_accessible": F.lit(literature is not None)})
    s = F.col("novelty_score")
    raised = flags(
        flag(s < 0.25, "low_novelty_score", "high", told(s, 3)),
        flag((s >= 0.25) & (s < 0.45), "moderate_novelty_concern", "medium", told(s, 3)),
        flag(F.size("incremental") >= 3, "incremental_language_detected", "medium", F.to_json(F.slice("incremental", 1, 3))),
    )
    rated = rated.withColumns({"flags": raised, "novelty_level": F.when(s >= 0.75, "very_high").when(s >= 0.55, "high").when(s >= 0.35, "moderate").otherwise("low"), "risk_level": level(s < 0.25, s < 0.40, s < 0.60)})
    return rated.select("id", "novelty_score", "novelty_level", "related_works_found", "key_terms_extracted", "literature_accessible", "flags", s.alias("score"), "risk_level", summary("Novelty", F.col("flags"), F.col("risk_level")).alias("summary"))


def llm_style(df: DataFrame) -> DataFrame:
    """Variation of sentence lengths, vocabulary of the first hundred words, and stock phrases."""
    body = strip(F.col("text"))
    sentences = F.filter(F.transform(F.split(F.col("body"), rf"(?<![.!?])[.!?]++[{V.BLANKS}]++", -1), strip), lambda s: F.length(s) > 10)
    words = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z]++(?![\p{L}\p{N}_])"), F.lit(0))
    read = with_phrases(df).select("id", "text", body.alias("body"), "phrases")
    read = read.select("id", (F.length("body") >= 100).alias("long"), F.transform(sentences, word_count).alias("lengths"), words.alias("words"), held(V.LLM_PHRASES).alias("phrases"))
    n = F.size("lengths")
    total = F.aggregate("lengths", F.lit(0.0), lambda acc, v: acc + v)
    read = read.withColumn("mean", F.when(n > 0, total / n).otherwise(F.lit(0.0)))
    spread = F.aggregate("lengths", F.lit(0.0), lambda acc, v: acc + (v - F.col("mean")) * (v - F.col("mean")))
    read = read.withColumn("cv", F.when((n >= 3) & (F.col("mean") > 0), F.sqrt(spread / (n - 1)) / F.col("mean")))
    first = F.slice("words", 1, 100)
    rated = read.withColumns({
        "burstiness": F.when(~F.col("long"), F.lit(0.0)).otherwise(F.coalesce(F.least("cv", F.lit(1.0)), F.lit(0.5))),
        "ttr": F.when(~F.col("long") | (F.size("words") == 0), F.lit(1.0)).otherwise(F.size(F.array_distinct(F.transform(first, F.lower))) / F.size(first)),
        "uniformity": F.when(~F.col("long"), F.lit(0.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least("cv", F.lit(1.0))), F.lit(0.0))),
        "llm_phrase_count": F.when(F.col("long"), F.size("phrases")).otherwise(F.lit(0)),
    })
    b, t, u, k, go = F.col("burstiness"), F.col("ttr"), F.col("uniformity"), F.col("llm_phrase_count"), F.col("long")
    raised = flags(
        flag(go & (b < 0.3) & (n >= 5), "low_burstiness", F.when(b < 0.15, "high").otherwise("medium"), told(b)),
        flag(go & (t < 0.4) & (F.size("words") >= 50), "low_vocabulary_diversity", "medium", told(t)),
        flag(go & (u > 0.7) & (n >= 5), "high_sentence_uniformity", "medium", told(u)),
        flag(go & (k >= 3), "llm_signature_phrases", F.when(k >= 6, "high").otherwise("medium"), F.to_json(F.slice("phrases", 1, 6))),
    )
    score = F.when(go & (n >= 3), F.least(rounded(F.greatest(F.lit(0.0), 1.0 - b / 0.5) * 0.35 + F.greatest(F.lit(0.0), 1.0 - t / 0.6) * 0.25 + u * 0.20 + F.least(k / 8.0, F.lit(1.0)) * 0.20, 4), F.lit(1.0))).otherwise(F.lit(0.0))
    rated = rated.withColumns({"flags": raised, "score": score})
    f, s = F.size("flags"), F.col("score")
    rated = rated.withColumn("risk_level", level((s >= 0.65) | (f >= 3), (s >= 0.45) | (f >= 2), (s >= 0.25) | (f >= 1)))
    return rated.select("id", rounded(b, 4).alias("burstiness_score"), rounded(t, 4).alias("vocabulary_diversity"), rounded(u, 4).alias("sentence_uniformity"), "llm_phrase_count", "flags", "score", "risk_level", summary("Style", F.col("flags"), F.col("risk_level")).alias("summary"))
