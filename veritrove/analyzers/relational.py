"""Analyzers of citations: retracted works, self-citation, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions import vocabulary as V
from veritrove.functions.scoring import flag, flag_each, flags, level, level_by_score, ratio, rounded, summary, told, weighted
from veritrove.functions.phrases import named, with_phrases
from veritrove.functions.text import found, in_line, pieces_with, strip, word_count


def dois(text: Column, limit: int | None = None) -> Column:
    """The distinct DOIs of a text (the first ``limit``, if given), in order, without punctuation at their ends."""
    every = F.array_distinct(F.transform(found(text, V.DOI, 1, False), lambda d: F.rtrim(d, F.lit(".,;"))))
    return every if limit is None else F.slice(every, 1, limit)


def retraction(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Cited DOIs of retracted works, and words about retraction.

    The known retractions are a fixed table, matched within the row.  ``known`` may give a further table
    with a column ``doi``: it is joined by exploded DOIs (the first five of a text that the fixed table
    doesn't hold), so it may be of any size.
    """
    fixed = F.array(*[F.lit(r) for r in V.KNOWN_RETRACTIONS])
    clean = lambda d: F.rtrim(F.lower(d), F.lit("."))
    read = df.select("id", dois(F.col("text"), 20).alias("dois_found"), found(F.col("text"), V.RETRACTION_TERM, 0).alias("signals"))
    read = read.withColumns({"listed": F.filter(F.transform("dois_found", clean), lambda d: F.array_contains(fixed, d)), "open": F.slice(F.filter("dois_found", lambda d: ~F.array_contains(fixed, clean(d))), 1, 5)})
    if known is None:
        read = read.withColumn("live", F.array().cast("array<string>"))
    else:
        table = known.select(clean(F.col("doi")).alias("key")).where("key is not null").distinct()
        asked = read.select("id", F.posexplode_outer("open").alias("pos", "doi")).where("doi is not null").withColumn("key", clean(F.col("doi")))
        hits = asked.join(table, "key", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "doi"))).alias("hits"))
        read = read.join(hits, "id", "left").withColumn("live", F.coalesce(F.transform("hits", lambda h: h["doi"]), F.array().cast("array<string>")))
    rated = read.withColumn("retracted_found", F.concat("listed", "live"))
    k, s = F.size("retracted_found"), F.size("signals")
    raised = F.concat(
        flag_each(F.col("listed"), "retracted_citation", "high", lambda d: d),
        flag_each(F.col("live"), "retracted_citation_live", "high", lambda d: d),
        flags(flag(s > 0, "retraction_language_detected", "medium", F.array_join(F.array_sort(F.array_distinct(F.slice("signals", 1, 8))), ", ")), flag(F.size("dois_found") == 0, "no_dois_found", "low")),
    )
    score = F.least(rounded(0.6 * F.least(k, F.lit(3)) / 3.0 + 0.2 * F.least(s, F.lit(5)) / 5.0, 4), F.lit(1.0))
    rated = rated.withColumns({"flags": raised, "score": score})
    rated = rated.withColumn("risk_level", level((k >= 1) | (F.col("score") >= 0.6), F.col("score") >= 0.3, F.col("score") >= 0.1))
    return rated.select("id", "dois_found", "retracted_found", F.size("dois_found").alias("checked_count"), s.alias("signal_count"), "flags", "score", "risk_level", summary("Retractions", F.col("flags"), F.col("risk_level")).alias("summary"))


def citations(df: DataFrame) -> DataFrame:
    """Citation marks, citations of the author, broad claims without a source, density."""
    text = F.col("text")
    marks = F.array_distinct(F.concat(*[found(text, p, 0, False) for p in V.CITATION_MARKS]))
    name = strip(F.col("author_name"))
    surname = F.regexp_extract(name, rf"([^{V.BLANKS}]+)\z", 1)
    own = F.when(F.col("author_name") == "", F.lit(0)).otherwise(F.regexp_count(text, F.concat(F.lit("(?iud)\\Q"), F.replace(F.when(surname == "", F.col("author_name")).otherwise(surname), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E[,{V.BLANKS}]{{0,10}}(?:\d{{4}}|et al)"))))
    df = with_phrases(df)
    # Only texts that hold a marker at all are cut into pieces.
    claims = F.when(named(V.CLAIM_MARKERS), pieces_with(text, V.CLAIM_MARKERS, 15)).otherwise(F.array().cast("array<string>"))
    cited = "|".join(in_line(p) for p in V.CITED_CLAIM.split("|"))
    loose = F.slice(F.filter(claims, lambda s: ~s.rlike("(?d)" + cited)), 1, 5)
    read = df.select("id", F.size(marks).alias("total_citations"), own.alias("self_citations"), loose.alias("loose"), F.greatest(F.lit(1), F.floor(word_count(text) / 250)).alias("pages"), F.regexp_count(text, F.lit("(?iu)" + V.ET_AL)).alias("et_al"))
    total, share = F.col("total_citations"), ratio(F.col("self_citations"), F.col("total_citations"))
    raised = flags(
        flag((total >= 5) & (share >= 0.5), "excessive_self_citation", "high", told(share)),
        flag((total >= 5) & (share >= 0.30) & (share < 0.5), "high_self_citation_ratio", "medium", told(share)),
        flag(F.size("loose") >= 3, "unsupported_broad_claims", "high", F.array_join(F.slice("loose", 1, 2), " | ")),
        flag(F.size("loose").between(1, 2), "unsupported_claims", "medium", F.try_element_at("loose", F.lit(1))),
        flag((F.col("pages") >= 5) & (total / F.col("pages") < 1.5), "low_citation_density", "medium", F.col("pages")),
        flag((total > 5) & (ratio(F.col("et_al"), total) > 0.7), "et_al_overuse", "low", told(ratio(F.col("et_al"), total))),
    )
    rated = read.withColumns({"flags": raised, "self_citation_ratio": rounded(share, 3)}).withColumn("raw", weighted(F.col("flags"))).withColumn("risk_level", level_by_score(F.col("raw")))
    return rated.select("id", "total_citations", "self_citations", "self_citation_ratio", F.size("loose").alias("unsupported_claims"), "flags", rounded(F.col("raw"), 3).alias("score"), "risk_level", summary("Citations", F.col("flags"), F.col("risk_level")).alias("summary"))


def cited_authors(text: Column) -> Column:
    """Cited authors in order: those of bracketed years, then those with "et al."; one may count under both."""
    return F.transform(F.concat(found(text, V.CARTEL_CITE_RUN), found(text, V.CARTEL_ET_AL_RUN)), strip)


def citation_edges(df: DataFrame) -> DataFrame:
    """The network in rows: ``id``, ``author``, ``cites``."""
    return df.select("id", F.explode_outer(cited_authors(F.col("text"))).alias("author")).where("author is not null").groupBy("id", "author").agg(F.count("*").alias("cites"))


def cartel(df: DataFrame) -> DataFrame:
    """How much of the citations few authors take."""
    read = df.select("id", cited_authors(F.col("text")).alias("cited"))
    # Citations counted by author: a run of equal names in sorted order ends where the next one differs.
    read = read.withColumn("sorted", F.array_sort("cited")).withColumn("authors", F.array_distinct("cited"))
    ends = F.filter(F.transform("sorted", lambda a, i: F.when((i + 1 == F.size("sorted")) | (F.get("sorted", i + 1) != a), F.struct(a.alias("author"), (i + 1).alias("end")))), lambda x: x.isNotNull())
    read = read.withColumn("ends", ends)
    runs = F.transform("ends", lambda x, i: F.struct(x["author"].alias("author"), (x["end"] - F.when(i > 0, F.get("ends", i - 1)["end"]).otherwise(0)).alias("n")))
    read = read.withColumn("network", F.map_from_entries(runs)).withColumn("counts", F.map_values("network"))
    n, k = F.size("cited"), F.size("authors")
    top = F.sort_array("counts", asc=False)
    entropy = F.aggregate("counts", F.lit(0.0), lambda acc, c: acc - (c / n) * F.log2(c / n))
    rated = read.withColumns({
        "concentration": F.when(n > 0, F.aggregate(F.slice(top, 1, 3), F.lit(0), lambda acc, c: acc + c) / n).otherwise(F.lit(0.0)),
        "diversity": F.when(k > 1, entropy / F.log2(k.cast("double"))).otherwise(F.lit(1.0)),
        "own": F.when(n > 0, F.array_max("counts") / n).otherwise(F.lit(0.0)),
        "often": F.when(k > 0, F.size(F.filter("counts", lambda c: c >= 2.0 * n / k))).otherwise(F.lit(0)),
    })
    c, d, o = F.col("concentration"), F.col("diversity"), F.col("own")
    raised = flags(
        flag((c > 0.5) & (n >= 5), "citation_concentration", F.when(c > 0.7, "high").otherwise("medium"), told(c)),
        flag((d < 0.3) & (n >= 8), "low_citation_diversity", "medium", told(d)),
        flag((o > 0.3) & (n >= 5), "excessive_self_citation", F.when(o > 0.5, "high").otherwise("medium"), told(o)),
        flag(F.col("often") > 0, "reciprocal_citation_pattern", "medium", F.col("often")),
        flag(n < 5, "insufficient_citations", "low", n),
    )
    rated = rated.withColumns({"flags": raised, "score": F.when(n < 3, F.lit(0.0)).otherwise(F.least(rounded(c * 0.4 + (1.0 - d) * 0.3 + o * 0.3, 4), F.lit(1.0)))})
    f, s = F.size("flags"), F.col("score")
    rated = rated.withColumn("risk_level", level((s >= 0.6) | (f >= 3), (s >= 0.4) | (f >= 2), (s >= 0.2) | (f >= 1)))
    return rated.select("id", F.slice("authors", 1, 10).alias("authors_found"), F.col("network").alias("citation_network"), n.alias("citation_count"), rounded(c, 4).alias("concentration"), rounded(o, 4).alias("self_citation_ratio"), rounded(d, 4).alias("network_diversity"), "flags", "score", "risk_level", summary("Citation network", F.col("flags"), F.col("risk_level")).alias("summary"))
