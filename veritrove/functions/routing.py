"""Sections of a text, and the part of it that each analyzer reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions.text import strip
from veritrove.functions.vocabulary import MODULE_SECTIONS, PARSER_MARKERS, SECTION_MARKERS

#: Longest line that can be a heading; least distance of two headings.
HEADING, APART = 60, 50


def section_list(df: DataFrame) -> DataFrame:
    """``df`` with ``section_list``: structs of ``start`` (offset from 0), ``name`` and ``body`` of ``text``, in order.

    Of each marker the first place in a line of at most 60 characters counts; places no more than
    50 behind the last kept one are dropped; a section runs to the next kept place, heading included.
    Each step is a column of its own, so that none is computed twice.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array(*map(F.lit, SECTION_MARKERS)).alias("open"), F.array().cast("array<struct<at:int,line:string>>").alias("kept"))
    fits = lambda acc, line: line.rlike("|".join(SECTION_MARKERS)) & (F.length(strip(line)) <= HEADING) & F.exists(acc["open"], lambda m: F.contains(line, m))
    # Only lines with a marker that no line before them holds are gathered, so there are at most as many as markers.
    lines = F.aggregate(
        F.split(F.lower("text"), "\n", -1), empty,
        lambda acc, line: F.when(
            fits(acc, line),
            F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.filter(acc["open"], lambda m: ~F.contains(line, m)).alias("open"), F.array_append(acc["kept"], F.struct(acc["at"].alias("at"), line.alias("line"))).alias("kept")),
        ).otherwise(F.struct((acc["at"] + F.length(line) + 1).alias("at"), acc["open"].alias("open"), acc["kept"].alias("kept"))),
    )["kept"]

    def place(order: int, marker: str) -> Column:
        hit = F.try_element_at(F.filter("_lines", lambda x: F.contains(x["line"], F.lit(marker))), F.lit(1))
        return F.transform(F.filter(F.array(hit), lambda h: h.isNotNull()), lambda h: F.struct((h["at"] + F.instr(h["line"], marker) - 1).alias("at"), F.lit(order).alias("order"), F.lit(marker).alias("name")))

    # The lines are named once for each marker: named once only, they would be folded again for each.
    places = F.array_sort(F.concat(*[place(k, m) for k, m in enumerate(SECTION_MARKERS)]))
    none = F.array().cast("array<struct<at:int,order:int,name:string>>")
    kept = F.aggregate("_places", none, lambda acc, p: F.when((F.size(acc) == 0) | (p["at"] - F.try_element_at(acc, F.lit(-1))["at"] > APART), F.array_append(acc, p)).otherwise(acc))
    body = F.transform("_kept", lambda p, k: F.struct(p["at"].alias("start"), p["name"].alias("name"), strip(F.substring(F.col("text"), p["at"] + 1, F.coalesce(F.try_element_at(F.col("_kept"), k + 2)["at"], F.length("text")) - p["at"])).alias("body")))
    staged = df.withColumn("_lines", lines).withColumn("_places", places).withColumn("_kept", kept).withColumn("section_list", body)
    return staged.drop("_lines", "_places", "_kept")


def with_sections(df: DataFrame) -> DataFrame:
    """``df`` with its ``text`` split once: ``sections`` as a map from name to body."""
    listed = section_list(df)
    return listed.withColumn("sections", F.map_from_entries(F.transform("section_list", lambda s: F.struct(s["name"], s["body"])))).drop("section_list")


def truncated(text: Column, limit: int = 8000) -> Column:
    """At most ``limit`` characters; of longer texts the begin and what follows the word method, if it is well inside."""
    at = F.instr(F.lower(text), "method") - 1
    both = F.concat(F.substring(text, 1, 3000), F.lit(" [...] "), F.substring(text, at + 1, F.lit(4000)))
    return F.when(F.length(text) <= limit, text).when((at > 0) & (at < F.length(text) - 1000), both).otherwise(F.substring(text, 1, limit))


def routed(df: DataFrame, module: str) -> DataFrame:
    """``df`` (with ``sections``) whose ``text`` is what ``module`` reads: its sections, or the truncated text."""
    limit = 2000 if module == "novelty" else 2500
    parts = F.array_compact(F.array(*[F.substring(F.col("sections")[s], 1, limit) for s in MODULE_SECTIONS[module]]))
    return df.withColumn("text", F.when(F.size(parts) > 0, F.substring(F.array_join(parts, "\n\n"), 1, 12000)).otherwise(truncated(F.col("text"))))


def parser_sections(text: Column) -> Column:
    """Sections as the document parser cuts them: each marker's first place to the next marker of the list found behind it."""
    low = F.lower(text)
    entries = []
    for k, marker in enumerate(PARSER_MARKERS):
        at = F.instr(low, marker)
        later = [F.nullif(F.position(F.lit(m), low, at + 1), F.lit(0)) for m in PARSER_MARKERS[k + 1 :]]
        end = F.coalesce(*later, F.length(text) + 1) if later else F.length(text) + 1
        entries.append(F.when(at > 0, F.struct(F.lit(marker).alias("key"), strip(F.substring(text, at, end - at)).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))
