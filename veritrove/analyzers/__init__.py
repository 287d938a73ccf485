"""Text analyzers.

Each takes a DataFrame with the columns ``id``, ``text``, ``abstract``, ``author_name`` and ``title`` and
gives one row a paper: ``id``, its measures, ``flags``, ``score``, ``risk_level`` and ``summary``.  They are
column expressions without a shuffle, so they run alike on batches and on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.analyzers import language, relational, rules, statistics

ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "statistics": statistics.stat_audit,
    "methodology": rules.methodology,
    "citations": relational.citations,
    "reproducibility": rules.reproducibility,
    "novelty": language.novelty,
    "grim": statistics.grim,
    "sprite": statistics.sprite,
    "granularity": statistics.granularity,
    "pcurve": statistics.pcurve,
    "effect_size": statistics.effect_size,
    "retraction": relational.retraction,
    "cartel": relational.cartel,
    "llm": language.llm_style,
}


#: The analyzers that ask for fixed phrases.
BY_PHRASES = ("statistics", "methodology", "citations", "reproducibility", "novelty", "llm")


def papers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", abstract: str | None = None, author_name: str | None = None, title: str | None = None) -> DataFrame:
    """``df`` in the form the analyzers read: missing values are empty strings, other columns left out."""
    optional = {"abstract": abstract, "author_name": author_name, "title": title}
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) if c else F.lit("").alias(n) for n, c in optional.items()]
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *filled)


def analyze(df: DataFrame, name: str) -> DataFrame:
    """The report of one analyzer."""
    return ANALYZERS[name](df)


def analyze_all(df: DataFrame, names: list[str] | None = None, by_section: bool = False) -> DataFrame:
    """``id`` and, for each analyzer, its ``score``, ``risk_level`` and ``flags`` side by side.

    One pass without a join: each paper travels through the analyzers as a struct that takes up their
    results.  With ``by_section`` sections are split once and each analyzer reads its own.
    """
    from veritrove.functions.phrases import marked
    from veritrove.functions.routing import routed, with_sections

    asked = names or list(ANALYZERS)
    reading = [n for n in asked if n in BY_PHRASES]
    if by_section:
        rows = with_sections(df)
        # The texts as each analyzer reads them, for the pass over phrases only.
        cut = rows
        for name in reading:
            cut = routed(cut.withColumn("_whole", F.col("text")), name).withColumnsRenamed({"text": f"_read_{name}", "_whole": "text"})
        rows = marked(cut, {f"phrases_{n}": F.col(f"_read_{n}") for n in reading}).drop(*(f"_read_{n}" for n in reading))
    else:
        rows = marked(df, {"phrases": F.col("text")}) if reading else df
    carried = [c for c in rows.columns if c != "id"]
    rows = rows.select(F.struct("id", *carried).alias("row"))
    for name in asked:
        staged = rows.select(F.col("row").alias("id"), *(F.col(f"row.{c}").alias(c) for c in carried))
        if by_section:
            staged = routed(staged, name)
            staged = staged.withColumn("phrases", F.col(f"phrases_{name}")) if name in reading else staged
        report = ANALYZERS[name](staged)
        rows = report.select(F.col("id").withField(name, F.struct("score", "risk_level", "flags")).alias("row"))
    return rows.select("row.id", *(F.col(f"row.{name}").alias(name) for name in asked))
