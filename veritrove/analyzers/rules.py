"""Analyzers that are rules over phrases: methodology and reproducibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions import vocabulary as V
from veritrove.functions.scoring import flag, flags, level_by_score, rounded, summary, weighted
from veritrove.functions.phrases import held, named, with_phrases
from veritrove.functions.text import any_of, matches, pieces_with

#: What a methodology flag objects to, and why; the first names the words found.
OBJECTION = {
    "causation_without_rct": ("A cause is claimed.", None),
    "weak_design_strong_claim": ("A firm conclusion is drawn from what people say of themselves.", "Self-reports are bent by memory and by the wish to please."),
    "timeframe_mismatch": ("A lasting effect is claimed.", "The time studied is short."),
    "missing_control_group": ("A treatment is said to work.", "Without a comparison, chance, recovery and expectation remain as reasons."),
    "overgeneralization": ("A finding is said to hold for everyone.", "The sample stands for few."),
}
NO_MODEL = "Language model assessment unavailable: no model is configured."


def _sentences(text: Column, holds: Column, markers: tuple[str, ...], least: int, most: int) -> Column:
    # Only texts that hold a marker at all are cut into pieces.
    return F.slice(F.when(holds, pieces_with(text, markers, least)).otherwise(F.array().cast("array<string>")), 1, most)


def methodology(df: DataFrame, assess=None) -> DataFrame:
    """Claims and methods, and the mismatches between them.

    Claims are read from ``abstract`` where there is one.  ``assess`` may give a column for the
    assessment by a language model; without it the column says that there is none.
    """
    df = with_phrases(df).withColumn("working", F.when(F.col("abstract") != "", F.col("abstract")).otherwise(F.col("text")))
    df = df.withColumns({"low_begin": F.substring(F.lower("text"), 1, 500), "working_low": F.lower("working")})
    read = df.select(
        "id", "text",
        _sentences(F.col("working"), any_of(F.col("working_low"), V.FINDING_MARKERS), V.FINDING_MARKERS, 20, 8).alias("claims_found"),
        _sentences(F.col("text"), named(V.METHOD_MARKERS), V.METHOD_MARKERS, 20, 8).alias("methods_found"),
        *(named(phrases).alias(name) for name, phrases in {
            "causal": V.CAUSATION, "weak": V.WEAK_DESIGNS, "rct": V.RCT, "self_report": V.SELF_REPORT, "strong": V.STRONG_CLAIM, "long_term": V.LONG_TERM, "short_term": V.SHORT_TERM,
            "treatment": V.TREATMENT, "effect": V.EFFECT_CLAIM, "control": V.CONTROL, "broad": V.BROAD_CLAIM, "limited": V.LIMITED_SAMPLE,
        }.items()),
        F.array_compact(F.array(*[F.when(F.contains("low_begin", F.lit(p)), F.lit(p)) for p in V.CAUSATION])).alias("causes"), held(V.WEAK_DESIGNS).alias("designs"),
    )
    c = F.col
    evidence = F.try_element_at(pieces_with(c("text"), V.CAUSATION, 0), F.lit(1))
    raised = flags(
        flag(c("causal") & c("weak") & ~c("rct"), "causation_without_rct", "high", F.when(c("causal") & c("weak") & ~c("rct"), evidence)),
        flag(c("self_report") & c("strong"), "weak_design_strong_claim", "medium"),
        flag(c("long_term") & c("short_term"), "timeframe_mismatch", "medium"),
        flag(c("treatment") & c("effect") & ~c("control"), "missing_control_group", "high"),
        flag(c("broad") & c("limited"), "overgeneralization", "medium"),
    )
    listed = F.format_string("Causal words (%s) rest on a design (%s) that shows no cause.", F.array_join("causes", ", "), F.array_join("designs", ", "))
    claim, issue = (F.create_map(*[F.lit(x) for k, v in OBJECTION.items() for x in (k, v[i])]) for i in (0, 1))
    objected = F.transform("flags", lambda f: f.withField("claim", claim[f["flag_type"]]).withField("issue", F.coalesce(issue[f["flag_type"]], listed)))
    rated = read.withColumn("flags", raised).withColumn("flags", objected).withColumn("raw", weighted(c("flags"))).withColumn("risk_level", level_by_score(c("raw")))
    told = assess(c("claims_found"), c("methods_found"), c("text")) if assess else F.lit(NO_MODEL)
    return rated.select("id", "claims_found", "methods_found", told.alias("llm_assessment"), F.lit(assess is not None).alias("llm_available"), "flags", rounded(c("raw"), 3).alias("score"), "risk_level", summary("Methodology", c("flags"), c("risk_level")).alias("summary"))


CHECKS = ("has_code_link", "has_data_link", "has_software_versions", "has_statistical_software", "has_preregistration", "has_ethics_statement", "has_conflict_statement", "has_sample_size_justification")


def reproducibility(df: DataFrame) -> DataFrame:
    """A checklist of eight statements, and what is missing where it would be due."""
    df = with_phrases(df)
    text, known = F.col("text"), F.col("phrases")
    read = df.select(
        "id",
        matches(text, known, V.CODE_LINK).alias("has_code_link"), matches(text, known, V.DATA_LINK).alias("has_data_link"), matches(text, known, V.SOFTWARE_VERSION).alias("has_software_versions"),
        named(V.STAT_SOFTWARE).alias("has_statistical_software"), matches(text, known, V.PREREGISTRATION).alias("has_preregistration"), named(V.ETHICS).alias("has_ethics_statement"),
        named(V.CONFLICT).alias("has_conflict_statement"), named(V.SAMPLE_SIZE_REASONS).alias("has_sample_size_justification"),
        *(named(phrases).alias(name) for name, phrases in {"computational": V.COMPUTATIONAL, "empirical": V.EMPIRICAL, "quantitative": V.QUANTITATIVE, "experimental": V.EXPERIMENTAL, "humans": V.HUMANS}.items()),
        matches(text, known, (V.ON_REQUEST,)).alias("on_request"),
    )
    c = F.col
    raised = flags(
        flag(c("computational") & ~c("has_code_link"), "missing_code_availability", "high"),
        flag(c("empirical") & ~c("has_data_link"), "missing_data_availability", "high"),
        flag(c("quantitative") & ~c("has_software_versions"), "missing_software_versions", "medium"),
        flag(c("experimental") & ~c("has_preregistration"), "missing_preregistration", "medium"),
        flag(c("humans") & ~c("has_ethics_statement"), "missing_ethics_statement", "high"),
        flag(c("on_request"), "data_available_on_request", "medium"),
    )
    met = sum((c(k).cast("int") for k in CHECKS), F.lit(0))
    rated = read.withColumns({"flags": raised, "reproducibility_score": rounded(met / 8.0, 3), "score": rounded(1.0 - met / 8.0, 3)}).withColumn("risk_level", level_by_score(c("score")))
    return rated.select("id", *CHECKS, "reproducibility_score", "flags", "score", "risk_level", summary("Reproducibility", c("flags"), c("risk_level")).alias("summary"))
