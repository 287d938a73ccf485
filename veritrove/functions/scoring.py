"""Flags, scores and risk levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrove.functions.vocabulary import SEVERITY_WEIGHTS

FLAG = "struct<flag_type:string,severity:string,description:string,evidence:string,suggestion:string>"

#: What each flag says, and what to do about it.
MEANING = {
    "p_hacking_suspected": ("Most reported p-values sit right around .05.", "Ask for the analysis plan and all tests that were run."),
    "borderline_p_values": ("Many reported p-values sit right around .05.", "Ask for scripts and a pre-registration."),
    "small_sample_size": ("A reported sample is very small.", "Ask for a power analysis or a replication."),
    "suspiciously_round_p_values": ("P-values stand exactly on a threshold.", "Ask for p-values to three digits."),
    "missing_statistical_tests": ("Samples and effects are reported without any p-value.", "Ask for the full test output."),
    "grim_impossible_mean": ("A mean cannot come from that many whole numbers.", "Ask for the raw data."),
    "sprite_impossible_distribution": ("No sample of that size and scale has this mean and deviation.", "Ask for the raw data."),
    "digit_preference_detected": ("Last digits 0 and 5 are too frequent.", "Check how values were recorded."),
    "benford_law_violation": ("First digits are far from their expected shares.", "Check where the numbers come from."),
    "excessive_round_numbers": ("Most decimals are whole numbers.", "Check the precision of measurement."),
    "uniform_decimal_precision": ("All decimals have one precision.", "Check for values typed in by hand."),
    "p_value_clustering": ("Significant p-values crowd below .05.", "Ask for the analysis plan."),
    "flat_pcurve": ("The p-curve is not right-skewed.", "Treat the evidence as weak."),
    "exact_threshold_reporting": ("Several p-values are given as .05.", "Ask for exact p-values."),
    "inflated_effect_size": ("A very large effect in a small sample.", "Look for a replication in a larger sample."),
    "underpowered_study": ("The sample is too small for the effect.", "Ask for a power analysis."),
    "impossible_correlation": ("A correlation beyond 1.", "Ask for a correction."),
    "large_eta_squared": ("An unusually large share of variance explained.", "Check the effect size computation."),
    "missing_effect_sizes": ("No effect size is reported.", "Ask for effect sizes with intervals."),
    "retracted_citation": ("A cited work is retracted.", "Remove or explain the citation."),
    "retracted_citation_live": ("A cited work is retracted by the supplied table.", "Remove or explain the citation."),
    "retraction_language_detected": ("The text speaks of retraction or misconduct.", "Check which works are meant."),
    "no_dois_found": ("References without DOI can't be checked.", "Ask for DOIs."),
    "excessive_self_citation": ("Most citations point to one author.", "Check the relevance of the self-citations."),
    "high_self_citation_ratio": ("Many citations point to the author.", "Check the relevance of the self-citations."),
    "unsupported_broad_claims": ("Several broad claims lack a citation.", "Ask for sources."),
    "unsupported_claims": ("A broad claim lacks a citation.", "Ask for a source."),
    "low_citation_density": ("Few citations for the length.", "Check the literature review."),
    "et_al_overuse": ("Most citations hide their authors.", "Give full references."),
    "citation_concentration": ("Few authors take most citations.", "Check for a citation circle."),
    "low_citation_diversity": ("Citations are spread over few authors.", "Check for a citation circle."),
    "reciprocal_citation_pattern": ("Some authors are cited far above average.", "Check for mutual citation."),
    "insufficient_citations": ("Too few citations to judge.", "Judge by hand."),
    "causation_without_rct": ("Causal language without a randomized design.", "Tone the claim down."),
    "weak_design_strong_claim": ("Conclusive language on self-reported data.", "Tone the claim down."),
    "timeframe_mismatch": ("Long-term claims from a short study.", "Limit the claim to the time studied."),
    "missing_control_group": ("A treatment effect without a control.", "Add a control or tone the claim down."),
    "overgeneralization": ("A broad claim from a narrow sample.", "Limit the claim to the group sampled."),
    "missing_code_availability": ("Computation without a link to code.", "Ask for the code."),
    "missing_data_availability": ("Data without a statement of availability.", "Ask for the data."),
    "missing_software_versions": ("Statistics without software versions.", "Ask for the versions."),
    "missing_preregistration": ("An experiment without registration.", "Ask for the registration."),
    "missing_ethics_statement": ("Human participants without an ethics statement.", "Ask for the approval."),
    "data_available_on_request": ("Data only on request.", "Ask for a deposit."),
    "low_novelty_score": ("Few signs of novelty.", "Check against the literature."),
    "moderate_novelty_concern": ("Weak signs of novelty.", "Check against the literature."),
    "incremental_language_detected": ("The text describes itself as incremental.", "Weigh the contribution."),
    "low_burstiness": ("Sentence lengths hardly vary.", "Read closely."),
    "low_vocabulary_diversity": ("The vocabulary is narrow.", "Read closely."),
    "high_sentence_uniformity": ("Sentences are of one length.", "Read closely."),
    "llm_signature_phrases": ("Stock phrases of generated text.", "Read closely."),
    "duplicate_figures": ("Two figures look alike.", "Compare with the originals."),
    "ela_anomaly": ("Compression errors differ across the figure.", "Ask for the original image."),
    "unnatural_brightness_uniformity": ("The figure's brightness hardly varies.", "Ask for the original image."),
}


def flag(condition: Column, flag_type: str, severity: str | Column, evidence: Column | str = "") -> Column:
    """A flag where ``condition`` holds, else null."""
    text, remedy = MEANING[flag_type]
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    body = F.struct(F.lit(flag_type).alias("flag_type"), lit(severity).alias("severity"), F.lit(text).alias("description"), F.coalesce(lit(evidence).cast("string"), F.lit("")).alias("evidence"), F.lit(remedy).alias("suggestion"))
    return F.when(condition, body)


def told(value: Column, digits: int = 4) -> Column:
    """A number as evidence: with ``digits`` places."""
    return F.format_string(f"%.{digits}f", rounded(value, digits))


def flags(*some: Column) -> Column:
    """The flags that are set, in rule order."""
    return F.array_compact(F.array(*some))


def flag_each(items: Column, flag_type: str, severity: str, evidence) -> Column:
    """A flag for each item."""
    text, remedy = MEANING[flag_type]
    return F.transform(items, lambda i: F.struct(F.lit(flag_type).alias("flag_type"), F.lit(severity).alias("severity"), F.lit(text).alias("description"), evidence(i).cast("string").alias("evidence"), F.lit(remedy).alias("suggestion")))


def weighted(flags_col: Column, weights: dict[str, float] = SEVERITY_WEIGHTS) -> Column:
    """Sum of the weights of the flags' severities, at most 1."""
    def weight(f: Column) -> Column:
        out = F.lit(0.0)
        for severity, w in weights.items():
            out = F.when(f["severity"] == severity, F.lit(w)).otherwise(out)
        return out

    return F.least(F.aggregate(flags_col, F.lit(0.0), lambda acc, f: acc + weight(f)), F.lit(1.0))


def level(critical: Column, high: Column, medium: Column) -> Column:
    """The first of the levels whose condition holds, else low."""
    return F.when(critical, "critical").when(high, "high").when(medium, "medium").otherwise("low")


def level_by_score(score: Column) -> Column:
    """Levels at .7, .4 and .2."""
    return level(score >= 0.7, score >= 0.4, score >= 0.2)


def rounded(value: Column, digits: int | Column) -> Column:
    """``value`` to ``digits`` places as decimal arithmetic has it: the binary number itself decides, exact ties go to the even digit.

    The product with the scale is split in two parts that hold it exactly, so nothing depends on how it is rounded
    (up to eight places; beyond them to the precision of a double).
    """
    scale = F.lit(float(10**digits)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)

    def exact(v: Column) -> Column:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        product = v * scale
        beyond = (product - F.floor(product) - 0.5) + ((high * scale - product) + (v - high) * scale)
        up = (beyond > 0) | ((beyond == 0) & (F.pmod(F.floor(product), F.lit(2)) == 1))
        return (F.floor(product) + up.cast("int")) / scale

    # A list of one, so that the value is computed once.
    return F.get(F.transform(F.array(value.cast("double")), exact), 0)


def summary(name: str, flags_col: Column, risk: Column) -> Column:
    """A sentence on the flags and the risk level."""
    count = lambda s: F.size(F.filter(flags_col, lambda f: f["severity"] == s))
    some = F.format_string(f"{name}: %d high, %d medium and %d low flags. Risk level: %s.", count("high"), count("medium"), count("low"), F.upper(risk))
    return F.when(F.size(flags_col) == 0, F.format_string(f"{name}: no flags. Risk level: %s.", F.upper(risk))).otherwise(some)


def ratio(part: Column, whole: Column) -> Column:
    """``part`` over ``whole``, 0 where that is empty."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
