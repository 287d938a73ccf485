"""Literal cases of the analyzers, worked out by hand, and the edges."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrove.analyzers import ANALYZERS, analyze, papers

STYLE = (
    "It is important to note that this comprehensive analysis plays a crucial role. Furthermore, it should be noted that the results demonstrate a novel approach. Moreover, the findings suggest "
    "a robust framework. In conclusion, this study aims to delve into the landscape of cutting-edge work. Notably, we utilize state-of-the-art methods."
)
CASES = {
    "SA1": ("statistics", "First contrast, p = 0.041; second, p = 0.044; third, p = 0.05.", {"flags": ["p_hacking_suspected", "suspiciously_round_p_values"], "score": 0.55, "risk_level": "high"}),
    "SA2": ("statistics", "Of n=64 mice one arm gave p<0.003, the other p=0.72.", {"flags": [], "score": 0.0, "risk_level": "low"}),
    "SA3": ("statistics", "With n=11 rats the difference held (p=0.02).", {"flags": ["small_sample_size"], "score": 0.35, "risk_level": "medium"}),
    "SA4": ("statistics", "", {"flags": [], "score": 0.0, "risk_level": "low"}),
    "SA5": ("statistics", "A result with n=40.", {"flags": ["missing_statistical_tests"], "score": 0.35}),
    "SA6": ("statistics", "capture p=.049 and p=.01 and p≥0.5", {"p_values_found": [1.0, 0.5]}),
    "SA7": ("statistics", "p\xa0=\xa00.03", {"p_values_found": [0.03]}),
    "GR1": ("grim", "average: 4.27 in n=12 jars", {"score": 1.0, "risk_level": "critical", "nearest": (4.25, 4.33)}),
    "GR2": ("grim", "average: 4.25 in n=12 jars", {"score": 0.0, "risk_level": "low"}),
    "GR3": ("grim", "mean: 6.75 for n: 16 and mean: 6.71 for n: 16", {"score": 0.0, "n_possible": 1}),
    "GR4": ("grim", "mean = 1.11 (n = 8)\nmean = 1.25 (n = 8)\nn = 7, mean = 2.50", {"score": 0.6667, "risk_level": "critical"}),
    "GR5": ("grim", "average=0.125, n=1000 seeds", {"score": 0.0}),
    "GR6": ("grim", "n=9 and then mean=5.15", {"score": 1.0}),
    "GR7": ("grim", "Mean=5.15\nn=9", {"score": 0.0, "n_possible": 0}),
    "SP1": ("sprite", "range: 0-6, mean: 3.25, std: 0.30, n: 4", {"score": 1.0, "risk_level": "critical"}),
    "SP2": ("sprite", "range: 0-6, mean: 4.00, std: 0.00, n: 9", {"score": 0.0, "risk_level": "low"}),
    "SP3": ("sprite", "range: 0-6, mean: 2.10, std: 1.75, n: 250", {"score": 0.0, "risk_level": "low"}),
    "SP4": ("sprite", "mean=9.00 sd=0.50 n=100 scale=1-5", {"n_errors": 1, "risk_level": "critical"}),
    "SP5": ("sprite", "mean=3.00 sd=0.50 n=10 scale=5-1", {"score": 1.0}),
    "SP6": ("sprite", "mean=50.00 sd=0.30 n=3 scale=0-100", {"score": 1.0}),
    "SP7": ("sprite", "mean=50.00 sd=0.82 n=3 scale=0-100", {"score": 0.0, "n_ok": 1}),
    "GA1": ("granularity", "Weights 11.5 12.5 9.5 8.0 7.5 6.0 10.5 and 13.25", {"has": "digit_preference_detected"}),
    "GA3": ("granularity", "a 12.0 b 9.0 c 8.0 d 11.0 e 6.0 f 10.0", {"flags": ["digit_preference_detected", "excessive_round_numbers", "uniform_decimal_precision"]}),
    "PC1": ("pcurve", "p=0.042; p=0.046; p=0.041; p=0.0499", {"score": 1.0, "risk_level": "critical", "flags": ["p_value_clustering", "flat_pcurve"], "clustering_score": 1.0, "right_skew_ratio": 0.0}),
    "PC2": ("pcurve", "p=0.002 p=.004 p=.011 p=.024", {"score": 0.0, "risk_level": "low", "right_skew_ratio": 1.0}),
    "PC3": ("pcurve", "only p=0.043 and p=0.2", {"score": 0.0, "risk_level": "low", "flags": []}),
    "PC4": ("pcurve", "p=0.05, then p=0.0501, p=0.012, p=0.03, p=0.02", {"has": "exact_threshold_reporting"}),
    "EF1": ("effect_size", "n: 14, Cohen's d: -2.6", {"score": 0.25, "risk_level": "critical", "flags": ["inflated_effect_size"]}),
    "EF2": ("effect_size", "n: 120, Cohen's d: 0.44", {"score": 0.0, "risk_level": "low"}),
    "EF3": ("effect_size", "n: 22, cohen d: 0.41", {"score": 0.15, "risk_level": "medium", "flags": ["underpowered_study"]}),
    "EF4": ("effect_size", "only n=61 and p=0.2", {"score": 0.3, "risk_level": "medium", "flags": ["missing_effect_sizes"]}),
    "EF5": ("effect_size", "eta squared = .61 and omega squared=.2 and odds ratio = 900", {"flags": ["large_eta_squared"]}),
    "EF6": ("effect_size", "n=20, cohens d=0.3 then cohens d=2.5, r = .4", {"flags": ["underpowered_study", "inflated_effect_size"]}),
    "RE1": ("retraction", "compare doi:10.1038/nature13187 with it", {"score": 0.2, "risk_level": "critical"}),
    "RE2": ("retraction", "as https://doi.org/10.1126/science.1254166. Then", {"score": 0.2, "risk_level": "critical"}),
    "RE3": ("retraction", "No source is named.", {"score": 0.0, "risk_level": "low", "flags": ["no_dois_found"]}),
    "RE4": ("retraction", "An erratum appeared before it was withdrawn.", {"score": 0.08, "risk_level": "low"}),
    "RE5": ("retraction", "(doi:10.1038/nature13187) stays unmatched", {"score": 0.0, "checked_count": 1}),
    "CI1": ("citations", "Shown before [4], and again [5, 6]; see [4].", {"total_citations": 2}),
    "CI2": ("citations", "Lindqvale, 2011 and Lindqvale 2013. [1] [2] [3] [4] [5]", {"self_citations": 2, "flags": ["high_self_citation_ratio"]}),
    "CI3": ("citations", "Scientists believe in the salt. It is well known to all here. Previous work shows the same thing.", {"unsupported_claims": 3, "flags": ["unsupported_broad_claims"]}),
    "CI4": ("citations", "It is well known to all here [7]. Previous work shows the same (Osterholm, 2015).", {"unsupported_claims": 0}),
    "CA1": ("cartel", "(Brandt 2021) (Brandt 2020) (Brandt 2019) (Brandt 2018) (Brandt 2017) (Holm 2020) (Holm 2019) Brandt et al. (2022), Brandt (2016)", {"score": 0.691, "risk_level": "critical", "self_citation_ratio": 0.7, "network_diversity": 0.7298}),
    "CA2": ("cartel", "Aa (2001) Bb (2002) Cc (2003) Dd (2004) Ee (2005) Ff (2006) Gg (2007) Hh (2008)", {"score": 0.1875, "risk_level": "low"}),
    "CA3": ("cartel", "nothing here", {"score": 0.0, "risk_level": "medium", "flags": ["insufficient_citations"]}),
    "ME1": ("methodology", "By this cross-sectional questionnaire, noise leads to worse sleep.", {"has": "causation_without_rct"}),
    "ME2": ("methodology", "In this placebo trial with a survey at its end, noise leads to worse sleep.", {"lacks": "causation_without_rct"}),
    "ME3": ("methodology", "The drug was effective and reduced pain.", {"has": "missing_control_group"}),
    "ME4": ("methodology", "After 3 days the change was permanent.", {"has": "timeframe_mismatch"}),
    "RP1": ("reproducibility", "Everything is kept at gitlab.com/assay/drift", {"has_code_link": True}),
    "RP2": ("reproducibility", "All data become available upon a written request.", {"has": "data_available_on_request"}),
    "NO1": ("novelty", "It is an unprecedented and groundbreaking yield; we introduce it here, for the first time.", {"novelty_score": 0.82}),
    "NO2": ("novelty", "Corroborating others and extending previous work, in line with them, and similar to previous yields.", {"novelty_score": 0.26}),
    "LL1": ("llm", STYLE, {"has": "llm_signature_phrases"}),
    "LL3": ("llm", "Too little to tell.", {"score": 0.0, "risk_level": "low", "flags": []}),
}


@pytest.fixture(scope="module")
def reports(spark):
    out = {}
    for name in ANALYZERS:
        rows = [(k, c[1], "Ida Lindqvale") for k, c in CASES.items() if c[0] == name]
        df = spark.createDataFrame(rows, "k string, t string, a string")
        out |= {r.id: r for r in analyze(papers(df, "k", "t", author_name="a"), name).collect()}
    return out


@pytest.mark.parametrize("key", sorted(CASES))
def test_case(reports, key):
    row, expected = reports[key], CASES[key][2]
    flags = [f.flag_type for f in row.flags]
    for what, value in expected.items():
        if what == "flags":
            assert flags == value
        elif what == "has":
            assert value in flags
        elif what == "lacks":
            assert value not in flags
        elif what == "n_possible":
            assert len(row.possible_means) == value
        elif what == "n_ok":
            assert len(row.possible_combinations) == value
        elif what == "nearest":
            assert (row.nearest_valid[0].lower, row.nearest_valid[0].upper) == value
        elif what == "n_errors":
            assert len(row.errors) == value
        elif isinstance(value, float):
            assert row[what] == pytest.approx(value, abs=1e-9)
        else:
            assert row[what] == value


@pytest.mark.parametrize("name", sorted(ANALYZERS))
def test_edges(spark, name):
    """Nulls, blanks, very long texts, repeated ids, clashing columns and an empty table."""
    rows = [(1, None), (1, ""), (2, " \n\xa0"), (3, "p=0.04 n=5 M=2.3 sd=1.1 [1] (Smith, 2020). " * 400), (None, "İ é\r\nAbstract\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as flags", "2 as score", "3 as title")
    got = analyze(papers(df), name)
    assert got.count() == 5
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.risk_level in ("low", "medium", "high", "critical") and r.summary
    assert analyze(papers(df.limit(0)), name).count() == 0


@given(st.text(alphabet="pnMsd=0.1234 9,;\n()[]ABab", max_size=120))
@settings(max_examples=12, deadline=None)
def test_statistics_of_any_text(spark, text):
    df = papers(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    for name in ("statistics", "pcurve", "grim", "granularity"):
        row = analyze(df, name).first()
        assert 0 <= row.score <= 1


def test_sprite_agrees_with_listing():
    """The search for a sample against listing every one, also on wide scales."""
    import random
    from itertools import combinations_with_replacement
    from math import sqrt

    from veritrove.functions.samples import possible

    rng = random.Random(3)
    for n, width in [(n, w) for n in (2, 3, 4, 5) for w in (0, 1, 4, 7, 12)] * 6 + [(3, 40), (4, 25), (6, 9), (2, 100), (3, 100)] * 2:
        lo = rng.randrange(3)
        drawn = [rng.randrange(lo, lo + width + 1) for _ in range(n)]
        mean = round(sum(drawn) / n, 3) if rng.random() < 0.7 else round(lo + rng.uniform(0, width), 2)
        sd = round(sqrt(sum((v - mean) ** 2 for v in drawn) / n), 2) if rng.random() < 0.5 else round(rng.uniform(0, width * 0.6 + 0.2), 2)
        want = abs(mean * n - round(mean * n)) <= 0.01 and any(sum(x) == round(mean * n) and abs(sqrt(sum((v - mean) ** 2 for v in x) / n) - sd) < 0.01 for x in combinations_with_replacement(range(lo, lo + width + 1), n))
        assert possible(mean, sd, n, lo, lo + width) == want, (mean, sd, n, lo, width)


def test_sprite_on_very_wide_scales():
    from veritrove.functions.samples import possible

    assert possible(500.0, 400.0, 12, 0, 1000) and possible(86.625, 1.99, 8, 0, 100) is not None
    assert possible(462962814.0, 20582856.3, 4, 0, 10**9) and not possible(0.5, 0.1, 12, 0, 10**18)
    assert possible(1.5, 1.0, 20, 2, 2**62) is None  # off the scale


HOSTILE = {
    "blanks": "eta {0} omega {0} cohen {0} Smith {0} p {0} n {0} scale {0} mean {0} odds {0} retract {0} Roe et {0}".format(" " * 100_000),
    "hyphens": "eta" + "-" * 10**6,
    "digits": "p=" + "1" * 10**6 + " mean=" + "2" * 400_000 + " n=" + "3" * 400_000 + " 1." + "0" * 300_000 + "1",
    "numbers": "mean=5.0 sd=1.0 n=5 scale=0-9999999999 mean=1.5 sd=1 n=20 scale=1000000000000000000-2000000000000000000 mean=99999999999999999999.5 sd=99999999999999999999.5 n=99999999999999999999",
    "list": "[" + "1, " * 200_000 + "2]",
    "brackets": "([" * 300_000 + "(A" * 100_000 + " studies show it",
    "dots": "." * 600_000 + " doi:10.1234/" + "." * 300_000 + "x",
    "lines": "Results\n" * 60_000 + "abstract",
    "phrases": "data available upon " * 20_000 + " code provided ",
    "names": "Smith 2001) " * 40_000,
}


def test_no_text_stops_a_job(spark):
    """Long runs of blanks, signs and digits, in all analyzers at once, on whole texts and on sections."""
    from pyspark.sql import functions as F

    from veritrove.analyzers import analyze_all
    from veritrove.functions.routing import parser_sections

    df = papers(spark.createDataFrame([(k, t, "Smith") for k, t in enumerate(HOSTILE.values())], "doc_id long, text string, a string").repartition(4), author_name="a")
    rows = analyze_all(df).collect()
    assert len(rows) == len(HOSTILE) and all(0 <= row[n].score <= 1 for n in ANALYZERS for row in rows)
    assert len(analyze_all(df, by_section=True).collect()) == len(HOSTILE)
    assert len(df.select(parser_sections(F.col("text"))).collect()) == len(HOSTILE)


def test_phrases_by_either_way(monkeypatch):
    """The automaton and looking for phrases one by one give the same."""
    from veritrove.functions import phrases

    texts = ["", None, STYLE.lower(), "the data are available upon request; we found that it causes harm in a survey", "x" * 1000, "state-of-the-art state of the art"]
    got = [sorted(phrases.phrases_of(t)) for t in texts]
    assert got == [sorted(p for p in phrases.PHRASES if p in (t or "")) for t in texts]
    monkeypatch.setattr(phrases, "_automaton", lambda: None)
    assert got == [sorted(phrases.phrases_of(t)) for t in texts] and got[3]


def test_rounding(spark):
    """As Python rounds: by the binary number, exact ties to the even digit."""
    import random

    from pyspark.sql import functions as F

    from veritrove.functions.scoring import rounded

    rng = random.Random(8)
    values = [k / 16 for k in range(-40, 40)] + [k / 1000 + 0.0005 for k in range(400)] + [2.675, 1.005, 0.5, 1.5, 2.5, 0.125, 0.375] + [rng.uniform(0, 20) for _ in range(400)] + [round(rng.uniform(0, 2), 5) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(rounded(F.col("v"), d).alias(f"r{d}") for d in (2, 3, 4)))
    for row in df.collect():
        assert [row.r2, row.r3, row.r4] == [round(row.v, d) for d in (2, 3, 4)], row


def test_methodology_objections(spark):
    df = papers(spark.createDataFrame([(1, "By this cross-sectional questionnaire, noise leads to worse sleep.")], "doc_id long, text string"))
    flag = analyze(df, "methodology").first().flags[0]
    assert "leads to" in flag.issue and "cross-sectional" in flag.issue and flag.claim and flag.evidence.startswith("By this")


def test_grim_with_precision(spark):
    from veritrove.analyzers.statistics import grim

    df = papers(spark.createDataFrame([(1, "mean=3.47, n=15")], "doc_id long, text string"))
    assert grim(df).first().score == 1.0 and grim(df, precision_aware=True).first().score == 0.0


def test_supplied_tables(spark):
    """Retractions and literature by join."""
    from veritrove.analyzers.language import novelty
    from veritrove.analyzers.relational import retraction

    df = papers(spark.createDataFrame([(1, "doi:10.1234/ABC and doi:10.1234/ABC.", "Deep Networks for Protein Folding Work"), (2, "doi:10.9999/z", "x")], "doc_id long, text string, title string"), title="title")
    known = spark.createDataFrame([("10.1234/abc",), (None,), ("10.1234/ABC",)], "doi string")
    got = {r.id: r for r in retraction(df, known).collect()}
    assert [f.flag_type for f in got[1].flags] == ["retracted_citation_live"] and got[2].flags == []
    works = spark.createDataFrame([(1, "deep networks for protein folding", 2020, ["A"]), (1, "other", 2021, [])], "id long, related_title string, related_year int, related_authors array<string>")
    row = {r.id: r for r in novelty(df, works).collect()}
    assert row[1].novelty_score == pytest.approx(0.34) and row[1].literature_accessible and [w.similarity_signal for w in row[1].related_works_found] == ["high", "low"]
    assert row[2].novelty_score == pytest.approx(0.5)
