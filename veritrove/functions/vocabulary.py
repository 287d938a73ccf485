"""Patterns, phrase lists and lookup tables that results depend on, in their natural order.

Patterns are written in the common part of the Java and RE2 dialects; ``java`` and ``re2`` add what
each engine needs so that blanks are Unicode blanks, ``.`` excludes line feeds only, and letter case
folds beyond ASCII.
"""

from __future__ import annotations

BLANKS = r"\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: The same as plain characters.
BLANK_SIGNS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Spark.  ``@B@`` within a class stands for the blanks."""
    return ("(?iud)" if ignore_case else "(?d)") + pattern.replace("\\s", "[@B@]").replace("@B@", BLANKS)


def re2(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for DuckDB, quoted for SQL; possessive repeats, which only keep Java linear, are plain there."""
    plain = pattern.replace("++", "+").replace("*+", "*").replace("?+", "?")
    return "'" + java(plain, ignore_case).replace("(?iud)", "(?i)").replace("(?d)", "").replace("'", "''") + "'"


# Patterns of reported statistics, citations and identifiers.
P_AUDIT = r"p\s*[=<>≤≥]\s*\.?(\d+\.?\d*)"
P_CURVE = r"p\s*[=<>≤]\s*(0?\.\d+)"
N_AUDIT = r"\bn\s*=\s*(\d+)"
N_EFFECT = r"\bn\s*[=:]\s*(\d+)"
GRIM_PAIR = r"(?:mean|average|m)\s*[=:]\s*(-?\d+\.\d+).{0,80}n\s*[=:]\s*(\d+)|n\s*[=:]\s*(\d+).{0,80}(?:mean|average|m)\s*[=:]\s*(-?\d+\.\d+)"
SPRITE_MEAN = r"(?:mean|m)\s*[=:]\s*(-?\d+\.\d+)"
SPRITE_SD = r"(?:sd|std|s\.d\.)\s*[=:]\s*(\d+\.\d+)"
SPRITE_SCALE = r"(?:scale|range)\s*[=:]\s*(\d+)\s*[-–]\s*(\d+)"
COHEN_D = r"cohen['@B@]?s?\s*d\s*[=:]\s*(-?\d+\.?\d*)"
PEARSON_R = r"\br\s*[=:]\s*(-?0?\.\d+)"
ETA_SQUARED = r"eta[²2@B@-]*squared?\s*[=:]\s*(0?\.\d+)"
OMEGA_SQUARED = r"omega[²2@B@-]*squared?\s*[=:]\s*(0?\.\d+)"
ODDS_RATIO = r"odds\s*ratio\s*[=:]\s*(\d+\.?\d*)"
DECIMAL = r"\b\d+\.\d+\b"
INTEGER = r"\b\d{2,}\b"
DOI = r"(?:doi\.org/|doi:|DOI:?\s*)(10\.\d{4,9}/[^@B@\],;\"']+)"
RETRACTION_TERM = r"\b(?:retract(?:ed|ion)|withdrawn|erratum|correction|expression\s+of\s+concern|fraud|fabricat(?:ed|ion)|misconduct)\b"
CITATION_MARKS = (
    r"\[\d++(?:,\s*+\d++)*+\]",
    r"\[\d+\-\d+\]",
    r"\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s+\d{4}\)",
    r"\([A-Z][a-z]+\s+&\s+[A-Z][a-z]+,?\s+\d{4}\)",
)
CITED_CLAIM = r"\[\d+\]|\([A-Z][a-z]+.*?\d{4}\)"
ET_AL = r"et al\.?"
CARTEL_CITE = r"([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*[(\[,]?\s*(\d{4})[)\]]"
CARTEL_ET_AL = r"([A-Z][a-z]+)\s+et\s+al\.?\s*[(\[,]?\s*(\d{4})"
# The same for engines with look-behind: a match can only begin where a run of letters does, and blanks are read once.
CARTEL_CITE_RUN = r"((?<![A-Za-z])[A-Z][a-z]++(?:\s++et\s++al\.?)?)\s*+(?:[(\[,]\s*+)?(\d{4})[)\]]"
CARTEL_ET_AL_RUN = r"((?<![A-Za-z])[A-Z][a-z]++)\s++et\s++al\.?\s*+(?:[(\[,]\s*+)?(\d{4})"
TITLE_WORD = r"\b[A-Z][a-z]{3,}\b"
CAPITAL_PAIR = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"
ON_REQUEST = r"data.*available.*upon.*request|data.*available.*on.*request|available.*from.*corresponding.*author"

# Phrases looked for in lower-cased text.
RESULT_WORDS = ("significant", "effect", "difference", "result")
CLAIM_MARKERS = ("studies show", "research shows", "evidence suggests", "it is well known", "it has been shown", "it is established", "previous work shows", "literature suggests", "experts agree", "scientists believe")
LLM_PHRASES = (
    "it is worth noting", "it is important to note", "it should be noted", "furthermore", "moreover", "in conclusion", "in summary", "this paper presents", "this study aims to",
    "the results demonstrate", "the findings suggest", "significantly", "notably", "interestingly", "it is evident", "plays a crucial role", "plays an important role", "has been widely studied",
    "in recent years", "state of the art", "state-of-the-art", "leveraging", "utilize", "utilizes", "delve into", "delves into", "shed light on", "sheds light on", "comprehensive analysis",
    "robust framework", "novel approach", "cutting-edge", "landscape of", "in the realm of", "a testament to",
)
CAUSATION = ("causes", "caused by", "leads to", "results in", "produces", "induces", "drives", "responsible for", "due to", "because of", "proves that", "demonstrates that")
WEAK_DESIGNS = ("survey", "questionnaire", "self-report", "cross-sectional", "retrospective", "observational", "case study", "anecdotal")
LONG_TERM = ("long-term", "chronic", "sustained", "permanent", "lasting", "durable", "years", "lifetime")
FINDING_MARKERS = (
    "we found", "we show", "we demonstrate", "we conclude", "our results", "our findings", "this study shows", "this study demonstrates", "results indicate", "results suggest", "data show",
    "analysis reveals", "we report", "evidence suggests", "we establish",
)
METHOD_MARKERS = (
    "we used", "we conducted", "we recruited", "we collected", "we measured", "we analyzed", "participants were", "subjects were", "samples were", "data were collected", "randomized", "controlled",
    "double-blind", "survey", "questionnaire", "interview", "experiment",
)
RCT = ("randomized", "randomised", "rct", "control group", "placebo", "double-blind")
SELF_REPORT = ("self-report", "self report", "questionnaire", "survey", "interview", "participants reported")
STRONG_CLAIM = ("proves", "demonstrates", "establishes", "confirms", "validates", "clinical evidence")
SHORT_TERM = ("two weeks", "2 weeks", "one week", "1 week", "3 days", "7 days", "short-term pilot", "preliminary study")
TREATMENT = ("treatment", "intervention", "drug", "therapy", "program", "training")
EFFECT_CLAIM = ("improved", "reduced", "increased", "effective", "significant effect")
CONTROL = ("control group", "control condition", "placebo", "comparison group", "waitlist")
BROAD_CLAIM = ("all patients", "general population", "universally", "across all", "globally applicable", "all humans")
LIMITED_SAMPLE = ("undergraduate students", "college students", "single institution", "convenience sample", "homogeneous sample")
NOVELTY_SIGNALS = (
    "first study to", "first paper to", "novel approach", "we propose a new", "we introduce", "we present a new", "previously unexplored", "to our knowledge", "no prior work", "first time",
    "new framework", "new method", "we develop a novel", "first investigation", "pioneer", "groundbreaking", "unprecedented",
)
INCREMENTAL_SIGNALS = (
    "extending previous work", "building on", "similar to previous", "following the approach of", "replicating", "consistent with prior", "confirming previous findings", "in line with",
    "as shown previously", "extending the work of", "we replicate", "corroborating",
)
DOMAIN_KEYWORDS = (
    "machine learning", "deep learning", "neural network", "transformer", "language model", "computer vision", "natural language processing", "reinforcement learning", "clinical trial",
    "randomized controlled", "meta-analysis", "systematic review", "molecular", "genomics", "proteomics", "quantum", "photonic", "nanomaterial",
)
STAT_SOFTWARE = ("r software", "rstudio", "spss", "stata", "sas", "matlab", "python", "excel", "graphpad")
ETHICS = ("ethics committee", "institutional review board", "irb approval", "ethics approval", "ethical approval", "helsinki declaration", "informed consent", "ethical clearance", "ethics board")
CONFLICT = ("conflict of interest", "competing interest", "no conflict", "declare no", "disclose", "funding source", "financial disclosure")
SAMPLE_SIZE_REASONS = ("power analysis", "sample size calculation", "power calculation", "statistical power", "a priori power", "effect size calculation", "g*power", "gpower")
COMPUTATIONAL = ("algorithm", "code", "software", "script", "simulation", "model", "neural network", "machine learning", "deep learning")
EMPIRICAL = ("dataset", "data", "sample", "participants", "measurements", "observations", "collected")
QUANTITATIVE = ("statistical", "analysis", "test", "regression", "anova", "correlation", "t-test", "chi-square")
EXPERIMENTAL = ("clinical trial", "randomized", "experiment", "intervention", "treatment", "placebo", "hypothesis", "we predicted", "we hypothesized")
HUMANS = ("participants", "subjects", "patients", "volunteers", "respondents", "human", "children", "adults")

# Patterns of availability statements, any of which counts.
CODE_LINK = (r"github\.com/\S+", r"gitlab\.com/\S+", r"bitbucket\.org/\S+", r"code.*available.*at", r"code.*provided.*at", r"source code.*available", r"scripts.*available", r"zenodo\.org/\S+", r"osf\.io/\S+", r"code ocean", r"figshare\.com/\S+")
DATA_LINK = (
    r"data.*available.*at", r"dataset.*available", r"data.*deposited", r"data.*repository", r"data.*doi", r"supplementary data", r"data.*provided", r"open data", r"zenodo\.org/\S+", r"osf\.io/\S+",
    r"dryad", r"figshare", r"harvard dataverse", r"data.*upon.*request",
)
SOFTWARE_VERSION = (r"r\s+version\s+\d", r"python\s+\d+\.\d+", r"spss\s+version", r"stata\s+\d+", r"matlab\s+r\d+", r"sas\s+version", r"scipy\s+\d", r"numpy\s+\d", r"sklearn\s+\d", r"tensorflow\s+\d", r"pytorch\s+\d")
PREREGISTRATION = (r"pre.?registered", r"preregistered", r"clinicaltrials\.gov", r"osf\.io", r"aspredicted\.org", r"registered report", r"trial registration", r"isrctn", r"anzctr")

# Section headings, and which sections each analyzer reads.
SECTION_MARKERS = (
    "abstract", "introduction", "background", "related work", "methods", "methodology", "materials and methods", "experimental", "experiments", "procedures", "results", "findings", "data analysis",
    "discussion", "conclusion", "conclusions", "references", "bibliography", "acknowledgments", "supplementary", "appendix",
)
PARSER_MARKERS = ("abstract", "introduction", "methods", "methodology", "results", "discussion", "conclusion", "references", "related work", "background", "experiments")
MODULE_SECTIONS = {
    "statistics": ("abstract", "results", "findings", "data analysis", "methods", "methodology"),
    "methodology": ("abstract", "introduction", "methods", "methodology", "materials and methods", "experimental", "conclusion", "conclusions"),
    "citations": ("introduction", "background", "related work", "references", "bibliography"),
    "reproducibility": ("methods", "methodology", "materials and methods", "experimental", "procedures", "acknowledgments"),
    "novelty": ("abstract", "introduction", "background", "related work"),
    "grim": ("results", "findings", "methods", "methodology", "data analysis"),
    "sprite": ("results", "findings", "methods", "methodology", "data analysis"),
    "granularity": ("results", "findings", "methods", "data analysis"),
    "pcurve": ("abstract", "results", "findings", "data analysis"),
    "effect_size": ("results", "findings", "methods", "discussion"),
    "retraction": ("references", "bibliography", "introduction"),
    "cartel": ("references", "bibliography", "introduction", "acknowledgments"),
    "llm": ("abstract", "introduction", "methods", "results", "discussion"),
}

# Expected shares of first digits, weights of severities.
BENFORD = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
SEVERITY_WEIGHTS = {"high": 0.35, "medium": 0.20, "low": 0.08}
FIGURE_WEIGHTS = {"high": 0.40, "medium": 0.20, "low": 0.08}
KNOWN_RETRACTIONS = ("10.1016/s0140-6736(97)11096-0", "10.1126/science.1254166", "10.1038/nature13187", "10.1097/00007632-200207150-00020", "10.1016/j.cell.2009.01.043")
