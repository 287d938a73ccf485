"""Queries of the analyzers over documents, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.analyzers import ANALYZERS, analyze_all, papers
from veritrove.analyzers.relational import citation_edges
from veritrove.analyzers.statistics import sprite_groups
from veritrove.functions import vocabulary as V
from veritrove.functions.routing import routed, section_list, truncated, with_sections
from veritrove.functions.vocabulary import re2
from veritrove.sources.tables import table


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers(table(spark, folder, "documents"), abstract="abstract", author_name="author_name", title="title")


def _flags() -> Column:
    return F.array_join(F.transform("flags", lambda f: F.concat(f["flag_type"], F.lit(":"), f["severity"])), ",").alias("flags")


def _evidence() -> Column:
    return F.array_join(F.transform("flags", lambda f: f["evidence"]), " ; ").alias("evidence")


def _listed(column: str, form: str) -> str:
    """A list as text, an item as ``form`` has it."""
    return f"array_join(transform({column}, x -> {form}), '|')"


_GROUP = "format_string('%.6f/%.6f/%d/%d-%d', x.mean, x.sd, x.n, x.lo, x.hi)"
_MEASURES = {
    "statistics": [_listed("p_values_found", "format_string('%.8f', x)") + " AS p_values", "array_join(sample_sizes_found, '|') AS sample_sizes"],
    "methodology": ["size(claims_found) AS n_claims", "size(methods_found) AS n_methods", "md5(array_join(claims_found, '|')) AS claims", "md5(array_join(methods_found, '|')) AS methods", "llm_available", _listed("flags", "concat(x.claim, ' ', x.issue)") + " AS issues"],
    "citations": ["total_citations", "self_citations", "self_citation_ratio", "unsupported_claims"],
    "reproducibility": ["has_code_link", "has_data_link", "has_software_versions", "has_statistical_software", "has_preregistration", "has_ethics_statement", "has_conflict_statement", "has_sample_size_justification", "reproducibility_score"],
    "novelty": ["novelty_score", "novelty_level", "array_join(key_terms_extracted, '|') AS key_terms", "literature_accessible"],
    "grim": [_listed("impossible_means", "format_string('%.6f/%d', x.mean, x.n)") + " AS impossible", _listed("possible_means", "format_string('%.6f/%d', x.mean, x.n)") + " AS possible"],
    "sprite": [_listed("impossible_combinations", _GROUP) + " AS impossible", _listed("possible_combinations", _GROUP) + " AS possible", "size(errors) AS n_errors"],
    "granularity": ["digit_preference_score", "benford_score", "round_number_ratio"],
    "pcurve": [_listed("p_values_found", "format_string('%.4f', x)") + " AS p_values", _listed("significant_p", "format_string('%.4f', x)") + " AS significant", "right_skew_ratio", "clustering_score"],
    "effect_size": [_listed("effect_sizes_found", "format_string('%s=%.4f', x.type, x.value)") + " AS effects", _listed("power_estimates", "format_string('%.4f/%d/%.3f', x.effect_value, x.n, x.power)") + " AS powers", "size(inflated_effects) AS n_inflated", "size(underpowered) AS n_underpowered"],
    "retraction": ["array_join(dois_found, ' ') AS dois", "array_join(retracted_found, ' ') AS retracted", "checked_count", "signal_count"],
    "cartel": ["array_join(authors_found, '|') AS authors", "citation_count", "size(citation_network) AS n_authors", "concentration", "self_citation_ratio", "network_diversity"],
    "llm": ["burstiness_score", "vocabulary_diversity", "sentence_uniformity", "llm_phrase_count"],
}


def flat(name: str, reported: DataFrame) -> DataFrame:
    """Measures, flags with their evidence, score and level of a report, flat: lists as text."""
    return reported.select(F.col("id").alias("doc_id"), *(F.expr(m) for m in _MEASURES[name]), _flags(), _evidence(), "score", "risk_level")


def report(name: str, df: DataFrame) -> DataFrame:
    """The flat report of one analyzer."""
    return flat(name, ANALYZERS[name](df))


def _query(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report(name, _papers(spark, folder))

    run.__doc__ = f"The {name} analyzer on whole texts."
    return run


def _routed_query(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report(name, routed(with_sections(_papers(spark, folder)), name))

    run.__doc__ = f"The {name} analyzer on the sections it reads."
    return run


def section_map(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every document: one row each."""
    # The outer form: the plain one lets the optimizer compute the sections once more for a filter.
    listed = section_list(_papers(spark, folder)).select("id", F.posexplode_outer("section_list").alias("pos", "s")).where("s is not null")
    return listed.select(F.col("id").alias("doc_id"), (F.col("pos") + 1).alias("section_no"), F.col("s.name").alias("name"), F.col("s.start").alias("start_at"), F.length("s.body").alias("n_chars"))


def truncated_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text cut to what fits, without sections."""
    return _papers(spark, folder).select(F.col("id").alias("doc_id"), F.md5(truncated(F.col("text"))).alias("digest"))


def sprite_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Means with their deviation, nearest sample size and nearest scale."""
    rows = sprite_groups(_papers(spark, folder)).select("id", F.posexplode_outer("groups").alias("pos", "g")).where("g is not null")
    return rows.select(F.col("id").alias("doc_id"), F.col("pos").alias("pair_no"), "g.mean", "g.sd", "g.n", "g.lo", "g.hi")


def cartel_network(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of each author in each document, and the author's rank there."""
    edges = citation_edges(_papers(spark, folder))
    total = edges.groupBy("id").agg(F.sum("cites").alias("total"), F.count("*").alias("authors"), F.max("cites").alias("most"))
    joined = edges.join(total, "id")
    return joined.select(F.col("id").alias("doc_id"), "author", "cites", (F.col("cites") / F.col("total")).alias("share"), (F.col("cites") >= F.col("total") * 2.0 / F.col("authors")).alias("repeated"), (F.col("cites") == F.col("most")).alias("top"))


def retraction_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that cite a DOI of the table of retractions, whichever position it has."""
    from veritrove.analyzers.relational import dois

    clean = lambda c: F.regexp_replace(F.lower(c), r"\.+$", "")
    known = table(spark, folder, "retractions").select(clean(F.col("doi")).alias("key"), "reason", F.col("year").alias("retracted_year"))
    cited = _papers(spark, folder).select(F.col("id").alias("doc_id"), F.explode_outer(F.array_distinct(F.transform(dois(F.col("text")), clean))).alias("key")).where("key is not null")
    return cited.join(known, "key").select("doc_id", F.col("key").alias("doi"), "reason", "retracted_year")


def retracted_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of retracted works by paper: how often, and since when."""
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    known = table(spark, folder, "retractions").select(clean(F.col("doi")).alias("key")).distinct()
    edges = table(spark, folder, "citation_edges").where("paper_id is not null").select("paper_id", clean(F.col("cited_doi")).alias("key"), "seen_at")
    return edges.join(known, "key", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n_edges"), F.count_distinct("key").alias("n_works"), F.min("seen_at").alias("first_seen"))


def _wide(spark: SparkSession, folder: str, by_section: bool) -> DataFrame:
    rows = analyze_all(_papers(spark, folder), by_section=by_section)
    return rows.select(F.col("id").alias("doc_id"), *(F.col(f"{n}.{c}").alias(f"{n}_{k}") for n in ANALYZERS for c, k in (("score", "score"), ("risk_level", "level"))))


def integrity_report(spark: SparkSession, folder: str) -> DataFrame:
    """Score and level of every analyzer side by side, on whole texts, in one pass."""
    return _wide(spark, folder, False)


def routed_integrity_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same with each analyzer on the sections it reads; sections are split once."""
    return _wide(spark, folder, True)


def _r(value: str, digits: int) -> str:
    """printf rounds the binary number itself, exact ties to the even digit."""
    return f"CAST(printf('%.{digits}f', ({value})::DOUBLE) AS DOUBLE)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(phrases, low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, {_q(p)})" for p in phrases) + ")"


def _held(phrases, low: str = "low") -> str:
    return f"list_filter([{', '.join(map(_q, phrases))}], lambda x: contains({low}, x))"


def _found(pattern: str, group: int = 1, ignore_case: bool = True, col: str = "text") -> str:
    return f"regexp_extract_all({col}, {re2(pattern, ignore_case)}, {group})"


def _ascii(col: str) -> str:
    """Letters and digits beyond ASCII as underscores, as RE2 knows word boundaries of ASCII only."""
    return rf"regexp_replace({col}, '[\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{2C1}}\x{{370}}-\x{{5FF}}\x{{620}}-\x{{669}}\x{{66E}}-\x{{6D3}}\x{{6D5}}-\x{{963}}\x{{966}}-\x{{1FFF}}\x{{2C00}}-\x{{2DFF}}\x{{3040}}-\x{{D7FF}}\x{{F900}}-\x{{FAFF}}\x{{10000}}-\x{{1FFFF}}]', '_', 'g')"


def _nums(strings: str, kind: str = "DOUBLE") -> str:
    return f"list_filter(list_transform({strings}, lambda s: TRY_CAST(s AS {kind})), lambda v: v IS NOT NULL)"


def _raised(*rules: tuple[str, ...]) -> str:
    """``flags`` and ``evidence`` from rules: condition, flag and, if there is any, evidence."""
    some = lambda k, sep: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r[0]} THEN {(*r, chr(39) * 2)[k]} END" for r in rules) + f"], lambda x: x IS NOT NULL), '{sep}')"
    return f"{some(1, ',')} AS flags, {some(2, ' ; ')} AS evidence"


def _no(value: str, digits: int = 4) -> str:
    return f"printf('%.{digits}f', ({value})::DOUBLE)"


def _text_list(items: str, form: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: {form}), '|')"


def _weight(col: str = "flags") -> str:
    count = lambda s: f"len(regexp_extract_all({col}, ':{s}'))"
    return f"least({count('high')} * 0.35::DOUBLE + {count('medium')} * 0.20::DOUBLE + {count('low')} * 0.08::DOUBLE, 1.0::DOUBLE)"


def _level(c: str, h: str, m: str) -> str:
    return f"CASE WHEN {c} THEN 'critical' WHEN {h} THEN 'high' WHEN {m} THEN 'medium' ELSE 'low' END"


def _level_of(score: str) -> str:
    return _level(f"{score} >= 0.7 - 1e-12", f"{score} >= 0.4 - 1e-12", f"{score} >= 0.2 - 1e-12")


_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, coalesce(abstract, '') AS abstract, coalesce(author_name, '') AS author_name, coalesce(title, '') AS title FROM documents)"
_STRIP = lambda x: rf"regexp_replace({x}, '^[{V.BLANKS}]+|[{V.BLANKS}]+$', '', 'g')"
_WORDS = lambda x: rf"len(regexp_extract_all({x}, '[^{V.BLANKS}]+'))"
_PIECES = f"list_transform(string_split_regex(text, '[.!?]'), lambda s: {_STRIP('s')})"


def _matches(patterns) -> str:
    return f"regexp_matches(text, {re2('|'.join(f'(?:{p})' for p in patterns))})"


_SQL = {}
_SQL["statistics"] = f"""WITH {_D},
a AS (SELECT doc_id, low, {_found(V.P_AUDIT)} AS mentions, {_nums(_found(V.N_AUDIT), "BIGINT")} AS n FROM d),
b AS (SELECT *, list_filter({_nums("mentions")}, lambda v: v > 0 AND v <= 1) AS p FROM a),
c AS (SELECT *, list_filter(p, lambda v: v >= 0.04::DOUBLE AND v <= 0.051::DOUBLE) AS close, len(list_filter(p, lambda v: v >= 0.04::DOUBLE AND v <= 0.051::DOUBLE)) AS near, list_filter(p, lambda v: v IN (0.05::DOUBLE, 0.049::DOUBLE, 0.001::DOUBLE, 0.01::DOUBLE)) AS round_p, CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda v: v >= 0.04::DOUBLE AND v <= 0.051::DOUBLE))::DOUBLE / len(p) ELSE 0 END AS share,
  list_filter(n, lambda v: v > 0 AND v < 30) AS small FROM b),
f AS (SELECT *, {_raised(("share >= 0.6 AND near >= 3", "'p_hacking_suspected:high'", "to_json(close)::VARCHAR"), ("NOT (share >= 0.6 AND near >= 3) AND share >= 0.4 AND near >= 2", "'borderline_p_values:medium'", "to_json(close)::VARCHAR"), ("len(small) > 0", "'small_sample_size:' || CASE WHEN list_min(small) < 15 THEN 'high' ELSE 'medium' END", "to_json(small)::VARCHAR"), ("len(round_p) > 0", "'suspiciously_round_p_values:medium'", "to_json(round_p)::VARCHAR"), (f"len(n) > 0 AND {_any(V.RESULT_WORDS)} AND len(mentions) = 0", "'missing_statistical_tests:high'"))} FROM c),
g AS (SELECT *, {_weight()} AS raw FROM f)
SELECT doc_id, {_text_list("p", _no("x", 8))} AS p_values, array_to_string(n, '|') AS sample_sizes, flags, evidence, {_r("raw", 3)} AS score, {_level_of("raw")} AS risk_level FROM g"""
_SQL["pcurve"] = f"""WITH {_D},
a AS (SELECT doc_id, list_transform(list_filter({_nums(_found(V.P_CURVE))}, lambda v: v > 0 AND v <= 1), lambda v: {_r("v", 4)}) AS p FROM d),
b AS (SELECT *, list_filter(p, lambda v: v <= 0.05::DOUBLE) AS s FROM a),
c AS (SELECT *, len(s) >= 3 AS go, CASE WHEN len(s) >= 3 THEN len(list_filter(s, lambda v: v <= 0.025::DOUBLE))::DOUBLE / len(s) ELSE 0 END AS k, CASE WHEN len(s) >= 3 THEN len(list_filter(s, lambda v: v >= 0.04::DOUBLE))::DOUBLE / len(s) ELSE 0 END AS c FROM b),
f AS (SELECT *, {_raised(("go AND c > 0.5", "'p_value_clustering:' || CASE WHEN c > 0.7 THEN 'high' ELSE 'medium' END", _no("c")), ("go AND k < 0.3 AND len(s) >= 4", "'flat_pcurve:medium'", _no("k")), ("go AND len(list_filter(p, lambda v: abs(v - 0.05::DOUBLE) < 0.001::DOUBLE)) >= 2", "'exact_threshold_reporting:medium'"))},
  CASE WHEN go THEN least({_r("c * 0.6::DOUBLE + (1.0::DOUBLE - k) * 0.4::DOUBLE", 4)}, 1.0) ELSE 0.0 END AS score FROM c)
SELECT doc_id, {_text_list("p", _no("x"))} AS p_values, {_text_list("s", _no("x"))} AS significant, {_r("k", 4)} AS right_skew_ratio, {_r("c", 4)} AS clustering_score, flags, evidence, score, CASE WHEN go THEN {_level("c > 0.7 OR score >= 0.7", "c > 0.5 OR score >= 0.5", "c > 0.3 OR score >= 0.3")} ELSE 'low' END AS risk_level FROM f"""
_SQL["grim"] = f"""WITH {_D},
a AS (SELECT doc_id, list_zip({_found(V.GRIM_PAIR, 1)}, {_found(V.GRIM_PAIR, 2)}, {_found(V.GRIM_PAIR, 3)}, {_found(V.GRIM_PAIR, 4)}) AS z FROM d),
b AS (SELECT doc_id, unnest(z) AS z, generate_subscripts(z, 1) AS k FROM a),
c0 AS (SELECT doc_id, k, CASE WHEN z[1] <> '' AND z[2] <> '' THEN z[1] ELSE z[4] END AS s, CASE WHEN z[1] <> '' AND z[2] <> '' THEN TRY_CAST(z[2] AS BIGINT) ELSE TRY_CAST(z[3] AS BIGINT) END AS n FROM b),
c AS (SELECT doc_id, k, TRY_CAST(s AS DOUBLE) AS m, n, abs(TRY_CAST(s AS DOUBLE) * n - round_even(TRY_CAST(s AS DOUBLE) * n, 0)) >= 0.001::DOUBLE AS wrong, greatest(len(rtrim(split_part(s, '.', 2), '0')), 1) AS digits FROM c0),
h AS (SELECT *, CAST(printf('%.' || digits || 'f', floor(m * n) / n) AS DOUBLE) AS lower_mean, CAST(printf('%.' || digits || 'f', ceil(m * n) / n) AS DOUBLE) AS upper_mean FROM c),
e AS (SELECT d.doc_id, count(*) FILTER (wrong) AS bad, count(*) FILTER (NOT wrong) AS good, coalesce(string_agg(printf('%.6f/%d', m, n), '|' ORDER BY k) FILTER (wrong), '') AS impossible, coalesce(string_agg(printf('%.6f/%d', m, n), '|' ORDER BY k) FILTER (NOT wrong), '') AS possible,
  coalesce(string_agg(printf('M = %.6f, N = %d, nearest %.6f or %.6f', m, n, lower_mean, upper_mean), ' ; ' ORDER BY k) FILTER (wrong), '') AS evidence FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND n BETWEEN 2 AND 10000 GROUP BY d.doc_id),
f AS (SELECT *, CASE WHEN bad + good > 0 THEN bad::DOUBLE / (bad + good) ELSE 0 END AS raw FROM e)
SELECT doc_id, impossible, possible, rtrim(repeat('grim_impossible_mean:high,', bad), ',') AS flags, evidence, {_r("raw", 4)} AS score, {_level("bad >= 3 OR raw >= 0.6", "bad = 2 OR raw >= 0.4", "bad = 1 OR raw >= 0.2")} AS risk_level FROM f"""
_FRACTION = "CASE WHEN rtrim(split_part(s, '.', 2), '0') = '' THEN '0' ELSE rtrim(split_part(s, '.', 2), '0') END"
_CHI = " + ".join(f"(cnt_{k} - {e}::DOUBLE) * (cnt_{k} - {e}::DOUBLE) / {e}::DOUBLE" for k, e in V.BENFORD.items())
_SQL["granularity"] = f"""WITH {_D},
a AS (SELECT doc_id, {_found(V.DECIMAL, 0, False, _ascii("text"))} AS ds, list_filter({_found(V.INTEGER, 0, False, _ascii("text"))}, lambda s: TRY_CAST(s AS BIGINT) BETWEEN 10 AND 99999) AS i FROM d),
b AS (SELECT doc_id, ds, list_transform(ds, lambda s: {_FRACTION}) AS fr,
  list_concat(list_transform(list_filter(ds, lambda s: CAST(s AS DOUBLE) >= 1), lambda s: regexp_extract(s, '[1-9]')), list_transform(i, lambda s: regexp_extract(s, '[1-9]'))) AS h FROM a),
c AS (SELECT doc_id, ds, fr, h, CASE WHEN len(ds) >= 5 THEN len(list_filter(fr, lambda x: right(x, 1) IN ('0', '5')))::DOUBLE / len(ds) ELSE 0 END AS share,
  CASE WHEN len(ds) >= 5 THEN len(list_filter(ds, lambda s: abs(CAST(s AS DOUBLE) - round_even(CAST(s AS DOUBLE), 0)) < 0.001::DOUBLE))::DOUBLE / len(ds) ELSE 0 END AS rounds,
  {", ".join(f"CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: x = '{k}'))::DOUBLE / len(h) ELSE 0 END AS cnt_{k}" for k in V.BENFORD)} FROM b),
e AS (SELECT *, CASE WHEN len(h) >= 10 THEN least((0.0 + {_CHI}) / 15.0, 1.0) ELSE 0.0 END AS benford, CASE WHEN share > 0.2::DOUBLE THEN least((share - 0.2::DOUBLE) / 0.4::DOUBLE, 1.0) ELSE 0.0 END AS pref FROM c),
f AS (SELECT *, {_raised(("share > 0.45", "'digit_preference_detected:' || CASE WHEN share > 0.6 THEN 'high' ELSE 'medium' END", _no("share")), ("benford > 0.4", "'benford_law_violation:' || CASE WHEN benford > 0.7 THEN 'high' ELSE 'medium' END", _no("benford")), ("rounds > 0.6", "'excessive_round_numbers:medium'", _no("rounds")), ("len(ds) >= 6 AND len(list_distinct(list_transform(fr, lambda x: len(x)))) = 1", "'uniform_decimal_precision:medium'"))}, {_r("(pref + benford + rounds) / 3.0", 4)} AS score FROM e),
g AS (SELECT *, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n FROM f)
SELECT doc_id, {_r("pref", 4)} AS digit_preference_score, {_r("benford", 4)} AS benford_score, {_r("rounds", 4)} AS round_number_ratio, flags, evidence, score, {_level("n >= 3 OR score >= 0.6", "n = 2 OR score >= 0.4", "n = 1 OR score >= 0.2")} AS risk_level FROM g"""
_ERF = "(1.0 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z))"
_EFFECTS = (("cohens_d", V.COHEN_D, "true"), ("pearson_r", V.PEARSON_R, "v BETWEEN -1.5 AND 1.5"), ("eta_squared", V.ETA_SQUARED, "true"), ("omega_squared", V.OMEGA_SQUARED, "true"), ("odds_ratio", V.ODDS_RATIO, "v BETWEEN 0.1 AND 50"))
_EACH = " UNION ALL ".join(f"SELECT doc_id, {k} AS family, '{kind}' AS type, unnest({_nums(_found(pattern))}) AS v, generate_subscripts({_nums(_found(pattern))}, 1) AS pos FROM d" for k, (kind, pattern, _) in enumerate(_EFFECTS))
_SQL["effect_size"] = f"""WITH {_D},
sizes AS (SELECT doc_id, list_min(list_filter({_nums(_found(V.N_EFFECT), "BIGINT")}, lambda v: v BETWEEN 2 AND 100000)) AS n FROM d),
u AS (SELECT each.*, n FROM ({_EACH}) each JOIN sizes USING (doc_id) WHERE {" OR ".join(f"(type = '{kind}' AND {test})" for kind, _, test in _EFFECTS)}),
w AS (SELECT *, 1.96::DOUBLE - abs(v) * sqrt(n / 2.0) AS x FROM u),
y AS (SELECT *, abs(x) / sqrt(2.0::DOUBLE) AS z, 1.0 / (1.0 + 0.3275911::DOUBLE * (abs(x) / sqrt(2.0::DOUBLE))) AS t FROM w),
p AS (SELECT *, CASE WHEN type = 'cohens_d' AND n IS NOT NULL THEN least(greatest(1.0 - 0.5 * (1.0 + CASE WHEN x < 0 THEN -{_ERF} ELSE {_ERF} END), 0.0), 1.0) END AS pw FROM y),
q AS (SELECT *, pw IS NOT NULL AND abs(v) > 2.0 AND n < 30 AS big, pw IS NOT NULL AND NOT (abs(v) > 2.0 AND n < 30) AND pw < 0.8 AND n < 50 AS weak FROM p),
o AS (SELECT *, CASE WHEN big THEN 'inflated_effect_size:high' WHEN weak THEN 'underpowered_study:medium' WHEN type = 'pearson_r' AND abs(v) > 1 THEN 'impossible_correlation:high' WHEN type = 'eta_squared' AND v > 0.5 THEN 'large_eta_squared:medium' END AS flag,
  CASE WHEN big OR weak THEN printf('%s = %.4f, N = %d, power %.3f', type, v, n, pw) ELSE printf('%s = %.4f', type, v) END AS ev FROM q),
k AS (SELECT doc_id, count(*) AS ne, count(*) FILTER (big) AS i, count(*) FILTER (weak) AS u, string_agg(printf('%s=%.4f', type, v), '|' ORDER BY family, pos) AS effects, string_agg(printf('%.4f/%d/%.3f', v, n, pw), '|' ORDER BY pos) FILTER (pw IS NOT NULL) AS powers,
  string_agg(flag, ',' ORDER BY family, pos) AS flags, string_agg(ev, ' ; ' ORDER BY family, pos) FILTER (flag IS NOT NULL) AS evidence FROM o GROUP BY doc_id),
e AS (SELECT d.doc_id, coalesce(ne, 0) AS ne, coalesce(i, 0) AS i, coalesce(u, 0) AS u, coalesce(effects, '') AS effects, coalesce(powers, '') AS powers, CASE WHEN ne IS NULL THEN 'missing_effect_sizes:medium' ELSE coalesce(flags, '') END AS flags, coalesce(evidence, '') AS evidence FROM d LEFT JOIN k USING (doc_id)),
f AS (SELECT *, CASE WHEN ne = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE * least(i, 2) / 2.0 + 0.3::DOUBLE * least(u, 2) / 2.0 END AS raw FROM e)
SELECT doc_id, effects, powers, i::INT AS n_inflated, u::INT AS n_underpowered, flags, evidence, {_r("raw", 4)} AS score, {_level("i >= 1 OR raw >= 0.6", "u >= 2 OR raw >= 0.4", "u >= 1 OR raw >= 0.2")} AS risk_level FROM f"""
_KNOWN = ", ".join(_q(r) for r in V.KNOWN_RETRACTIONS)
_DISTINCT_DOIS = f"(SELECT doc_id, doi, min(pos) AS pos FROM (SELECT doc_id, regexp_replace(unnest({_found(V.DOI, 1, False)}), '[.,;]+$', '') AS doi, generate_subscripts({_found(V.DOI, 1, False)}, 1) AS pos FROM d) GROUP BY doc_id, doi QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) <= 20)"
_BARE = "rtrim(lower(doi), '.')"
_SQL["retraction"] = f"""WITH {_D}, x AS {_DISTINCT_DOIS},
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER ({_BARE} IN ({_KNOWN})) AS k, string_agg(doi, ' ' ORDER BY pos) AS dois, string_agg({_BARE}, ' ' ORDER BY pos) FILTER ({_BARE} IN ({_KNOWN})) AS retracted, string_agg({_BARE}, ' ; ' ORDER BY pos) FILTER ({_BARE} IN ({_KNOWN})) AS ev FROM x GROUP BY doc_id),
g AS (SELECT doc_id, {_found(V.RETRACTION_TERM, 0)} AS signals FROM d),
e AS (SELECT g.doc_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k, len(signals) AS s, coalesce(dois, '') AS dois, coalesce(retracted, '') AS retracted, ev, array_to_string(list_sort(list_distinct(list_slice(signals, 1, 8))), ', ') AS words FROM g LEFT JOIN c USING (doc_id)),
f AS (SELECT *, least({_r("0.6::DOUBLE * least(k, 3) / 3.0 + 0.2::DOUBLE * least(s, 5) / 5.0", 4)}, 1.0) AS score FROM e)
SELECT doc_id, dois, retracted, n::INT AS checked_count, s::INT AS signal_count, rtrim(repeat('retracted_citation:high,', k) || CASE WHEN s > 0 THEN 'retraction_language_detected:medium,' ELSE '' END || CASE WHEN n = 0 THEN 'no_dois_found:low' ELSE '' END, ',') AS flags,
  array_to_string(list_filter([ev, CASE WHEN s > 0 THEN words END, CASE WHEN n = 0 THEN '' END], lambda x: x IS NOT NULL), ' ; ') AS evidence, score,
  {_level("k >= 1 OR score >= 0.6", "score >= 0.3", "score >= 0.1")} AS risk_level FROM f"""
_OBJECTION = (
    "A cause is claimed. Causal words (' || causes || ') rest on a design (' || designs || ') that shows no cause.", "A firm conclusion is drawn from what people say of themselves. Self-reports are bent by memory and by the wish to please.",
    "A lasting effect is claimed. The time studied is short.", "A treatment is said to work. Without a comparison, chance, recovery and expectation remain as reasons.", "A finding is said to hold for everyone. The sample stands for few.",
)
_RULES = [
    (f"{_any(V.CAUSATION)} AND {_any(V.WEAK_DESIGNS)} AND NOT {_any(V.RCT)}", "'causation_without_rct:high'", "coalesce(causal, '')"), (f"{_any(V.SELF_REPORT)} AND {_any(V.STRONG_CLAIM)}", "'weak_design_strong_claim:medium'"),
    (f"{_any(V.LONG_TERM)} AND {_any(V.SHORT_TERM)}", "'timeframe_mismatch:medium'"), (f"{_any(V.TREATMENT)} AND {_any(V.EFFECT_CLAIM)} AND NOT {_any(V.CONTROL)}", "'missing_control_group:high'"), (f"{_any(V.BROAD_CLAIM)} AND {_any(V.LIMITED_SAMPLE)}", "'overgeneralization:medium'"),
]
_SQL["methodology"] = f"""WITH {_D},
a AS (SELECT doc_id, low, list_filter({_PIECES.replace("(text", "(CASE WHEN abstract <> '' THEN abstract ELSE text END")}, lambda s: len(s) >= 20 AND {_any(V.FINDING_MARKERS, "lower(s)")}) AS claims, list_filter({_PIECES}, lambda s: len(s) >= 20 AND {_any(V.METHOD_MARKERS, "lower(s)")}) AS methods,
  list_filter({_PIECES}, lambda s: {_any(V.CAUSATION, "lower(s)")})[1] AS causal, array_to_string({_held(V.CAUSATION, "substr(low, 1, 500)")}, ', ') AS causes, array_to_string({_held(V.WEAK_DESIGNS)}, ', ') AS designs FROM d),
f AS (SELECT doc_id, claims, methods, {_raised(*_RULES)}, array_to_string(list_filter([{", ".join(f"CASE WHEN {r[0]} THEN '{o}' END" for r, o in zip(_RULES, _OBJECTION, strict=True))}], lambda x: x IS NOT NULL), '|') AS issues FROM a),
g AS (SELECT *, {_weight()} AS raw FROM f)
SELECT doc_id, least(len(claims), 8)::INT AS n_claims, least(len(methods), 8)::INT AS n_methods, md5(array_to_string(list_slice(claims, 1, 8), '|')) AS claims, md5(array_to_string(list_slice(methods, 1, 8), '|')) AS methods, false AS llm_available, issues, flags, evidence, {_r("raw", 3)} AS score, {_level_of("raw")} AS risk_level FROM g"""
_SQL["reproducibility"] = f"""WITH {_D},
a AS (SELECT doc_id, low, {_matches(V.CODE_LINK)} AS has_code_link, {_matches(V.DATA_LINK)} AS has_data_link, {_matches(V.SOFTWARE_VERSION)} AS has_software_versions, {_any(V.STAT_SOFTWARE)} AS has_statistical_software, {_matches(V.PREREGISTRATION)} AS has_preregistration,
  {_any(V.ETHICS)} AS has_ethics_statement, {_any(V.CONFLICT)} AS has_conflict_statement, {_any(V.SAMPLE_SIZE_REASONS)} AS has_sample_size_justification, {_matches((V.ON_REQUEST,))} AS asked FROM d),
f AS (SELECT *, has_code_link::INT + has_data_link::INT + has_software_versions::INT + has_statistical_software::INT + has_preregistration::INT + has_ethics_statement::INT + has_conflict_statement::INT + has_sample_size_justification::INT AS met,
  {_raised((f"{_any(V.COMPUTATIONAL)} AND NOT has_code_link", "'missing_code_availability:high'"), (f"{_any(V.EMPIRICAL)} AND NOT has_data_link", "'missing_data_availability:high'"), (f"{_any(V.QUANTITATIVE)} AND NOT has_software_versions", "'missing_software_versions:medium'"), (f"{_any(V.EXPERIMENTAL)} AND NOT has_preregistration", "'missing_preregistration:medium'"), (f"{_any(V.HUMANS)} AND NOT has_ethics_statement", "'missing_ethics_statement:high'"), ("asked", "'data_available_on_request:medium'"))} FROM a),
g AS (SELECT *, {_r("1.0 - met / 8.0", 3)} AS score FROM f)
SELECT doc_id, has_code_link, has_data_link, has_software_versions, has_statistical_software, has_preregistration, has_ethics_statement, has_conflict_statement, has_sample_size_justification, {_r("met / 8.0", 3)} AS reproducibility_score, flags, evidence, score, {_level("score >= 0.7", "score >= 0.4", "score >= 0.2")} AS risk_level FROM g"""
_BOTH = f"list_concat(w, list_slice({_held(V.DOMAIN_KEYWORDS)}, 1, greatest(6 - len(w), 1)))"
_SQL["novelty"] = f"""WITH {_D},
a AS (SELECT *, list_slice({_found(V.TITLE_WORD, 0, False, _ascii("title"))}, 1, 5) AS w, len({_held(V.NOVELTY_SIGNALS)}) AS ns, len({_held(V.INCREMENTAL_SIGNALS)}) AS ni, {_held(V.INCREMENTAL_SIGNALS)} AS inc FROM d),
b AS (SELECT *, CASE WHEN len({_BOTH}) < 3 THEN list_concat({_BOTH}, list_slice({_found(V.CAPITAL_PAIR, 0, False, _ascii("text"))}, 1, 3)) ELSE {_BOTH} END AS t FROM a),
u AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM b),
k AS (SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS key_terms FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY pos) AS copy FROM u) WHERE copy = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 6) GROUP BY doc_id),
s AS (SELECT b.doc_id, ni, inc, coalesce(key_terms, '') AS key_terms, {_r("least(greatest(0.5 + 0.08::DOUBLE * ns - 0.06::DOUBLE * ni, 0.05), 0.95)", 3)} AS s FROM b LEFT JOIN k USING (doc_id))
SELECT doc_id, s AS novelty_score, CASE WHEN s >= 0.75 THEN 'very_high' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.35 THEN 'moderate' ELSE 'low' END AS novelty_level, key_terms, false AS literature_accessible,
  {_raised(("s < 0.25", "'low_novelty_score:high'", _no("s", 3)), ("s >= 0.25 AND s < 0.45", "'moderate_novelty_concern:medium'", _no("s", 3)), ("ni >= 3", "'incremental_language_detected:medium'", "to_json(list_slice(inc, 1, 3))::VARCHAR"))}, s AS score, {_level("s < 0.25", "s < 0.40", "s < 0.60")} AS risk_level FROM s"""
_SQL["citations"] = f"""WITH {_D},
a AS (SELECT doc_id, len(list_distinct(list_concat({", ".join(_found(p, 0, False) for p in V.CITATION_MARKS[:2])}, {", ".join(_found(p, 0, False) for p in V.CITATION_MARKS[2:])}))) AS total,
  CASE WHEN author_name = '' THEN 0 ELSE len(regexp_extract_all(text, '(?i)' || regexp_escape(CASE WHEN regexp_extract({_STRIP("author_name")}, '[^{V.BLANKS}]+$') = '' THEN author_name ELSE regexp_extract({_STRIP("author_name")}, '[^{V.BLANKS}]+$') END) || '[,{V.BLANKS}]{{0,10}}(?:\\d{{4}}|et al)')) END AS own,
  list_slice(list_filter({_PIECES}, lambda s: len(s) >= 15 AND {_any(V.CLAIM_MARKERS, "lower(s)")} AND NOT regexp_matches(s, {re2(V.CITED_CLAIM, False)})), 1, 5) AS claims,
  greatest(1, {_WORDS("text")} // 250) AS pages, len({_found(V.ET_AL, 0)}) AS ea FROM d),
b AS (SELECT *, len(claims) AS loose, CASE WHEN total > 0 THEN own::DOUBLE / total ELSE 0.0 END AS share FROM a),
f AS (SELECT *, {_raised(("total >= 5 AND share >= 0.5", "'excessive_self_citation:high'", _no("share")), ("total >= 5 AND share >= 0.30::DOUBLE AND share < 0.5", "'high_self_citation_ratio:medium'", _no("share")), ("loose >= 3", "'unsupported_broad_claims:high'", "array_to_string(list_slice(claims, 1, 2), ' | ')"), ("loose BETWEEN 1 AND 2", "'unsupported_claims:medium'", "claims[1]"), ("pages >= 5 AND total::DOUBLE / pages < 1.5", "'low_citation_density:medium'", "pages::VARCHAR"), ("total > 5 AND ea::DOUBLE / total > 0.7", "'et_al_overuse:low'", _no("ea::DOUBLE / total")))} FROM b),
g AS (SELECT *, {_weight()} AS raw FROM f)
SELECT doc_id, total::INT AS total_citations, own::INT AS self_citations, {_r("share", 3)} AS self_citation_ratio, loose::INT AS unsupported_claims, flags, evidence, {_r("raw", 3)} AS score, {_level_of("raw")} AS risk_level FROM g"""
_CITED = f"list_transform(list_concat({_found(V.CARTEL_CITE)}, {_found(V.CARTEL_ET_AL)}), lambda s: {_STRIP('s')})"
_SQL["cartel"] = f"""WITH {_D}, u AS (SELECT doc_id, unnest({_CITED}) AS author, generate_subscripts({_CITED}, 1) AS pos FROM d),
firsts AS (SELECT doc_id, string_agg(author, '|' ORDER BY begun) FILTER (place <= 10) AS authors FROM (SELECT doc_id, author, min(pos) AS begun, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS place FROM u GROUP BY doc_id, author) GROUP BY doc_id), e AS (SELECT doc_id, author, count(*) AS c FROM u GROUP BY doc_id, author),
t AS (SELECT doc_id, sum(c) AS n, count(*) AS k, max(c) AS most FROM e GROUP BY doc_id),
r AS (SELECT e.*, n, k, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS rn FROM e JOIN t USING (doc_id)),
m AS (SELECT doc_id, sum(c) FILTER (rn <= 3) AS top3, -sum(c::DOUBLE / n * log2(c::DOUBLE / n)) AS h, count(*) FILTER (c >= 2.0 * n / k) AS often FROM r GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(top3::DOUBLE / n, 0.0) AS c, CASE WHEN coalesce(k, 0) > 1 THEN h / log2(k) ELSE 1.0 END AS dv, coalesce(most::DOUBLE / n, 0.0) AS o, coalesce(often, 0) AS often FROM d LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)),
f AS (SELECT *, {_raised(("c > 0.5 AND n >= 5", "'citation_concentration:' || CASE WHEN c > 0.7 THEN 'high' ELSE 'medium' END", _no("c")), ("dv < 0.3 AND n >= 8", "'low_citation_diversity:medium'", _no("dv")), ("o > 0.3 AND n >= 5", "'excessive_self_citation:' || CASE WHEN o > 0.5 THEN 'high' ELSE 'medium' END", _no("o")), ("often > 0", "'reciprocal_citation_pattern:medium'", "often::VARCHAR"), ("n < 5", "'insufficient_citations:low'", "n::BIGINT::VARCHAR"))},
  CASE WHEN n < 3 THEN 0.0 ELSE least({_r("c * 0.4::DOUBLE + (1.0 - dv) * 0.3::DOUBLE + o * 0.3::DOUBLE", 4)}, 1.0) END AS score FROM a),
g AS (SELECT *, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS nf FROM f)
SELECT doc_id, coalesce(authors, '') AS authors, n::INT AS citation_count, k::INT AS n_authors, {_r("c", 4)} AS concentration, {_r("o", 4)} AS self_citation_ratio, {_r("dv", 4)} AS network_diversity, flags, evidence, score, {_level("score >= 0.6 OR nf >= 3", "score >= 0.4 OR nf >= 2", "score >= 0.2 OR nf >= 1")} AS risk_level FROM g LEFT JOIN firsts USING (doc_id)"""
_SQL["llm"] = f"""WITH {_D},
a AS (SELECT doc_id, {_STRIP("text")} AS body, low, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]+')) AS words FROM d),
b AS (SELECT doc_id, len(body) >= 100 AS go, words, list_transform(list_filter(list_transform(string_split_regex(body, '[.!?]+[{V.BLANKS}]+'), lambda s: {_STRIP("s")}), lambda s: len(s) > 10), lambda s: {_WORDS("s")}) AS l, {_held(V.LLM_PHRASES)} AS phrases, len({_held(V.LLM_PHRASES)}) AS ph FROM a),
c AS (SELECT *, CASE WHEN len(l) > 0 THEN list_sum(l)::DOUBLE / len(l) ELSE 0.0 END AS m FROM b),
v AS (SELECT *, CASE WHEN len(l) >= 3 AND m > 0 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / (len(l) - 1)) / m END AS cv FROM c),
e AS (SELECT doc_id, go, phrases, len(l) AS ns, len(words) AS nw, CASE WHEN NOT go THEN 0.0 ELSE coalesce(least(cv, 1.0), 0.5) END AS b, CASE WHEN NOT go OR len(words) = 0 THEN 1.0 ELSE len(list_distinct(list_transform(list_slice(words, 1, 100), lambda w: lower(w))))::DOUBLE / least(len(words), 100) END AS t,
  CASE WHEN NOT go THEN 0.0 ELSE coalesce(greatest(0.0, 1.0 - least(cv, 1.0)), 0.0) END AS u, CASE WHEN go THEN ph ELSE 0 END AS k FROM v),
f AS (SELECT *, {_raised(("go AND b < 0.3 AND ns >= 5", "'low_burstiness:' || CASE WHEN b < 0.15 THEN 'high' ELSE 'medium' END", _no("b")), ("go AND t < 0.4 AND nw >= 50", "'low_vocabulary_diversity:medium'", _no("t")), ("go AND u > 0.7 AND ns >= 5", "'high_sentence_uniformity:medium'", _no("u")), ("go AND k >= 3", "'llm_signature_phrases:' || CASE WHEN k >= 6 THEN 'high' ELSE 'medium' END", "to_json(list_slice(phrases, 1, 6))::VARCHAR"))},
  CASE WHEN go AND ns >= 3 THEN least({_r("greatest(0.0, 1.0 - b / 0.5) * 0.35::DOUBLE + greatest(0.0, 1.0 - t / 0.6::DOUBLE) * 0.25 + u * 0.20::DOUBLE + least(k / 8.0, 1.0) * 0.20::DOUBLE", 4)}, 1.0) ELSE 0.0 END AS score FROM e),
g AS (SELECT *, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS nf FROM f)
SELECT doc_id, {_r("b", 4)} AS burstiness_score, {_r("t", 4)} AS vocabulary_diversity, {_r("u", 4)} AS sentence_uniformity, k::INT AS llm_phrase_count, flags, evidence, score, {_level("score >= 0.65 OR nf >= 3", "score >= 0.45 OR nf >= 2", "score >= 0.25 OR nf >= 1")} AS risk_level FROM g"""

_MARKERS = ", ".join(f"({k}, {_q(m)})" for k, m in enumerate(V.SECTION_MARKERS))
_SECTION_CTES = f"""{_D}, markers(ord, name) AS (VALUES {_MARKERS}),
lines AS (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS no FROM d),
placed AS (SELECT doc_id, line, no, coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM lines),
hits AS (SELECT doc_id, ord, name, arg_min(begins + instr(line, name) - 1, no) AS pos FROM placed, markers WHERE contains(line, name) AND len({_STRIP("line")}) <= 60 GROUP BY doc_id, ord, name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, ord) AS rn FROM hits),
kept AS (SELECT doc_id, rn, name, pos, pos AS last, true AS keep FROM ranked WHERE rn = 1 UNION ALL
  SELECT r.doc_id, r.rn, r.name, r.pos, CASE WHEN r.pos - k.last > 50 THEN r.pos ELSE k.last END, r.pos - k.last > 50 FROM kept k JOIN ranked r ON r.doc_id = k.doc_id AND r.rn = k.rn + 1),
sections AS (SELECT doc_id, name, pos, row_number() OVER w AS no, lead(pos) OVER w AS next FROM kept WHERE keep WINDOW w AS (PARTITION BY doc_id ORDER BY pos, rn))"""
_SQL_MORE = {
    "section_map": f"WITH RECURSIVE {_SECTION_CTES} SELECT doc_id, no::INT AS section_no, name, pos::INT AS start_at, len({_STRIP('substr(text, (pos + 1)::BIGINT, (coalesce(next, len(text)) - pos)::BIGINT)')})::INT AS n_chars FROM sections JOIN d USING (doc_id)",
    "truncated_text": f"WITH {_D} SELECT doc_id, md5(CASE WHEN len(text) <= 8000 THEN text WHEN instr(low, 'method') > 1 AND instr(low, 'method') - 1 < len(text) - 1000 THEN substr(text, 1, 3000) || ' [...] ' || substr(text, instr(low, 'method'), 4000) ELSE substr(text, 1, 8000) END) AS digest FROM d",
    "cartel_network": f"WITH {_D}, u AS (SELECT doc_id, unnest({_CITED}) AS author FROM d), e AS (SELECT doc_id, author, count(*) AS cites FROM u GROUP BY ALL) SELECT doc_id, author, cites, cites::DOUBLE / sum(cites) OVER w AS share, cites >= sum(cites) OVER w * 2.0 / count(*) OVER w AS repeated, cites = max(cites) OVER w AS top FROM e WINDOW w AS (PARTITION BY doc_id)",
    "retraction_hits": f"WITH {_D}, x AS {_DISTINCT_DOIS.split(' QUALIFY')[0]}), c AS (SELECT DISTINCT doc_id, regexp_replace(lower(doi), '\\.+$', '') AS doi FROM x) SELECT doc_id, c.doi, r.reason, r.year AS retracted_year FROM c JOIN retractions r ON regexp_replace(lower(r.doi), '\\.+$', '') = c.doi",
    "retracted_edges": "WITH k AS (SELECT DISTINCT regexp_replace(lower(trim(doi)), '\\.+$', '') AS key FROM retractions) SELECT paper_id, count(*) AS n_edges, count(DISTINCT regexp_replace(lower(trim(cited_doi)), '\\.+$', '')) AS n_works, min(seen_at) AS first_seen FROM citation_edges WHERE paper_id IS NOT NULL AND regexp_replace(lower(trim(cited_doi)), '\\.+$', '') IN (SELECT key FROM k) GROUP BY paper_id",
}



def _routed_sql(name: str) -> str:
    """The analyzer's SQL over routed texts: sections of d0, then d as the analyzer reads it."""
    limit = 2000 if name == "novelty" else 2500
    wanted = ", ".join(f"({k}, {_q(m)})" for k, m in enumerate(V.MODULE_SECTIONS[name]))
    cut = _SQL_MORE["truncated_text"].split("md5(", 1)[1].rsplit(") AS digest", 1)[0]
    sections = _SECTION_CTES.replace("d AS (SELECT doc_id, coalesce", "d0 AS (SELECT doc_id, coalesce").replace("FROM d)", "FROM d0)")
    routed = f"""{sections},
wanted(ord, name) AS (VALUES {wanted}),
parts AS (SELECT doc_id, string_agg(substr({_STRIP("substr(text, (pos + 1)::BIGINT, (coalesce(next, len(text)) - pos)::BIGINT)")}, 1, {limit}), chr(10) || chr(10) ORDER BY w.ord) AS t FROM sections s JOIN d0 USING (doc_id) JOIN wanted w USING (name) GROUP BY doc_id),
d1 AS (SELECT d0.* EXCLUDE (text, low), coalesce(substr(t, 1, 12000), {cut}) AS text FROM d0 LEFT JOIN parts USING (doc_id)),
d AS (SELECT *, lower(text) AS low FROM d1)"""
    return _SQL[name].replace(f"WITH {_D}", f"WITH RECURSIVE {routed}", 1).replace(f"WITH RECURSIVE {_D}", f"WITH RECURSIVE {routed}", 1)


def _offsets(label: str, pattern: str, columns: str) -> str:
    """Matches of a pattern with their offsets: from the lengths of what lies between them."""
    p = re2(pattern)
    return f"""{label}0 AS (SELECT doc_id, unnest(regexp_extract_all(text, {p}, 0)) AS w, unnest(list_slice(string_split_regex(text, {p}), 1, len(regexp_extract_all(text, {p}, 0)))) AS between, unnest(regexp_extract_all(text, {p}, 1)) AS g1, {"unnest(regexp_extract_all(text, " + p + ", 2)) AS g2, " if "g2" in columns else ""}generate_subscripts(regexp_extract_all(text, {p}, 0), 1) AS k FROM d),
{label} AS (SELECT doc_id, k, {columns}, sum(len(between) + len(w)) OVER (PARTITION BY doc_id ORDER BY k) - len(w) AS place FROM {label}0)"""


_GROUPS = f"""{_offsets("m", V.SPRITE_MEAN, "TRY_CAST(g1 AS DOUBLE) AS mean")}, {_offsets("s", V.SPRITE_SD, "TRY_CAST(g1 AS DOUBLE) AS sd")}, {_offsets("n", V.N_EFFECT, "TRY_CAST(g1 AS BIGINT) AS v")},
{_offsets("c", V.SPRITE_SCALE, "TRY_CAST(g1 AS BIGINT) AS lo, TRY_CAST(g2 AS BIGINT) AS hi")},
ms AS (SELECT m.doc_id, m.k, mean, sd, m.place FROM m JOIN s ON s.doc_id = m.doc_id AND s.k = m.k WHERE mean IS NOT NULL AND sd IS NOT NULL),
nn AS (SELECT ms.doc_id, ms.k, arg_min(v, abs(n.place - ms.place) * 1000000000 + n.place) AS n FROM ms JOIN n ON n.doc_id = ms.doc_id AND v IS NOT NULL GROUP BY ALL),
cc AS (SELECT ms.doc_id, ms.k, arg_min(lo, abs(c.place - ms.place) * 1000000000 + c.place) AS lo, arg_min(hi, abs(c.place - ms.place) * 1000000000 + c.place) AS hi FROM ms JOIN c ON c.doc_id = ms.doc_id AND lo IS NOT NULL AND hi IS NOT NULL GROUP BY ALL),
g AS (SELECT ms.doc_id, ms.k, mean, sd, n, coalesce(lo, 1) AS lo, coalesce(hi, 7) AS hi FROM ms JOIN nn USING (doc_id, k) LEFT JOIN cc USING (doc_id, k) WHERE n BETWEEN 2 AND 500)"""
_SQL_MORE["sprite_pairs"] = f"WITH {_D}, {_GROUPS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pair_no, mean, sd, n, lo, hi FROM g"
_SQL["sprite"] = f"""WITH RECURSIVE {_D}, {_GROUPS},
reach(n, w, s, q) AS (SELECT 1, w, v, v * v FROM (SELECT DISTINCT (hi - lo)::BIGINT AS w FROM g WHERE hi >= lo AND hi - lo <= 12 AND n <= 12), range(0, 13) r(v) WHERE v <= w UNION SELECT reach.n + 1, w, reach.s + v, q + v * v FROM reach, range(0, 13) r(v) WHERE v <= w AND reach.n < 12),
x AS (SELECT *, round_even(mean * n, 0) AS target, (round_even(mean * n, 0) - lo * n)::BIGINT AS shifted, n <= 12 AND hi - lo <= 12 AS small, CASE WHEN hi = lo THEN 0.5 ELSE (mean - lo) / (hi - lo) END AS p FROM g),
j AS (SELECT x.*, CASE WHEN small THEN hi >= lo AND abs(mean * n - target) <= 0.01::DOUBLE AND EXISTS (SELECT 1 FROM reach r WHERE r.n = x.n AND r.w = x.hi - x.lo AND r.s = x.shifted AND abs(sqrt(greatest((r.q - 2 * (x.mean - x.lo) * x.shifted + x.n * (x.mean - x.lo) * (x.mean - x.lo)) / x.n, 0.0)) - x.sd) < 0.01::DOUBLE)
  WHEN p < 0 OR p > 1 THEN NULL ELSE sd <= sqrt(greatest(p * (1 - p), 0)) * abs(hi - lo) + 0.05::DOUBLE END AS ok FROM x),
e AS (SELECT d.doc_id, count(j.k) FILTER (NOT coalesce(ok, false)) AS bad, count(j.k) FILTER (coalesce(ok, false)) AS good, count(j.k) FILTER (ok IS NULL) AS err, coalesce(string_agg(printf('%.6f/%.6f/%d/%d-%d', mean, sd, n, lo, hi), '|' ORDER BY j.k) FILTER (NOT coalesce(ok, false)), '') AS impossible,
  coalesce(string_agg(printf('%.6f/%.6f/%d/%d-%d', mean, sd, n, lo, hi), '|' ORDER BY j.k) FILTER (coalesce(ok, false)), '') AS possible, coalesce(string_agg(printf('M = %.6f, SD = %.6f, N = %d, scale %d to %d', mean, sd, n, lo, hi), ' ; ' ORDER BY j.k) FILTER (NOT coalesce(ok, false)), '') AS evidence FROM d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id),
f AS (SELECT *, CASE WHEN bad + good > 0 THEN bad::DOUBLE / (bad + good) ELSE 0 END AS raw FROM e)
SELECT doc_id, impossible, possible, err::INT AS n_errors, rtrim(repeat('sprite_impossible_distribution:high,', bad), ',') AS flags, evidence, {_r("raw", 4)} AS score, {_level("bad >= 2 OR raw >= 0.6", "bad = 1 OR raw >= 0.3", "raw > 0")} AS risk_level FROM f"""

_NAMES = {
    "statistics": "stat_audit", "methodology": "methodology_rules", "citations": "citation_integrity", "reproducibility": "reproducibility_checklist", "novelty": "novelty_score", "grim": "grim_report", "sprite": "sprite_report",
    "granularity": "granularity_digits", "pcurve": "pcurve", "effect_size": "effect_size_power", "retraction": "retraction_report", "cartel": "cartel_report", "llm": "llm_style",
}
QUERIES = {label: _query(name) for name, label in _NAMES.items()} | {f"routed_{label}": _routed_query(name) for name, label in _NAMES.items()}
QUERIES |= {f.__name__: f for f in (section_map, truncated_text, sprite_pairs, cartel_network, retraction_hits, retracted_edges, integrity_report, routed_integrity_report)}
SQL = {_NAMES[name]: sql for name, sql in _SQL.items()} | {f"routed_{_NAMES[name]}": _routed_sql(name) for name in _SQL} | _SQL_MORE


def _wide_sql(parts: dict[str, str]) -> str:
    tables = [f"(SELECT doc_id, score AS {n}_score, risk_level AS {n}_level FROM ({sql}))" for n, sql in parts.items()]
    return f"SELECT * FROM {tables[0]} " + " ".join(f"JOIN {t} USING (doc_id)" for t in tables[1:])


SQL["integrity_report"] = _wide_sql({n: _SQL[n] for n in ANALYZERS})
SQL["routed_integrity_report"] = _wide_sql({n: _routed_sql(n) for n in ANALYZERS})
