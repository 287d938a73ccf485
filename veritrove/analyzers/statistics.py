"""Analyzers of reported statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrove.functions import vocabulary as V
from veritrove.functions.scoring import flag, flag_each, flags, level, level_by_score, ratio, rounded, summary, told, weighted
from veritrove.functions.phrases import named, with_phrases
from veritrove.functions.text import found, numbers


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def stat_audit(df: DataFrame) -> DataFrame:
    """P-values and sample sizes: borderline and round p-values, small samples, missing tests."""
    raw = with_phrases(df).select("id", "phrases", found(F.col("text"), V.P_AUDIT).alias("mentions"), numbers(found(F.col("text"), V.N_AUDIT), "bigint").alias("sample_sizes_found"))
    read = raw.withColumn("p_values_found", F.filter(numbers(F.col("mentions")), lambda v: (v > 0) & (v <= 1)))
    p, n = F.col("p_values_found"), F.col("sample_sizes_found")
    near = read.withColumns({"borderline": F.filter(p, lambda v: (v >= 0.04) & (v <= 0.051)), "small": F.filter(n, lambda v: (v > 0) & (v < 30)), "round_p": F.filter(p, lambda v: v.isin(0.05, 0.049, 0.001, 0.01))})
    share, count = ratio(F.size("borderline"), F.size(p)), F.size("borderline")
    hacking = (share >= 0.6) & (count >= 3)
    raised = flags(
        flag(hacking, "p_hacking_suspected", "high", F.to_json("borderline")),
        flag(~hacking & (share >= 0.4) & (count >= 2), "borderline_p_values", "medium", F.to_json("borderline")),
        flag(F.size("small") > 0, "small_sample_size", F.when(F.array_min("small") < 15, "high").otherwise("medium"), F.to_json("small")),
        flag(F.size("round_p") > 0, "suspiciously_round_p_values", "medium", F.to_json("round_p")),
        flag((F.size(n) > 0) & named(V.RESULT_WORDS) & (F.size("mentions") == 0), "missing_statistical_tests", "high"),
    )
    scored = near.withColumn("flags", raised).withColumn("raw", weighted(F.col("flags"))).withColumn("risk_level", level_by_score(F.col("raw")))
    return scored.select("id", "p_values_found", "sample_sizes_found", "flags", rounded(F.col("raw"), 3).alias("score"), "risk_level", summary("P-value audit", F.col("flags"), F.col("risk_level")).alias("summary"))


def pcurve(df: DataFrame) -> DataFrame:
    """Distribution of significant p-values; needs three of them."""
    read = df.select("id", F.transform(F.filter(numbers(found(F.col("text"), V.P_CURVE)), lambda v: (v > 0) & (v <= 1)), lambda v: rounded(v, 4)).alias("p_values_found"))
    read = read.withColumn("significant_p", F.filter("p_values_found", lambda v: v <= 0.05))
    s = F.col("significant_p")
    enough = F.size(s) >= 3
    rated = read.withColumns({"skew": F.when(enough, ratio(_count(s, lambda v: v <= 0.025), F.size(s))).otherwise(F.lit(0.0)), "cluster": F.when(enough, ratio(_count(s, lambda v: v >= 0.04), F.size(s))).otherwise(F.lit(0.0))})
    c, k = F.col("cluster"), F.col("skew")
    raised = flags(
        flag(enough & (c > 0.5), "p_value_clustering", F.when(c > 0.7, "high").otherwise("medium"), told(c)),
        flag(enough & (k < 0.3) & (F.size(s) >= 4), "flat_pcurve", "medium", told(k)),
        flag(enough & (_count(F.col("p_values_found"), lambda v: F.abs(v - 0.05) < 0.001) >= 2), "exact_threshold_reporting", "medium"),
    )
    scored = rated.withColumns({"flags": raised, "score": F.when(enough, F.least(rounded(c * 0.6 + (1.0 - k) * 0.4, 4), F.lit(1.0))).otherwise(F.lit(0.0))})
    sc = F.col("score")
    scored = scored.withColumn("risk_level", F.when(enough, level((c > 0.7) | (sc >= 0.7), (c > 0.5) | (sc >= 0.5), (c > 0.3) | (sc >= 0.3))).otherwise("low"))
    return scored.select("id", "p_values_found", "significant_p", rounded(k, 4).alias("right_skew_ratio"), rounded(c, 4).alias("clustering_score"), "flags", "score", "risk_level", summary("P-curve", F.col("flags"), F.col("risk_level")).alias("summary"))


def grim(df: DataFrame, precision_aware: bool = False) -> DataFrame:
    """Means that so many whole numbers can't have.

    A pair is read greedily within a line; the product of mean and number must be whole within .001.
    ``precision_aware`` also lets means pass that are right to the digits reported.
    """
    # The text is searched once; the groups are read from the short matches.
    matched = df.select("id", found(F.col("text"), V.GRIM_PAIR, 0).alias("matched"))
    group = lambda m, g: F.regexp_extract(m, V.java(V.GRIM_PAIR), g).alias(f"g{g}")
    zipped = matched.select("id", F.transform("matched", lambda m: F.struct(*(group(m, g) for g in (1, 2, 3, 4)))).alias("zipped"))
    first = lambda z: (z["g1"] != "") & (z["g2"] != "")
    pair = F.transform(
        F.col("zipped"),
        lambda z: F.struct(F.when(first(z), z["g1"]).otherwise(z["g4"]).try_cast("double").alias("mean"), F.when(first(z), z["g2"]).otherwise(z["g3"]).try_cast("bigint").alias("n"), F.length(_fraction(F.when(first(z), z["g1"]).otherwise(z["g4"]))).alias("digits"), F.length(F.regexp_extract(F.when(first(z), z["g1"]).otherwise(z["g4"]), r"\.(\d+)$", 1)).alias("written")),
    )
    read = zipped.select("id", F.filter(pair, lambda x: (x["n"] >= 2) & (x["n"] <= 10000)).alias("pairs"))

    def whole(x: Column) -> Column:
        product = x["mean"] * x["n"]
        exact = F.abs(product - F.rint(product)) < 0.001
        if not precision_aware:
            return exact
        return exact | (F.abs(F.rint(product) / x["n"] - x["mean"]) <= F.pow(F.lit(10.0), -x["written"]) * 0.5 + 1e-9)

    split = read.select("id", F.filter("pairs", lambda x: ~whole(x)).alias("bad"), F.filter("pairs", whole).alias("good"))
    shape = lambda c: F.transform(c, lambda x: F.struct(x["mean"].alias("mean"), x["n"].alias("n")))
    # The means next to an impossible one that so many numbers can have, to the digits reported.
    product = lambda x: x["mean"] * x["n"]
    near = F.transform("bad", lambda x: F.struct(x["mean"].alias("mean"), x["n"].alias("n"), rounded(F.floor(product(x)) / x["n"], x["digits"]).alias("lower"), rounded(F.ceil(product(x)) / x["n"], x["digits"]).alias("upper")))
    rated = split.select("id", shape("bad").alias("impossible_means"), shape("good").alias("possible_means"), near.alias("nearest"))
    count = F.size("impossible_means")
    shown = lambda x: F.format_string("M = %.6f, N = %d, nearest %.6f or %.6f", x["mean"], x["n"], x["lower"], x["upper"])
    rated = rated.withColumns({"raw": ratio(count, count + F.size("possible_means")), "flags": flag_each(F.col("nearest"), "grim_impossible_mean", "high", shown)})
    rated = rated.withColumn("risk_level", level((count >= 3) | (F.col("raw") >= 0.6), (count == 2) | (F.col("raw") >= 0.4), (count == 1) | (F.col("raw") >= 0.2)))
    return rated.select("id", "impossible_means", "possible_means", F.col("nearest").alias("nearest_valid"), "flags", rounded(F.col("raw"), 4).alias("score"), "risk_level", summary("GRIM", F.col("flags"), F.col("risk_level")).alias("summary"))


SPRITE_GROUP = "struct<mean:double,sd:double,n:bigint,lo:bigint,hi:bigint,ok:boolean>"


def sprite_groups(df: DataFrame) -> DataFrame:
    """``id`` and ``groups``: means with their deviation, the nearest sample size and scale, and whether a sample can have them.

    The search for a sample is no column expression: texts that report a deviation at all go through Python in
    Arrow batches, the others never leave the JVM's side of the expression.
    """

    def read(texts: pa.Array) -> pa.Array:
        from veritrove.functions.samples import groups

        return pa.array([groups(t) for t in texts.to_pylist()], kind)

    fields = [("mean", pa.float64()), ("sd", pa.float64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("ok", pa.bool_())]
    kind = pa.list_(pa.struct(fields))
    reported = F.when(F.col("text").rlike(V.java(V.SPRITE_SD)), F.col("text"))
    return df.select("id", F.arrow_udf(read, f"array<{SPRITE_GROUP}>")(reported).alias("groups"))


def sprite(df: DataFrame) -> DataFrame:
    """Means and deviations that no sample of that size and scale can have.

    A mean off its scale in a sample above twelve can't be judged; it counts as impossible and is named
    in ``errors``.  Samples of up to twelve are searched on scales of any width.
    """
    judged = sprite_groups(df).select("id", F.col("groups").alias("judged"))
    shape = lambda c: F.transform(c, lambda g: F.struct(*(g[k].alias(k) for k in ("mean", "sd", "n", "lo", "hi"))))
    rated = judged.select(
        "id", shape(F.filter("judged", lambda g: ~F.coalesce(g["ok"], F.lit(False)))).alias("impossible_combinations"), shape(F.filter("judged", lambda g: F.coalesce(g["ok"], F.lit(False)))).alias("possible_combinations"),
        shape(F.filter("judged", lambda g: g["ok"].isNull())).alias("errors"),
    )
    count = F.size("impossible_combinations")
    rated = rated.withColumns({"raw": ratio(count, count + F.size("possible_combinations")), "flags": flag_each(F.col("impossible_combinations"), "sprite_impossible_distribution", "high", lambda g: F.format_string("M = %.6f, SD = %.6f, N = %d, scale %d to %d", g["mean"], g["sd"], g["n"], g["lo"], g["hi"]))})
    rated = rated.withColumn("risk_level", level((count >= 2) | (F.col("raw") >= 0.6), (count == 1) | (F.col("raw") >= 0.3), F.col("raw") > 0))
    return rated.select("id", "impossible_combinations", "possible_combinations", "errors", "flags", rounded(F.col("raw"), 4).alias("score"), "risk_level", summary("SPRITE", F.col("flags"), F.col("risk_level")).alias("summary"))


def _fraction(text: Column) -> Column:
    """Digits behind the point as a float is written: without trailing zeros, but at least one."""
    tail = F.rtrim(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit("0"))
    return F.when(tail == "", "0").otherwise(tail)


def _whole(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"^(\d+)", 1), "^0+(?=.)", "")


def granularity(df: DataFrame) -> DataFrame:
    """Digits of the numbers in a text: last digits, first digits, round numbers, precision."""
    read = df.select("id", found(F.col("text"), V.DECIMAL, 0, False).alias("d"), F.filter(found(F.col("text"), V.INTEGER, 0, False), lambda s: s.try_cast("bigint").between(10, 99999)).alias("i"))
    nonzero = lambda s: F.regexp_extract(F.concat(_whole(s), _fraction(s)), "^0*([1-9])", 1)
    read = read.select(
        "id",
        F.transform("d", lambda s: F.struct(F.right(_fraction(s), F.lit(1)).alias("last"), F.length(_fraction(s)).alias("digits"), s.cast("double").alias("v"))).alias("d"),
        # numbers of at least 1 begin with their first digit that isn't 0
        F.concat(F.transform(F.filter("d", lambda s: s.cast("double") >= 1), nonzero), F.transform(F.filter("i", lambda s: s.try_cast("bigint") >= 1), lambda s: F.left(F.regexp_replace(s, "^0+", ""), F.lit(1)))).alias("heads"),
    )
    d, heads = F.col("d"), F.col("heads")
    share = F.when(F.size(d) >= 5, ratio(_count(d, lambda x: x["last"].isin("0", "5")), F.size(d))).otherwise(F.lit(0.0))
    chi = F.lit(0.0)
    for digit, expected in V.BENFORD.items():
        observed = ratio(_count(heads, F.lit(str(digit)).__eq__), F.size(heads))
        chi = chi + (observed - expected) * (observed - expected) / expected
    rated = read.withColumns({
        "share": share,
        "benford": F.when(F.size(heads) >= 10, F.least(chi / 15.0, F.lit(1.0))).otherwise(F.lit(0.0)),
        "rounds": F.when(F.size(d) >= 5, ratio(_count(d, lambda x: F.abs(x["v"] - F.rint(x["v"])) < 0.001), F.size(d))).otherwise(F.lit(0.0)),
        "even": (F.size(d) >= 6) & (F.size(F.array_distinct(F.transform("d", lambda x: x["digits"]))) == 1),
    })
    rated = rated.withColumn("preference", F.when(F.col("share") > 0.2, F.least((F.col("share") - 0.2) / 0.4, F.lit(1.0))).otherwise(F.lit(0.0)))
    raised = flags(
        flag(F.col("share") > 0.45, "digit_preference_detected", F.when(F.col("share") > 0.6, "high").otherwise("medium"), told(F.col("share"))),
        flag(F.col("benford") > 0.4, "benford_law_violation", F.when(F.col("benford") > 0.7, "high").otherwise("medium"), told(F.col("benford"))),
        flag(F.col("rounds") > 0.6, "excessive_round_numbers", "medium", told(F.col("rounds"))),
        flag(F.col("even"), "uniform_decimal_precision", "medium"),
    )
    rated = rated.withColumns({"flags": raised, "score": rounded((F.col("preference") + F.col("benford") + F.col("rounds")) / 3.0, 4)})
    n, sc = F.size("flags"), F.col("score")
    rated = rated.withColumn("risk_level", level((n >= 3) | (sc >= 0.6), (n == 2) | (sc >= 0.4), (n == 1) | (sc >= 0.2)))
    return rated.select("id", rounded(F.col("preference"), 4).alias("digit_preference_score"), rounded(F.col("benford"), 4).alias("benford_score"), rounded(F.col("rounds"), 4).alias("round_number_ratio"), "flags", "score", "risk_level", summary("Digits", F.col("flags"), F.col("risk_level")).alias("summary"))


def normal_cdf(x: Column) -> Column:
    """Normal distribution by the error function's approximation of Abramowitz and Stegun, 7.1.26."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    erf = 1.0 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


def power(d: Column, n: Column) -> Column:
    """Power of a two-sample test by the normal approximation, from 0 to 1."""
    return F.least(F.greatest(1.0 - normal_cdf(1.96 - F.abs(d) * F.sqrt(n / 2.0)), F.lit(0.0)), F.lit(1.0))


def effect_size(df: DataFrame) -> DataFrame:
    """Effect sizes, and the power they leave with the smallest sample reported."""
    text = F.col("text")

    def family(kind: str, pattern: str, test=None) -> Column:
        values = numbers(found(text, pattern))
        return F.transform(F.filter(values, test) if test else values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    read = df.select(
        "id",
        F.concat(family("cohens_d", V.COHEN_D), family("pearson_r", V.PEARSON_R, lambda v: v.between(-1.5, 1.5)), family("eta_squared", V.ETA_SQUARED), family("omega_squared", V.OMEGA_SQUARED), family("odds_ratio", V.ODDS_RATIO, lambda v: v.between(0.1, 50))).alias("effects"),
        F.array_min(F.filter(numbers(found(text, V.N_EFFECT), "bigint"), lambda v: v.between(2, 100000))).alias("n"),
    )
    # Every effect with its power, where it has one; flags follow the effects in their order.
    own = lambda e: F.when((e["type"] == "cohens_d") & F.col("n").isNotNull(), power(e["value"], F.col("n")))
    read = read.withColumn("measured", F.transform("effects", lambda e: F.struct(e["type"].alias("effect_type"), e["value"].alias("effect_value"), F.col("n").alias("n"), own(e).alias("power"))))
    big = lambda e: (F.abs(e["effect_value"]) > 2.0) & (e["n"] < 30)
    weak = lambda e: ~big(e) & (e["power"] < 0.8) & (e["n"] < 50)
    powered = F.filter("measured", lambda e: e["power"].isNotNull())
    rated = read.withColumns({
        "power_estimates": F.transform(powered, lambda e: e.withField("power", rounded(e["power"], 3))),
        "inflated_effects": F.filter(powered, big),
        "underpowered": F.filter(powered, weak),
    })
    has = lambda e: e["power"].isNotNull()
    plain = lambda e: F.format_string("%s = %.4f", e["effect_type"], e["effect_value"])
    sized = lambda e: F.format_string("%s = %.4f, N = %d, power %.3f", e["effect_type"], e["effect_value"], e["n"], rounded(e["power"], 3))
    each = lambda e: F.coalesce(
        flag(has(e) & big(e), "inflated_effect_size", "high", sized(e)),
        flag(has(e) & weak(e), "underpowered_study", "medium", sized(e)),
        flag((e["effect_type"] == "pearson_r") & (F.abs(e["effect_value"]) > 1.0), "impossible_correlation", "high", plain(e)),
        flag((e["effect_type"] == "eta_squared") & (e["effect_value"] > 0.5), "large_eta_squared", "medium", plain(e)),
    )
    raised = F.concat(F.array_compact(F.transform("measured", each)), flags(flag(F.size("effects") == 0, "missing_effect_sizes", "medium")))
    i, u = F.size("inflated_effects"), F.size("underpowered")
    raw = F.when(F.size("effects") == 0, F.lit(0.3)).otherwise(0.5 * F.least(i, F.lit(2)) / 2.0 + 0.3 * F.least(u, F.lit(2)) / 2.0)
    rated = rated.withColumns({"flags": raised, "raw": raw})
    rated = rated.withColumn("risk_level", level((i >= 1) | (F.col("raw") >= 0.6), (u >= 2) | (F.col("raw") >= 0.4), (u >= 1) | (F.col("raw") >= 0.2)))
    return rated.select("id", F.col("effects").alias("effect_sizes_found"), "power_estimates", "inflated_effects", "underpowered", "flags", rounded(F.col("raw"), 4).alias("score"), "risk_level", summary("Effect sizes", F.col("flags"), F.col("risk_level")).alias("summary"))
