"""A sample whose shares match target proportions (problem 1).

Systematic unequal-probability sampling.  Units (distinct papers of a stratum) are put in order of
(stratum, random number); a unit's inclusion probability in a plan is the target of its stratum over
the stratum's size, at most 1.  Prefix sums of the probabilities run over the whole order, across
partitions, and a unit is drawn where the sum passes a further whole number, counted from one random
start of the plan.  Floors are repaired afterwards: a stratum with fewer than its minimum gets the
next units of the same random order.

The order is held as ranks: rows are spread over ``(stratum, slice of the random number)``, so that a
stratum with most of all rows is cut into many slices; within a slice ranks are local, and a table of
slice sizes (strata times slices rows) gives the offset.  With equal probabilities inside a stratum
the prefix sum of a unit is the offset of its stratum plus its rank times the probability.

Defined results: a stratum value is compared without regard to letter case, outer blanks and the
choice of blank, hyphen or underscore; null and empty values and null paper ids belong to no stratum.
A paper counts once in a stratum however often it was delivered, and in several strata where its
rows disagree.  A stratum without papers is short of all it needs, unless it needs none.  Plans
whose strata overlap or whose percentages don't add up to 100 are drawn as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrove.sources.scratch import Scratch

#: Rows of the input for each slice of a stratum.  The table of slice sizes has a row a stratum and slice.
ROWS_A_SLICE = 50_000


def stratum_form(value: Column) -> Column:
    """The form in which stratum values are compared."""
    text = F.regexp_replace(F.lower(value.cast("string")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(text, r"(?U)[\s_\-\x{2010}-\x{2015}]+", "_")


def _drawn(*parts: Column) -> Column:
    """A number below 2^60 from the digest of some values; any engine with MD5 gives the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def units(papers: DataFrame, fields: list[str], slices: int, id_col: str = "paper_id", seed: int = 17) -> DataFrame:
    """Distinct (``field``, ``stratum``, ``unit``) of ``papers``, with ``slice`` and ``rand``.

    A slice is a stretch of the random numbers, so their order does not depend on how many slices there are.
    Spread by stratum and slice before rows are made distinct, so that the ranks within a slice need no further shuffle.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), stratum_form(F.col(f)).alias("stratum")) for f in fields]).cast("array<struct<field:string,stratum:string>>"))
    rows = papers.select(F.col(id_col).alias("unit"), pairs.alias("s")).select("s.field", "s.stratum", "unit")
    rows = rows.where("unit is not null and stratum is not null and stratum <> ''")
    rows = rows.withColumn("rand", _drawn(F.col("unit"), F.lit(str(seed))))
    rows = rows.withColumn("slice", F.least(F.floor(F.col("rand") / float(2**60) * slices), F.lit(slices - 1)).cast("int"))
    return rows.repartition("field", "stratum", "slice").distinct()


def draw(papers: DataFrame, plans: DataFrame, id_col: str = "paper_id", seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The sample and its report.

    The sample has ``plan_id``, ``stratum_value``, ``unit``.  The report has a row for each row of
    ``plans``: ``plan_id``, ``stratum_field``, ``stratum_value``, ``available``, ``needed``,
    ``drawn``, ``repaired`` (drawn by the repair of floors) and ``short``.
    """
    spark = papers.sparkSession
    # Plans are a fixed small table; what is made of them below has as many rows.
    listed = plans.select("plan_id", "sample_n", "stratum_field", "stratum_value", "target_pct", "min_keep", stratum_form(F.col("stratum_value")).alias("stratum"))
    fields = sorted(r[0] for r in plans.select("stratum_field").distinct().collect() if r[0] in papers.columns)
    place = ["field", "stratum", "slice"]
    slices = max(16, -(-papers.count() // ROWS_A_SLICE))
    placed = units(papers, fields, slices, id_col, seed)
    # A row a stratum and slice; strata outside every plan are left out first.
    wanted = listed.select(F.col("stratum_field").alias("field"), "stratum").distinct()
    counted = placed.groupBy(*place).agg(F.count("*").alias("n")).join(F.broadcast(wanted), ["field", "stratum"]).collect()
    total: dict[tuple, int] = {}
    offset = []
    for r in sorted(counted, key=lambda r: (r.field, r.stratum, r.slice)):
        offset.append((r.field, r.stratum, r.slice, total.get((r.field, r.stratum), 0)))
        total[r.field, r.stratum] = offset[-1][3] + r.n
    design, summed = [], {}
    for p in sorted(listed.collect(), key=lambda p: (p.plan_id, p.stratum_field, p.stratum or "")):
        have = total.get((p.stratum_field, p.stratum), 0)
        share = (p.sample_n * p.target_pct + 50) // 100
        quota = min(share, have)
        summed[p.plan_id] = summed.get(p.plan_id, 0) + quota
        design.append((p.plan_id, p.stratum_field, p.stratum, p.stratum_value, have, max(p.min_keep, share), min(p.min_keep, have), summed[p.plan_id] - quota, quota))
    design_df = spark.createDataFrame(design, "plan_id int, field string, stratum string, stratum_value string, available bigint, needed bigint, floor bigint, begin bigint, quota bigint")
    start = _drawn(F.col("plan_id").cast("string"), F.lit(f"start {seed}")) / float(2**60)
    local = F.row_number().over(Window.partitionBy(*place).orderBy("rand", "unit"))
    offsets = spark.createDataFrame(offset, "field string, stratum string, slice int, before bigint")
    ranked = placed.join(F.broadcast(offsets), place).withColumn("rank", F.col("before") + local)
    # The plans of a stratum as an array: a unit is multiplied only by the plans that draw it.
    by_stratum = design_df.where("available > 0").groupBy("field", "stratum").agg(F.collect_list(F.struct("plan_id", "stratum_value", "begin", "quota", "available", F.floor(start * F.col("available")).alias("start"), "floor")).alias("plans"))
    # Probabilities are quota/available; sums are kept as whole multiples of 1/available.
    def passed(p: Column, rank: Column) -> Column:
        scaled = p["quota"] * rank + p["start"]
        return p["begin"] + F.floor((scaled - F.pmod(scaled, p["available"])) / p["available"])

    def crossing(p: Column) -> Column:
        return passed(p, F.col("rank")) > passed(p, F.col("rank") - 1)

    # Units up to the floor are carried along: if the crossings leave a stratum short, they repair it.
    kept = F.filter("plans", lambda p: crossing(p) | (F.col("rank") <= p["floor"]))
    near = ranked.join(F.broadcast(by_stratum), ["field", "stratum"]).select("unit", "rank", F.explode(kept).alias("p"))
    near = near.select(F.col("p.plan_id").alias("plan_id"), F.col("p.stratum_value").alias("stratum_value"), "unit", "rank", crossing(F.col("p")).alias("crossed"))
    # What is drawn or may repair, at most the sample and the floors: written, so that units are ranked once.
    near, _ = Scratch(spark, "sample").keep(near)
    first = near.groupBy("plan_id", "stratum_value").agg(F.sum(F.col("crossed").cast("bigint")).alias("crossed"))
    need = design_df.join(F.broadcast(first), ["plan_id", "stratum_value"], "left").select("plan_id", "stratum_value", F.greatest(F.lit(0), F.col("floor") - F.coalesce("crossed", F.lit(0))).alias("missing"))
    # Candidates for repair are at most ``floor`` rows a stratum and plan.
    spare = near.where("not crossed").withColumn("turn", F.row_number().over(Window.partitionBy("plan_id", "stratum_value").orderBy("rank")))
    repair = spare.join(F.broadcast(need), ["plan_id", "stratum_value"]).where("turn <= missing")
    sample = near.where("crossed").select("plan_id", "stratum_value", "unit", F.lit(False).alias("repaired")).unionByName(repair.select("plan_id", "stratum_value", "unit", F.lit(True).alias("repaired")))
    drawn = sample.groupBy("plan_id", "stratum_value").agg(F.count("*").alias("drawn"), F.sum(F.col("repaired").cast("bigint")).alias("repaired"))
    report = design_df.join(F.broadcast(drawn), ["plan_id", "stratum_value"], "left").select(
        "plan_id", F.col("field").alias("stratum_field"), "stratum_value", "available", "needed", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("repaired", F.lit(0)).alias("repaired"), (F.coalesce("drawn", F.lit(0)) < F.col("needed")).alias("short")
    )
    return sample.select("plan_id", "stratum_value", "unit"), report
