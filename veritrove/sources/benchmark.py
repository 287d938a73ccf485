"""The benchmark table of labelled papers as CSV, and its fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fourteen dimension scores, in file order.
SCORES = (
    "stat_audit_score", "figure_forensics_score", "methodology_score", "citation_score", "reproducibility_score", "novelty_score", "grim_score", "sprite_score", "granularity_score", "pcurve_score", "effect_size_score",
    "retraction_score", "cartel_score", "llm_score",
)
_TYPES = {"year": T.IntegerType(), "is_fraud": T.IntegerType(), "fraud_confidence": T.DoubleType(), "overall_risk_score": T.DoubleType()} | {s: T.DoubleType() for s in SCORES}
#: Columns in file order.
COLUMNS = (
    "paper_id", "doi", "title", "authors", "year", "journal", "source_db", "category", "is_fraud", "fraud_confidence", "fraud_types", "retraction_date", "retraction_reason", "pubpeer_url", *SCORES,
    "overall_risk_score", "abstract_text", "full_text_path", "field_of_study", "labeling_method", "labeled_by", "notes",
)
SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in COLUMNS])

# Categories with their target counts.
CATEGORIES = (("CONFIRMED_FRAUD", 300), ("SUSPECTED_FRAUD", 200), ("BORDERLINE", 150), ("CLEAN", 250), ("BASELINE_ELITE", 100))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records of a CSV file or folder; empty numbers are null."""
    return spark.read.csv(path, header=True, schema=SCHEMA, quote='"', escape='"', multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as benchmark CSV, columns in file order."""
    df.select(*(F.col(c).cast(SCHEMA[c].dataType) for c in COLUMNS)).write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="overwrite")


def categories(spark: SparkSession) -> DataFrame:
    """``category`` and its ``target`` count."""
    return spark.createDataFrame(list(CATEGORIES), "category string, target int")


def status(spark: SparkSession) -> DataFrame:
    """The analyzers that are ready: ``name``, ``kind``."""
    from veritrove.analyzers import ANALYZERS

    return spark.createDataFrame([(n, "text") for n in ANALYZERS] + [("figures", "pixels")], "name string, kind string")
