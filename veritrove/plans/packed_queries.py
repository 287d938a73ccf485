"""Queries of the packed-field operator (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.operators.packed import unpack
from veritrove.sources.tables import table

_FIELDS = {"authors": "names", "fraud_types": "codes"}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of a field of paper_records that holds two or more."""
    values = unpack(table(spark, folder, "paper_records"), "record_id", _FIELDS)
    return values.where("n_values >= 2").select("record_id", "field_name", "pos", "item_value")


def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Fields, values and flagged values of paper_records by field."""
    values = unpack(table(spark, folder, "paper_records"), "record_id", _FIELDS)
    return values.groupBy("field_name", F.coalesce("flag", F.lit("")).alias("flag")).agg(F.count("*").alias("n_values"), F.sum((F.col("pos") == 1).cast("bigint")).alias("n_first"))


QUERIES = {"p3_found": p3_found, "p3_flags": p3_flags}
SQL: dict[str, str] = {}
