"""Papers from text files, JSON requests and page texts; reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions.text import strip

#: Shortest text that a request may have.
SHORTEST = 50
REQUEST = "paper_id bigint, text string, abstract string, author_name string, title string"


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected requests of JSON lines: a text needs at least 50 characters."""
    rows = spark.read.schema(REQUEST).json(path)
    valid = F.coalesce(F.length("text") >= SHORTEST, F.lit(False))
    return rows.where(valid), rows.where(~valid)


def page_texts(pages: DataFrame) -> DataFrame:
    """``paper_id`` and ``full_text`` from ``paper_id``, ``page_number``, ``text``: pages in order, a line feed between."""
    ordered = pages.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return ordered.select("paper_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("full_text"))


def title_of(full_text: str = "full_text", meta: str | None = None):
    """Title: of the metadata, else the first line of more than ten characters, else a stock phrase."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(full_text), F.lit("")), "\n"), strip), lambda x: F.length(x) > 10)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("Unknown Title"))
    return F.when(F.coalesce(F.col(meta), F.lit("")) != "", strip(F.col(meta))).otherwise(first) if meta else first


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary files with ``filename`` and ``file_size_kb``; only the metadata is read unless ``content`` is used."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), (F.floor(F.col("length") / 1024 * 100 + 0.5) / 100).alias("file_size_kb"), "content")


def write_reports(report: DataFrame, path: str) -> None:
    """A report, nested as it is, as JSON lines."""
    report.write.mode("overwrite").json(path)
