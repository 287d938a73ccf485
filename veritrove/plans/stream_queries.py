"""Queries that run as streams over what is there, with the oracles of their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.plans import integrity_queries
from veritrove.streaming.papers import reports, run_to_table, run_updates, table_stream


def stream_stat_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The p-value audit of documents read as a stream."""
    report = reports(table_stream(spark, folder, "documents"), "statistics", abstract="abstract", author_name="author_name", title="title")
    flat = integrity_queries.flat("statistics", report)
    return run_to_table(flat, "stream")


def stream_edges_by_week(spark: SparkSession, folder: str) -> DataFrame:
    """Citation edges by window of seven days, counted by a stream with a watermark; open windows are given as they stand."""
    edges = table_stream(spark, folder, "citation_edges").select(F.col("seen_at").cast("timestamp").alias("at"), "cited_doi").where("at is not null")
    counts = edges.withWatermark("at", "30 days").groupBy(F.window("at", "7 days")).agg(F.count("*").alias("n_edges"), F.count("cited_doi").alias("n_dois"))
    return run_updates(counts.select(F.col("window.start").cast("string").alias("week"), "n_edges", "n_dois"), "week", "windows")


QUERIES = {"stream_stat_audit": stream_stat_audit, "stream_edges_by_week": stream_edges_by_week}
_WEEK = 7 * 24 * 3600 * 1_000_000
SQL = {
    "stream_stat_audit": integrity_queries.SQL["stat_audit"],
    "stream_edges_by_week": f"SELECT strftime(make_timestamp((epoch_us(seen_at) // {_WEEK}) * {_WEEK}), '%Y-%m-%d %H:%M:%S') AS week, count(*) AS n_edges, count(cited_doi) AS n_dois FROM citation_edges WHERE seen_at IS NOT NULL GROUP BY 1",
}
