"""Queries over sources and sinks, and analyzers with tables supplied, with SQL oracles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.analyzers import papers
from veritrove.analyzers.language import novelty
from veritrove.analyzers.relational import retraction
from veritrove.functions import vocabulary as V
from veritrove.functions.routing import parser_sections
from veritrove.plans import integrity_queries as I
from veritrove.sources import pdf
from veritrove.sources.benchmark import read_csv, write_csv
from veritrove.sources.papers import page_texts, read_requests
from veritrove.sources.scratch import Scratch
from veritrove.sources.tables import table


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    return papers(table(spark, folder, "documents"), abstract="abstract", author_name="author_name", title="title")


def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of every document as the document parser cuts them."""
    cut = _papers(spark, folder).select("id", F.explode_outer(parser_sections(F.col("text"))).alias("name", "body")).where("name is not null")
    return cut.select(F.col("id").alias("doc_id"), "name", F.md5("body").alias("digest"))


def json_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Documents sent as JSON lines: which requests are valid, and what came through."""
    path = f"{Scratch(spark, 'requests').root}/sent"
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "text", "abstract", "author_name", "title")
    docs.write.json(path)
    valid, rejected = read_requests(spark, path)
    both = valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))
    return both.select(F.col("paper_id").alias("doc_id"), "valid", F.md5("text").alias("digest"))


def joined_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Full texts put together from pages; the parts between blank lines stand for pages."""
    parts = table(spark, folder, "parsed_papers").where("full_text is not null").select("parsed_id", F.posexplode(F.split("full_text", "\n\n", -1)).alias("page_number", "text"))
    return page_texts(parts.withColumnRenamed("parsed_id", "paper_id")).select(F.col("paper_id").alias("parsed_id"), F.md5("full_text").alias("digest"))


def benchmark_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark records written as CSV and read again: empty and null are one there."""
    path = f"{Scratch(spark, 'csv').root}/records"
    write_csv(table(spark, folder, "paper_records"), path)
    words = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("doi", "title", "authors", "journal", "source_db", "category", "fraud_types", "retraction_date", "notes")])
    return read_csv(spark, path).select("paper_id", "year", "is_fraud", "overall_risk_score", F.md5(words).alias("digest"))


def retraction_live(spark: SparkSession, folder: str) -> DataFrame:
    """The retraction analyzer with the table of retractions."""
    report = retraction(_papers(spark, folder), table(spark, folder, "retractions"))
    return I.flat("retraction", report)


def novelty_literature(spark: SparkSession, folder: str) -> DataFrame:
    """The novelty analyzer with the catalogued works of each document's paper as literature."""
    docs = table(spark, folder, "documents").where("paper_id is not null").select(F.col("doc_id").alias("id"), "paper_id")
    works = table(spark, folder, "paper_records").where("title is not null").select("paper_id", F.col("title").alias("related_title"), F.coalesce("year", F.lit(0)).alias("related_year"), F.array(F.coalesce("authors", F.lit(""))).alias("related_authors"))
    report = novelty(_papers(spark, folder), docs.join(works, "paper_id").drop("paper_id").distinct())
    signals = F.array_join(F.transform("related_works_found", lambda w: w["similarity_signal"]), "|")
    return report.select(F.col("id").alias("doc_id"), "novelty_score", "novelty_level", signals.alias("signals"), "literature_accessible", "risk_level")


def pdf_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed papers written as PDF files, with as many pictures as they have figures, and read again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, titles, counts = (batch.column(k).to_pylist() for k in range(4))
            made = [pdf.encode(t.split("\n\n"), n or "", [(50, 50, bytes([k % 256]) * 7500) for k in range(c or 0)]) for t, n, c in zip(texts, titles, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["parsed_id", "content"])

    source = table(spark, folder, "parsed_papers").where("full_text is not null").select("parsed_id", "full_text", "title", "figure_count")
    read = pdf.documents(source.mapInArrow(write, "parsed_id bigint, content binary"), "parsed_id")
    return read.select("parsed_id", "page_count", "figure_count", "title", F.md5("full_text").alias("digest"), "error")


QUERIES = {f.__name__: f for f in (document_sections, json_requests, joined_pages, benchmark_csv, retraction_live, novelty_literature, pdf_scan)}


def _sections_sql() -> str:
    parts = []
    for k, marker in enumerate(V.PARSER_MARKERS):
        later = [f"nullif(instr(substr(low, (place + 1)::BIGINT), '{m}'), 0) + place" for m in V.PARSER_MARKERS[k + 1 :]]
        end = f"coalesce({', '.join([*later, 'len(text) + 1'])})"
        body = I._STRIP(f"substr(text, place::BIGINT, ({end} - place)::BIGINT)")
        parts.append(f"SELECT doc_id, '{marker}' AS name, md5({body}) AS digest FROM (SELECT *, instr(low, '{marker}') AS place FROM d) WHERE place > 0")
    return f"WITH {I._D} " + " UNION ALL ".join(parts)


_TEXTS = ", ".join(f"coalesce({c}, '')" for c in ("doi", "title", "authors", "journal", "source_db", "category", "fraud_types", "retraction_date", "notes"))
_SCORE = "least(" + I._r("0.6::DOUBLE * least(k, 3) / 3.0 + 0.2::DOUBLE * least(s, 5) / 5.0", 4) + ", 1.0)"
SQL = {
    "document_sections": _sections_sql(),
    "json_requests": "SELECT doc_id, coalesce(len(text) >= 50, false) AS valid, md5(text) AS digest FROM documents",
    "joined_pages": "SELECT parsed_id, md5(replace(full_text, chr(10) || chr(10), chr(10))) AS digest FROM parsed_papers WHERE full_text IS NOT NULL",
    "pdf_scan": "SELECT parsed_id, len(string_split(full_text, chr(10) || chr(10)))::INT AS page_count, coalesce(figure_count, 0)::INT AS figure_count, coalesce(title, '') AS title, md5(replace(full_text, chr(10) || chr(10), chr(10))) AS digest, NULL::VARCHAR AS error FROM parsed_papers WHERE full_text IS NOT NULL",
    "benchmark_csv": f"SELECT nullif(paper_id, '') AS paper_id, year, is_fraud, overall_risk_score, md5(concat_ws('|', {_TEXTS})) AS digest FROM paper_records",
    "retraction_live": f"""WITH {I._D}, x AS {I._DISTINCT_DOIS}, y AS (SELECT *, {I._BARE} AS bare, {I._BARE} IN ({I._KNOWN}) AS listed FROM x),
z AS (SELECT *, NOT listed AND row_number() OVER (PARTITION BY doc_id, listed ORDER BY pos) <= 5 AND bare IN (SELECT rtrim(lower(doi), '.') FROM retractions) AS live FROM y),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (listed) AS kl, count(*) FILTER (live) AS kv, string_agg(doi, ' ' ORDER BY pos) AS dois, string_agg(bare, ' ' ORDER BY pos) FILTER (listed) AS a, string_agg(doi, ' ' ORDER BY pos) FILTER (live) AS b FROM z GROUP BY doc_id),
g AS (SELECT doc_id, {I._found(V.RETRACTION_TERM, 0)} AS signals FROM d),
e AS (SELECT g.doc_id, coalesce(n, 0) AS n, coalesce(kl, 0) AS kl, coalesce(kv, 0) AS kv, coalesce(kl, 0) + coalesce(kv, 0) AS k, len(signals) AS s, coalesce(dois, '') AS dois, a, b, array_to_string(list_sort(list_distinct(list_slice(signals, 1, 8))), ', ') AS words FROM g LEFT JOIN c USING (doc_id)),
f AS (SELECT *, {_SCORE} AS score FROM e)
SELECT doc_id, dois, concat_ws(' ', a, b) AS retracted, n::INT AS checked_count, s::INT AS signal_count, rtrim(repeat('retracted_citation:high,', kl) || repeat('retracted_citation_live:high,', kv) || CASE WHEN s > 0 THEN 'retraction_language_detected:medium,' ELSE '' END || CASE WHEN n = 0 THEN 'no_dois_found:low' ELSE '' END, ',') AS flags,
  array_to_string(list_filter([replace(a, ' ', ' ; '), replace(b, ' ', ' ; '), CASE WHEN s > 0 THEN words END, CASE WHEN n = 0 THEN '' END], lambda x: x IS NOT NULL), ' ; ') AS evidence, score, {I._level("k >= 1 OR score >= 0.6", "score >= 0.3", "score >= 0.1")} AS risk_level FROM f""",
    "novelty_literature": f"""WITH base AS ({I.SQL["novelty_score"]}),
w AS (SELECT DISTINCT doc_id, coalesce(d.title, '') AS own, p.title AS t, coalesce(p.year, 0) AS y, coalesce(p.authors, '') AS a FROM documents d JOIN paper_records p ON p.paper_id = d.paper_id WHERE p.title IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, y, a) AS place, len(list_intersect(list_distinct(regexp_extract_all(lower(own), '[0-9a-z_]+')), list_distinct(regexp_extract_all(lower(t), '[0-9a-z_]+')))) AS shared FROM w),
g AS (SELECT doc_id, count(*) AS n, string_agg(CASE WHEN shared > 4 THEN 'high' WHEN shared > 2 THEN 'moderate' ELSE 'low' END, '|' ORDER BY place) AS signals FROM r WHERE place <= 5 GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(signals, '') AS signals, CASE WHEN n > 0 THEN {I._r("greatest(novelty_score - least(n * 0.08::DOUBLE, 0.4::DOUBLE), 0.1::DOUBLE)", 3)} ELSE novelty_score END AS s FROM base LEFT JOIN g USING (doc_id))
SELECT doc_id, s AS novelty_score, CASE WHEN s >= 0.75 THEN 'very_high' WHEN s >= 0.55 THEN 'high' WHEN s >= 0.35 THEN 'moderate' ELSE 'low' END AS novelty_level, signals, true AS literature_accessible, {I._level("s < 0.25", "s < 0.40", "s < 0.60")} AS risk_level FROM s""",
}
