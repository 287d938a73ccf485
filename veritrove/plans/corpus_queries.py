"""Queries over the benchmark records and the derived tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.analyzers.figures import duplicate_pairs, figure_report
from veritrove.functions.text import word_count
from veritrove.functions.vocabulary import BLANKS
from veritrove.operators.packed import unpack
from veritrove.sources.benchmark import SCORES, categories, status
from veritrove.sources.papers import title_of
from veritrove.sources.tables import table


def _form(column: str):
    return F.upper(F.regexp_replace(F.trim(F.col(column)), r"[ \-]+", "_"))


def corpus_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Records, fraud share and years by category and source, with totals."""
    df = table(spark, folder, "paper_records").select(_form("category").alias("category"), _form("source_db").alias("source_db"), "is_fraud", "year", "paper_id")
    # Records without category or source are rows of their own; ``level`` tells them from totals.
    return df.rollup("category", "source_db").agg(F.count("*").alias("n_records"), F.count_distinct("paper_id").alias("n_papers"), F.sum(F.col("is_fraud").cast("bigint")).alias("n_fraud"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.grouping_id().alias("level"))


def category_targets(spark: SparkSession, folder: str) -> DataFrame:
    """How far each category is from its target count."""
    have = table(spark, folder, "paper_records").groupBy(_form("category").alias("category")).agg(F.count_distinct("paper_id").alias("n_papers"))
    return categories(spark).join(have, "category", "left").select("category", "target", F.coalesce("n_papers", F.lit(0)).alias("n_papers"), (F.col("target") - F.coalesce("n_papers", F.lit(0))).alias("missing"))


def fraud_taxonomy_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by fraud code, with descriptions; codes that no paper has count 0."""
    codes = unpack(table(spark, folder, "paper_records"), "record_id", {"fraud_types": "codes"}).select("record_id", F.upper("item_value").alias("code"))
    counts = codes.groupBy("code").agg(F.count("*").alias("n_values"), F.count_distinct("record_id").alias("n_records"))
    known = table(spark, folder, "fraud_taxonomy")
    return known.join(counts, "code", "left").select("code", "description", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_records", F.lit(0)).alias("n_records"))


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the fourteen dimension scores over records."""
    stack = ", ".join(f"'{s}', {s}" for s in SCORES)
    long = table(spark, folder, "paper_records").selectExpr(f"stack({len(SCORES)}, {stack}) as (dimension, score)").where("score is not null")
    return long.groupBy("dimension").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.sum((F.col("score") >= 0.7).cast("bigint")).alias("n_critical"))


def parsed_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Title of every parsed paper: its own, else its first long line."""
    df = table(spark, folder, "parsed_papers")
    return df.select("parsed_id", title_of("full_text", "title").alias("title"), word_count(F.coalesce("full_text", F.lit(""))).alias("n_words"), F.col("metadata.filename").alias("filename"), "figure_count")


def cited_author_top(spark: SparkSession, folder: str) -> DataFrame:
    """The three most cited authors of every paper, ties by name."""
    from pyspark.sql.window import Window

    counts = table(spark, folder, "citation_edges").where("paper_id is not null and cited_author is not null").groupBy("paper_id", "cited_author").agg(F.count("*").alias("cites"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("cites"), "cited_author"))
    return counts.withColumn("place", place).where("place <= 3")


def citation_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Age of cited works by year of citation: rows, distinct works, mean age of possible years."""
    edges = table(spark, folder, "citation_edges").where("cited_year between 1900 and year(seen_at)")
    return edges.groupBy(F.year("seen_at").alias("seen_year")).agg(F.count("*").alias("n_edges"), F.count_distinct("cited_doi").alias("n_works"), F.sum((F.year("seen_at") - F.col("cited_year")).cast("bigint")).alias("sum_age"))


def analyzer_status(spark: SparkSession, folder: str) -> DataFrame:
    """The analyzers that are ready."""
    return status(spark)


#: Figures of a made document.
_A_DOCUMENT = 8


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of ``embeddings`` as figures of documents: eight in the order of ``vec_id`` each, the last with the vector before it."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    last = F.col("vec_id") % _A_DOCUMENT == _A_DOCUMENT - 1
    placed = vectors.select((F.col("vec_id") / _A_DOCUMENT).cast("bigint").alias("doc_id"), (F.col("vec_id") % _A_DOCUMENT).cast("int").alias("figure_index"), (F.col("vec_id") - last.cast("int")).alias("source"))
    return placed.join(vectors, F.col("source") == F.col("vec_id")).select("doc_id", "figure_index", "embedding")


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    """These as pictures: 64 by 64 dots, a grey block for each of 64 entries, the last figure a little brighter."""
    grey = lambda v: F.least(F.greatest(F.floor(v.cast("double") * 300) + 128, F.lit(0)), F.lit(250)) + F.when(F.col("figure_index") == _A_DOCUMENT - 1, 3).otherwise(0)
    drawn = _placed(spark, folder).select("doc_id", "figure_index", F.transform("embedding", grey).alias("greys"))
    row = lambda k: F.concat(*[F.repeat(F.lpad(F.hex(F.get("greys", 8 * k + j)), 2, "0"), 24) for j in range(8)])
    dots = F.unhex(F.concat(*[F.repeat(row(k), 8) for k in range(8)]))
    return drawn.select("doc_id", F.lit(1).alias("page_number"), "figure_index", F.lit(64).alias("width"), F.lit(64).alias("height"), dots.alias("pixels"))


def figure_forensics(spark: SparkSession, folder: str) -> DataFrame:
    """Look-alikes, recompression and brightness of the figures of every document: count, pairs, flags, score and level."""
    figures = _figures(spark, folder)
    report = figure_report(figures.select("doc_id"), figures)
    pairs = F.array_join(F.transform("duplicate_pairs", lambda p: F.concat(p["a"].cast("string"), F.lit("-"), p["b"].cast("string"))), ",")
    kinds = F.array_join(F.transform("flags", lambda f: F.concat(f["flag_type"], F.lit(":"), F.array_join(f["figures_involved"].cast("array<string>"), "-"))), ",")
    return report.select("doc_id", "figures_found", pairs.alias("pairs"), kinds.alias("flags"), "score", "risk_level")


def figure_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Look-alike pairs of figures of a document by 64-bit hashes, the signs of their vectors."""
    # Bit 63 is the sign of the number, so the bits are joined by "or", which can't overflow.
    bits = " | ".join(f"(case when get(embedding, {k}) > 0 then shiftleft(1L, {k}) else 0L end)" for k in range(64))
    return duplicate_pairs(_placed(spark, folder).select("doc_id", "figure_index", F.expr(bits).alias("hash")))


_FORM = "upper(regexp_replace(trim({0}), '[ \\-]+', '_', 'g'))"
_BITS = " + ".join(f"(CASE WHEN embedding[{k + 1}] > 0 THEN {2**k}::UBIGINT ELSE 0::UBIGINT END)" for k in range(64))
QUERIES = {f.__name__: f for f in (corpus_profile, category_targets, fraud_taxonomy_profile, score_summary, parsed_titles, cited_author_top, citation_lag, analyzer_status, figure_duplicates, figure_forensics)}
_STRIP = lambda x: rf"regexp_replace({x}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"
_GREYS = f"list_transform(embedding, lambda v: least(greatest(floor(v::DOUBLE * 300) + 128, 0), 250))"
SQL = {
    "figure_forensics": f"""WITH p AS (SELECT (vec_id // 8)::BIGINT AS doc_id, vec_id % 8 AS i, vec_id - (vec_id % 8 = 7)::INT AS source FROM embeddings),
g AS (SELECT p.doc_id, p.i, {_GREYS} AS greys FROM p JOIN embeddings e ON e.vec_id = p.source),
m AS (SELECT *, 1.0 - least(list_stddev_pop(greys) / 128.0, 1.0) AS uniformity FROM g),
f AS (SELECT doc_id, count(*) AS n, count(*) FILTER (i IN (6, 7)) = 2 AS alike, count(*) FILTER (uniformity > 0.92::DOUBLE) AS flat, string_agg('unnatural_brightness_uniformity:' || i, ',' ORDER BY i) FILTER (uniformity > 0.92::DOUBLE) AS flats FROM m GROUP BY doc_id),
s AS (SELECT *, least(CASE WHEN alike THEN 0.40::DOUBLE ELSE 0 END + 0.20::DOUBLE * flat, 1.0) AS raw FROM f)
SELECT doc_id, n::INT AS figures_found, CASE WHEN alike THEN '6-7' ELSE '' END AS pairs, array_to_string(list_filter([CASE WHEN alike THEN 'duplicate_figures:6-7' END, flats], lambda x: x IS NOT NULL), ',') AS flags, CAST(printf('%.3f', raw) AS DOUBLE) AS score,
  CASE WHEN raw >= 0.7 - 1e-12 THEN 'critical' WHEN raw >= 0.4 - 1e-12 THEN 'high' WHEN raw >= 0.2 - 1e-12 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
    "parsed_titles": f"SELECT parsed_id, CASE WHEN coalesce(title, '') <> '' THEN {_STRIP('title')} ELSE coalesce(list_filter(list_transform(string_split(coalesce(full_text, ''), chr(10)), lambda x: {_STRIP('x')}), lambda x: len(x) > 10)[1], 'Unknown Title') END AS title, len(regexp_extract_all(coalesce(full_text, ''), '[^{BLANKS}]+'))::INT AS n_words, metadata.filename AS filename, figure_count FROM parsed_papers",
    "corpus_profile": f"SELECT category, source_db, count(*) AS n_records, count(DISTINCT paper_id) AS n_papers, sum(is_fraud)::BIGINT AS n_fraud, min(year) AS first_year, max(year) AS last_year, grouping(category, source_db)::BIGINT AS level FROM (SELECT {_FORM.format('category')} AS category, {_FORM.format('source_db')} AS source_db, is_fraud, year, paper_id FROM paper_records) GROUP BY ROLLUP (category, source_db)",
    "category_targets": f"SELECT t.category, t.target, coalesce(n, 0) AS n_papers, t.target - coalesce(n, 0) AS missing FROM (VALUES ('CONFIRMED_FRAUD', 300), ('SUSPECTED_FRAUD', 200), ('BORDERLINE', 150), ('CLEAN', 250), ('BASELINE_ELITE', 100)) t(category, target) LEFT JOIN (SELECT {_FORM.format('category')} AS category, count(DISTINCT paper_id) AS n FROM paper_records GROUP BY 1) h USING (category)",
    "fraud_taxonomy_profile": "WITH v AS (SELECT record_id, unnest(regexp_extract_all(upper(fraud_types), '[A-Z]+-[0-9]+')) AS code FROM paper_records) SELECT t.code, t.description, count(v.code) AS n_values, count(DISTINCT v.record_id) AS n_records FROM fraud_taxonomy t LEFT JOIN v ON v.code = t.code GROUP BY ALL",
    "score_summary": "SELECT dimension, count(*) AS n, min(score) AS least, max(score) AS most, count(*) FILTER (score >= 0.7::DOUBLE) AS n_critical FROM (UNPIVOT paper_records ON " + ", ".join(SCORES) + " INTO NAME dimension VALUE score) GROUP BY dimension",
    "cited_author_top": "SELECT * FROM (SELECT paper_id, cited_author, count(*) AS cites, row_number() OVER (PARTITION BY paper_id ORDER BY count(*) DESC, cited_author)::INT AS place FROM citation_edges WHERE paper_id IS NOT NULL AND cited_author IS NOT NULL GROUP BY paper_id, cited_author) WHERE place <= 3",
    "citation_lag": "SELECT year(seen_at)::INT AS seen_year, count(*) AS n_edges, count(DISTINCT cited_doi) AS n_works, sum(year(seen_at) - cited_year)::BIGINT AS sum_age FROM citation_edges WHERE cited_year BETWEEN 1900 AND year(seen_at) GROUP BY 1",
    "analyzer_status": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'text')" for n in ("statistics", "methodology", "citations", "reproducibility", "novelty", "grim", "sprite", "granularity", "pcurve", "effect_size", "retraction", "cartel", "llm")) + ", ('figures', 'pixels')) t(name, kind)",
    "figure_duplicates": f"WITH p AS (SELECT (vec_id // 8)::BIGINT AS doc_id, (vec_id % 8)::INT AS i, vec_id - (vec_id % 8 = 7)::INT AS source FROM embeddings), h AS (SELECT p.doc_id, p.i, {_BITS} AS h FROM p JOIN embeddings e ON e.vec_id = p.source) SELECT x.doc_id, x.i AS a, y.i AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.i < y.i WHERE bit_count(xor(x.h, y.h)) <= 8",
}
