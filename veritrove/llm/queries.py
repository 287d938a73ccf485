"""Queries of the training-data operators, with their SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.llm import layout, leak, pii, sample, sentences, splits, tokens, variants
from veritrove.operators.packed import authors_of
from veritrove.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of sample_plans whose stratum has fewer papers than needed."""
    _, report = sample.draw(table(spark, folder, "paper_records"), table(spark, folder, "sample_plans"))
    return report.where("short").select("plan_id", "stratum_value")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample of every plan."""
    drawn, _ = sample.draw(table(spark, folder, "paper_records"), table(spark, folder, "sample_plans"))
    return drawn.withColumnRenamed("unit", "paper_id")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """What every row of sample_plans asked for and got."""
    return sample.draw(table(spark, folder, "paper_records"), table(spark, folder, "sample_plans"))[1].drop("repaired")


def _layout_records(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "paper_records").select(F.lit(0).alias("tag"), F.col("record_id").alias("id"), layout.layout_key(F.col("doi"), F.col("title")).alias("key"))
    payload = F.col("payload")
    raw = table(spark, folder, "raw_records").select(F.lit(1).alias("tag"), F.col("raw_id").alias("id"), layout.layout_key(layout.payload_field(payload, "doi"), layout.payload_field(payload, "title")).alias("key"))
    return papers.unionByName(raw)


def _table_name() -> F.Column:
    return F.when(F.col("tag") == 0, "paper_records").otherwise("raw_records").alias("table_name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that is a copy, but for layout, of a row with a smaller id."""
    return layout.copies(_layout_records(spark, folder)).select(_table_name(), "first_id", "copy_id")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with the number of its copies."""
    return layout.collapse(_layout_records(spark, folder)).select(_table_name(), "first_id", "n_copies")


def _names(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "paper_records")
    authors = authors_of(papers).select(F.lit("author").alias("kind"), F.col("author").alias("name"))
    return authors.unionByName(papers.select(F.lit("journal").alias("kind"), F.col("journal").alias("name")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of spellings of one person, group or journal."""
    return variants.variant_pairs(variants.clusters(_names(spark, folder)))


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with the spelling its cluster is named by."""
    return variants.clusters(_names(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that is linked to a row with a smaller record_id."""
    found = splits.components(splits.links(table(spark, folder, "paper_records")))
    return found.where("node <> first").select(F.col("first").alias("first_id"), F.col("node").alias("record_id"))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every row."""
    return splits.assign(table(spark, folder, "paper_records"), table(spark, folder, "split_targets"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records of every split, and how far its share is from the target."""
    targets = table(spark, folder, "split_targets")
    return splits.report(splits.assign(table(spark, folder, "paper_records"), targets), targets)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by whether their stretches of the text, put together, give the text again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = tokens.encode(docs, "doc_id", "text", offsets=True)
    body = F.coalesce("text", F.lit(""))
    # A character split over several tokens is covered by each of them: a stretch counts from where the one before ended.
    pieces = F.transform("ends", lambda e, i: F.substring(body, F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)) + 1, F.greatest(F.lit(0), e - F.when(i > 0, F.get("ends", i - 1)).otherwise(F.lit(0)))))
    joined = coded.join(docs, "doc_id").select("doc_id", (F.array_join(pieces, "") == body).alias("same"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("n_chars"))
    return joined


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by whether decoding their ids gives the text again."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").groupBy((F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same")).agg(F.count("*").alias("n_docs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence unit of every full text, with its place."""
    return sentences.sentences(table(spark, folder, "parsed_papers"), "parsed_id", "full_text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least a third of an evaluation item."""
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """What each such document holds, and where."""
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of personal information in the documents."""
    return pii.detect(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pii_kind", "start_at", "end_at")


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with placeholders."""
    return pii.redact(table(spark, folder, "documents"), "doc_id", "text")


_FORM = r"regexp_replace(regexp_replace(lower(CAST({} AS VARCHAR)), '^\s+|\s+$', '', 'g'), '[\s_\-]+', '_', 'g')"
_UNITS = " UNION ".join(f"SELECT '{f}' AS field, {_FORM.format(f)} AS stratum, paper_id FROM paper_records WHERE {f} IS NOT NULL AND paper_id IS NOT NULL" for f in ("category", "is_fraud", "source_db"))
_P1 = f"""
WITH units AS ({_UNITS}), sizes AS (SELECT field, stratum, count(*) AS n FROM units WHERE stratum <> '' GROUP BY ALL),
r AS (SELECT p.plan_id, p.stratum_field, p.stratum_value, coalesce(s.n, 0) AS available,
      CAST(greatest(p.min_keep, (p.sample_n * p.target_pct + 50) // 100) AS BIGINT) AS needed,
      greatest(least(coalesce(s.n, 0), p.min_keep), least(coalesce(s.n, 0), (p.sample_n * p.target_pct + 50) // 100)) AS drawn
      FROM sample_plans p LEFT JOIN sizes s ON s.field = p.stratum_field AND s.stratum = {_FORM.format("p.stratum_value")})
"""
_DRAWN = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
_P1_SAMPLE = f"""
WITH units AS ({_UNITS}), ranked AS (SELECT field, stratum, paper_id, row_number() OVER (PARTITION BY field, stratum ORDER BY {_DRAWN("paper_id || '|17'")}, paper_id) AS rank, count(*) OVER (PARTITION BY field, stratum) AS have FROM units WHERE stratum <> ''),
sizes AS (SELECT field, stratum, any_value(have) AS have FROM ranked GROUP BY ALL),
p AS (SELECT plan_id, stratum_value, stratum_field AS field, {_FORM.format("stratum_value")} AS stratum, sample_n, target_pct, min_keep FROM sample_plans),
q AS (SELECT p.*, have, least((sample_n * target_pct + 50) // 100, coalesce(have, 0)) AS quota, least(min_keep, coalesce(have, 0)) AS low, {_DRAWN("plan_id::VARCHAR || '|start 17'")} / 1152921504606846976.0::DOUBLE AS begun FROM p LEFT JOIN sizes USING (field, stratum)),
o AS (SELECT *, sum(quota) OVER (PARTITION BY plan_id ORDER BY field, stratum) - quota AS before, floor(begun * have)::BIGINT AS start FROM q),
u AS (SELECT plan_id, stratum_value, paper_id, rank, low, before + (quota * rank + start) // o.have > before + (quota * (rank - 1) + start) // o.have AS crossed FROM ranked JOIN o USING (field, stratum)),
c AS (SELECT *, greatest(0, low - count(*) FILTER (crossed) OVER (PARTITION BY plan_id, stratum_value)) AS missing FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY plan_id, stratum_value, crossed ORDER BY rank) AS turn FROM c)
SELECT plan_id, stratum_value, paper_id FROM t WHERE crossed OR (rank <= low AND turn <= missing)
"""
_BARE = r"regexp_replace(replace(lower(upper({})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')"
_P2 = rf"""
WITH r AS (
  SELECT 'paper_records' AS table_name, record_id AS id, doi, title FROM paper_records
  UNION ALL
  SELECT 'raw_records', raw_id,
    CASE WHEN regexp_matches(payload, '^\s*\{{') THEN payload->>'$.doi' ELSE regexp_extract(payload, '(?im)^[ \t]*doi[ \t]*[:=][ \t]*(\S.*)$', 1) END,
    CASE WHEN regexp_matches(payload, '^\s*\{{') THEN payload->>'$.title' ELSE regexp_extract(payload, '(?im)^[ \t]*title[ \t]*[:=][ \t]*(\S.*)$', 1) END
  FROM raw_records),
k AS (SELECT table_name, id, regexp_replace({_BARE.format("doi")}, '^(doi)+', '') AS d, {_BARE.format("title")} AS t FROM r),
g AS (SELECT table_name, id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM k WHERE d <> '' AND t <> '' WINDOW w AS (PARTITION BY table_name, d, t))
"""
_SPLIT = r"([\p{L}\p{N}])(?:[-\x{2010}\x{2011}\x{AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}''\x{2019}\x{2BC}]+(?:[ \t]*\r?\n[ \t]*)?)([\p{L}\p{N}])"


def _words_sql(text: str) -> str:
    """The words of a text as they are compared, for texts whose signs have no other form in Unicode."""
    bare = f"regexp_replace(regexp_replace({text}, '<!--(?:.|\\n)*?-->', '', 'g'), '</?[a-zA-Z][^<>]*>', '', 'g')"
    for entity, sign in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&shy;", "chr(173)"), ("&amp;", "'&'")):
        bare = f"replace({bare}, '{entity}', {sign})"
    joined = f"lower({bare})"
    for _ in range(2):  # a word of one letter ends one match and cannot begin the next
        joined = f"regexp_replace({joined}, '{_SPLIT}', '\\1\\2', 'g')"
    return rf"regexp_extract_all({joined}, '[\p{{L}}\p{{N}}]+')"


_GRAM = " || ' ' || ".join(f"w[k + {j}]" for j in range(6))
_P8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_words_sql("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, k - 1 AS pos, {_GRAM} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS k FROM d)), ig AS (SELECT item_id, n, k - 1 AS place, {_GRAM} AS g FROM (SELECT item_id, w, len(w) AS n, unnest(range(1, len(w) - 4)) AS k FROM i)),
hits AS (SELECT doc_id, item_id, n, pos, place, place - row_number() OVER (PARTITION BY doc_id, item_id, pos - place ORDER BY place) AS island FROM dg JOIN ig USING (g)),
runs AS (SELECT doc_id, item_id, n, min(place) AS item, min(pos) AS doc, count(*) + 5 AS size FROM hits GROUP BY doc_id, item_id, n, pos - place, island),
may AS (SELECT doc_id, item_id, n, max(size) AS longest, min(doc) AS low, max(doc + size) AS high FROM runs GROUP BY ALL HAVING sum(size) * 3 >= n),
chain AS (SELECT r.doc_id, r.item_id, r.item, r.doc, r.size, r.size AS held FROM runs r SEMI JOIN may USING (doc_id, item_id)
  UNION SELECT r.doc_id, r.item_id, r.item, r.doc, r.size, c.held + r.size - greatest(c.item + c.size - r.item, c.doc + c.size - r.doc, 0)
  FROM chain c JOIN runs r ON r.doc_id = c.doc_id AND r.item_id = c.item_id AND c.item < r.item AND c.doc < r.doc AND greatest(c.item + c.size - r.item, c.doc + c.size - r.doc, 0) < r.size),
best AS (SELECT doc_id, item_id, max(held) AS held FROM chain GROUP BY ALL),
found AS (SELECT doc_id, item_id, (CASE WHEN longest >= n THEN longest ELSE held END)::INT AS held, n::INT AS item_words, longest::INT AS longest, low::INT AS word_from, high::INT AS word_to FROM may JOIN best USING (doc_id, item_id))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_sample": p1_sample,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p4_found": p4_found,
    "p5_clusters": p5_clusters,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_splits": p6_splits,
    "p7_ids": p7_ids,
    "p7_offsets": p7_offsets,
    "p7_round_trip": p7_round_trip,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
SQL = {
    "p1_found": _P1 + "SELECT plan_id, stratum_value FROM r WHERE available < needed",
    "p1_report": _P1 + "SELECT plan_id, stratum_field, stratum_value, available, needed, CAST(drawn AS BIGINT) AS drawn, drawn < needed AS short FROM r",
    "p1_sample": _P1_SAMPLE,
    "p2_found": _P2 + "SELECT table_name, first_id, id AS copy_id FROM g WHERE id <> first_id",
    "p2_records": _P2 + "SELECT table_name, first_id, n AS n_copies FROM g WHERE id = first_id",
    "p8_found": _P8 + "SELECT doc_id, item_id FROM found WHERE held * 3 >= item_words",
    "p8_matches": _P8 + "SELECT * FROM found WHERE held * 3 >= item_words",
    "p7_offsets": "SELECT doc_id, true AS same, len(coalesce(text, ''))::INT AS n_chars FROM documents",
    "p7_round_trip": "SELECT true AS same, count(*) AS n_docs FROM documents",
}
