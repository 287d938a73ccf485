"""Sources, sinks, routing, figures and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrove.analyzers import figures as fig
from veritrove.analyzers import papers
from veritrove.functions import routing
from veritrove.functions.vocabulary import SECTION_MARKERS
from veritrove.sources import benchmark
from veritrove.sources import papers as source


def test_benchmark_csv_round_trip(spark, tmp_path):
    row = {c: None for c in benchmark.COLUMNS} | {"paper_id": "P-1", "title": 'A "quoted", title\nin two lines', "authors": "Roe Ana, Lee Bo", "year": 2001, "is_fraud": 1, "grim_score": 0.5, "notes": "β — é"}
    df = spark.createDataFrame([tuple(row[c] for c in benchmark.COLUMNS)], benchmark.SCHEMA)
    benchmark.write_csv(df, str(tmp_path / "out"))
    got = benchmark.read_csv(spark, str(tmp_path / "out")).first().asDict()
    assert got == row
    assert len(benchmark.COLUMNS) == 35
    assert benchmark.categories(spark).agg(F.sum("target")).first()[0] == 1000 and benchmark.status(spark).count() == 14


def test_requests_and_reports(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"paper_id": 1, "text": "' + "x" * 50 + '"}\n{"paper_id": 2, "text": "short"}\n{"paper_id": 3}\n')
    valid, rejected = source.read_requests(spark, str(tmp_path / "in.json"))
    assert [r.paper_id for r in valid.collect()] == [1] and sorted(r.paper_id for r in rejected.collect()) == [2, 3]
    from veritrove.analyzers import analyze

    source.write_reports(analyze(papers(valid, "paper_id"), "grim"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().risk_level == "low"


def test_pages_titles_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "paper_id long, page_number int, text string")
    assert source.page_texts(pages).first().full_text == "a\nb\n"
    df = spark.createDataFrame([("short\n  A title of the work \nx", ""), ("", None), (None, " Meta ")], "full_text string, meta string")
    assert [r[0] for r in df.select(source.title_of("full_text", "meta")).collect()] == ["A title of the work", "Unknown Title", "Meta"]
    (tmp_path / "a.pdf").write_bytes(b"x" * 1536)
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [tuple(r) for r in source.files(spark, str(tmp_path)).select("filename", "file_size_kb").collect()] == [("a.pdf", 1.5)]


def brute_sections(text):
    low, first, at = text.lower(), {}, 0
    for line in low.split("\n"):
        for k, m in enumerate(SECTION_MARKERS):
            if len(line.strip()) <= 60 and m in line:
                first.setdefault(m, (at + line.index(m), k, m))
        at += len(line) + 1
    kept = []
    for p in sorted(first.values()):
        if not kept or p[0] - kept[-1][0] > 50:
            kept.append(p)
    ends = [p[0] for p in kept[1:]] + [len(text)] * bool(kept)
    return {p[2]: text[p[0] : e].strip() for p, e in zip(kept, ends, strict=True)}


TEXTS = [
    "",
    "no headings at all",
    "Abstract\n" + "a " * 60 + "\nMaterials and Methods\n" + "m " * 60 + "\nResults\n" + "r " * 60 + "\nConclusions\n" + "c " * 60,
    "abstract " + "x" * 61 + "\nABSTRACT\nshort\nIntroduction\nnear",
    "1. Introduction\n" + "i " * 80 + "\n" + "y" * 61 + " results\nFindings and results\n" + "f " * 60,
]


def test_sections(spark):
    df = papers(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    got = {r.id: r.sections for r in routing.with_sections(df).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == brute_sections(text), k
    routed = {r.id: r.text for r in routing.routed(routing.with_sections(df), "statistics").collect()}
    assert routed[1] == TEXTS[1] and routed[2].startswith("Abstract\n") and "\n\nResults\n" in routed[2] and "Conclusions" not in routed[2]


def test_truncation_and_parser_sections(spark):
    long = "x" * 3500 + " method " + "y" * 6000
    texts = ["a" * 8000, "a" * 8001, long, "method" + "z" * 9000, "abstract A introduction B methods C results D"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [r[0] for r in df.orderBy("id").select(routing.truncated(F.col("text"))).collect()]
    assert got[:2] == ["a" * 8000, "a" * 8000] and got[2] == long[:3000] + " [...] " + long[3501:7501] and got[3] == ("method" + "z" * 9000)[:8000]
    sections = df.where("id = 4").select(routing.parser_sections(F.col("text"))).first()[0]
    assert sections == {"abstract": "abstract A", "introduction": "introduction B", "methods": "methods C", "results": "results D"}


def image(seed=None, size=100):
    rgb = np.full((size, size, 3), 120, np.uint8) if seed is None else np.random.default_rng(seed).integers(0, 256, (size, size, 3), dtype=np.uint8)
    return bytearray(rgb.tobytes())


def test_figures(spark):
    rows = [(1, 1, 0, 100, 100, image()), (1, 3, 1, 100, 100, image()), (2, 1, 0, 100, 100, image(42)), (2, 1, 1, 100, 100, image(7)), (2, 1, 2, 40, 40, image(1, 40)), (3, 1, 0, 100, 100, bytearray(b"cut"))]
    figures = spark.createDataFrame(rows, "doc_id long, page_number int, figure_index int, width int, height int, pixels binary")
    documents = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "doc_id long")
    got = {r.doc_id: r for r in fig.figure_report(documents, figures).collect()}
    assert got[1].figures_found == 2 and [tuple(p) for p in got[1].duplicate_pairs] == [(0, 1)]
    assert [f.flag_type for f in got[1].flags] == ["duplicate_figures", "unnatural_brightness_uniformity", "unnatural_brightness_uniformity"] and got[1].flags[0].figures_involved == [0, 1]
    assert got[1].score == pytest.approx(0.8) and got[1].risk_level == "critical"
    # noise of all colours loses much when its colour is halved
    assert got[2].figures_found == 2 and {f.flag_type for f in got[2].flags} == {"ela_anomaly"} and got[3].figures_found == 0 and got[4].risk_level == "low"
    assert fig.brightness_uniformity(np.full((9, 9), 7.0)) == 1.0
    assert fig.figure_report(documents, figures.limit(0)).count() == 4


def test_duplicate_bands_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 12)]
    hashes = [h ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for h in base for k in (0, 3, 8, 9)]
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate(hashes)], "doc_id long, figure_index int, hash long")
    got = {(r.a, r.b) for r in fig.duplicate_pairs(df).collect()}
    want = {(a, b) for b in range(len(hashes)) for a in range(b) if bin((hashes[a] ^ hashes[b]) & (2**64 - 1)).count("1") <= 8}
    assert got == want


def test_streams(spark, tmp_path):
    from veritrove.streaming.papers import flag_counts, reports, run_to_table

    rows = [(k, f"We saw p=0.04{k % 10} and n=5.", f"2024-01-{1 + k:02d} 00:00:00") for k in range(20)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert run_to_table(reports(stream(), "statistics").select("id", "score"), "t").count() == 21
    query = flag_counts(stream(), "statistics", "at").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n_papers) from counts").first()[0] == 20


# PDF files


def test_pdf_round_trip(spark, tmp_path):
    from veritrove.sources import pdf
    from veritrove.sources.papers import files

    dots = bytes(range(256)) * 30
    (tmp_path / "a.pdf").write_bytes(pdf.encode(["First line\nβ (x) \\ ü", "", "third"], "A (title) of ß", [(64, 40, dots)]))
    (tmp_path / "b.pdf").write_bytes(b"no pdf at all")
    got = {r.path.rsplit("/", 1)[1]: r for r in pdf.documents(files(spark, str(tmp_path))).collect()}
    a, b = got["a.pdf"], got["b.pdf"]
    assert (a.page_count, a.figure_count, a.title, a.full_text, a.error) == (3, 1, "A (title) of ß", "First line\nβ (x) \\ ü\n\nthird", None)
    assert b.page_count == 0 and b.error
    (figure,) = pdf.figures(files(spark, str(tmp_path))).collect()
    assert (figure.page_number, figure.figure_index, figure.width, figure.height, bytes(figure.pixels)) == (1, 0, 64, 40, dots)
    assert pdf.documents(files(spark, str(tmp_path)).limit(0)).count() == 0


def test_pdf_plain_notation():
    from veritrove.sources.pdf import decode

    body = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [5 0 R 3 0 R] /Count 2 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents [4 0 R] >> endobj
4 0 obj << /Length 64 >> stream
BT (Second \\(page\\)) Tj T* [(with) -20 (out)] TJ (next) ' ET
endstream endobj
5 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /XObject << /I 7 0 R >> >> >> endobj
6 0 obj << /Length 30 >> stream
BT (First\\040p\\141ge) Tj ET
endstream endobj
7 0 obj << /Subtype /Image /Width 9 /Height 4 /Filter /DCTDecode /BitsPerComponent 8 >> stream
\xff\xd8 endstream endobj
trailer << /Root 1 0 R >>"""
    got = decode(body.replace(b"\\\\", b"\\"))
    assert got.error is None and got.figures == [(1, 9, 4, None)]
    assert got.pages[0] == "First page" and got.pages[1].startswith("Second (page)\nwithout")


def test_no_pdf_stops_a_job():
    import random
    import time

    from veritrove.sources import pdf

    good, rng = pdf.encode(["some text"] * 3, "t", [(50, 50, b"x" * 7500)]), random.Random(5)
    cases = [b"", b"%PDF-1.4", b"%PDF-" + b"1 0 obj " * 50_000, b"%PDF-" + b"(" * 300_000, b"%PDF-\n1 0 obj << /Type /Pages /Kids [1 0 R] >> endobj"]
    for _ in range(150):
        broken = bytearray(good)
        for _ in range(rng.randrange(1, 30)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        cases.append(bytes(broken[: rng.randrange(len(broken))] if rng.random() < 0.3 else broken))
    began = time.time()
    for case in cases:
        assert isinstance(pdf.decode(case), pdf.Pdf)
    assert time.time() - began < 30


# figures


def test_recompression_error():
    import numpy as np

    from veritrove.analyzers.figures import recompression_error

    rng = np.random.default_rng(3)
    flat = np.full((64, 80, 3), 130, np.uint8)
    smooth = np.repeat(np.linspace(40, 200, 96).astype(np.uint8)[None, :, None], 64, 0).repeat(3, 2)
    noise = rng.integers(0, 256, (61, 75, 3)).astype(np.uint8)
    assert recompression_error(flat) == 0.0
    assert recompression_error(flat) <= recompression_error(smooth) < 3 < 20 < recompression_error(noise)
    assert recompression_error(noise, 30) > recompression_error(noise, 95) - 8


def test_all_windows_of_a_stream(spark, tmp_path):
    """Also those that the watermark has not passed."""
    from pyspark.sql import functions as F

    from veritrove.streaming.papers import run_updates

    rows = [(f"2024-01-{d:02d} 00:00:00", k) for d in range(1, 29) for k in range(3)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "at string, k int").select(F.col("at").cast("timestamp"), "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = stream.withWatermark("at", "60 days").groupBy(F.window("at", "7 days")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("string").alias("week"), "n")
    got = {r.week: r.n for r in run_updates(counts, "week", "weeks").collect()}
    assert sum(got.values()) == len(rows) and len(got) == 5
