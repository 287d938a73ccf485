"""Figure forensics on pixels.

Input are figures: ``doc_id``, ``page_number``, ``figure_index``, ``width``, ``height`` and ``pixels`` (RGB, row by row).
A figure's measures are made where it lies; only its 64-bit hash is shuffled.  Pairs of look-alikes are
found by bands: two hashes at most eight bits apart share at least one of nine bands of seven bits, so a
document with many figures is joined by band, not all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.functions.scoring import flag, level_by_score, rounded, summary, weighted
from veritrove.functions.vocabulary import FIGURE_WEIGHTS

#: Smallest side of a figure, greatest distance of look-alikes.
SMALLEST, NEAR = 50, 8
_BANDS = 9
_MEASURES = "doc_id bigint, page_number int, figure_index int, width int, height int, hash bigint, uniformity double, ela double"


def _resized(gray: np.ndarray, side: int) -> np.ndarray:
    """Mean over blocks, as an image reduced to ``side`` by ``side``."""
    rows = np.linspace(0, gray.shape[0], side + 1).astype(int)
    columns = np.linspace(0, gray.shape[1], side + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(gray, np.minimum(rows[:-1], gray.shape[0] - 1), 0), np.minimum(columns[:-1], gray.shape[1] - 1), 1)
    return sums / np.outer(np.maximum(np.diff(rows), 1), np.maximum(np.diff(columns), 1))


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits: which of the lowest 8 by 8 cosine frequencies of a 32 by 32 reduction are above their median."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = np.round((basis @ _resized(gray, 32) @ basis.T)[:8, :8], 6)
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.int64))


def brightness_uniformity(gray: np.ndarray) -> float:
    """1 less the deviation of brightness over 128, at least 0."""
    return float(1.0 - min(gray.std() / 128.0, 1.0))


# The example quantization tables of the JPEG standard (luminance, chrominance), row by row.
_LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)


def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


def _requantized(plane: np.ndarray, table: tuple[int, ...], quality: int) -> np.ndarray:
    """A plane as it comes back from 8 by 8 cosine transforms whose coefficients are rounded to multiples of a table."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = np.clip((np.array(table).reshape(8, 8) * scale + 50) // 100, 1, 255)
    height, width = plane.shape
    full = np.pad(plane - 128.0, ((0, -height % 8), (0, -width % 8)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    basis = _cosines()
    kept = np.rint(basis @ blocks @ basis.T / steps) * steps
    back = (basis.T @ kept @ basis).transpose(0, 2, 1, 3).reshape(full.shape)
    return np.clip(np.rint(back + 128.0), 0, 255)[:height, :width]


def recompression_error(pixels: np.ndarray, quality: int = 75) -> float:
    """Deviation of the errors that JPEG compression leaves: brightness as it is, colour at half the resolution."""
    rgb = pixels.astype(np.float64)
    red, green, blue = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    bright = 0.299 * red + 0.587 * green + 0.114 * blue
    colours = [np.rint(128 + 0.564 * (blue - bright)), np.rint(128 + 0.713 * (red - bright))]
    height, width = bright.shape
    halved = []
    for plane in colours:
        even = np.pad(plane, ((0, height % 2), (0, width % 2)), mode="edge")
        small = np.rint(even.reshape(even.shape[0] // 2, 2, even.shape[1] // 2, 2).mean((1, 3)))
        halved.append(np.repeat(np.repeat(_requantized(small, _CHROMINANCE, quality), 2, 0), 2, 1)[:height, :width] - 128.0)
    y = _requantized(np.rint(bright), _LUMINANCE, quality)
    again = np.clip(np.rint(np.stack([y + 1.402 * halved[1], y - 0.344136 * halved[0] - 0.714136 * halved[1], y + 1.772 * halved[0]], axis=-1)), 0, 255)
    return float(np.abs(rgb - again).std())


def measures(figures: DataFrame) -> DataFrame:
    """Hash, brightness uniformity and recompression error of every figure that is large enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.pixels is None or len(r.pixels) != r.width * r.height * 3:
                    continue  # cut off, like an image that can't be decoded
                rgb = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                gray = np.floor((rgb.astype(np.int64) * (19595, 38470, 7471)).sum(2) / 65536 + 0.5).astype(float)
                rows.append((r.doc_id, r.page_number, r.figure_index, r.width, r.height, perceptual_hash(gray), brightness_uniformity(gray), recompression_error(rgb)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEASURES.split(", ")])

    kept = figures.where(f"width >= {SMALLEST} and height >= {SMALLEST}").select("doc_id", "page_number", "figure_index", "width", "height", "pixels")
    return kept.mapInPandas(run, _MEASURES)


def duplicate_pairs(measured: DataFrame) -> DataFrame:
    """``doc_id``, ``a``, ``b``, ``distance`` of look-alike figures of one document, ``a`` < ``b``."""
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", 7 * k).bitwiseAND(F.lit(127 if k < 8 else 255)).alias("value")) for k in range(_BANDS)]))
    spread = measured.select("doc_id", "figure_index", "hash", bands.alias("x")).select("doc_id", "figure_index", "hash", "x.band", "x.value")
    a = spread.select("doc_id", "band", "value", F.col("figure_index").alias("a"), F.col("hash").alias("ha"))
    b = spread.select("doc_id", "band", "value", F.col("figure_index").alias("b"), F.col("hash").alias("hb"))
    distance = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    return a.join(b, ["doc_id", "band", "value"]).where("a < b").select("doc_id", "a", "b", distance.alias("distance")).where(f"distance <= {NEAR}").distinct()


def figure_report(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """One row a document of ``documents`` (``doc_id``): figures, look-alikes, flags, score, level."""
    measured = measures(figures)
    pairs = duplicate_pairs(measured)
    pair_flags = pairs.select("doc_id", F.lit(1).alias("rule"), "a", "b", flag(F.lit(True), "duplicate_figures", F.when(F.col("distance") <= 4, "high").otherwise("medium"), F.col("distance")).alias("f"), F.array("a", "b").alias("figures_involved"))
    own = lambda cond, name, sev, ev, rule: measured.where(cond).select("doc_id", F.lit(rule).alias("rule"), F.col("figure_index").alias("a"), F.lit(0).alias("b"), flag(F.lit(True), name, sev, ev).alias("f"), F.array("figure_index").alias("figures_involved"))
    ela = own(F.col("ela") > 35, "ela_anomaly", F.when(F.col("ela") > 50, "high").otherwise("medium"), F.col("ela"), 2)
    flat = own(F.col("uniformity") > 0.92, "unnatural_brightness_uniformity", F.lit("medium"), F.col("uniformity"), 3)
    all_flags = pair_flags.unionByName(ela).unionByName(flat).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule", "a", "b", "f", "figures_involved"))).alias("raised"))
    counts = measured.groupBy("doc_id").agg(F.count("*").cast("int").alias("figures_found"))
    alike = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("duplicate_pairs"))
    joined = documents.select("doc_id").distinct().join(counts, "doc_id", "left").join(alike, "doc_id", "left").join(all_flags, "doc_id", "left")
    shape = "array<struct<flag_type:string,severity:string,description:string,evidence:string,figures_involved:array<int>>>"
    flags = F.coalesce(F.transform("raised", lambda r: F.struct(r["f"]["flag_type"].alias("flag_type"), r["f"]["severity"].alias("severity"), r["f"]["description"].alias("description"), r["f"]["evidence"].alias("evidence"), r["figures_involved"].alias("figures_involved"))), F.array().cast(shape))
    rated = joined.select("doc_id", F.coalesce("figures_found", F.lit(0)).alias("figures_found"), F.coalesce("duplicate_pairs", F.array().cast("array<struct<a:int,b:int>>")).alias("duplicate_pairs"), flags.alias("flags"))
    rated = rated.withColumn("raw", weighted(F.col("flags"), FIGURE_WEIGHTS)).withColumn("risk_level", level_by_score(F.col("raw")))
    return rated.select("doc_id", "figures_found", "duplicate_pairs", "flags", rounded(F.col("raw"), 3).alias("score"), "risk_level", summary("Figures", F.col("flags"), F.col("risk_level")).alias("summary"))
