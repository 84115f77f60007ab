"""Smoke and dust features of photos, and the category they lead to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zephra.functions.risk import clip

SIZE = 256
FEATURES = ["brightness", "blue_sky", "dark_smoke", "light_haze", "dust", "edge_density"]


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def image_features(pixels: DataFrame) -> DataFrame:
    """One row per image from pixels (image_id, x, y, r, g, b).

    Pixels are shuffled once by image (an image is a fixed-size grid); rows and columns are scanned within it.
    """
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    gray = (r + g + b) / 3.0
    rows = pixels.repartition("image_id").withColumn("gray", gray)
    std = F.sqrt(((r - F.col("gray")) ** 2 + (g - F.col("gray")) ** 2 + (b - F.col("gray")) ** 2) / 3.0)
    along_x = Window.partitionBy("image_id", "y").orderBy("x")
    along_y = Window.partitionBy("image_id", "x").orderBy("y")
    rows = rows.withColumns(
        {
            "std": std,
            "dx": F.abs(F.col("gray") - F.lag("gray").over(along_x)),
            "dy": F.abs(F.col("gray") - F.lag("gray").over(along_y)),
        }
    )
    bright, std = F.col("gray"), F.col("std")
    return rows.groupBy("image_id").agg(
        F.avg(bright).alias("brightness"),
        _share((b > 1.15 * r) & (b > 1.05 * g) & (b > 80.0)).alias("blue_sky"),
        _share((bright < 70.0) & (std < 25.0)).alias("dark_smoke"),
        _share((std < 14.0) & (bright >= 70.0) & (bright <= 225.0)).alias("light_haze"),
        _share((r > 1.15 * b) & (g > 0.82 * b) & (r > 80.0) & (F.abs(r - g) < 65.0)).alias("dust"),
        (F.coalesce(F.avg("dx"), F.lit(0.0)) + F.coalesce(F.avg("dy"), F.lit(0.0))).alias("edge_density"),
    )


def classify_image(features: DataFrame) -> DataFrame:
    """Adds smoke_probability, dust_probability, category, severity_score, confidence and explanation."""
    blue, dark, haze, dust = (F.col(c) for c in ("blue_sky", "dark_smoke", "light_haze", "dust"))
    calm = 1.0 - F.least(F.col("edge_density"), F.lit(30.0)) / 30.0
    smoke_p = clip(0.55 * dark + 0.35 * haze + 0.10 * calm - 0.45 * blue, 0.02, 0.98)
    dust_p = clip(0.60 * dust + 0.30 * haze + 0.10 * (F.col("brightness") / 255.0) - 0.35 * blue, 0.02, 0.95)
    df = features.withColumns({"_s": smoke_p, "_d": dust_p})
    s, d = F.col("_s"), F.col("_d")

    def pct(c: Column) -> Column:
        return F.format_string("%.1f%%", F.bround(c * 100, 1))

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    # In order of precedence: condition, category, severity, confidence, explanation.
    rules = [
        (
            (blue > 0.35) & (dark < 0.05) & (haze < 0.20), "Clean / Normal Air",
            clip((1.0 - blue) * 20.0, 5, 25), clip(0.85 + 0.12 * blue, 0.85, 0.98),
            text("Clear sky and high atmospheric visibility detected (Blue Sky Coverage: ", pct(blue), ", Minimal Plumes)."),
        ),
        (
            (dark > 0.08) | ((s > 0.50) & (dark > 0.03)), "Garbage Burning",
            clip(s * 85.0 + dark * 30.0 + 10.0, 50, 98), clip(0.82 + 0.15 * s, 0.80, 0.96),
            text("Detected dark carbonaceous plume and open waste burning absorption (Smoke Prob: ", pct(s),
                 ", Dark Plume: ", pct(dark), ")."),
        ),
        (
            (s > 0.35) | (haze > 0.35), "Industrial Smoke",
            clip(s * 80.0 + haze * 15.0 + 10.0, 40, 92), clip(0.78 + 0.16 * s, 0.75, 0.94),
            text("Detected airborne effluent haze and desaturated stack plume dispersion (Smoke Prob: ", pct(s),
                 ", Haze: ", pct(haze), ")."),
        ),
        (
            (dust > 0.15) & (d > 0.30), "Construction Dust",
            clip(d * 85.0 + dust * 15.0, 35, 88), clip(0.76 + 0.18 * d, 0.75, 0.93),
            text("Detected heavy tan/brownish particulate haze from unmitigated site dust (Dust Prob: ", pct(d),
                 ", Dust Tint: ", pct(dust), ")."),
        ),
        (
            d > 0.25, "Road Dust",
            clip(d * 75.0, 25, 75), clip(0.72 + 0.20 * d, 0.70, 0.90),
            text("Detected road dust re-suspension and localized vehicular particulate haze (Dust Prob: ", pct(d), ")."),
        ),
        (
            F.lit(True), "Clean / Normal Air",
            clip((s + d) * 20.0, 5, 25), clip(0.80 + 0.10 * (1.0 - F.greatest(s, d)), 0.80, 0.95),
            text("No severe smoke or dust plumes detected across visual spectrum. Normal atmospheric clarity."),
        ),
    ]

    def pick(i: int) -> Column:
        out = F.when(F.col("brightness").isNull(), None)
        for rule in rules:
            out = out.when(rule[0], F.lit(rule[i]) if isinstance(rule[i], str) else rule[i])
        return out

    return df.select(
        *features.columns,
        F.round(s, 3).alias("smoke_probability"),
        F.round(d, 3).alias("dust_probability"),
        F.round(pick(3), 3).alias("confidence"),
        pick(2).cast("int").alias("severity_score"),
        pick(1).alias("category"),
        pick(4).alias("explanation"),
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, height, width, channels, data) with BGR bytes; unreadable files have NULL data."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    known = F.col("height") > 0
    return raw.select(
        F.col("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("channels"),
        F.when(known, F.col("data")).alias("data"),
    )


def _weights(size: int, target: int) -> np.ndarray:
    """Cubic resampling matrix (a = -0.5) whose support widens when shrinking."""
    scale = size / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    t = np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide)
    w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def _resized_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    img = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    rgb = np.repeat(img, 3, axis=2) if channels == 1 else img[:, :, 2::-1]
    rgb = np.rint(np.clip(np.einsum("xw,hwc->hxc", _weights(width, SIZE), rgb), 0, 255))
    return np.rint(np.clip(np.einsum("yh,hxc->yxc", _weights(height, SIZE), rgb), 0, 255))


def _features_of(rgb: np.ndarray) -> list[float]:
    r, g, b = rgb[:, :, 0], rgb[:, :, 1], rgb[:, :, 2]
    bright, std = rgb.mean(axis=2), rgb.std(axis=2)
    return [
        bright.mean(),
        ((b > 1.15 * r) & (b > 1.05 * g) & (b > 80)).mean(),
        ((bright < 70) & (std < 25)).mean(),
        ((std < 14) & (bright >= 70) & (bright <= 225)).mean(),
        ((r > 1.15 * b) & (g > 0.82 * b) & (r > 80) & (np.abs(r - g) < 65)).mean(),
        np.abs(np.diff(bright, axis=1)).mean() + np.abs(np.diff(bright, axis=0)).mean(),
    ]


def photo_features(images: DataFrame) -> DataFrame:
    """Features of image files at 256 x 256; unreadable files give NULL features. One image at a time per task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch.itertuples(index=False):
                ok = i.data is not None
                values = _features_of(_resized_rgb(i.data, i.height, i.width, i.channels)) if ok else [None] * len(FEATURES)
                rows.append([i.image_id, *values])
            yield pd.DataFrame(rows, columns=["image_id", *FEATURES])

    return images.mapInPandas(work, "image_id string, " + ", ".join(f"{f} double" for f in FEATURES))
