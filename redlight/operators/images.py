"""Jobs over image rows: statistics, quality, histograms, similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Night by mean luminance and 10th percentile.
NIGHT = {"offline": (85, 30), "live": (70, None), "batch": (100, None)}


def _grey(row) -> np.ndarray:
    x = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(float)
    return x[..., 0] if row.nChannels == 1 else x[..., :3] @ np.array([0.114, 0.587, 0.299])


def laplacian_variance(x: np.ndarray) -> float:
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


def image_stats(images: DataFrame, key: str = "image_id") -> DataFrame:
    """``mean, std, p10, sharpness, noise, width, height`` of rows in the image source's layout
    (``height, width, nChannels, data``; channels blue, green, red)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                g = _grey(r)
                rows.append((getattr(r, key), g.mean(), g.std(), np.percentile(g, 10), laplacian_variance(g), sobel_std(g), r.width, r.height))
            yield pd.DataFrame(rows, columns=[key, "mean", "std", "p10", "sharpness", "noise", "width", "height"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(work, f"{key} {kind}, mean double, std double, p10 double, sharpness double, noise double, width int, height int")


def pixel_stats(df: DataFrame, col: str = "pixels") -> DataFrame:
    """``mean, std`` and lower ``p10`` of small luminance arrays, without Python."""
    n = F.size(col)
    mean = F.aggregate(col, F.lit(0.0), lambda s, x: s + x) / n
    rows = df.withColumn("mean", mean)
    var = F.aggregate(F.col(col), F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n
    return rows.withColumns({"std": F.sqrt(var), "p10": F.element_at(F.array_sort(col), (F.floor((n - 1) * 0.1) + 1).cast("int")).cast("double")})


def is_night(mode: str = "offline") -> Column:
    mean, p10 = NIGHT[mode]
    dark = F.col("mean") < mean
    return dark if p10 is None else dark | (F.col("p10") < p10)


def sobel_std(x: np.ndarray) -> float:
    """Spread of the mixed Sobel derivative (1, 1) of a luminance picture."""
    p = np.pad(x, 1, mode="reflect") if min(x.shape) > 1 else np.pad(x, 1, mode="edge")
    return float((p[2:, 2:] + p[:-2, :-2] - p[2:, :-2] - p[:-2, 2:]).std())


def plate_quality(variant: str = "reader", format_score: Column | None = None, noise: Column | None = None) -> Column:
    """0 to 1 from ``mean, std, sharpness, width, height``; two weightings. The stored one also
    takes ``noise``, the spread of the mixed derivative (unknown: half of its share)."""
    if variant == "reader":
        bright = 1 - F.abs((F.col("mean") - 127.5) / 127.5)
        q = 0.4 * F.col("sharpness") / 100 + 0.3 * F.col("std") / 80 + 0.2 * bright + 0.1 * F.least(F.lit(1.0), F.col("width") * F.col("height") / (200 * 50))
    else:
        form = F.lit(0.0) if format_score is None else format_score
        calm = F.lit(0.5) if noise is None else F.coalesce(1 - F.least(F.lit(1.0), noise / 100), F.lit(0.5))
        q = 0.4 * F.col("sharpness") / 500 + 0.3 * F.col("std") / 80 + 0.15 * F.least(F.lit(1.0), F.col("width") * F.col("height") / (200 * 50)) + 0.05 * calm + 0.1 * form
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))


def route_params(contrast: str = "std", blur: str = "sharpness", mean: str = "mean") -> Column:
    """Which enhancement a picture gets."""
    return F.when(F.col(mean) < 100, F.when(F.col(contrast) < 25, "night_contrast").otherwise("night")).when(F.col(contrast) < 25, "contrast").when(F.col(blur) < 80, "sharpen").otherwise("plain")


def _histograms(r, bins: int) -> list[np.ndarray]:
    x = np.frombuffer(r.data, np.uint8).reshape(r.height * r.width, r.nChannels)
    return [np.histogram(x[:, min(c, r.nChannels - 1)], bins, (0, 256))[0].astype(float) for c in range(3)]


def histogram_features(images: DataFrame, key: str = "image_id", time_col: str = "t", bins: int = 16) -> DataFrame:
    """Three histograms of ``bins`` bins, each scaled from 0 to 1, and time / 100."""

    def scaled(h: np.ndarray) -> np.ndarray:
        spread = h.max() - h.min()
        return (h - h.min()) / spread if spread else np.zeros(bins)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(getattr(r, key), [*np.concatenate([scaled(h) for h in _histograms(r, bins)]), getattr(r, time_col) / 100.0]) for r in b.itertuples(index=False)]
            yield pd.DataFrame(out, columns=[key, "features"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, time_col, "height", "width", "nChannels", "data").mapInPandas(work, f"{key} {kind}, features array<double>")


def channel_histograms(images: DataFrame, key: str = "image_id", bins: int = 32) -> DataFrame:
    """``histograms``: one array of ``bins`` counts for each of the three channels."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(getattr(r, key), [h.tolist() for h in _histograms(r, bins)]) for r in b.itertuples(index=False)], columns=[key, "histograms"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(work, f"{key} {kind}, histograms array<array<double>>")


def colour_similarity(a: str, b: str) -> Column:
    """Mean correlation of the channels' histograms (see :func:`channel_histograms`)."""
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    return (correlation(at(a, 0), at(b, 0)) + correlation(at(a, 1), at(b, 1)) + correlation(at(a, 2), at(b, 2))) / 3


def correlation(a, b) -> Column:
    """Correlation of two arrays; negative values count as 0, and an array without spread as 1."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    dot = lambda x, y, mx, my: F.aggregate(F.zip_with(x, y, lambda u, v: (u - mx) * (v - my)), F.lit(0.0), lambda s, z: s + z)
    ma, mb = mean(a), mean(b)
    r = F.try_divide(dot(a, b, ma, mb), F.sqrt(dot(a, a, ma, ma) * dot(b, b, mb, mb)))
    return F.greatest(F.lit(0.0), F.coalesce(r, F.lit(1.0)))


def image_similarity(colour: Column, structure: Column, keypoints: Column | None = None) -> Column:
    total = 0.45 * colour + 0.35 * structure + 0.20 * (F.lit(0.0) if keypoints is None else keypoints)
    total = F.when((colour >= 0.85) & (structure >= 0.70), F.greatest(total, F.lit(0.85))).otherwise(total)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def structure_similarity(a: str, b: str) -> Column:
    """1 - min(1, mean squared difference / 10000) of two luminance arrays of equal size."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return 1 - F.least(F.lit(1.0), mse / 10000)
