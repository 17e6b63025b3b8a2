"""Quality scores from measured pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.functions.geometry import clamp

# Weights of sharpness, exposure, composition and open eyes; scores without a measure; full sharpness.
WEIGHTS = (0.4, 0.3, 0.15, 0.15)
MOCK_WEIGHTS = (0.4, 0.2, 0.2, 0.2)
COMPOSITION, EYES_OPEN, UNKNOWN, SHARP_VARIANCE = 0.5, 0.8, 0.5, 500.0


def weighted(weights: tuple[float, ...], *parts: Column) -> Column:
    out = parts[0] * weights[0]
    for p, w in zip(parts[1:], weights[1:], strict=True):
        out = out + p * w
    return out


def quality(laplacian_variance: Column, mean_luminance: Column) -> Column:
    """Scores of an image by the variance of its Laplacian and its mean luminance (0 to 1); all 0.5 where either is null."""
    sharp = clamp(laplacian_variance / SHARP_VARIANCE, 0, 1)
    exposure = clamp(1 - F.abs(mean_luminance - 0.5) * 2, 0, 1)
    known = laplacian_variance.isNotNull() & mean_luminance.isNotNull()
    part = lambda c: F.when(known, c).otherwise(F.lit(UNKNOWN))
    composition, eyes = F.lit(COMPOSITION), F.lit(EYES_OPEN)
    return F.struct(part(sharp).alias("sharpness"), part(exposure).alias("exposure"), part(composition).alias("composition"), part(eyes).alias("eyes_open"), part(weighted(WEIGHTS, sharp, exposure, composition, eyes)).alias("composite"))


def mock_composite(sharpness: Column, exposure: Column, composition: Column, eyes_open: Column) -> Column:
    return weighted(MOCK_WEIGHTS, sharpness, exposure, composition, eyes_open)
