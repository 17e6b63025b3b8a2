"""Proposals of pictures that are hardly worth keeping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import media as paths

# Reasons in their order, and what joins them.
SCREENSHOT, BLURRED, DARK, BLOWN, POOR, JOINED = "スクリーンショット", "ブレ", "露出不足(暗い)", "白飛び", "低品質", " / "


@dataclass(frozen=True)
class Thresholds:
    composite: float = 0.35
    sharpness: float = 0.2
    exposure: float = 0.08


def junk(media: DataFrame, quality: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``media_id``, ``action``, ``reason`` for items with a reason.

    ``media`` has ``media_id``, ``source_ref``; ``quality`` has ``media_id``, ``sharpness``, ``exposure``,
    ``composite``.  Without a quality only the name counts; a low composite counts where nothing else does.
    """
    m = media.select("media_id", "source_ref").join(quality.select("media_id", "sharpness", "exposure", "composite"), "media_id", "left")
    reasons = F.concat_ws(
        JOINED,
        F.when(paths.is_screenshot(F.col("source_ref")), SCREENSHOT),
        F.when(F.col("sharpness") < t.sharpness, BLURRED),
        F.when(F.col("exposure") < t.exposure, DARK),
        F.when(F.col("exposure") > 1 - t.exposure, BLOWN),
    )
    m = m.withColumn("r", reasons)
    reason = F.when(F.col("r") != "", F.col("r")).when(F.col("composite") < t.composite, POOR)
    return m.select("media_id", F.lit("trash").alias("action"), reason.alias("reason")).where("reason is not null")
