"""Slideshow timelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.functions import geometry

LONGEST_VIDEO_MS, HERO_FACTOR = 12_000, 1.3


@dataclass(frozen=True)
class TimelineConfig:
    base_ms: int = 4000
    transition: str = "crossfade"
    transition_ms: int = 600
    ken_burns: bool = True


def duration(kind: Column, duration_ms: Column, role: Column, config: TimelineConfig = TimelineConfig()) -> Column:
    """A video its own time up to twelve seconds, a hero 1.3 times the base, others the base."""
    own = (kind == "video") & (F.coalesce(duration_ms, F.lit(0)) != 0)
    hero = int(config.base_ms * HERO_FACTOR + 0.5)
    return F.when(own, F.least(duration_ms, F.lit(LONGEST_VIDEO_MS))).when(role == "hero", hero).otherwise(config.base_ms).cast("long")


def largest_face(faces: DataFrame) -> DataFrame:
    """``media_id``, ``bbox`` of the face with the largest area, the first on a tie."""
    return faces.groupBy("media_id").agg(F.min_by("bbox", F.struct(-geometry.area(F.col("bbox")), F.col("seq"))).alias("bbox"))


def timeline(items: DataFrame, media: DataFrame, faces: DataFrame | None = None, config: TimelineConfig = TimelineConfig(), story: str = "story_id") -> DataFrame:
    """Clips of each story: ``order``, ``start_ms``, ``duration_ms``, ``transition_in`` and the frames of the pan.

    ``items`` has the story, ``media_id``, ``order``, ``role``; ``media`` has ``media_id``, ``media_type``,
    ``duration_ms``.  Items without media are left out, but keep their number.  A clip starts where those before
    it end, less one transition for each clip so far that fades in.
    """
    clips = items.join(media.select("media_id", "media_type", "duration_ms"), "media_id")
    order = W.partitionBy(story).orderBy("order")
    clips = clips.withColumn("clip_ms", duration(F.col("media_type"), F.col("duration_ms"), F.col("role"), config))
    clips = clips.withColumn("transition_in", F.when(F.col("order") == 0, "none").otherwise(config.transition))
    fades = F.sum(F.when(F.col("transition_in") != "none", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum("clip_ms").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    clips = clips.withColumn("start_ms", (before - fades * config.transition_ms).cast("long"))
    face = F.lit(None).cast("array<double>")
    if faces is not None and config.ken_burns:
        clips, face = clips.join(largest_face(faces), "media_id", "left"), F.col("bbox")
    frames = geometry.ken_burns(F.col("media_type"), face) if config.ken_burns else geometry.ken_burns(F.lit("video"), face)
    clips = clips.withColumn("frames", frames)
    return clips.select(story, "media_id", "order", "start_ms", F.col("clip_ms").alias("duration_ms"), "transition_in", F.col("frames.start").alias("kb_start"), F.col("frames.end").alias("kb_end"))
