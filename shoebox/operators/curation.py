"""Event sessions and the stories made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.functions.naming import MEMORIES, event_title, given

GAP_MS, HEROES, LEAST_PHOTOS = 6 * 3600 * 1000, 3, 5


def sessions(media: DataFrame, gap_ms: int = GAP_MS, library: str = "library_id") -> DataFrame:
    """Adds ``event_no`` (from 1) and ``position`` (from 0) to dated ``media`` of each library.

    A new event begins after a gap of more than ``gap_ms`` or where this and the previous item have places that
    differ.  ``media`` has ``media_id``, ``created_ms``, ``place``, ``seq``; libraries are the unit of work, so
    windows never cross one.
    """
    order = W.partitionBy(library).orderBy("created_ms", "seq")
    m = media.where("created_ms is not null").withColumns({"_prev": F.lag("created_ms").over(order), "_place": F.lag("place").over(order)})
    moved = given(F.col("place")).isNotNull() & given(F.col("_place")).isNotNull() & (F.col("place") != F.col("_place"))
    new = F.when(F.col("_prev").isNull() | (F.col("created_ms") - F.col("_prev") > gap_ms) | moved, 1).otherwise(0)
    m = m.withColumn("_new", new).withColumn("event_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return m.withColumn("position", F.row_number().over(W.partitionBy(library, "event_no").orderBy("created_ms", "seq")) - 1).drop("_prev", "_place", "_new")


def story_items(events: DataFrame, quality: DataFrame, heroes: int = HEROES, by: tuple[str, ...] = ("library_id", "event_no")) -> DataFrame:
    """Adds ``composite``, ``hero_rank`` and ``role`` (hero for the best, support for the rest; ties in time order)."""
    e = events.join(quality.select("media_id", "composite"), "media_id", "left").withColumn("composite", F.coalesce("composite", F.lit(0.0)))
    best = W.partitionBy(*by).orderBy(F.col("composite").desc(), "position")
    return e.withColumn("hero_rank", F.row_number().over(best)).withColumn("role", F.when(F.col("hero_rank") <= heroes, "hero").otherwise("support"))


def common_place(events: DataFrame, by: tuple[str, ...] = ("library_id", "event_no")) -> DataFrame:
    """``place`` of most items of each event, the first seen on a tie; events without places are left out."""
    counts = events.where("place <> ''").groupBy(*by, "place").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return counts.groupBy(*by).agg(F.min_by("place", F.struct(-F.col("n"), F.col("first"))).alias("place"))


def stories(items: DataFrame, by: tuple[str, ...] = ("library_id", "event_no")) -> DataFrame:
    """One row a story of ``story_items``: ``start_ms``, ``end_ms``, ``n_items``, ``cover_id``, ``place``, ``title``."""
    head = items.groupBy(*by).agg(F.min("created_ms").alias("start_ms"), F.max("created_ms").alias("end_ms"), F.count("*").alias("n_items"), F.max(F.when(F.col("hero_rank") == 1, F.col("media_id"))).alias("cover_id"))
    out = head.join(common_place(items, by), list(by), "left")
    return out.withColumn("title", event_title(F.timestamp_millis("start_ms"), F.col("place"), F.col("n_items")))


def person_stories(faces: DataFrame, persons: DataFrame, media: DataFrame, quality: DataFrame, least: int = LEAST_PHOTOS, heroes: int = HEROES) -> tuple[DataFrame, DataFrame]:
    """Stories of named, active persons with at least ``least`` pictures: (stories, their items).

    ``faces`` has ``media_id``, ``cluster_id``; ``persons`` has ``person_id``, ``cluster_id``, ``display_name``,
    ``merged_into``; ``media`` has ``media_id``, ``created_ms``, ``seq``.
    """
    named = persons.where("merged_into is null and display_name <> ''").select("person_id", "cluster_id", "display_name")
    shown = faces.where("cluster_id <> ''").groupBy("cluster_id", "media_id").agg(F.min("seq").alias("face_seq"))
    members = named.join(shown, "cluster_id").join(media.select("media_id", "created_ms"), "media_id")
    order = W.partitionBy("person_id").orderBy(F.coalesce("created_ms", F.lit(0)), "face_seq", "media_id")
    members = members.withColumns({"n": F.count("*").over(W.partitionBy("person_id")), "position": F.row_number().over(order) - 1}).where(F.col("n") >= least)
    items = story_items(members, quality, heroes, ("person_id",))
    ends = items.groupBy("person_id", "display_name").agg(F.min_by("created_ms", "position").alias("start_ms"), F.max_by("created_ms", "position").alias("end_ms"), F.count("*").alias("n_items"), F.max(F.when(F.col("hero_rank") == 1, F.col("media_id"))).alias("cover_id"))
    return ends.withColumn("title", F.concat("display_name", F.lit(MEMORIES))), items
