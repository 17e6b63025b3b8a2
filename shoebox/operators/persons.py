"""Persons, feedback on their faces, and clustering under that feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.operators.neighbors import THRESHOLD, centroids, nearest_anchor


def faces_by_cluster(faces: DataFrame) -> DataFrame:
    """``cluster_id``, ``cover_face_id`` (the first face), ``n_faces``."""
    return faces.where("cluster_id <> ''").groupBy("cluster_id").agg(F.min_by("face_id", F.struct("seq", "face_id")).alias("cover_face_id"), F.count("*").alias("n_faces"))


def sync_persons(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """New person rows for clusters that no person, merged ones included, has."""
    new = faces_by_cluster(faces).join(persons.select("cluster_id"), "cluster_id", "left_anti")
    return new.select(F.concat(F.lit("person-"), "cluster_id").alias("person_id"), "cluster_id", F.lit(None).cast("string").alias("display_name"), "cover_face_id", F.lit(False).alias("is_favorite"), F.lit(False).alias("confirmed"), F.lit(None).cast("string").alias("merged_into"))


def list_persons(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Active persons with ``photo_count`` and the picture of their cover face (else of the cluster's first face), most photos first."""
    active = persons.where("merged_into is null")
    counts = faces.where("cluster_id <> ''").groupBy("cluster_id").agg(F.countDistinct("media_id").alias("photos"), F.min_by("media_id", F.struct("seq", "face_id")).alias("first_media"))
    cover = faces.select(F.col("face_id").alias("cover_face_id"), F.col("media_id").alias("cover_media"))
    out = active.join(counts, "cluster_id", "left").join(cover, "cover_face_id", "left")
    return out.select("person_id", "cluster_id", "display_name", F.coalesce("photos", F.lit(0)).alias("photo_count"), F.coalesce("cover_media", "first_media").alias("cover_media_id")).orderBy(F.col("photo_count").desc(), "person_id")


def unnamed(persons: DataFrame) -> DataFrame:
    return persons.where("display_name is null or display_name = ''")


def merge_persons(persons: DataFrame, faces: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """``source`` is hidden behind ``target`` and its faces go to the target's cluster: (persons, faces)."""
    clusters = persons.where(F.col("person_id").isin(source, target)).groupBy().agg(F.max(F.when(F.col("person_id") == source, F.col("cluster_id"))).alias("_from"), F.max(F.when(F.col("person_id") == target, F.col("cluster_id"))).alias("_to"))
    moved = faces.crossJoin(F.broadcast(clusters)).withColumn("cluster_id", F.when(F.col("cluster_id") == F.col("_from"), F.col("_to")).otherwise(F.col("cluster_id"))).drop("_from", "_to")
    return persons.withColumn("merged_into", F.when(F.col("person_id") == source, target).otherwise(F.col("merged_into"))), moved


def fold_verdicts(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feedback log folded in time: (``face_id``, ``person_id`` confirmed; ``face_id``, ``person_id`` rejected).

    ``feedback`` has ``face_id``, ``person_id``, ``verdict``, ``created_ms``, ``seq``.  The last confirmation of a
    face holds unless a later rejection names the same person; a pair is rejected if its last verdict says so.
    """
    at = F.struct("created_ms", "seq")
    confirmed = feedback.where("verdict = 'confirm'").groupBy("face_id").agg(F.max_by("person_id", at).alias("person_id"), F.max(at).alias("at"))
    last = feedback.groupBy("face_id", "person_id").agg(F.max_by("verdict", at).alias("verdict"), F.max(at).alias("last"))
    rejected = last.where("verdict <> 'confirm'")
    later = rejected.select("face_id", "person_id", "last")
    holds = confirmed.join(later, ["face_id", "person_id"], "left").where("last is null or last < at").select("face_id", "person_id")
    return holds, rejected.select("face_id", "person_id")


def resolve_merged(feedback: DataFrame, persons: DataFrame) -> DataFrame:
    """Feedback on a person that was merged away counts for the person it went to."""
    to = persons.where("merged_into is not null").select(F.col("person_id").alias("_p"), "merged_into")
    return feedback.join(to, F.col("person_id") == F.col("_p"), "left").withColumn("person_id", F.coalesce("merged_into", "person_id")).drop("_p", "merged_into")


def recluster(faces: DataFrame, persons: DataFrame, feedback: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``face_id``, ``cluster_id``, ``rule``: clusters that keep to the feedback.

    In order: the confirmed person's cluster; that of the nearest person who is not rejected, within
    ``threshold``; the present cluster unless its owner is rejected; a cluster of the face's own.  A person's
    centroid is of the confirmed faces, else of the present members that are not rejected.  ``faces`` has
    ``face_id``, ``embedding``, ``cluster_id``; ``persons`` has ``person_id``, ``cluster_id``, ``seq``.
    """
    confirmed, rejected = fold_verdicts(feedback)
    p = persons.select("person_id", F.col("cluster_id").alias("person_cluster"), "seq")
    by_confirm = faces.join(confirmed, "face_id").select("person_id", "embedding")
    own = faces.join(p, F.col("cluster_id") == F.col("person_cluster")).join(rejected, ["face_id", "person_id"], "left_anti")
    members = own.join(by_confirm.select("person_id").distinct(), "person_id", "left_anti").select("person_id", "embedding")
    anchors = centroids(by_confirm.unionByName(members), "person_id").join(p, "person_id")
    near = nearest_anchor(faces, anchors, rejected, threshold).join(p.select("person_id", F.col("person_cluster").alias("near_cluster")), "person_id").select("face_id", "near_cluster")
    must = confirmed.join(p, "person_id").select("face_id", F.col("person_cluster").alias("must_cluster"))
    owner = W.partitionBy("person_cluster").orderBy(F.col("seq").desc())
    owners = p.withColumn("_r", F.row_number().over(owner)).where("_r = 1").select(F.col("person_cluster").alias("cluster_id"), F.col("person_id").alias("owner"))
    banned = rejected.select("face_id", F.col("person_id").alias("owner"), F.lit(True).alias("banned"))
    f = faces.select("face_id", "cluster_id").join(must, "face_id", "left").join(near, "face_id", "left").join(owners, "cluster_id", "left").join(banned, ["face_id", "owner"], "left")
    stay = F.when(F.col("banned").isNull(), F.nullif(F.col("cluster_id"), F.lit("")))
    rule = F.when(F.col("must_cluster").isNotNull(), "confirmed").when(F.col("near_cluster").isNotNull(), "nearest").when(stay.isNotNull(), "kept").otherwise("new")
    return f.select("face_id", F.coalesce("must_cluster", "near_cluster", stay, F.concat(F.lit("cluster-"), F.col("face_id").cast("string"))).alias("cluster_id"), rule.alias("rule"))
