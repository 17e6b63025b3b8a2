"""Nearest neighbours of vectors and the clusters they make."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.functions.vectors import cosine_distance
from shoebox.operators.cells import fit_cells, in_cells, probes_for
from shoebox.operators.graph import components
from shoebox.operators.metric import within
from shoebox.operators.topk import top_k

K, THRESHOLD = 10, 0.35


def approximate_top_k(query: DataFrame, rows: DataFrame, k: int = K, centres: np.ndarray | None = None, probes: int | None = None) -> DataFrame:
    """``query_id``, ``id``, ``distance``, ``rank`` like ``top_k``, looked for in each query's ``probes`` nearest cells only.

    Every row is indexed: it lies in the cell of its nearest centre.  Queries meet the rows of their cells in a
    shuffled join, and each task keeps ``k`` rows of a query before the last shuffle.  Recall grows with ``probes``,
    which ``probes_for`` measures where they are not given; with as many as there are cells the result is exact.
    """
    centres = fit_cells(rows) if centres is None else centres
    probes = probes_for(rows, centres, k) if probes is None else probes
    q = in_cells(query.select("id", F.col("embedding").cast("array<double>").alias("embedding")), centres, probes).select(F.col("id").alias("query_id"), F.col("embedding").alias("asked"), "cell")
    r = in_cells(rows.select("id", "seq", F.col("embedding").cast("array<double>").alias("embedding")), centres)
    met = q.join(r.hint("merge"), "cell").where("id <> query_id").select("query_id", "id", "seq", cosine_distance(F.col("asked"), F.col("embedding")).alias("distance"))
    best = W.partitionBy("query_id").orderBy("distance", "seq")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("seq")


def cluster_faces(faces: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """``node``, ``component``: faces linked to those of their ``k`` nearest earlier faces that are within ``threshold``.

    Order matters: a face links only to faces before it in ``seq``, and only to the k nearest of all of them.
    """
    near = within(faces, faces, threshold, k, earlier_only=True) if threshold < 1 else top_k(faces, faces, k, earlier_only=True).where(F.col("distance") <= threshold)
    return components(faces.select("id"), near.select(F.col("query_id").alias("a"), F.col("id").alias("b")), "id")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """``by``, ``centroid``: the mean of each group's vectors at length 1 (a mean without length stays)."""
    parts = vectors.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    mean = whole.select(by, F.transform("p", lambda s: s["m"]).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(by, F.transform("mean", lambda x: x / F.when(length == 0, 1.0).otherwise(length)).alias("centroid"))


def nearest_anchor(faces: DataFrame, anchors: DataFrame, rejected: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``face_id``, ``person_id``, ``distance`` of the nearest allowed anchor within ``threshold`` (below 1), the earlier one on a tie.

    ``anchors`` (``person_id``, ``seq``, ``centroid``) are one row a person; ``rejected`` has ``face_id``,
    ``person_id``.  Faces meet only the anchors that metric bounds leave in reach (``metric.within``).
    """
    f = faces.select(F.col("face_id").alias("id"), "embedding")
    a = anchors.select(F.col("person_id").alias("id"), "seq", F.col("centroid").alias("embedding"))
    no = None if rejected is None else rejected.select(F.col("face_id").alias("query_id"), F.col("person_id").alias("id"))
    near = within(f, a, threshold, 1, banned=no, own=True)
    return near.select(F.col("query_id").alias("face_id"), F.col("id").alias("person_id"), "distance")
