"""Decoding of detector outputs and suppression of overlapping boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import geometry

IOU, MOST = 0.4, 100


def nms(boxes: DataFrame, iou_threshold: float = IOU, most: int = MOST, image: str = "image_id") -> DataFrame:
    """The boxes of each image kept in order of score: each that overlaps none kept before it by more than the threshold.

    ``boxes`` has the image, ``box_id``, ``bbox``, ``score``; ties by ``box_id``.  The choice is sequential, so
    one image's boxes (bounded by its detector's anchors) are one group.
    """
    schema = boxes.select(image, "box_id", "bbox", "score").schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True])
        kept: list[int] = []
        rects = [tuple(map(float, b)) for b in pdf["bbox"]]
        for i, (x, y, w, h) in enumerate(rects):
            if len(kept) >= most:
                break
            for j in kept:
                u, v, s, t = rects[j]
                both = max(0.0, min(x + w, u + s) - max(x, u)) * max(0.0, min(y + h, v + t) - max(y, v))
                union = w * h + s * t - both
                if both > iou_threshold * union:  # a product: a quotient rounds to the other side of the threshold
                    break
            else:
                kept.append(i)
        return pdf.iloc[kept]

    return boxes.select(image, "box_id", "bbox", "score").groupBy(image).applyInPandas(keep, schema)


def decode_anchors(outputs: DataFrame, input_w: int, input_h: int, threshold: float) -> DataFrame:
    """Boxes of a detector with one output a stride.

    ``outputs`` has ``image_id``, ``stride``, ``cls``, ``obj``, ``bbox`` (four numbers an anchor), ``kps`` (ten, or
    null), ``orig_w``, ``orig_h``; strides without ``cls``, ``obj`` or ``bbox`` are left out.  A score is the root
    of the product of both scores clamped to 0 to 1; centres are anchor plus offset times stride, sides the
    exponential times stride; axes are scaled to the image each for itself.
    """
    s = F.col("stride").cast("double")
    o = outputs.where("cls is not null and obj is not null and bbox is not null")
    o = o.withColumn("cols", F.round(F.lit(float(input_w)) / s).cast("int"))
    o = o.withColumns({"sx": F.col("orig_w") / float(input_w), "sy": F.col("orig_h") / float(input_h)})
    a = o.select("*", F.posexplode("cls").alias("idx", "c"))
    at = lambda col, k: F.element_at(col, (F.col("idx") * k[0] + k[1] + 1).cast("int")).cast("double")
    score = F.sqrt(geometry.clamp(F.col("c").cast("double"), 0, 1) * geometry.clamp(at("obj", (1, 0)), 0, 1))
    a = a.withColumn("score", score).where(F.col("score") >= threshold)
    row, col = F.floor(F.col("idx") / F.col("cols")), F.col("idx") % F.col("cols")
    cx, cy = (col + at("bbox", (4, 0))) * s, (row + at("bbox", (4, 1))) * s
    w, h = F.exp(at("bbox", (4, 2))) * s, F.exp(at("bbox", (4, 3))) * s
    rect = F.array((cx - w / 2) * F.col("sx"), (cy - h / 2) * F.col("sy"), w * F.col("sx"), h * F.col("sy"))
    marks = []
    for p in range(5):
        marks += [(col + at("kps", (10, 2 * p))) * s * F.col("sx"), (row + at("kps", (10, 2 * p + 1))) * s * F.col("sy")]
    return a.select("image_id", F.concat_ws("-", "stride", "idx").alias("box_id"), rect.alias("bbox"), "score", F.when(F.col("kps").isNotNull(), F.array(*marks)).alias("landmarks"))


def decode_rows(outputs: DataFrame, input_w: int, input_h: int, threshold: float) -> DataFrame:
    """Boxes of a detector whose output is rows of 15 numbers: box, five landmarks, score, in fitted coordinates.

    ``outputs`` has ``image_id``, ``data`` (flat), ``orig_w``, ``orig_h``.
    """
    o = outputs.withColumn("fit", geometry.letterbox(F.col("orig_w"), F.col("orig_h"), input_w, input_h))
    n = F.floor(F.size("data") / 15).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice("data", i * 15 + 1, F.lit(15)))
    r = o.where(n > 0).select("image_id", "orig_w", "orig_h", "fit", F.posexplode(rows).alias("i", "r")).where(F.col("r")[14] >= threshold)
    d = F.col("r").cast("array<double>")
    marks = [(d[4 + k] - F.col("fit")["pad_x" if k % 2 == 0 else "pad_y"]) / F.col("fit.scale") for k in range(10)]
    return r.select("image_id", F.col("i").cast("string").alias("box_id"), geometry.unletterbox(F.slice(d, 1, 4), F.col("fit"), F.col("orig_w"), F.col("orig_h")).alias("bbox"), d[14].alias("score"), F.array(*marks).alias("landmarks"))
