"""Boxes ``[x, y, w, h]`` as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = (0.0, 0.0, 1.0, 1.0)
# Fixed values of the pan and zoom: frame around a face, its smallest side, the frame without a face.
FACE_PAD, LEAST_SIDE, CENTER = 1.6, 0.3, (0.08, 0.08, 0.84, 0.84)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*[c.cast("double") for c in (x, y, w, h)])


def area(b: Column) -> Column:
    return b[2] * b[3]


def clamp(v: Column, low: float | Column, high: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(lit(low), F.least(lit(high), v))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i]))
    both = side(0) * side(1)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def letterbox(src_w: Column, src_h: Column, w: float, h: float) -> Column:
    """``new_w``, ``new_h``, ``pad_x``, ``pad_y``, ``scale`` of an image fitted into w x h with its aspect kept."""
    scale = F.least(F.lit(float(w)) / src_w, F.lit(float(h)) / src_h)
    new_w, new_h = F.floor(src_w * scale + 0.5), F.floor(src_h * scale + 0.5)
    return F.struct(new_w.cast("int").alias("new_w"), new_h.cast("int").alias("new_h"), F.floor((w - new_w) / 2).cast("int").alias("pad_x"), F.floor((h - new_h) / 2).cast("int").alias("pad_y"), scale.alias("scale"))


def unletterbox(b: Column, fitted: Column, src_w: Column, src_h: Column) -> Column:
    """A box in fitted coordinates back in those of the image, clamped to it."""
    scale, w, h = fitted["scale"], src_w.cast("double"), src_h.cast("double")
    return F.array(clamp((b[0] - fitted["pad_x"]) / scale, 0, w), clamp((b[1] - fitted["pad_y"]) / scale, 0, h), clamp(b[2] / scale, 0, w), clamp(b[3] / scale, 0, h))


def ken_burns(kind: Column, face: Column) -> Column:
    """``start`` and ``end`` frames of a clip: a video stays, a photo zooms to its face (null: none) or a little."""
    full = F.array(*map(F.lit, FULL))
    w, h = clamp(face[2] * FACE_PAD, 0, 1), clamp(face[3] * FACE_PAD, 0, 1)
    x, y = clamp(face[0] + face[2] / 2 - w / 2, 0, 1), clamp(face[1] + face[3] / 2 - h / 2, 0, 1)
    near = F.array(x, y, F.greatest(F.lit(LEAST_SIDE), w), F.greatest(F.lit(LEAST_SIDE), h))
    end = F.when(kind == "video", full).when(face.isNotNull(), near).otherwise(F.array(*map(F.lit, CENTER)))
    return F.struct(full.alias("start"), end.alias("end"))
