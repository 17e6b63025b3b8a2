"""The model port: faces, embeddings and quality scores of pictures, and the pixel work around models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions.quality import MOCK_WEIGHTS

DIM = 512
# Offset and prime of the FNV-1a hash, increment of the generator, its constant for scores.
FNV_OFFSET, FNV_PRIME, STEP, SCORE_SEED = 2166136261, 16777619, 0x6D2B79F5, 0x9E3779B9
_M32 = 0xFFFFFFFF


class ModelAdapter(Protocol):
    def faces(self, image: bytes) -> list[dict[str, Any]]: ...

    def embed(self, image: bytes, face: dict[str, Any]) -> np.ndarray: ...

    def quality(self, image: bytes) -> dict[str, float]: ...


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & _M32
    return h


def uniform(seed: int) -> Iterator[float]:
    """A fixed sequence of numbers in [0, 1) from 32-bit integer arithmetic."""
    a = seed & _M32
    while True:
        a = (a + STEP) & _M32
        t = ((a ^ (a >> 15)) * (a | 1)) & _M32
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & _M32)) & _M32) ^ t
        yield (t ^ (t >> 14)) / 4294967296


class MockModel:
    """Made-up but fixed answers from a picture's bytes, for work without models."""

    def faces(self, image: bytes) -> list[dict[str, Any]]:
        r = uniform(fnv1a(image))
        out = []
        for _ in range(int(next(r) * 3)):
            box = [next(r), next(r), 0.2 + next(r) * 0.2, 0.2 + next(r) * 0.2]
            out.append({"bbox": box, "quality": 0.5 + next(r) * 0.5, "eyes_open": next(r) > 0.2})
        return out

    def embed(self, image: bytes, face: dict[str, Any]) -> np.ndarray:
        r = uniform(fnv1a(image) ^ int(face["bbox"][0] * 1e6))
        v = np.array([next(r) * 2 - 1 for _ in range(DIM)], np.float32)
        return v / (np.sqrt(float((v.astype(float) ** 2).sum())) or 1.0)

    def quality(self, image: bytes) -> dict[str, float]:
        r = uniform(fnv1a(image) ^ SCORE_SEED)
        parts = [next(r) for _ in range(4)]
        return dict(zip(("sharpness", "exposure", "composition", "eyes_open"), parts, strict=True)) | {"composite": sum(p * w for p, w in zip(parts, MOCK_WEIGHTS, strict=True))}


def choose(manifest: dict[str, Any] | None, load: Callable[[dict[str, Any]], ModelAdapter] | None = None) -> Callable[[], ModelAdapter]:
    """A maker of the adapter for workers: that of the manifest's models where they can be loaded, else the mock."""
    if manifest and load and manifest.get("faceDetector") and manifest.get("faceEmbedder"):
        return lambda: load(manifest)
    return MockModel


ANALYSIS = "media_id string, status string, faces array<struct<bbox:array<double>,quality:double,eyes_open:boolean,embedding:array<float>>>, score struct<sharpness:double,exposure:double,composition:double,eyes_open:double,composite:double>"


def analyze(pictures: DataFrame, make: Callable[[], ModelAdapter] = MockModel) -> DataFrame:
    """``media_id``, ``status`` (done or failed), ``faces``, ``score`` of rows with ``media_id``, ``content``.

    The adapter is made once a task and used for all its batches; a picture on which it fails is marked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rows = []
            for media_id, content in zip(pdf["media_id"], pdf["content"], strict=True):
                try:
                    image = bytes(content)
                    faces = [f | {"embedding": model.embed(image, f).tolist()} for f in model.faces(image)]
                    rows.append((media_id, "done", faces, model.quality(image)))
                except Exception:  # noqa: BLE001  one bad picture does not stop the rest
                    rows.append((media_id, "failed", [], None))
            yield pd.DataFrame(rows, columns=["media_id", "status", "faces", "score"])

    return pictures.select("media_id", "content").mapInPandas(run, ANALYSIS)


def face_rows(analyzed: DataFrame) -> DataFrame:
    """One row a face of ``analyze``, with a fixed ``face_id``."""
    return analyzed.where("status = 'done'").select("media_id", F.posexplode("faces").alias("i", "f")).select(F.concat_ws("-", F.lit("face"), "media_id", "i").alias("face_id"), "media_id", "f.*")


def laplacian_variance(gray: np.ndarray) -> float:
    """Population variance of the 3 x 3 Laplacian, clamped to what a byte holds, as image libraries give it."""
    g = gray.astype(float)
    p = np.pad(g, 1, mode="edge")
    r = np.clip(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g, 0, 255)
    return float(r.var())


def sharpness(grids: DataFrame, column: str, width: int, height: int) -> DataFrame:
    """Adds ``variance``, ``laplacian_variance`` of each row's grid of gray values, ``width`` x ``height`` row by row; null for another size."""

    @F.pandas_udf("double")
    def variance(values: pd.Series) -> pd.Series:
        whole = (np.asarray(v) if v is not None and len(v) == width * height else None for v in values)
        return pd.Series([None if v is None else laplacian_variance(v.reshape(height, width)) for v in whole], dtype=float)

    return grids.withColumn("variance", variance(F.col(column)))


def input_tensor(pixels: np.ndarray, order: str = "rgb", mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    """Height x width x RGB bytes as three planes in the model's colour order, each value less ``mean`` by ``std``."""
    planes = pixels.transpose(2, 0, 1).astype(np.float32)
    return (planes[::-1] if order == "bgr" else planes) - np.float32(mean) if std == 1.0 else ((planes[::-1] if order == "bgr" else planes) - np.float32(mean)) / np.float32(std)


def resize(pixels: np.ndarray, w: int, h: int, fit: str = "fill") -> np.ndarray:
    """Nearest pixels of an image at w x h: stretched, or kept in shape on black."""
    sh, sw = pixels.shape[:2]
    if fit == "fill":
        return pixels[(np.arange(h) * sh // h)[:, None], (np.arange(w) * sw // w)[None, :]]
    scale = min(w / sw, h / sh)
    nw, nh = int(sw * scale + 0.5), int(sh * scale + 0.5)
    out = np.zeros((h, w, pixels.shape[2]), pixels.dtype)
    y, x = (h - nh) // 2, (w - nw) // 2
    out[y : y + nh, x : x + nw] = resize(pixels, nw, nh)
    return out


def crop(pixels: np.ndarray, bbox: list[float]) -> np.ndarray:
    """A face's pixels, the box clamped to the image and at least one pixel wide."""
    h, w = pixels.shape[:2]
    x, y = max(0, min(w - 1, int(bbox[0] + 0.5))), max(0, min(h - 1, int(bbox[1] + 0.5)))
    return pixels[y : y + max(1, min(h - y, int(bbox[3] + 0.5))), x : x + max(1, min(w - x, int(bbox[2] + 0.5)))]


def output_named(outputs: dict[str, Any], kind: str, stride: int) -> Any | None:
    """A detector's output by kind and stride: the exact name, else the first that has both."""
    if f"{kind}_{stride}" in outputs:
        return outputs[f"{kind}_{stride}"]
    s = str(stride)
    return next((o for n, o in outputs.items() if kind in n.lower() and (n.endswith(s) or f"_{s}" in n or f"{s}_" in n)), None)
