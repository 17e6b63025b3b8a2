"""File trees as DataFrames: scan, incremental index, probe, derived files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import media as paths
from shoebox.functions.hashing import dhash
from shoebox.sources import measures, ranged, tree


def is_online(spark: SparkSession, path: str) -> bool:
    """Whether a root's path can be reached, by the file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    except Exception:  # noqa: BLE001  an unreachable store is an offline root
        return False


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``mtime``, ``bytes``, ``media_type`` of the media files below a root; other applications' libraries are not entered."""
    tree.register(spark)
    return spark.read.format(tree.FORMAT).option("path", root).load()


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``mtime``, ``bytes``, ``content`` of the media files below a root: whole files of at most 2 GB."""
    return _files(spark, root).select(_plain(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"), "content").where(paths.media_type(F.col("path")).isNotNull())


def new_files(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned files whose path is no known ``source_ref``."""
    return scanned.join(known.select(F.col("source_ref").alias("path")), "path", "left_anti")


class MediaProbe(Protocol):
    """Reads the measures of one open file: a dict with width, height, orientation, taken_ms, lat, lng, duration_ms, gray (9 x 8)."""

    def __call__(self, path: str, file: ranged.File) -> dict[str, Any]: ...


def no_probe(path: str, file: ranged.File) -> dict[str, Any]:
    """Knows nothing of a file: what is left is its hash and its modification time."""
    return {}


MEASURES = "width int, height int, orientation int, taken_ms long, lat double, lng double, duration_ms long, gray array<int>"
PROBED = f"path string, mtime timestamp, content_hash string, {MEASURES}"


def probe(files: DataFrame, measure: MediaProbe = no_probe) -> DataFrame:
    """Media rows of files with ``path``, ``mtime``.

    A task opens each of its files where it lies, measures it by reading the ranges it needs, and hashes it chunk by
    chunk, so files of any size pass through one chunk of memory and are read once.  Rows are: the content's
    SHA-256, the dhash of a photo's 9 x 8 gray grid ("" without one or for videos), the time taken or else the modification
    time, which is uncertain.  A file that cannot be measured is indexed all the same; one that cannot be read, or is
    gone, is left out.
    """
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, mtime in zip(pdf["path"], pdf["mtime"], strict=True):
                try:
                    with ranged.File(path) as file:
                        try:
                            got = measure(path, file)
                        except Exception:  # noqa: BLE001  damaged files stay in the index
                            got = {}
                        rows.append([path, mtime, ranged.sha256(file)] + [got.get(n) for n in names])
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "mtime", "content_hash", *names])

    m = files.select("path", "mtime").mapInPandas(run, PROBED).withColumn("media_type", paths.media_type(F.col("path")))
    grid = F.when((F.col("media_type") == "photo") & (F.size("gray") == 72), dhash(F.col("gray")))
    return m.select(
        F.concat(F.lit("media-"), F.md5("path")).alias("id"), F.col("path").alias("source_ref"), "media_type", F.coalesce(F.timestamp_millis("taken_ms"), "mtime").alias("created_at"), F.col("taken_ms").isNull().alias("date_uncertain"),
        F.col("lat").alias("gps_lat"), F.col("lng").alias("gps_lng"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "duration_ms", F.coalesce("orientation", F.lit(1)).alias("orientation"),
        "content_hash", F.coalesce(grid, F.lit("")).alias("perceptual_hash"), F.lit("pending").alias("analysis_status"),
    )


def media_probe(path: str, file: ranged.File) -> dict[str, Any]:
    """Measures that a photo's or video's own bytes tell, and a photo's gray grid where an image library is installed."""
    if path.lower().endswith(paths.VIDEO_EXTENSIONS):
        return measures.video_measures(file)
    try:
        seen = image_probe(path, file)
    except Exception:  # noqa: BLE001  a picture that cannot be decoded still has its date
        seen = {}
    return seen | measures.photo_measures(file)


def image_probe(path: str, file: ranged.File) -> dict[str, Any]:
    """Measures of a photo where an image library is installed; nothing otherwise."""
    try:
        from PIL import Image
    except ImportError:
        return {}
    file.file.seek(0)
    image = Image.open(file.file)
    gray = list(image.convert("L").resize((9, 8)).getdata())
    return {"width": image.width, "height": image.height, "orientation": image.getexif().get(274, 1), "gray": gray}


def load_manifest(path: str) -> dict[str, Any] | None:
    """A model folder's ``manifest.json``; null where it is missing or malformed."""
    try:
        with open(f"{path}/manifest.json", encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def save_vectors(vectors: DataFrame, path: str) -> None:
    """A vector index as Parquet of ``id``, ``seq``, ``embedding``, sorted by id in each file."""
    vectors.select("id", "seq", "embedding").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def derive(items: DataFrame, write: Callable[[dict[str, Any]], str | None]) -> DataFrame:
    """``media_id``, ``derived_path``: a derived file (thumbnail, proxy) of each item, made inside the tasks by ``write``.

    An item whose file cannot be made is left out, so that the next run finds it again.
    """
    names = items.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    path = write(dict(zip(names, row, strict=True)))
                except Exception:  # noqa: BLE001  tried again by the next run
                    path = None
                if path:
                    out.append((row[names.index("media_id")], path))
            yield pd.DataFrame(out, columns=["media_id", "derived_path"])

    return items.mapInPandas(run, "media_id string, derived_path string")


def videos_without_proxy(media: DataFrame, limit: int = 0) -> DataFrame:
    v = media.where("media_type = 'video' and video_proxy_path is null")
    return v.limit(limit) if limit else v


def slice_of(files: DataFrame, header: Column) -> DataFrame:
    """``path``, ``status``, ``body``: the bytes that a range request asks for of files with ``path``, ``bytes``; only these are read.

    A range that cannot be served has no body.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = []
            for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"], strict=True):
                if pd.isna(start) or pd.isna(stop):
                    bodies.append(None)
                    continue
                with ranged.File(path) as file:
                    bodies.append(file.read(int(start), int(stop) - int(start) + 1))
            yield pd.DataFrame({"path": pdf["path"], "status": pdf["status"], "body": bodies})

    asked = files.select("path", paths.byte_range(header, F.col("bytes").cast("long")).alias("r")).select("path", "r.start", "r.stop", "r.status")
    return asked.mapInPandas(run, "path string, status int, body binary")
