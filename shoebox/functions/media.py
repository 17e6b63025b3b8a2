"""Predicates and parts of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the media types, marks of other applications' libraries, the Japanese word for screenshot.
PHOTO_EXTENSIONS = (".jpg", ".jpeg", ".png", ".heic", ".heif", ".webp", ".gif", ".tif", ".tiff", ".bmp", ".dng")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".m4v", ".avi", ".mkv", ".webm", ".3gp")
MANAGED_MARKS = (".photoslibrary", ".photolibrary", "lightroom", ".aplibrary")
MANAGED_ENDING = ".lrcat"
SCREENSHOT_JA = "スクリーンショット"


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """The extension with its dot, lower-cased; a leading dot makes no extension."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    """The base name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def media_type(path: Column) -> Column:
    """"photo", "video" or null by extension."""
    ext = extension(path)
    return F.when(ext.isin(*PHOTO_EXTENSIONS), "photo").when(ext.isin(*VIDEO_EXTENSIONS), "video")


def managed_by_other_app(path: Column) -> Column:
    low = F.lower(path)
    out = low.endswith(MANAGED_ENDING)
    for mark in MANAGED_MARKS:
        out = out | low.contains(mark)
    return out


def is_screenshot(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.contains("screenshot") | name.contains("screen shot") | name.startswith(SCREENSHOT_JA)


def under(path: Column, base: Column) -> Column:
    """Whether a normalised path lies strictly below a folder; paths with ``..`` never do."""
    return path.startswith(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def shorten(path: Column, most: int = 42, tail: int = 40) -> Column:
    return F.when(F.length(path) > most, F.concat(F.lit("…"), F.substring(path, -tail, tail))).otherwise(path)


def format_bytes(n: Column) -> Column:
    """"0 B", "1.5 KB" and so on, up to TB."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    i = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(4)).cast("int")
    value = F.format_string("%.1f", n / F.pow(F.lit(1024.0), i))
    return F.when(n <= 0, "0 B").otherwise(F.concat(value, F.lit(" "), F.element_at(units, i + 1)))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done * 100 / total)).otherwise(0).cast("int")


def bearer_token(header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, r"^Bearer (.+)$", 1), F.lit(""))


def byte_range(header: Column, size: Column) -> Column:
    """``start``, ``stop`` (inclusive) and ``status`` (200, 206 or 416) of a request for a file of ``size`` bytes."""
    first, last = (F.regexp_extract(header, r"bytes=(\d*)-(\d*)", g) for g in (1, 2))
    ranged = F.coalesce(header.rlike(r"bytes=\d*-\d*"), F.lit(False))
    start = F.when(first != "", first.cast("long")).otherwise(F.lit(0))
    stop = F.when(last != "", last.cast("long")).otherwise(size - 1)
    bad = (start >= size) | (stop >= size) | (start > stop)
    return F.struct(
        F.when(ranged & ~bad, start).when(~ranged, 0).cast("long").alias("start"),
        F.when(ranged & ~bad, stop).when(~ranged, size - 1).cast("long").alias("stop"),
        F.when(~ranged, 200).when(bad, 416).otherwise(206).alias("status"),
    )


def chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size``."""
    n = F.ceil(F.size(items) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(items), 1, 0))
