"""Reports of used and reclaimable space, and of the folders a plan makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_year(media: DataFrame) -> DataFrame:
    """``year`` ("unknown" without a date), ``bytes``, ``n`` of ``media`` with ``created_at``, ``bytes``."""
    year = F.coalesce(F.date_format("created_at", "yyyy"), F.lit("unknown"))
    return media.groupBy(year.alias("year")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


def total(media: DataFrame) -> DataFrame:
    return media.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count("*").alias("n"))


def reclaimable(media: DataFrame, groups: DataFrame, junk: DataFrame, proxies: DataFrame) -> DataFrame:
    """One row: bytes of duplicates that are not kept, of junk and of video proxies; an item may count in more than one."""
    def size(ids: DataFrame, name: str) -> DataFrame:
        return ids.select("media_id").join(media.select("media_id", "bytes"), "media_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias(name))

    dup, poor = size(groups.where("not is_representative"), "duplicates"), size(junk, "junk")
    proxy = proxies.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("video_proxies"))
    return dup.crossJoin(poor).crossJoin(proxy)  # three one-row frames


def largest(media: DataFrame, n: int = 20) -> DataFrame:
    return media.orderBy(F.col("bytes").desc(), "media_id").limit(n)


def archive(media: DataFrame, year: str) -> DataFrame:
    """Items taken in one UTC year."""
    return media.where(F.date_format("created_at", "yyyy") == year)


def folder_counts(items: DataFrame, root: str) -> DataFrame:
    """``path`` (below ``root``, "" for the root itself), ``added``: how many of ``items`` (``to_path``) come under each folder.

    A grouped count of path prefixes: a hierarchical roll-up without collecting paths.
    """
    folder, base = F.regexp_replace("to_path", r"/[^/]*$", ""), root.rstrip("/")
    below = F.when(F.concat(folder, F.lit("/")).startswith(F.lit(base + "/")), F.substring(folder, len(base) + 1, 1 << 30)).otherwise(folder)
    parts = F.filter(F.split(below, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return items.select(F.explode(prefixes).alias("path")).groupBy("path").agg(F.count("*").alias("added"))


def folder_tree(counts: DataFrame) -> dict:
    """The nested tree of ``folder_counts`` for display: as many nodes as there are folders reach the driver, items do not."""
    root: dict = {"path": "", "added": 0, "children": []}
    nodes = {"": root}
    for r in counts.orderBy("path").toLocalIterator():
        node = nodes.setdefault(r["path"], {"path": r["path"], "added": 0, "children": []})
        node["added"] = r["added"]
        if r["path"]:
            nodes[r["path"].rpartition("/")[0]]["children"].append(node)
    return root
