"""Changes merged into catalogue tables: each is one join per batch, and the result is written where the caller likes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()


def _same(keys: Sequence[str]) -> list:
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def remove(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``gone``; a null key is a key like others."""
    return table.join(_on(gone, keys), _same(keys), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` are added and take the place of rows with the same key; columns they lack are null.

    Keys are unique in ``rows``: a batch that repeats one is reduced by ``last`` first.
    """
    return remove(table, rows, keys).unionByName(rows, allowMissingColumns=True)


def last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, as one grouped maximum that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def patch(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The other columns of ``changes`` are set (to null too) in the rows with their key; changes without a row add nothing."""
    new = [c for c in changes.columns if c not in keys]
    c = changes.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(n).alias(f"_new_{n}") for n in new], F.lit(True).alias("_there"))
    out = table.join(c, _same(keys), "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_new_{n}")).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in table.columns])


def replace_part(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents that ``rows`` name give way to ``rows``."""
    return remove(table, rows, [parent]).unionByName(rows, allowMissingColumns=True)


def upsert_timelines(timelines: DataFrame, clips: DataFrame, new: DataFrame, new_clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A story has one timeline: ``new`` ones take the place of their stories' (``id``, ``story_id``), and all clips of the old and new ones give way to ``new_clips`` (``timeline_id``)."""
    old = timelines.join(_on(new, ["story_id"]), _same(["story_id"]), "left_semi").select("id").unionByName(new.select("id"))
    kept = remove(clips, old.select(F.col("id").alias("timeline_id")), ["timeline_id"])
    return replace_part(timelines, new, "story_id"), kept.unionByName(new_clips, allowMissingColumns=True)


def upsert_media(media: DataFrame, rows: DataFrame) -> DataFrame:
    """Media replace those with the same id and those with the same path."""
    return remove(remove(media, rows, ["id"]), rows, ["source_ref"]).unionByName(rows, allowMissingColumns=True)


def reset_analysis(media: DataFrame) -> DataFrame:
    """Media as before any analysis: pending, with their paths, hashes and times."""
    return media.withColumn("analysis_status", F.lit("pending"))


def encoded(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays and structs as JSON text, for stores that hold text only."""
    return df.withColumns({c: F.to_json(c) for c in columns})


def decoded(df: DataFrame, **types: str) -> DataFrame:
    """JSON text as columns of the given types; null where it is malformed."""
    return df.withColumns({c: F.from_json(c, t) for c, t in types.items()})
