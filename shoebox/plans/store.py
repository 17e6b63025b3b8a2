"""Reads of catalogue tables: logs as their latest rows, pages, picks by status, parents with their children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's last row of a log with ``_step``, ``_at``; ``seq`` numbers the key's first one."""
    last = W.partitionBy(*keys).orderBy(F.col("_step").desc(), F.col("_at").desc())
    first = F.min(F.struct("_step", "_at")).over(W.partitionBy(*keys))
    out = log.withColumns({"_first": first, "_r": F.row_number().over(last)}).where("_r = 1")
    return out.withColumn("seq", F.col("_first")).drop("_first", "_r", "_step", "_at")


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows after ``offset`` in an order that tells rows apart; a limit of 0 is none."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def cursor_page(rows: DataFrame, key: str, identity: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The ``limit`` rows that follow a cursor in descending order of ``key``, then ascending of ``identity``, which tells rows apart.

    ``after`` is the last row's (key, identity), or none for the first page; a null key comes last.  Rows up to the cursor are filtered
    by value, not skipped by count: the filter reaches the scan, and each task keeps ``limit`` rows.  Every row has
    ``next_cursor``, a struct of the page's last key and identity, null where nothing follows.
    """
    k, i = F.col(key), F.col(identity)
    if after is not None:
        at, last = (F.lit(x).cast(rows.schema[c].dataType) for x, c in zip(after, (key, identity), strict=True))
        rows = rows.where(k.isNull() & (i > last)) if after[0] is None else rows.where((k < at) | k.isNull() | ((k == at) & (i > last)))
    some = rows.orderBy(k.desc_nulls_last(), i).limit(limit + 1)  # one row more tells whether another page follows
    whole = W.orderBy(k.desc_nulls_last(), i)
    ranked = some.withColumns({"_r": F.row_number().over(whole), "_n": F.count("*").over(W.partitionBy())})
    cursor = F.struct(k.alias("key"), i.alias("identity"))
    end = F.max(F.when(F.col("_r") == limit, cursor)).over(W.partitionBy())
    return ranked.withColumn("next_cursor", F.when(F.col("_n") > limit, end)).where(F.col("_r") <= limit).drop("_r", "_n")


def by_status(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; none for no values."""
    return rows.where(F.col(column).isin(*values)) if values else rows.limit(0)


def nested(parents: DataFrame, children: DataFrame, on: str, name: str, order: Sequence[str]) -> DataFrame:
    """Parents with their children as a sorted array; a parent without children has an empty one."""
    rest = [c for c in children.columns if c != on and c not in order]
    many = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    out = parents.join(many, on, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))
