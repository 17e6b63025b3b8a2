"""Cells of a vector space: centres fitted on a bounded sample, and the cells nearest to each vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.operators.topk import K, top_k
from shoebox.plans.lineage import cut

#: Vectors that reach the driver at most, whatever the number of rows.
SAMPLE = 20_000


def sample_vectors(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` vectors of ``rows`` at length 1, taken by the hash of their ids."""
    some = rows.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).toPandas()["v"]
    x = np.array(some.tolist(), float).reshape(len(some), -1) if len(some) else np.zeros((0, 0))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Means of ``k`` groups of points, by a few rounds from points of the sample."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(sums, near, x)
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def fit_cells(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres of the cells of a vector space, by a few rounds of spherical k-means on a sample of ``rows``.

    At most ``sample`` rows, taken by the hash of their ids, reach the driver; the number of cells is the root of the
    number of rows, and at most a sixteenth of the sample; there are none where there are no rows.
    """
    n = rows.count()
    cells = cells or max(1, min(int(n**0.5), sample // 16))
    x = sample_vectors(rows, sample)
    if not len(x):
        return x
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(held > 0, sums / np.maximum(held, 1e-12), c)
    return c


def in_cells(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Adds ``nth``, ``cell``: a row for each of the ``probes`` cells nearest to each vector, from 0.  ``centres`` are few (``fit_cells``) and go to every task."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(len(v), -1)
        return pd.Series(list(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return rows.select("*", F.posexplode(nearest(F.col("embedding").cast("array<double>"))).alias("nth", "cell"))


def probes_for(rows: DataFrame, centres: np.ndarray, k: int = K, recall: float = 0.95, sample: int = 200) -> int:
    """Cells that a query must look into to meet ``recall`` of its ``k`` nearest rows, measured against ``top_k`` for ``sample`` rows."""
    asked = cut(rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(sample))
    exact = top_k(asked, rows, k).select("query_id", F.col("id").alias("_id"))
    own = in_cells(rows.select("id", "embedding"), centres).select(F.col("id").alias("_own"), "cell")
    order = in_cells(asked.select("id", "embedding"), centres, len(centres)).select(F.col("id").alias("query_id"), "nth", "cell")
    met = exact.join(own, F.col("_id") == F.col("_own")).join(order, ["query_id", "cell"])
    last = met.agg(F.percentile("nth", recall)).first()[0]
    return int(np.ceil(last)) + 1 if last is not None else 1
