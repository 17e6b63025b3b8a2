"""The nearest rows to each query by blocks that meet one by one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, BLOCK = 10, 2048


def top_k(query: DataFrame, rows: DataFrame, k: int = K, block: int = BLOCK, earlier_only: bool = False) -> DataFrame:
    """``query_id``, ``id``, ``distance``, ``rank``: the ``k`` rows nearest to each query by cosine distance, then by ``seq``.

    Both inputs have ``id``, ``seq``, ``embedding``; a row is not its own neighbour.  Exact: blocks of about
    ``block`` vectors meet block by block, one matrix product a pair, and each pair hands on k rows a query.
    ``earlier_only`` keeps rows with a smaller ``seq``.
    """
    n_q, n_r = max(1, -(-query.count() // block)), max(1, -(-rows.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = query.select("id", "seq", F.col("embedding").cast("array<double>").alias("v"), deal(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("rb"))
    r = rows.select(F.col("id").alias("rid"), F.col("seq").alias("rseq"), F.col("embedding").cast("array<double>").alias("rv"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("rqb"), deal(n_r).alias("rrb"))
    id_type = query.schema["id"].dataType.simpleString()
    seq_type = rows.schema["seq"].dataType.simpleString()

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "seq": [], "distance": []}
        if len(a) and len(b):
            x, y = np.array(a["v"].tolist(), float), np.array(b["rv"].tolist(), float)
            length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            d = np.where(length == 0, 1.0, 1 - x @ y.T / np.where(length == 0, 1.0, length))
            other = a["id"].to_numpy()[:, None] != b["rid"].to_numpy()[None, :]
            if earlier_only:
                other &= b["rseq"].to_numpy()[None, :] < a["seq"].to_numpy()[:, None]
            seq = b["rseq"].to_numpy()
            for i in range(len(a)):
                at = np.flatnonzero(other[i])
                at = at[np.lexsort((seq[at], d[i, at]))[:k]]
                out["query_id"] += [a["id"].iloc[i]] * len(at)
                out["id"] += b["rid"].iloc[at].tolist()
                out["seq"] += seq[at].tolist()
                out["distance"] += d[i, at].tolist()
        return pd.DataFrame(out, dtype=object)

    met = q.groupBy("qb", "rb").cogroup(r.groupBy("rqb", "rrb")).applyInPandas(near, f"query_id {id_type}, id {id_type}, seq {seq_type}, distance double")
    best = W.partitionBy("query_id").orderBy("distance", "seq")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("seq")
