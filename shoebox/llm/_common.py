"""Small helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.plans.lineage import Scratch, shared_dir, written

__all__ = ["Scratch", "cut", "fresh", "indexed", "shared_dir", "size_bucket", "written"]

#: Rows one window or prefix-sum bucket is meant to hold; the number of buckets grows with the data.
BUCKET_ROWS = 1024


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of ``df`` has."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        out.append(n)
    return out


def size_bucket(rows: int, *cols: Column) -> Column:
    """A hash bucket so that ``rows`` rows give about BUCKET_ROWS a bucket, whatever the skew of any key."""
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, -(-rows // BUCKET_ROWS))).cast("long"))


def indexed(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Adds ``name``: a gapless index from 0 inside each ``by`` group, without putting a group in one task.

    Rows are dealt to buckets by the hash of ``order``; bucket sizes are summed first, so a task sorts one bucket
    (about BUCKET_ROWS rows) and one prefix window holds one row a bucket.  ``order`` must tell rows apart, or
    rows that tie in it must be alike.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_bucket", size_bucket(rows, *[F.col(c) for c in order]))
    sums = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_by_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(inside).cast("long"))
        .join(sums, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by] + [F.col("_bucket") == F.col("_by_bucket")])
        .withColumn(name, F.col("_before") + F.col("_rank") - 1)
        .drop("_bucket", "_rank", "_before", "_by_bucket", *[f"_by_{c}" for c in by])
    )
