"""Duplicate groups kept up to date batch by batch: hashes are looked up in a stored index, components are folded in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import hashing
from shoebox.operators.dedup import MAX_HAMMING
from shoebox.operators.graph import fold, resolved
from shoebox.operators.hash_index import HashIndex, code
from shoebox.plans.lineage import cut, delete

PARTS = 32


class Duplicates:
    """Groups of equal and nearly equal media under a folder.

    Media and hashes are the nodes of one graph: a medium is linked to its content hash and to its perceptual hash, and perceptual hashes
    at most ``max_hamming`` bits apart to each other.  A flat picture's very many copies cost one link each.  A batch
    meets the hash index and the names of the components it touches; nothing else of what is stored is compared.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, max_hamming: int = MAX_HAMMING):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = HashIndex(spark, f"{self.path}/hashes", name or f"hashes_{uuid.uuid4().hex}", max_hamming, PARTS)
        for table, columns in (("labels", "node string, label string"), ("roots", "label string, root string, part int")):
            if not self._exists(table):
                out = spark.createDataFrame([], columns).write
                (out.partitionBy("part") if "part" in columns else out).parquet(f"{self.path}/{table}")

    def _exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def labels(self) -> DataFrame:
        return self.spark.read.schema("node string, label string").parquet(f"{self.path}/labels")

    def roots(self) -> DataFrame:
        return self.spark.read.schema("label string, root string, part int").parquet(f"{self.path}/roots")

    def fold(self, media: DataFrame) -> None:
        """Adds media (``id``, ``content_hash``, ``perceptual_hash``); a batch that is run twice changes nothing more."""
        m = cut(media.select(F.col("id"), F.nullif("content_hash", F.lit("")).alias("content_hash"), F.when(F.length("perceptual_hash") == hashing.DIGITS, F.col("perceptual_hash")).alias("hash")))
        self.index.add(m.where("hash is not null").select("id", "hash"))
        name = lambda c: F.concat(F.lit("~near "), c.cast("string"))  # noqa: E731  after all ids that begin with a letter or digit
        edges = m.select(F.col("id").alias("a"), F.coalesce(F.concat(F.lit("~same "), "content_hash"), "id").alias("b"))
        edges = edges.unionByName(m.where("hash is not null").select(F.col("id").alias("a"), name(code(F.col("hash"))).alias("b")))
        near = self.index.near_codes(m.where("hash is not null").select(code(F.col("hash")).alias("code"))).where("query_code <> code")
        edges = edges.unionByName(near.select(name(F.col("query_code")).alias("a"), name(F.col("code")).alias("b")))
        new, moved = fold(self.labels(), self.roots().drop("part"), cut(edges))
        new, moved = cut(new), cut(moved.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("int")))
        touched = [r[0] for r in moved.select("part").distinct().collect()]
        if touched:  # roots first: names that no node has yet do no harm
            keep = self.roots().where(F.col("part").isin(touched)).join(moved.select("label"), "label", "left_anti")
            keep.unionByName(moved.select("label", "root", "part")).repartition("part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/roots")
        new.write.mode("append").parquet(f"{self.path}/labels")

    def groups(self) -> DataFrame:
        """``group_id`` (smallest member), ``media_id`` of groups of two or more."""
        own = resolved(self.labels(), self.roots().drop("part")).where(~F.col("node").startswith("~"))
        many = own.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("group_id")).where("n > 1")
        return own.join(many, "component").select("group_id", F.col("node").alias("media_id"))

    def drop(self) -> None:
        """Forgets the index's tables and deletes the folder."""
        for table in (self.index.bands, self.index.ids):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, self.path)
