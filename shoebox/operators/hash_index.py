"""A kept index of perceptual hashes: bucketed tables of bands, so that a search shuffles its queries alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import hashing
from shoebox.operators.dedup import MAX_HAMMING
from shoebox.plans.lineage import cut

BUCKETS = 32


def code(hash_: Column) -> Column:
    """A hash of 16 hex digits as a long."""
    return F.shiftleft(hashing.half(hash_), 32).bitwiseOR(hashing.half(hash_, True))


class HashIndex:
    """Hashes under a folder, found again within ``max_hamming`` bits.

    Of max_hamming / 2 + 1 bands (rounded down) one differs in a bit at most.  ``bands`` holds every distinct hash once a band,
    bucketed by band and value; ``ids`` holds the rows, bucketed by hash.  Very many equal hashes are one hash in all
    comparisons.  Tables are named in the session's catalogue and lie under ``path``, where another session finds them.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "hash_index", max_hamming: int = MAX_HAMMING, buckets: int = BUCKETS, id_type: str = "string"):
        self.spark, self.max_hamming, self.buckets = spark, max_hamming, buckets
        self.path, self.bands, self.ids = path.rstrip("/"), f"{name}_bands", f"{name}_ids"
        m = max_hamming // 2 + 1
        self.edges = [64 * i // m for i in range(m + 1)]
        for table, columns, keys in ((self.bands, "band INT, value BIGINT, code BIGINT", "band, value"), (self.ids, f"code BIGINT, id {id_type}", "code")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.path}/{table}'")

    def _masks(self) -> list[int]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(((1 << b - a) - 1) << a) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def _append(self, rows: DataFrame, table: str, keys: list[str]) -> None:
        rows.repartition(self.buckets, *keys).write.mode("append").bucketBy(self.buckets, *keys).option("path", f"{self.path}/{table}").format("parquet").saveAsTable(table)
        self.spark.catalog.refreshTable(table)

    def size(self) -> int:
        return self.spark.table(self.ids).count()

    def add(self, rows: DataFrame) -> None:
        """Adds rows with ``id`` and ``hash`` (16 hex digits; others are left out) that the index does not have."""
        new = cut(rows.where(F.length("hash") == hashing.DIGITS).select(code(F.col("hash")).alias("code"), "id").distinct())
        new = cut(new.join(self.spark.table(self.ids), ["code", "id"], "left_anti"))
        codes = cut(new.select("code").distinct().join(self.spark.table(self.ids).select("code").distinct(), "code", "left_anti"))
        value = F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(x)) for x in self._masks()])).alias("band", "value")
        # bands first: a batch that is cut off here is found not to be in ``ids`` and runs again
        again = codes.select(value, "code").join(self.spark.table(self.bands), ["band", "value", "code"], "left_anti")
        self._append(cut(again.select("band", "value", "code")), self.bands, ["band", "value"])
        self._append(new, self.ids, ["code"])

    def near_codes(self, codes: DataFrame) -> DataFrame:
        """``query_code``, ``code``, ``distance`` of the hashes in the index at most ``max_hamming`` bits from those of ``codes`` (``code``)."""
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        flips = F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in (0, *(1 << i for i in range(a, b)))]) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)])
        asked = codes.select(F.col("code").alias("query_code")).distinct()
        asked = asked.select("query_code", F.posexplode(F.array(*[F.col("query_code").bitwiseAND(F.lit(x)) for x in self._masks()])).alias("band", "value"))
        asked = asked.select("query_code", "band", F.explode(F.transform(F.get(flips, F.col("band")), lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
        distance = F.bit_count(F.col("code").bitwiseXOR(F.col("query_code"))).cast("int")
        met = asked.hint("shuffle_hash").join(self.spark.table(self.bands), ["band", "value"]).withColumn("distance", distance)
        return met.where(F.col("distance") <= self.max_hamming).select("query_code", "code", "distance").distinct()

    def near(self, queries: DataFrame) -> DataFrame:
        """``query_id``, ``id``, ``distance`` of all rows of the index at most ``max_hamming`` bits from a query (``id``, ``hash``)."""
        asked = cut(queries.where(F.length("hash") == hashing.DIGITS).select(F.col("id").alias("query_id"), code(F.col("hash")).alias("query_code")))
        met = self.near_codes(asked.select(F.col("query_code").alias("code")))
        return asked.join(met, "query_code").hint("shuffle_hash").join(self.spark.table(self.ids), "code").select("query_id", "id", "distance")
