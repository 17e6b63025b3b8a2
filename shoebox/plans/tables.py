"""The catalogue's tables as Parquet partitioned by key hash: a merge rewrites the parts it touches, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from shoebox import schema as tables
from shoebox.operators import merge
from shoebox.plans.lineage import cut

#: Parts of a table; a merge of few rows reads and rewrites at most as many parts as it has keys.
PARTS = 64
#: Tables whose rows are replaced parent by parent lie together by their parent.
BY_PARENT = {"story_item": ("story_id",), "timeline_clip": ("timeline_id",), "duplicate_member": ("group_id",)}


class Catalogue:
    """Tables under one folder, each partitioned by ``part``, a hash of its key (of the parent for children).

    A change is a join of its rows with the touched parts alone, written back by dynamic partition overwrite: new files are
    staged and take the place of the old ones when the job commits, and no other file is touched.  Merges give the same table when they
    run twice.  ``seq`` is the order of first insertion, kept when a row is replaced.  There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _schema(self, table: str) -> StructType:
        return tables.schema(table).add("seq", LongType()).add("part", IntegerType())

    def _part(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*BY_PARENT.get(table, tables.KEYS[table])), F.lit(self.parts)).cast("int")

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.schema(self._schema(table)).parquet(f"{self.path}/{table}")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def migrate(self) -> list[str]:
        """Makes the tables of versions that are not applied yet; their names in order."""
        new = []
        for version, names in tables.VERSIONS:
            for name in names:
                if not self._exists(f"{self.path}/{name}"):
                    self.spark.createDataFrame([], self._schema(name)).drop("part").write.parquet(f"{self.path}/{name}")
                    new.append(f"{version}:{name}")
        return new

    def read(self, table: str) -> DataFrame:
        return self._all(table).where("seq is not null").drop("part")  # see _rewrite

    def check(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows with values that the table's columns may not have."""
        bad = F.lit(False)
        for (name, col), values in tables.ALLOWED.items():
            if name == table and col in rows.columns:
                bad = bad | (F.col(col).isNotNull() & ~F.col(col).isin(*values))
        return rows.where(bad)

    def _rows(self, table: str, rows: DataFrame) -> DataFrame:
        """A batch with the table's columns, the last of each key, and places after all that are there."""
        place = (self._all(table).agg(F.max("seq")).first()[0] or 0) + 1
        cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in tables.schema(table).fields]
        held = rows.select(*cols, (F.monotonically_increasing_id() + F.lit(place)).alias("seq"))
        out = cut(merge.last(held, tables.KEYS[table], "seq").withColumn("part", self._part(table)).select(*self._schema(table).names))
        if not self.check(table, out).isEmpty():
            raise ValueError(f"{table}: a value is not allowed")
        return out

    def _rewrite(self, table: str, rows: DataFrame, touched: Sequence[int]) -> None:
        """Writes parts anew.  Each gets a row without a place besides, so that a part which has lost all its rows is written too."""
        blank = self.spark.createDataFrame([(p,) for p in touched], "part int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.schema(table).fields], F.lit(None).cast("long").alias("seq"), "part")
        out = rows.unionByName(blank)
        out.repartition(min(len(touched), 200), "part").write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{table}")

    def _held(self, table: str, touched: Sequence[int]) -> DataFrame:
        return self._all(table).where(F.col("part").isin(touched) & F.col("seq").isNotNull())

    def _change(self, table: str, gone: DataFrame, keys: Sequence[str], new: DataFrame | None) -> None:
        """Rows whose ``keys`` are in ``gone`` (with ``part``) go, ``new`` ones come; only the parts of both are read and written."""
        parts = gone.select("part") if new is None else gone.select("part").unionByName(new.select("part"))
        touched = sorted(r[0] for r in parts.distinct().collect())
        if touched:
            keep = merge.remove(self._held(table, touched), gone, keys)
            self._rewrite(table, keep if new is None else keep.unionByName(new), touched)

    def put(self, table: str, rows: DataFrame) -> None:
        """Inserts rows or replaces those with the same key, which keep their place."""
        keys, rows = list(tables.KEYS[table]), self._rows(table, rows)
        touched = sorted(r[0] for r in rows.select("part").distinct().collect())
        if not touched:
            return
        held = self._held(table, touched)
        old = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("seq").alias("_seq"))
        placed = rows.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").withColumn("seq", F.coalesce("_seq", "seq")).select(*rows.columns)
        self._rewrite(table, merge.remove(held, rows, keys).unionByName(placed), touched)

    def delete(self, table: str, rows: DataFrame) -> None:
        """Rows with the keys of ``rows`` go."""
        keys = list(tables.KEYS[table])
        self._change(table, cut(rows.select(*keys).distinct().withColumn("part", self._part(table))), keys, None)

    def clear(self, *names: str) -> None:
        for name in names:
            self.spark.createDataFrame([], self._schema(name)).drop("part").write.mode("overwrite").parquet(f"{self.path}/{name}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows of a table at once; ``rows`` may come from a read of the table."""
        rows = self._rows(table, rows)
        rows.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{self.path}/{table}")

    def replace_part(self, table: str, column: str, value: str, rows: DataFrame) -> None:
        """The rows of one parent (``column`` = ``value``) give way to ``rows``."""
        gone = self._all(table).where((F.col(column) == value) & F.col("seq").isNotNull()).select(column, "part")
        parent = self.spark.createDataFrame([(value,)], f"{column} string")
        gone = gone.unionByName(parent.withColumn("part", self._part(table))) if (column,) == BY_PARENT.get(table) else gone
        self._change(table, cut(gone.distinct()), [column], self._rows(table, rows))

    def patch(self, table: str, where: Column, **values: Column | str | int | float | bool | None) -> None:
        """Sets columns of the rows that ``where`` picks."""
        lit = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        rows = self.read(table).where(where).drop("seq")
        self.put(table, rows.withColumns({k: v.cast(tables.schema(table)[k].dataType) for k, v in lit.items()}))

    def upsert_media(self, rows: DataFrame) -> None:
        """Media replace those with the same id or the same path."""
        old = self.read("media_item").join(rows.select("source_ref", F.col("id").alias("_new")), "source_ref").where("id <> _new")
        self.delete("media_item", old)
        self.put("media_item", rows)

    def reset_analysis(self) -> None:
        """Forgets what was derived from media and marks them pending; media keep their paths and hashes."""
        self.clear("face", "person", "quality_score", "scene_label", "duplicate_group", "duplicate_member", "face_feedback", "cluster_merge_log")
        self.patch("media_item", F.lit(True), analysis_status="pending")
