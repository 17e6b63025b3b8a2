"""Cutting the lineage of iterative plans with tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, which a cluster's session must set.

    Where it is unset and Spark runs in this process alone, as in tests, a temporary folder is made and set.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shoebox-checkpoint-")
        atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows, with all that is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Those that note what ``written`` writes, the innermost last.
_COLLECTORS: list[Collected] = []


def _table(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder: columnar, so later reads prune columns.

    A lost executor costs no more than reading it again, and later plans know its true size, which a checkpoint's do not: that
    keeps the estimate of what it was made from, and in a loop of joins these multiply without end.
    """
    out, path = _table(df)
    if _COLLECTORS:
        _COLLECTORS[-1].paths.append(path)
    return out


#: Lineage is cut by a written table.
cut = written


class Scratch:
    """Tables in the shared folder that are deleted when the ``with`` block ends.

    What a block returns must not be read from its tables: it is ``written`` to an outer scratch, or by ``written``
    of this module where it is the result.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        out, path = _table(df)
        self.paths.append(path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop()

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


class Collected(Scratch):
    """Notes every table that ``written`` writes inside its ``with`` block, by whichever operator, and deletes them at its end.

    What is to be kept is written by another ``Scratch`` before that.
    """

    def __enter__(self) -> Collected:
        _COLLECTORS.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _COLLECTORS.remove(self)
        self.drop()
