"""Incremental ingestion: a file stream whose batches are probed and appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from shoebox.functions import media as paths
from shoebox.plans.lineage import cut
from shoebox.plans.tables import Catalogue
from shoebox.sources.files import MediaProbe, new_files, no_probe, probe


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``mtime`` of new media files below a root; their contents are left to the tasks that read them."""
    f = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    f = f.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("mtime"))
    return f.where(paths.media_type(F.col("path")).isNotNull() & ~paths.managed_by_other_app(F.col("path")))


def index_root(spark: SparkSession, root: str, root_id: str, store: Catalogue, checkpoint: str, measure: MediaProbe = no_probe, steps: Sequence[Callable[[DataFrame], None]] = ()) -> StreamingQuery:
    """Index what is new below a root and stop; run it again for what comes later.

    The stream's checkpoint remembers files, and a path that the store has is left out all the same, so a batch
    that is run twice adds nothing.  ``steps`` are the chain that follows, in order: each gets the stored media rows of the
    batch's files.  They get them again when a batch is run again, whichever step it was cut off in, so each
    step is to be one that may run twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        found = cut(batch)
        store.put("media_item", probe(new_files(found, store.read("media_item")), measure).withColumn("root_id", F.lit(root_id)))
        for step in steps:
            step(store.read("media_item").join(found.select(F.col("path").alias("source_ref")), "source_ref", "left_semi"))

    return file_stream(spark, root).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start()


def item_states(transitions: DataFrame) -> DataFrame:
    """The last state of each plan item in a stream of transitions, as a streaming aggregate (update mode)."""
    return transitions.groupBy("plan_id", "media_id").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


class Progress(StreamingQueryListener):
    """Hands each batch's number of rows on to ``push``."""

    def __init__(self, push: Callable[[str, int], None]):
        self.push = push

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.push("started", 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.push("progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.push("idle", 0)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.push("failed" if event.exception else "done", 0)
