"""Plans that move files to new paths, their state machine and its undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.functions.naming import with_sequence
from shoebox.plans.lineage import cut

# States of an item in order, on one volume and across volumes, and states of plans and jobs.
SAME_VOLUME = ("pending", "renamed", "done")
ACROSS_VOLUMES = ("pending", "copied", "verified", "source_trashed", "done")
FAILED = "failed"
UNFINISHED_PLANS = ("running", "approved")
INTERRUPTED_JOBS = ("running", "queued", "paused")


def without_managed(media: DataFrame, roots: DataFrame) -> DataFrame:
    """Media whose root is not managed by another application; an unknown root counts as not managed."""
    managed = roots.where("managed_by_other_app").select("root_id")
    return media.join(managed, "root_id", "left_anti")


def sequence_paths(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds ``n`` and ``to_path``: ``base_path`` with the first number that no earlier item and no existing file has.

    ``items`` has ``base_path``, ``seq``; ``existing`` has ``path``.  Items of one base take its free numbers in
    order of ``seq``.  Where a numbered name is the base of other items, the affected bases are numbered again
    with the taken names as existing; that is repeated until names are distinct, which is rare and short.
    """
    taken = existing.select(F.col("path").alias("taken")).distinct() if existing is not None else None
    order = W.partitionBy("base_path").orderBy("seq")
    out = items.withColumn("_k", F.row_number().over(order) - 1)
    sizes = out.groupBy("base_path").agg((F.max("_k") + 1).alias("need"))
    while True:
        if taken is None:
            numbered = out.withColumn("n", F.col("_k"))
        else:
            # a base may need as many more numbers as files lie in its way; those all begin like it
            head = lambda c: F.regexp_extract(c, r"^(.*?)(_\d+)?(\.[^./]*)?$", 1)
            near = taken.select("taken", head(F.col("taken")).alias("_head")).unionByName(taken.select("taken", F.regexp_replace("taken", r"\.[^./]*$", "").alias("_head"))).distinct()
            bases = sizes.withColumn("_head", F.regexp_replace("base_path", r"\.[^./]*$", ""))
            blocked = bases.join(near, "_head", "left").groupBy("base_path", "need").agg(F.count("taken").alias("more"))
            tries = blocked.select("base_path", F.explode(F.sequence(F.lit(0), F.col("need") + F.col("more") - 1)).alias("n"))
            tries = tries.withColumn("taken", with_sequence(F.col("base_path"), F.col("n"))).join(taken, "taken", "left_anti")
            free = tries.withColumn("_k", F.row_number().over(W.partitionBy("base_path").orderBy("n")) - 1).select("base_path", "_k", "n")
            numbered = out.join(free, ["base_path", "_k"])
        numbered = cut(numbered.withColumn("to_path", with_sequence(F.col("base_path"), F.col("n"))))
        clash = numbered.groupBy("to_path").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1")
        if clash.isEmpty():
            return numbered.drop("_k")
        # a natural name stays; names made for others must avoid it
        natural = numbered.where("n = 0").select(F.col("to_path").alias("taken")).join(clash.select(F.col("to_path").alias("taken")), "taken", "left_semi")
        made = clash.where("least > 0").select(F.col("to_path").alias("taken"))
        more = natural.unionByName(made).distinct()
        fixed = numbered.join(clash.select("to_path"), "to_path", "left_anti")
        keep = numbered.where("n = 0").join(clash.select("to_path"), "to_path", "left_semi")
        again = numbered.join(clash.select("to_path"), "to_path", "left_semi").where("n > 0").select("base_path").distinct()
        rest = sequence_paths(items.join(again, "base_path", "left_semi").join(keep.select("base_path", "seq"), ["base_path", "seq"], "left_anti"), cut((taken.unionByName(more) if taken is not None else more).unionByName(fixed.join(again, "base_path", "left_anti").select(F.col("to_path").alias("taken"))).distinct()).withColumnRenamed("taken", "path"))
        done = numbered.join(again, "base_path", "left_anti").unionByName(keep.join(again, "base_path", "left_semi")).drop("_k")
        return done.unionByName(rest)


def plan(media: DataFrame, roots: DataFrame, base_path: Column, target_root: str, existing: DataFrame | None = None) -> DataFrame:
    """Preview of a plan: ``media_id``, ``from_path``, ``to_path``, ``same_drive``, ``bytes``, ``conflict``, ``state``.

    ``media`` has ``media_id``, ``root_id``, ``source_ref``, ``seq``, ``bytes``, ``volume``; nothing is moved.
    """
    m = without_managed(media, roots).withColumn("base_path", base_path)
    m = sequence_paths(m, existing)
    return m.select("media_id", F.col("source_ref").alias("from_path"), "to_path", (F.col("volume") == F.lit(target_root)).alias("same_drive"), "bytes", (F.col("n") > 0).alias("conflict"), F.lit("pending").alias("state"))


def space_required(items: DataFrame) -> DataFrame:
    """Bytes that a plan needs on the target volume: those of items that come from another one."""
    return items.agg(F.coalesce(F.sum(F.when(~F.col("same_drive"), F.col("bytes"))), F.lit(0)).alias("space_required"))


def fold_states(transitions: DataFrame, by: tuple[str, ...] = ("plan_id", "media_id")) -> DataFrame:
    """The last state of each item in an append-only log with ``state``, ``seq``."""
    return transitions.groupBy(*by).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.count("*").alias("n_transitions"))


def unfinished(states: DataFrame) -> DataFrame:
    return states.where(~F.col("state").isin("done", FAILED))


def plan_status(states: DataFrame) -> DataFrame:
    """``status`` of each plan: running while an item is unfinished, failed where one failed, else done."""
    open_, failed = F.bool_or(~F.col("state").isin("done", FAILED)), F.bool_or(F.col("state") == FAILED)
    return states.groupBy("plan_id").agg(F.when(open_, "running").when(failed, FAILED).otherwise("done").alias("status"))


def undo_steps(journal: DataFrame, ref_type: str, ref_id: str) -> DataFrame:
    """Reversible entries of one reference, last first, with paths swapped."""
    own = journal.where((F.col("ref_type") == ref_type) & (F.col("ref_id") == ref_id) & F.col("reversible"))
    return own.orderBy(F.col("executed_at").desc(), F.col("seq").desc()).select("op", F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"), "executed_at", "seq")


def undo_sources(steps: DataFrame, media: DataFrame) -> DataFrame:
    """``media_id``, ``source_ref``: where media lie again after ``undo_steps``, found by the path they were moved to.

    A path that was moved to more than once goes back by its last step.
    """
    last = steps.groupBy("from_path").agg(F.max_by("to_path", F.struct("executed_at", "seq")).alias("to_path"))
    return media.select("media_id", F.col("source_ref").alias("from_path")).join(last, "from_path").select("media_id", F.col("to_path").alias("source_ref"))


def remaining(items: DataFrame, journal: DataFrame, ref_type: str = "restructure_plan") -> DataFrame:
    """Items (``plan_id``, ``to_path``, ``state``) that a plan taken up again has still to move: neither at their end nor in the journal."""
    done = journal.where(F.col("ref_type") == ref_type).select(F.col("ref_id").alias("plan_id"), "to_path").distinct()
    return unfinished(items).join(done, ["plan_id", "to_path"], "left_anti")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs to take up again: running, then queued, then paused, each in order of ``seq``."""
    rank = F.array_position(F.array(*map(F.lit, INTERRUPTED_JOBS)), F.col("status"))
    return jobs.where(F.col("status").isin(*INTERRUPTED_JOBS)).withColumn("rank", rank.cast("int")).orderBy("rank", "seq")
