"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.llm._common import Scratch, indexed, size_bucket, written

SHARDS, ROUNDS, SEED = 24, 8, 20240611


def propagate(votes: DataFrame, n_shards: int, capacity: int, scratch: Scratch, rounds: int = ROUNDS, held: DataFrame | None = None, whole_only: bool = False) -> DataFrame:
    """Where each neighbourhood of linked documents ends: columns ``anchor``, ``target``; those that find no room are left out.

    ``votes`` has ``anchor``, ``shard``, ``n``: how many of a neighbourhood's documents lie in a shard.  In each
    round every neighbourhood that is not yet together asks to bring its documents to the shard where most of
    them are, of those with room for it; a shard takes askers, those with more documents first and then in the order
    of their hash, while its quota (free places, and half of those that others ask to leave) lasts.  Running sums
    are by hash bucket, so no task holds all askers of a shard.  Rounds end when nobody is taken.  ``held``
    (``shard``, ``n``) are places that are not free from the start.  With ``whole_only`` a place is free unless a
    neighbourhood that is together has it, as those that are scattered will all leave for one shard each.
    """
    v = scratch.written(votes)
    moves = F.col("total") if whole_only else F.col("total") - F.col("n")
    n_anchors = v.select("anchor").distinct().count()
    for _ in range(rounds):
        total = v.groupBy("anchor").agg(F.sum("n").alias("total"))
        used = v.join(total, "anchor").where("n = total or not " + str(whole_only).lower()).select("shard", "n")
        used = used if held is None else used.unionByName(held)
        used = used.groupBy("shard").agg(F.sum("n").alias("used"))
        shards = v.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
        room = shards.join(used, "shard", "left").select("shard", (F.lit(capacity) - F.coalesce("used", F.lit(0))).alias("free"))
        asks = v.join(total, "anchor").where("n < total").join(F.broadcast(room), "shard")
        best = asks.groupBy("anchor").agg(F.max(F.struct((F.col("free") >= moves).alias("fits"), "n", (-F.col("shard")).alias("s"), "total", moves.alias("moves"))).alias("b"))
        best = best.select("anchor", (-F.col("b.s")).alias("target"), F.col("b.moves").alias("moves"), F.floor(F.log2("b.total")).cast("int").alias("level"))
        leaving = v.limit(0).select("shard", F.col("n").alias("leaving")) if whole_only else v.join(best.select("anchor", "target"), "anchor").where("shard <> target").groupBy("shard").agg(F.sum("n").alias("leaving"))
        quota = room.join(leaving, "shard", "left").select(F.col("shard").alias("target"), (F.greatest("free", F.lit(0)) + F.coalesce(F.col("leaving") / 2, F.lit(0))).cast("long").alias("quota"))
        best = best.withColumn("bucket", size_bucket(n_anchors, F.col("anchor")))
        order = W.partitionBy("target", "level", "bucket").orderBy(F.xxhash64("anchor"), "anchor")
        sums = best.groupBy("target", "level", "bucket").agg(F.sum("moves").alias("m"))
        ahead = W.partitionBy("target").orderBy(F.col("level").desc(), "bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0))).drop("m")
        taken = best.withColumn("running", F.sum("moves").over(order)).join(sums, ["target", "level", "bucket"]).join(F.broadcast(quota), "target")
        taken = scratch.written(taken.where("before + running <= quota").select("anchor", "target"))
        if taken.isEmpty():
            break
        v = scratch.written(v.join(taken, "anchor", "left").groupBy("anchor", F.coalesce("target", "shard").alias("shard")).agg(F.sum("n").alias("n")))
    whole = v.groupBy("anchor").agg(F.min("shard").alias("target"), F.max("shard").alias("other")).where("target = other")
    return whole.select("anchor", "target")


def _ends(votes: DataFrame, n_shards: int, room: int, rounds: int, scratch: Scratch) -> DataFrame:
    """``propagate`` of large neighbourhoods, and then of the others in the places that are left."""
    votes = scratch.written(votes)
    total = votes.groupBy("anchor").agg(F.sum("n").alias("total")).where(F.col("total") * 2 > room)
    first = votes.join(total.select("anchor"), "anchor", "left_semi")
    if first.isEmpty():
        return scratch.written(propagate(votes, n_shards, room, scratch, rounds))
    ends = scratch.written(propagate(first, n_shards, room, scratch, rounds, whole_only=True))
    left = first.join(ends, "anchor", "left").select(F.coalesce("target", "shard").alias("shard"), "n")
    held = scratch.written(left.groupBy("shard").agg(F.sum("n").alias("n")))
    return scratch.written(ends.unionByName(propagate(votes.join(total.select("anchor"), "anchor", "left_anti"), n_shards, room, scratch, rounds, held)))


def shard(docs: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for each row of ``docs``.

    Documents with equal texts (null texts too) are linked.  Documents begin in the shard of their hash;
    linked ones move towards their neighbours' shard by ``propagate``; then shards are made exactly even, the
    law being ``rows``: counts are at most one apart.  Unlinked documents go first where a shard is too full,
    as moving them cuts no link.  Only a group larger than a shard is several neighbourhoods: as many as fill a shard,
    and a rest.  Neighbourhoods larger than half a shard, of which there are at most two a shard, move first.
    ``size`` is the text's UTF-8 bytes (null: none) plus 8, ``text_crc32`` its CRC-32 (null: 0), ``slot`` is
    gapless from 0 in each shard, ``grown_shard`` is null under this law.  Repeated rows are documents of their
    own; a null ``doc_id`` is a value like others; an empty table gives an empty one; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        return written(_sharded(docs, n_shards, rounds, seed, id_col, text_col, scratch))


def _sharded(docs: DataFrame, n_shards: int, rounds: int, seed: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    text = F.col(text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit("null")).alias("text_key"))
    d = scratch.written(d)
    rows = d.count()
    capacity = rows // n_shards
    room = max(1, capacity)
    own = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    begin = F.pmod(own, F.lit(n_shards)).cast("int").alias("shard")
    groups = scratch.written(d.groupBy(F.col("text_key").alias("_key")).agg(F.count("*").alias("copies")).where("copies > 1"))
    d = scratch.written(d.join(groups, F.col("text_key") == F.col("_key"), "left").select("doc_id", "size", "text_crc32", "text_key", "copies", begin))
    alone, small, large = d.where("copies is null"), d.where(F.col("copies") <= room), d.where(F.col("copies") > room)
    large = indexed(large, ["text_key"], ["doc_id", "text_crc32", "size"], "at", rows)
    linked = small.withColumn("anchor", F.col("text_key")).unionByName(large.withColumn("anchor", F.concat_ws("-", "text_key", F.floor(F.col("at") / room))).drop("at"))
    linked = scratch.written(linked.drop("text_key", "copies"))
    ends = _ends(linked.groupBy("anchor", "shard").agg(F.count("*").alias("n")), n_shards, room, rounds, scratch)
    linked = linked.join(ends.withColumnRenamed("anchor", "_anchor"), F.col("anchor") == F.col("_anchor"), "left").withColumn("shard", F.coalesce("target", "shard")).drop("anchor", "_anchor", "target")
    d = linked.withColumn("linked", F.lit(True)).unionByName(alone.drop("text_key", "copies").withColumn("linked", F.lit(False)))
    d = scratch.written(indexed(d, ["shard", "linked"], ["doc_id", "text_crc32", "size"], "at", rows))
    # linked documents have a shard's first places; what is beyond its quota goes to the free places of others
    held = d.groupBy("shard").agg(F.sum(F.col("linked").cast("long")).alias("links"), F.count("*").alias("held"))
    shards = d.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    quota = (F.lit(capacity) + (F.col("shard") < rows % n_shards).cast("long")).cast("long")
    held = shards.join(held, "shard", "left").select("shard", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("held", F.lit(0)).alias("held"), quota.alias("quota"))
    held = held.withColumn("free", F.greatest(F.col("quota") - F.col("held"), F.lit(0)))
    held = held.withColumn("free_until", F.sum("free").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    d = d.join(F.broadcast(held.select("shard", "links", "quota")), "shard").withColumn("slot", F.col("at") + F.when(F.col("linked"), F.lit(0)).otherwise(F.col("links"))).drop("at", "linked", "links")
    stay = d.where("slot < quota").drop("quota")
    pool = indexed(d.where("slot >= quota").drop("quota", "slot", "shard"), [], ["doc_id", "text_crc32", "size"], "p", rows)
    to = held.where("free > 0").select("shard", "held", "free", "free_until")
    moved = pool.join(F.broadcast(to), (F.col("p") < F.col("free_until")) & (F.col("p") >= F.col("free_until") - F.col("free")))
    moved = moved.withColumn("slot", F.col("held") + F.col("p") - (F.col("free_until") - F.col("free")))
    cols = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return stay.select(*cols).unionByName(moved.select(*cols))
