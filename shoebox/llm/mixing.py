"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.llm._common import cut, fresh, size_bucket

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20240607
#: Words in a block at most; small mixes use smaller blocks, so that every target holds a thousand of them.
BLOCK = 1024
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to rows ``source``, ``source_size``: one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and the excess is reshared by weight until none is above.  That
    fixed point is reached in one pass: in order of cap to weight, the sources that stop come first.
    """
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("stops", F.min((F.col("cap") > F.col("level") * F.col("weight")).cast("int")).over(order.rowsBetween(0, 0)) == 0)
    first = F.min(F.when(~F.col("stops"), F.col("cap") / F.col("weight"))).over(whole)
    level = F.max(F.when(~F.col("stops") & (F.col("cap") / F.col("weight") == first), F.col("level"))).over(whole)
    target = F.when(F.col("stops") | level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return s.withColumn("target", target.cast("double")).drop("cap", "level", "stops")


def sainte_lague(rows: DataFrame, by: list[str], key: list[str], value: str, seats: str, name: str) -> DataFrame:
    """Adds ``name``: how many of the group's ``seats`` each row gets by the highest quotients value / (2 i + 1).

    Exact without a loop over seats: every row is first given the seats it has at a divisor at which no more
    than all are given; of the quotients that follow (two a row on average) the highest take what is left,
    ties by ``key``.  ``seats`` is a column that is constant in the group.
    """
    group = W.partitionBy(*[F.col(c) for c in by]) if by else W.partitionBy(F.lit(0))
    r = rows.withColumn("_all", F.sum(value).over(group)).withColumn("_count", F.count("*").over(group))
    share = F.when(F.col("_all") > 0, F.col(value) / F.col("_all")).otherwise(F.lit(0.0))
    low = F.floor(share * F.greatest(F.col(seats) - F.col("_count") / 2, F.lit(0.0)) + 0.5)
    high = F.ceil(share * (F.col(seats) + F.col("_count") / 2) + 0.5)
    r = r.withColumn("_low", F.greatest(F.lit(0), low - 1).cast("long")).withColumn("_high", high.cast("long"))
    r = r.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    more = r.where(F.col(value) > 0).select(*by, *key, "_left", value, F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_i"))
    ranked = W.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy((F.col(value) / (2 * F.col("_i") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], "_i")
    won = more.withColumn("_place", F.row_number().over(ranked)).where("_place <= _left").groupBy(*by, *key).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in [*by, *key]], "_won")
    r = r.join(won, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in [*by, *key]], "left")
    return r.withColumn(name, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_all", "_count", "_low", "_high", "_left", "_won", *[f"_w_{c}" for c in [*by, *key]])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted).

    Documents are dealt to shards of their source by a seeded hash (shards grow in number with the rows, so a
    hot source is many shards) and lie in a seeded order in a shard's blocks.  Equal-token blocks are given to
    sources by Sainte-Laguë on their targets, then to a source's shards in the same way by size.  A shard takes
    its blocks as a run from a seeded start, going round again where its quota is above its blocks, never more
    than ``most`` times; a document's ``taken`` is what those blocks cover of it.  Reruns agree.

    A null text has size 0; a null source is a source; a null ``doc_id`` and repeated rows are documents of
    their own; an empty table gives an empty one; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    return _take(d, weights, share, most, block, seed).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that ``mix`` takes, all columns of ``docs``: a document comes as often as its taken words make it whole, rounded.

    Rows that repeat id, source and text are one document that may be taken as often as all of them.
    """
    key = [F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.md5(text_col)]
    d = docs.select(key[0].alias("doc_id"), key[1].alias("source"), key[2].alias("md5"), n_words(F.col(text_col)).alias("size"))
    taken = _take(d, weights, share, most, block, seed)
    times = taken.groupBy("doc_id", "source", "md5").agg(F.sum(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("times"))
    own, theirs = fresh(docs, "_id", "_source", "_md5"), fresh(docs, "_taken_id", "_taken_source", "_taken_md5")
    n, (once,) = fresh(docs, "_times")[0], fresh(docs, "_time")
    times = times.where("times > 0").select(*[F.col(c).alias(t) for c, t in zip(("doc_id", "source", "md5"), theirs, strict=True)], F.col("times").alias(n))
    found = docs.withColumns(dict(zip(own, key, strict=True))).join(times, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs, strict=True)])
    found = found.dropDuplicates(own).drop(*own, *theirs)
    return found.withColumn(once, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, once)


def _take(d: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, seed: int) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to rows with ``doc_id``, ``source``, ``size``."""
    d = cut(d)
    by_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rows = d.count()
    shard = size_bucket(rows, F.lit(seed), F.col("doc_id"), F.col("size"))
    d = d.withColumn("shard", shard)
    t = targets(by_source, weights, share, most)
    one = W.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(one)
    t = t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / 1000))).cast("long"))
    t = t.withColumn("blocks", F.round(F.sum("target").over(one) / F.col("block")).cast("long"))
    t = cut(sainte_lague(t.where("block is not null"), [], ["source"], "target", "blocks", "source_blocks"))
    shards = d.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    named = t.select(F.col("source").alias("_source"), "source_size", "target", "block", "source_blocks")
    shards = shards.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_size", "source_blocks", "quota")
    held = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))).cast("long")
    shards = shards.withColumn("held", held).withColumn("quota", F.least(F.col("quota"), (F.lit(float(most)) * F.col("held")).cast("long")))
    shards = shards.withColumn("rounds", F.floor(F.col("quota") / F.col("held")).cast("long")).withColumn("part", F.pmod("quota", "held"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("held"))
    shards = shards.withColumn("from", start * F.col("block")).withColumn("until", (start + F.col("part")) * F.col("block"))
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "rounds", "from", "until", (F.col("held") * F.col("block")).alias("round_at"))
    lie = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), "doc_id", "size")
    d = d.withColumn("end", F.sum("size").over(lie.rowsBetween(W.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    d = d.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    covered = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    taken = F.col("rounds") * F.col("size") + covered(F.col("from"), F.least("until", "round_at")) + covered(F.lit(0), F.col("until") - F.col("round_at"))
    return d.withColumn("taken", taken.cast("long"))
