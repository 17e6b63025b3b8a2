"""Exact top-k search of binary codes by incremental multi-index hashing, as joins on segment values."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.llm._common import Scratch, written

K, BITS = 10, 64
#: Codes that share a segment's value, about; fewer would ask for more values, more for more verified pairs.
SHARED = 24
#: Values of a query that the first round and each later one ask for, about.
FIRST, ASKED = 64, 256
SALTS = 64


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``code``: bit i of the long is 1 where element i is above 0; of the first 64 elements.

    A null vector or element gives 0 bits.
    """
    v = F.col(vector_col)
    masks = F.array(*[F.lit(-(1 << 63) if i == BITS - 1 else 1 << i).cast("long") for i in range(BITS)])
    bits = F.zip_with(F.slice(v, 1, BITS), masks, lambda x, bit: F.when(x > 0, bit).otherwise(F.lit(0).cast("long")))
    code = F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)), F.lit(0).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def widths(n_codes: int, bits: int = BITS) -> list[int]:
    """Bits of each segment, so that about SHARED of so many codes have a segment's value in common."""
    width = max(4.0, math.log2(max(n_codes, 2) / SHARED))
    m = math.ceil(bits / width)
    edges = [bits * i // m for i in range(m + 1)]
    return [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def rounds(segments: list[int]) -> Iterator[list[tuple[int, int]]]:
    """Steps (radius, segment) in order, in rounds of about as many values for a query."""
    held, size, most = [], 0, FIRST
    for radius in range(max(segments) + 1):
        for segment, w in enumerate(segments):
            if radius <= w:
                held.append((radius, segment))
                size += math.comb(w, radius)
            if size >= most:
                yield held
                held, size, most = [], 0, ASKED
    if held:
        yield held


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``neighbor_id``, ``distance``, ``rank`` (from 1): for each query its ``k`` nearest rows, itself left out.

    Both inputs have ``id`` and ``code`` (long).  Nearest is by Hamming distance, then by smaller id; exact.
    Equal codes become one with its k + 1 smallest ids (taken in salted steps, so a code that a third of the
    rows share is no large group), and equal query codes are searched once.

    The index is a table of each code's segment values.  In each step the queries still open ask, in one segment,
    for all values at one more bit of distance from their own; the values meet the index in a shuffled join, which
    Spark splits where very many codes share a value, and pairs are verified at once.  After radius r in the first
    s + 1 of m segments and r - 1 in the others every code within r m + s bits has been met (one that has not
    differs in more than r bits in each of those segments and in at least r in each other), so a query is done
    once its (k + 1)-th verified distance is no larger.  A pair counts in the first step that meets it only, and
    where it is not beyond the query's distance so far, so that nothing need be made distinct.

    Rows with a null id or code are left out; rows that repeat an id count once; fewer than k + 1 rows give fewer
    answers; empty tables give an empty result; other columns are not read.
    """
    good = rows.select("id", "code").where("id is not null and code is not null").distinct()
    salted = W.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    few = good.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).drop("r")
    few = few.withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    with Scratch(rows.sparkSession) as scratch:
        codes = scratch.written(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
        asked = scratch.written(queries.select("id", "code").where("id is not null and code is not null").distinct())
        near = _nearest(codes, asked.select(F.col("code").alias("query")).distinct(), k + 1, scratch)
        ids = near.join(codes, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
        order = W.partitionBy("query").orderBy("distance", "neighbor_id")
        ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
        ids = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
        mine = asked.join(ids, F.col("code") == F.col("query")).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("id")), 1, k).alias("near"))
        return written(mine.select("query_id", F.posexplode("near").alias("at", "n")).select("query_id", "n.neighbor_id", "n.distance", (F.col("at") + 1).alias("rank")))


def _nearest(codes: DataFrame, queries: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``query``, ``code``, ``distance``: for each query code the nearest codes that hold its k nearest rows."""
    segments = widths(codes.count())
    m, shifts = len(segments), [sum(segments[:i]) for i in range(len(segments))]
    masks = [((1 << w) - 1) << at for w, at in zip(segments, shifts, strict=True)]
    value = lambda c, j: F.col(c).bitwiseAND(F.lit(_long(masks[j])))
    index = codes.select("code", F.element_at("ids", 1).alias("first"), F.size("ids").alias("n"), F.posexplode(F.array(*[value("code", j) for j in range(m)])).alias("segment", "value"))
    index = scratch.written(index)
    open_ = scratch.written(queries.select("query", F.lit(BITS).alias("bound")))
    order = W.partitionBy("query").orderBy("distance", "first")
    best, ended = None, []
    for steps in rounds(segments):
        values = []
        for radius, j in steps:
            flips = [_long(sum(1 << b for b in c) << shifts[j]) for c in combinations(range(segments[j]), radius)]
            asks = open_.select("query", "bound", F.lit(radius).alias("radius"), F.lit(j).alias("segment"), F.explode(F.lit(flips).cast("array<bigint>")).alias("flip"))
            values.append(asks.withColumn("value", value("query", j).bitwiseXOR(F.col("flip"))).drop("flip"))
        met = reduce(DataFrame.unionByName, values).join(index.hint("merge"), ["segment", "value"])  # never a broadcast: values are many more than queries
        differ = F.col("code").bitwiseXOR(F.col("query"))
        bits = [F.bit_count(differ.bitwiseAND(F.lit(_long(x)))) for x in masks]
        later = reduce(lambda a, b: a & b, [(bits[j] > F.col("radius")) | (F.col("segment") <= j) & (bits[j] >= F.col("radius")) for j in range(m)])
        met = met.where(later).withColumn("distance", F.bit_count(differ).cast("int")).where("distance <= bound").select("query", "code", "first", "n", "distance")
        if best is not None:
            met = met.unionByName(best.join(open_.select("query"), "query", "left_semi").select(*met.columns))
        top = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        best = scratch.written(top.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("place"))
        covered = steps[-1][0] * m + steps[-1][1]
        kth = best.where(F.col("upto") >= k).groupBy("query").agg(F.min("distance").alias("kth"))
        open_ = scratch.written(open_.join(kth, "query", "left").where(F.coalesce("kth", F.lit(BITS + 1)) > covered).select("query", F.coalesce("kth", "bound").alias("bound")))
        ended.append(best.join(open_, "query", "left_anti"))
        if open_.isEmpty():
            break
    else:
        ended.append(best.join(open_, "query", "left_semi"))
    return reduce(DataFrame.unionByName, ended).select("query", "code", "distance")


def top_k_vectors(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``top_k`` of the sign codes of ``vectors`` for the query set of rows whose id is divisible by ``every``."""
    codes = sign_codes(vectors, id_col, vector_col)
    return top_k(codes, codes.where(F.col("id") % every == 0), k)

