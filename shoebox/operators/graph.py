"""Connected components of an edge table, whole or batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.plans.lineage import Scratch, cut, written


def linked(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node that has an edge.

    Alternating large-star and small-star steps: each is one grouped minimum (combined before the shuffle) and
    one join that Spark can split where a node has very many neighbours.  Every round's edges are written to the
    shared folder, so a lost executor costs one round; those before are deleted.  Rows with a null end and self-loops add nothing;
    repeated edges count once; an empty table gives an empty table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    with Scratch(edges.sparkSession) as first:
        e, seen = first.written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
        held: list[Scratch] = []
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
            # large star: every larger neighbour is hung on the smallest node around u
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # small star: u and its smaller neighbours are hung on the smallest of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            hung = large.join(least, "u")
            small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            held.append(Scratch(edges.sparkSession))
            e = held[-1].written(small.where("u <> v").distinct())
            for old in held[:-1]:
                old.drop()
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
        out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
        held[-1].drop()
        return out


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every row of ``nodes``; a node without edges is its own."""
    found = linked(edges, a, b).select(F.col("node").alias("_u"), F.col("component").alias("_l"))
    return nodes.select(F.col(node).alias("node")).join(found, F.col("node") == F.col("_u"), "left").select("node", F.coalesce("_l", "node").alias("component"))


def fold(labels: DataFrame, roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of ``edges`` (``a``, ``b``) adds to stored components: rows of ``labels`` and changed rows of ``roots``.

    ``labels`` (``node``, ``label``) gives each node the name its component had when the node came, and is only added to;
    ``roots`` (``label``, ``root``) says what each name has become.  The batch's old nodes stand for their whole components
    (the contracted graph has as many edges as the batch), so rounds run over these alone; of the stored names only those whose
    root has changed are rewritten.  A batch that is folded twice changes nothing more.
    """
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    known = cut(ends.join(labels, "node", "left").join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("old")))
    name = lambda side: known.select(F.col("node").alias(side), F.coalesce("old", "node").alias(f"_{side}"))
    contracted = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    grown = cut(components(known.select(F.coalesce("old", "node").alias("node")).distinct(), contracted))
    new = known.where("old is null").select("node").join(grown, "node").select("node", F.col("component").alias("label"))
    moved = grown.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("root"))
    # names whose root moved on, those roots' own names, and names that are roots themselves
    again = roots.join(moved.withColumnRenamed("root", "_to"), F.col("root") == F.col("old")).select("label", F.col("_to").alias("root"))
    return new, again.unionByName(moved.join(labels.select(F.col("label").alias("old")).distinct(), "old", "left_semi").select(F.col("old").alias("label"), "root")).distinct()


def resolved(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``, ``component`` of stored components: the smallest node reachable."""
    return labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("component"))
