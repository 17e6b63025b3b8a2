"""A vector index kept as Parquet: cells of a space, residual product-quantised codes, exact distances for the best candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.functions.vectors import cosine_distance
from shoebox.operators.cells import SAMPLE, fit_cells, in_cells, k_means, probes_for, sample_vectors
from shoebox.operators.metric import plain, units
from shoebox.plans.lineage import cut

#: Parts of a vector, each coded by one byte, and values that a byte may take.
PARTS, VALUES = 8, 256
#: Rows of a block of cells, queries that meet it in one task, and candidates a query keeps for each neighbour asked for.
BLOCK, QUERIES, REFINE = 1 << 16, 512, 16


class VectorIndex:
    """An index under a folder: ``meta`` (centres, codebooks, probes) and ``rows``, a Parquet table partitioned by cell.

    A row keeps its ``id``, ``seq``, vector, and a code of PARTS bytes: the nearest codebook value of each part of what is left of
    its vector beside its cell's centre.  A search reads the codes of the cells it probes alone, and the vectors of its
    best candidates.  What is fitted is fitted once, on a bounded sample; rows are added at any time.
    """

    def __init__(self, spark: SparkSession, path: str):
        """Loads an index; its rows stay where they are."""
        self.spark, self.path = spark, path.rstrip("/")
        meta: dict[str, dict[int, np.ndarray]] = {}
        for r in spark.read.parquet(f"{self.path}/meta").collect():
            meta.setdefault(r["kind"], {})[r["i"]] = np.array(r["v"], float)
        stacked = {kind: np.array([own[i] for i in sorted(own)]) for kind, own in meta.items()}
        self.centres = stacked.pop("centre")
        self.probes = int(stacked.pop("probes")[0, 0])
        self.books = [stacked[f"part{j}"] for j in range(len(stacked))]

    @classmethod
    def create(cls, rows: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, k: int = 10, recall: float = 0.95, sample: int = SAMPLE) -> VectorIndex:
        """Fits centres and codebooks on at most ``sample`` of ``rows`` (``id``, ``seq``, ``embedding``), measures how many cells a search must probe to
        meet ``recall`` of the ``k`` nearest, and writes the index with all of them."""
        spark, path = rows.sparkSession, path.rstrip("/")
        centres = fit_cells(rows, cells, sample)
        x = sample_vectors(rows, sample)
        if not len(x):
            raise ValueError("an index is fitted on rows")
        left = x - centres[(x @ centres.T).argmax(axis=1)]
        edges = [x.shape[1] * j // parts for j in range(parts + 1)]
        books = [k_means(left[:, a:b], min(VALUES, max(1, len(left) // 4))) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
        probes = probes_for(rows, centres, k, recall)
        meta = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("probes", 0, [float(probes)])]
        meta += [(f"part{j}", i, c.tolist()) for j, book in enumerate(books) for i, c in enumerate(book)]
        spark.createDataFrame(meta, "kind string, i int, v array<double>").coalesce(1).write.parquet(f"{path}/meta")
        schema = f"id {rows.schema['id'].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}, embedding array<float>, code binary, cell int"
        spark.createDataFrame([], schema).write.parquet(f"{path}/rows/cell=-1")  # keeps the columns of an empty index
        index = cls(spark, path)
        index.add(rows)
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").where("cell >= 0")

    def size(self) -> int:
        return self.rows().count()

    def add(self, rows: DataFrame) -> None:
        """Adds rows whose ``id`` the index does not have, each once; a batch that is run twice adds nothing."""
        new = rows.where(F.col("embedding").isNotNull()).dropDuplicates(["id"]).join(self.rows().select("id"), "id", "left_anti")
        shared = self.spark.sparkContext.broadcast((self.centres, self.books))

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, books = shared.value
            for pdf in batches:
                x = units(pdf["embedding"])
                cell = (x @ centres.T).argmax(axis=1)
                left, at, codes = x - centres[cell], 0, []
                for book in books:
                    part = left[:, at : at + book.shape[1]]
                    at += book.shape[1]
                    codes.append(((book**2).sum(axis=1)[None] - 2 * part @ book.T).argmin(axis=1).astype(np.uint8))
                yield plain({"id": pdf["id"].tolist(), "seq": pdf["seq"].tolist(), "embedding": pdf["embedding"], "code": [c.tobytes() for c in np.array(codes, np.uint8).T], "cell": cell.astype(np.int32)})

        types = {f.name: f.dataType.simpleString() for f in self.rows().schema.fields}
        out = new.select("id", "seq", F.col("embedding").cast("array<float>").alias("embedding")).mapInPandas(coded, f"id {types['id']}, seq {types['seq']}, embedding array<float>, code binary, cell int")
        # files of one cell are written by a few tasks, however many rows it has
        out.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")

    def candidates(self, query: DataFrame, most: int, probes: int | None = None) -> DataFrame:
        """``query_id``, ``cell``, ``id``: the ``most`` rows of each query's probed cells whose codes are nearest to it; codes alone are read."""
        probes = min(probes or self.probes, len(self.centres))
        asked = query.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        wanted = [r[0] for r in in_cells(asked, self.centres, probes).select("cell").distinct().collect()]  # cells are few
        rows = self.rows().where(F.col("cell").isin(wanted)).select("id", "code", "cell")
        # small cells are put together to blocks, so a query is copied, and keeps candidates, once a block and not once a cell
        blocks, at, held = {}, 0, 0
        for cell, n in sorted((r["cell"], r["count"]) for r in rows.groupBy("cell").count().collect()):
            if held and held + n > BLOCK:
                at, held = at + 1, 0
            many = -(-n // BLOCK)
            blocks[cell] = (at, many)
            at, held = (at + many, 0) if many > 1 else (at, held + n)
        chunks = max(1, -(-asked.count() // QUERIES))
        dealt = self.spark.createDataFrame([(c, *b) for c, b in blocks.items()], "cell int, first int, n int")
        r = rows.join(F.broadcast(dealt), "cell").withColumn("rblock", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int"))
        r = r.select("id", "code", F.col("cell").alias("rcell"), "rblock", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("rchunk"))
        shared = self.spark.sparkContext.broadcast((self.centres, self.books, blocks))
        id_type, query_type = rows.schema["id"].dataType.simpleString(), query.schema["id"].dataType.simpleString()

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, _, blocks = shared.value
            for pdf in batches:
                near = np.argsort(-(np.array(pdf["embedding"].tolist(), float) @ centres.T), axis=1, kind="stable")[:, :probes]
                out: dict[str, list] = {"query_id": [], "asked": [], "block": [], "cells": []}
                for query_id, v, cells in zip(pdf["id"].tolist(), pdf["embedding"], near.tolist(), strict=True):
                    own: dict[int, list[int]] = {}
                    for c in cells:
                        for b in range(blocks[c][0], sum(blocks[c])) if c in blocks else ():
                            own.setdefault(b, []).append(c)
                    out["query_id"] += [query_id] * len(own)
                    out["asked"] += [v] * len(own)
                    out["block"] += own.keys()
                    out["cells"] += own.values()
                yield plain(out)

        q = asked.mapInPandas(send, f"query_id {query_type}, asked array<double>, block int, cells array<int>")
        q = q.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))

        def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            out: dict[str, list] = {"query_id": [], "cell": [], "id": [], "about": []}
            if not len(x) or not len(y):
                return plain(out)
            centres, books, _ = shared.value
            y = y.sort_values(["rcell", "id"], kind="stable")
            codes = np.frombuffer(b"".join(y["code"]), np.uint8).reshape(len(y), len(books))
            ids, cell = y["id"].to_numpy(), y["rcell"].to_numpy()
            place = np.empty(len(y), np.int64)
            place[np.argsort(ids, kind="stable")] = np.arange(len(y))
            for query_id, own, v in zip(x["query_id"], x["cells"], units(x["asked"]), strict=True):
                low, high = np.searchsorted(cell, own), np.searchsorted(cell, own, side="right")
                i = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                if not len(i):
                    continue
                alike, at = (centres @ v)[cell[i]], 0
                for j, book in enumerate(books):
                    alike += (book @ v[at : at + book.shape[1]])[codes[i, j]]
                    at += book.shape[1]
                alike[ids[i] == query_id] = -np.inf
                if len(i) > most:
                    some = np.flatnonzero(alike >= np.partition(alike, -most)[-most])
                    i, alike = i[some], alike[some]
                best = np.lexsort((place[i], -alike))[:most]
                best = best[alike[best] > -np.inf]
                out["query_id"] += [query_id] * len(best)
                out["cell"] += cell[i[best]].tolist()
                out["id"] += ids[i[best]].tolist()
                out["about"] += (1 - alike[best]).tolist()
            return plain(out)

        met = q.groupBy("block", "chunk").cogroup(r.groupBy("rblock", "rchunk")).applyInPandas(near, f"query_id {query_type}, cell int, id {id_type}, about double")
        best = W.partitionBy("query_id").orderBy("about", "id")
        return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).select("query_id", "cell", "id")

    def search(self, query: DataFrame, k: int = 10, probes: int | None = None, refine: int = REFINE) -> DataFrame:
        """``query_id``, ``id``, ``distance``, ``rank``: the ``k`` nearest of ``refine`` times as many candidates, by exact cosine distance, then by ``seq``.

        ``query`` has ``id``, ``embedding``; a row is not its own neighbour.
        """
        found = cut(self.candidates(query, k * refine, probes))  # read twice
        wanted = [r[0] for r in found.select("cell").distinct().collect()]
        rows = self.rows().where(F.col("cell").isin(wanted)).select("cell", "id", "seq", "embedding")
        asked = query.select(F.col("id").alias("query_id"), F.col("embedding").cast("array<double>").alias("asked"))
        met = found.join(rows, ["cell", "id"]).join(asked, "query_id").select("query_id", "id", "seq", cosine_distance(F.col("asked"), F.col("embedding")).alias("distance"))
        best = W.partitionBy("query_id").orderBy("distance", "seq")
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("seq")
