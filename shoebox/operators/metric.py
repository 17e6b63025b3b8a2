"""Neighbours within a distance by metric pruning: cells, rings around their centres, and bounds by pivots."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.operators.cells import fit_cells
from shoebox.plans.lineage import cut

#: Rows of a block, and queries that meet it in one task.
BLOCK, CHUNK = 8192, 16384
#: Vectors of a batch that are compared with all centres or with a block at once, and pairs whose distance is taken at once.
TILE, PAIRS = 256, 1 << 16
#: Rings of half a turn around a centre, and centres whose angles bound every cell.
RINGS, PIVOTS = 64, 32
#: Radians by which bounds are widened against rounding.
SLACK = 1e-6


def plain(columns: dict) -> pd.DataFrame:
    """A frame whose lists stay lists of objects: Arrow takes text of any pandas version from them."""
    return pd.DataFrame({k: pd.Series(v, dtype=object) if isinstance(v, list) else v for k, v in columns.items()})


def units(vectors: list | pd.Series) -> np.ndarray:
    """Vectors as rows of length 1; one without length stays."""
    x = np.array([np.asarray(v, float) for v in vectors], float).reshape(len(vectors), -1)
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1.0, n)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _bounds(placed: DataFrame, centres: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest angle of each cell's rows to each pivot: at most cells x PIVOTS numbers, whatever the number of rows."""
    pivots = centres[:PIVOTS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = _angles(units(pdf["v"]), pivots)
            cells = pdf["cell"].to_numpy()
            for c in np.unique(cells):
                held = a[cells == c]
                yield pd.DataFrame({"cell": int(c), "pivot": np.arange(len(pivots)), "low": held.min(axis=0), "high": held.max(axis=0)})

    parts = placed.select("v", "cell").mapInPandas(run, "cell int, pivot int, low double, high double")
    out: dict[int, tuple[np.ndarray, np.ndarray]] = defaultdict(lambda: (np.zeros(len(pivots)), np.zeros(len(pivots))))
    for r in parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        out[r["cell"]][0][r["pivot"]], out[r["cell"]][1][r["pivot"]] = r["low"], r["high"]
    return dict(out)


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts of TILE rows: what is held for a part is TILE times the number of centres."""
    for whole in batches:
        for first in range(0, len(whole), TILE):
            yield whole.iloc[first : first + TILE]


def _packed(sizes: dict[int, dict[int, tuple[int, object]]], centres: np.ndarray, block: int) -> list[tuple[int, int, int, int, object]]:
    """``cell``, ``ring``, first block, number of blocks, least ``seq`` of all rings, in the order of blocks.

    Cells follow each other from near to near, so a block of small ones holds neighbours.
    """
    left, chain = sorted(sizes), []
    while left:
        alike = centres[left] @ centres[chain[-1]] if chain else np.zeros(len(left))
        chain.append(left.pop(int(alike.argmax())))
    out, at, held = [], 0, 0
    for cell in chain:
        for ring, (n, first) in sorted(sizes[cell].items()):
            if held and held + n > block:
                at, held = at + 1, 0
            many = -(-n // block)
            out.append((cell, ring, at, many, first))
            at, held = (at + many, 0) if many > 1 else (at, held + n)
    return out


def within(query: DataFrame, rows: DataFrame, threshold: float, k: int, earlier_only: bool = False, banned: DataFrame | None = None, own: bool = False, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id``, ``id``, ``distance``, ``rank``: of the rows within ``threshold`` of a query (cosine distance, below 1) the ``k`` nearest, then by ``seq``.

    Both inputs have ``id``, ``embedding``, the rows ``seq`` too, and the queries with ``earlier_only``, which keeps rows of a smaller
    ``seq``; a row is not its own neighbour unless ``own`` says that ids of queries and rows have nothing to do with each other.  ``banned`` (``query_id``, ``id``) names pairs that do not count.  A vector without length
    has no neighbour.

    Exact.  Angles between vectors are a metric: a row at angle b from a centre can be within t of a query at angle
    a from it only if a - t <= b <= a + t.  Rows lie in the cell of their nearest centre, in a ring of angles
    around it; of each cell the angles to PIVOTS centres are bounded.  A query is sent only to cells that all bounds
    allow, there only to the rings it can reach, and with ``earlier_only`` only to those that begin before it.
    Rings are put together, along a chain of near cells, to blocks of about ``block`` rows, and those of more are dealt to several,
    so a query is copied at most as often as there are blocks, whatever the number of rings.  Centres, bounds and ring sizes are
    few (``fit_cells``) and go to every task.  Queries meet a block in chunks of about ``chunk``, in each task by TILE.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold of a pruned search is at least 0 and below 1")
    theta = float(np.arccos(1 - threshold)) + SLACK
    centres = fit_cells(rows)
    spark = rows.sparkSession
    id_type, seq_type, query_type = rows.schema["id"].dataType.simpleString(), rows.schema["seq"].dataType.simpleString(), query.schema["id"].dataType.simpleString()
    vector = "array<float>" if {f.schema["embedding"].dataType.simpleString() for f in (query, rows)} == {"array<float>"} else "array<double>"
    if not len(centres):
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, distance double, rank int")
    shared = spark.sparkContext.broadcast(centres)
    width = np.pi / RINGS

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(batches):
            x = units(pdf["embedding"])
            a = _angles(x, shared.value)
            cell = a.argmin(axis=1)
            keep = (x != 0).any(axis=1)
            ring = np.minimum((a[np.arange(len(x)), cell] / width).astype(int), RINGS - 1)
            ids, seq, v = (pdf[c].to_numpy(object)[keep].tolist() for c in ("id", "seq", "embedding"))
            yield plain({"id": ids, "seq": seq, "v": v, "cell": cell[keep], "ring": ring[keep]})

    taken = F.col("embedding").cast(vector).alias("embedding")
    placed = cut(rows.where(F.col("embedding").isNotNull()).select("id", "seq", taken).mapInPandas(place, f"id {id_type}, seq {seq_type}, v {vector}, cell int, ring int"))
    bounds = _bounds(placed, centres)
    sizes: dict[int, dict[int, tuple[int, object]]] = defaultdict(dict)
    for r in placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("seq").alias("first")).collect():
        sizes[r["cell"]][r["ring"]] = (r["n"], r["first"])
    rings = _packed(sizes, centres, block)
    cells = sorted(bounds)
    low, high = (np.array([bounds[c][i] for c in cells]).reshape(len(cells), -1) for i in (0, 1))
    known = spark.sparkContext.broadcast((cells, low, high, rings))
    asked = query.where(F.col("embedding").isNotNull()).select(F.col("id").alias("query_id"), taken, *(["seq"] if earlier_only else [F.lit(None).cast(seq_type).alias("seq")]))
    if banned is None:
        asked = asked.withColumn("no", F.array().cast(f"array<{id_type}>"))
    else:
        no = banned.groupBy("query_id").agg(F.collect_set("id").alias("no"))
        asked = asked.join(no, "query_id", "left").withColumn("no", F.coalesce("no", F.array().cast(f"array<{id_type}>")))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, low, high, rings = known.value
        own = np.searchsorted(cells, [r[0] for r in rings])
        ring, at = np.array([r[1] for r in rings]), np.array([r[0] for r in rings])
        first = np.array([r[2] for r in rings])
        group = np.flatnonzero(np.append(True, first[1:] != first[:-1]))  # rings of one block, or of one run of blocks
        blocks = np.concatenate([np.arange(rings[g][2], rings[g][2] + rings[g][3]) for g in group])
        of = np.repeat(np.arange(len(group)), [rings[g][3] for g in group])
        begins = np.array([min(r[4] for r in rings[g:h]) for g, h in zip(group, np.append(group[1:], len(rings)), strict=True)]) if earlier_only else None
        for pdf in _tiles(batches):
            x = units(pdf["embedding"])
            a = _angles(x, shared.value)
            may = np.repeat((x != 0).any(axis=1)[:, None], len(cells), axis=1)
            for p in range(low.shape[1]):
                may &= (a[:, p, None] + theta >= low[None, :, p]) & (a[:, p, None] - theta <= high[None, :, p])
            to = a[:, at]
            reach = may[:, own] & ((to - theta) / width - 1e-9 < ring + 1) & (ring <= (to + theta) / width + 1e-9)
            reach = np.logical_or.reduceat(reach, group, axis=1)
            if earlier_only:
                reach &= begins[None] < np.array(pdf["seq"].tolist())[:, None]
            reach = reach[:, of]
            some = np.flatnonzero(reach.any(axis=1))
            out = {c: pdf[c].to_numpy(object)[some].tolist() for c in ("query_id", "seq", "no", "embedding")}
            out["v"] = out.pop("embedding")
            yield plain(out | {"blocks": [blocks[reach[i]].astype(np.int32) for i in some]})

    sent = cut(asked.mapInPandas(send, f"query_id {query_type}, seq {seq_type}, no array<{id_type}>, v {vector}, blocks array<int>"))
    each = sent.select("query_id", "seq", "no", "v", F.explode("blocks").alias("block"))
    # a block that very many queries reach meets them in chunks, so it is copied as often as it has chunks
    deal = sent.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = each.join(F.broadcast(deal), "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).drop("chunks")
    counts = spark.createDataFrame([r[:4] for r in rings], "cell int, ring int, first int, n int")
    held = placed.join(F.broadcast(counts), ["cell", "ring"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("n"))).cast("int"))
    held = held.join(F.broadcast(deal), "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select(F.col("id").alias("rid"), F.col("seq").alias("rseq"), F.col("v").alias("rv"), "block", "chunk")

    forbids = banned is not None

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "seq": [], "distance": []}
        if len(x) and len(y):
            v, ids, seq = units(y["rv"]), y["rid"].to_numpy(), y["rseq"].to_numpy()
            names, since = x["query_id"].to_numpy(), x["seq"].to_numpy()
            asked, no = units(x["v"]), [set(own) for own in x["no"]]
            spare = np.array([k + len(own) for own in no])
            for a in range(0, len(x), TILE):
                q, r = np.nonzero(1 - asked[a : a + TILE] @ v.T <= threshold + SLACK)
                q += a
                # a sum by pairs does not depend on a vector's place in its block, so equal vectors are equally near
                d = np.concatenate([np.zeros(0), *(1 - (asked[q[i : i + PAIRS]] * v[r[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(q), PAIRS))])
                ok = d <= threshold
                if not own:
                    ok &= names[q] != ids[r]
                if earlier_only:
                    ok &= seq[r] < since[q]
                q, r, d = q[ok], r[ok], d[ok]
                order = np.lexsort((seq[r], d, q))
                q, r, d = q[order], r[order], d[order]
                for skip in (True, False):  # the nearest but for banned ones are among as many more
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    ok = rank < (spare[q] if skip else k)
                    q, r, d = q[ok], r[ok], d[ok]
                    if skip and forbids:
                        ok = np.array([i not in no[j] for i, j in zip(ids[r].tolist(), q.tolist(), strict=True)], bool)
                        q, r, d = q[ok], r[ok], d[ok]
                for c, found in (("query_id", names[q]), ("id", ids[r]), ("seq", seq[r]), ("distance", d)):
                    out[c] += found.tolist()
        return plain(out)

    keys = ["block", "chunk"]
    met = dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(near, f"query_id {query_type}, id {id_type}, seq {seq_type}, distance double")
    best = W.partitionBy("query_id").orderBy("distance", "seq")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("seq")
