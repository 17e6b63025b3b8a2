"""Metric pruning against all pairs, and the stored vector index against exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.operators import metric, neighbors
from shoebox.operators.vector_index import VectorIndex

ROW = "id long, seq long, embedding array<float>"


def clustered(n=500, d=12, groups=14, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, d))
    return (centres[rnd.integers(0, groups, n)] + rnd.normal(size=(n, d)) * 0.35).astype(np.float32)


def frame(spark, x, more=()):
    rows = [(i, (i * 37) % (len(x) + 1), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *more], ROW).repartition(3)


def all_pairs(x, seq, threshold, k, earlier, banned):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d, out = 1 - u @ u.T, set()
    for i in range(len(x)):
        near = sorted((d[i, j], seq[j], j) for j in range(len(x)) if j != i and d[i, j] <= threshold and (not earlier or seq[j] < seq[i]) and (i, j) not in banned)
        out |= {(i, j, r + 1) for r, (_, _, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("threshold", "k", "earlier"), [(0.2, 4, False), (0.35, 10, True), (0.9, 2, True), (0.0, 3, False)])
def test_neighbours_within_a_distance_are_those_of_all_pairs(spark, threshold, k, earlier):
    x = clustered()
    x[17] = x[91] = x[92]
    seq = [(i * 37) % (len(x) + 1) for i in range(len(x))]
    banned = {(i, (i + 1) % len(x)) for i in range(0, len(x), 2)} | {(17, 91)}
    odd = [(9000, 1, [0.0] * 12), (9001, 2, None)]
    rows = frame(spark, x, odd)
    got = metric.within(rows, rows, threshold, k, earlier, spark.createDataFrame(list(banned), "query_id long, id long"), block=40, chunk=30)
    found = got.collect()
    if threshold:  # at 0 rounding decides
        assert {(r["query_id"], r["id"], r["rank"]) for r in found} == all_pairs(x, seq, threshold, k, earlier, banned)
    assert len({(r["query_id"], r["id"]) for r in found}) == len(found) and all(r["distance"] <= threshold for r in found)


def test_bounds_keep_most_queries_from_most_blocks(spark, monkeypatch):
    rows = frame(spark, clustered(800, 12, 20))
    kept, cut = [], metric.cut
    monkeypatch.setattr(metric, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    metric.within(rows, rows, 0.05, 5, block=16).collect()
    placed, sent = kept
    blocks = sum(-(-r["count"] // 16) for r in placed.groupBy("cell", "ring").count().collect())
    assert placed.count() == 800 and sent.count() < 0.25 * 800 * blocks


def test_no_rows_and_thresholds_that_cannot_be_pruned(spark):
    none = spark.createDataFrame([], ROW)
    some = frame(spark, clustered(20))
    assert metric.within(some, none, 0.3, 2).count() == 0 and metric.within(none, some, 0.3, 2).count() == 0
    with pytest.raises(ValueError):
        metric.within(some, some, 1.0, 2)


def test_an_index_is_kept_grows_and_finds_nearly_all_neighbours(spark, tmp_path):
    x = clustered(1500, 32, 25, 5)
    rows = frame(spark, x)
    path = str(tmp_path / "index")
    index = VectorIndex.create(rows.where("id < 1000"), path, parts=8)
    assert index.size() == 1000
    index = VectorIndex(spark, path)  # loaded again
    index.add(rows.where("id >= 900"))
    index.add(rows.where("id >= 900"))  # a batch that is run twice
    assert index.size() == 1500
    asked = rows.where("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in neighbors.top_k(asked, rows).collect()}
    found = index.search(asked)
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert len(got) == 750 and len(got & exact) >= 0.9 * len(exact)
    every = {(r["query_id"], r["id"]) for r in index.search(asked, probes=10**6, refine=200).collect()}
    assert every == exact  # all cells, all candidates


def test_a_search_reads_the_cells_it_probes_and_codes_before_vectors(spark, tmp_path):
    rows = frame(spark, clustered(600, 16, 12))
    index = VectorIndex.create(rows, str(tmp_path / "index"))
    plan = index.candidates(rows.where("id = 3"), 50, probes=2)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "cell" in line]
    assert scans and all("PartitionFilters: [" in s and "cell#" in s.split("PartitionFilters: [")[1].split("]")[0] and "IN (" in s.split("PartitionFilters: [")[1] or "INSET" in s for s in scans)
    assert not any("embedding" in s.split("ReadSchema")[1] for s in scans)


def test_recall_of_the_registered_query(spark):
    from shoebox.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    exact = {(r["query_id"], r["id"]) for r in QUERIES["knn_topk"](spark, sf).collect()}
    got = {(r["query_id"], r["id"]) for r in QUERIES["ann_topk"](spark, sf).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_a_rejected_nearest_person_gives_way_to_the_next(spark):
    faces = spark.createDataFrame([("f", [1.0, 0.0]), ("g", [0.0, 1.0])], "face_id string, embedding array<double>")
    anchors = spark.createDataFrame([("p", 1, [1.0, 0.0]), ("q", 2, [0.9, 0.1]), ("f", 3, [0.1, 0.9])], "person_id string, seq int, centroid array<double>")
    rejected = spark.createDataFrame([("f", "p")], "face_id string, person_id string")
    assert {(r["face_id"], r["person_id"]) for r in neighbors.nearest_anchor(faces, anchors, rejected).collect()} == {("f", "q"), ("g", "f")}
    assert {(r["face_id"], r["person_id"]) for r in neighbors.nearest_anchor(faces, anchors).select(F.col("face_id"), "person_id").collect()} == {("f", "p"), ("g", "f")}


def test_a_search_without_structure_copies_a_query_once_a_block_and_no_more(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(900, 24)).astype(np.float32)
    rows = frame(spark, x)
    kept, cut = [], metric.cut
    monkeypatch.setattr(metric, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    found = {(r["query_id"], r["id"], r["rank"]) for r in metric.within(rows, rows, 0.6, 4, block=100, chunk=200).collect()}
    seq = [(i * 37) % (len(x) + 1) for i in range(len(x))]
    assert found == all_pairs(x, seq, 0.6, 4, False, set())
    placed, sent = kept
    assert placed.groupBy("cell", "ring").count().count() > 100  # rings are many, and none of them is a block of its own
    blocks = sent.select(F.explode("blocks")).distinct().count()
    assert blocks <= 2 * 900 / 100 and sent.count() == 900  # vectors are written once each


def test_bounds_keep_most_queries_from_most_blocks_of_several_rings(spark, monkeypatch):
    rows = frame(spark, clustered(800, 12, 20))
    kept, cut = [], metric.cut
    monkeypatch.setattr(metric, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    metric.within(rows, rows, 0.05, 5, block=16).collect()
    sent = kept[1].select("query_id", F.explode("blocks").alias("block"))
    assert sent.count() < 0.25 * 800 * sent.select("block").distinct().count()


def test_equal_vectors_come_in_the_order_of_seq(spark):
    x = np.random.default_rng(2).normal(size=(61, 64)).astype(np.float32)
    x[1:40] = x[1]
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], ROW)
    asked = spark.createDataFrame([(100, 100, (x[1] + x[50] / 4).tolist())], ROW)
    got = metric.within(asked, rows, 0.9, 30, own=True).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(1, 31)) and len({r["distance"] for r in got}) == 1


def test_a_query_keeps_candidates_once_a_block_and_not_once_a_cell(spark, tmp_path, monkeypatch):
    from shoebox.operators import vector_index

    x = np.random.default_rng(4).normal(size=(900, 16)).astype(np.float32)
    rows = frame(spark, x)
    index = VectorIndex.create(rows, str(tmp_path / "index"))
    whole = {(r["query_id"], r["id"]) for r in index.candidates(rows.where("id % 20 = 0"), 20, probes=10**6).collect()}
    plan = index.candidates(rows.where("id % 20 = 0"), 20, probes=10**6)._jdf.queryExecution().optimizedPlan().toString()
    keys = next(line for line in plan.splitlines() if "FlatMapCoGroupsInPandas" in line)
    assert "block#" in keys and "chunk#" in keys and "cell#" not in keys.split("near(")[0]
    monkeypatch.setattr(vector_index, "BLOCK", 100)  # cells on several blocks, and cells of more than one
    monkeypatch.setattr(vector_index, "QUERIES", 10)
    parted = {(r["query_id"], r["id"]) for r in index.candidates(rows.where("id % 20 = 0"), 20, probes=10**6).collect()}
    assert parted == whole and len(whole) == 45 * 20
