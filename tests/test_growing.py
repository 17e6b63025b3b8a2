"""Merges that touch parts, components and duplicate groups that grow by batches, stateful checks of transitions."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from shoebox.operators import dedup, graph
from shoebox.operators.hash_index import HashIndex
from shoebox.plans import store
from shoebox.plans.lineage import cut
from shoebox.plans.tables import Catalogue
from shoebox.streaming import ingest, plan_states
from shoebox.streaming.duplicates import Duplicates


def test_a_merge_leaves_untouched_parts_alone_and_may_run_twice(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"), 16)
    c.migrate()
    rows = spark.createDataFrame([(f"k{i}", str(i)) for i in range(200)], "key string, value string")
    c.put("app_settings", rows)
    names = lambda: set(glob.glob(str(tmp_path / "c/app_settings/part=*/*.parquet")))
    before, change = names(), spark.createDataFrame([("k7", "new"), ("k7", "newest"), ("k8", "x")], "key string, value string").coalesce(1)
    for _ in range(2):
        c.put("app_settings", change)
        assert {r["value"] for r in c.read("app_settings").where("key in ('k7', 'k8')").collect()} == {"newest", "x"} and c.read("app_settings").count() == 200
    folders = lambda files: {os.path.dirname(f) for f in files}
    assert len(folders(before - names())) <= 2 and len(before & names()) >= len(before) - 2
    place = {r["key"]: r["seq"] for r in c.read("app_settings").collect()}
    assert len(set(place.values())) == 200 and place["k7"] < place["k9"] or place["k7"] < max(place.values())
    c.delete("app_settings", rows.where("key <> 'k3'"))
    assert [r["key"] for r in c.read("app_settings").collect()] == ["k3"]
    c.delete("app_settings", rows)
    assert c.read("app_settings").count() == 0
    c.put("app_settings", rows.limit(0))
    assert c.read("app_settings").count() == 0


def test_children_are_replaced_parent_by_parent(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path / "c"), 4)
    c.migrate()
    items = lambda *x: spark.createDataFrame([(s, m, i, "hero") for i, (s, m) in enumerate(x)], "story_id string, media_id string, ord int, role string")
    c.put("story_item", items(("s", "a"), ("s", "b"), ("t", "a")))
    c.replace_part("story_item", "story_id", "s", items(("s", "z")))
    assert sorted((r["story_id"], r["media_id"]) for r in c.read("story_item").collect()) == [("s", "z"), ("t", "a")]
    c.replace_part("story_item", "story_id", "u", items(("u", "q")))
    c.replace_part("story_item", "story_id", "t", spark.createDataFrame([], "story_id string, media_id string, ord int, role string"))
    assert sorted((r["story_id"], r["media_id"]) for r in c.read("story_item").collect()) == [("s", "z"), ("u", "q")]


def test_components_folded_by_batches_are_those_of_all_edges(spark):
    rnd = random.Random(6)
    edges = [(f"n{rnd.randint(0, 90):02}", f"n{rnd.randint(0, 90):02}") for _ in range(75)]
    frame = lambda e: spark.createDataFrame(e, "a string, b string")
    labels, roots = spark.createDataFrame([], "node string, label string"), spark.createDataFrame([], "label string, root string")
    for i in (0, 25, 50, 50):  # the last batch twice
        new, moved = graph.fold(labels, roots, frame(edges[i : i + 25]))
        new, moved = cut(new), cut(moved)
        roots = cut(roots.join(moved.select("label"), "label", "left_anti").unionByName(moved))
        labels = cut(labels.unionByName(new))
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e})], "node string")
    whole = {tuple(r) for r in graph.components(nodes, frame(edges)).collect()}
    assert {tuple(r) for r in graph.resolved(labels, roots).collect()} == whole
    assert new.isEmpty() and moved.isEmpty()


def hashes(rnd, n):
    base = [rnd.getrandbits(64) for _ in range(12)] + [0]
    out = []
    for i in range(n):
        x = rnd.choice(base)
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        out.append((f"m{i:03}", f"{0 if i % 5 == 0 else x:016x}", f"c{rnd.randint(0, n)}" if i % 7 else ""))
    return out


def test_a_hash_index_is_kept_and_is_not_shuffled_by_a_search(spark, tmp_path):
    rows = spark.createDataFrame(hashes(random.Random(2), 160), "id string, hash string, content_hash string")
    path = str(tmp_path / "hashes")
    index = HashIndex(spark, path, "kept")
    index.add(rows.where("id < 'm100'"))
    index.add(rows.where("id >= 'm090'"))
    index.add(rows.where("id >= 'm090'"))
    found = HashIndex(spark, path, "kept").near(rows.where("id like '%5'"))
    want = {tuple(r) for r in dedup.hash_range(rows.where("id like '%5'").select("id", "hash"), rows.select("id", "hash")).collect()}
    assert index.size() == 160 and {tuple(r) for r in found.collect()} == want and want
    met = index.near_codes(rows.where("id = 'm001'").select(F.lit(5).cast("long").alias("code")))
    plan = met._jdf.queryExecution().executedPlan().toString()
    at = [i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and "kept_bands" in line]
    above = plan.splitlines()[at[0] - 4 : at[0]]
    assert at and not any("Exchange" in line for line in above if "hashpartitioning" in line) and "Bucketed: true" in plan
    spark.sql("DROP TABLE kept_bands")
    spark.sql("DROP TABLE kept_ids")


def test_duplicate_groups_grow_with_the_index_chain(spark, tmp_path):
    rnd = random.Random(9)
    c = Catalogue(spark, str(tmp_path / "c"), 4)
    c.migrate()
    kept = Duplicates(spark, str(tmp_path / "d"))
    root, seen = tmp_path / "root", []
    root.mkdir()
    grids = {f"p{i}.jpg": [rnd.randint(0, 9) for _ in range(72)] if i % 4 else [0] * 72 for i in range(24)}
    grids["p5.jpg"] = list(grids["p3.jpg"])
    grids["p5.jpg"][10] += 20
    probe = lambda path, file: {"gray": grids[os.path.basename(path)]}
    for batch in (range(0, 8), range(8, 16), range(16, 24)):
        for i in batch:
            (root / f"p{i}.jpg").write_bytes(bytes([i % 9]))
        q = ingest.index_root(spark, str(root), "r", c, str(tmp_path / "cp"), probe, steps=[kept.fold, lambda m: seen.append(m.count())])
        q.awaitTermination()
    assert seen == [8, 8, 8] and c.read("media_item").count() == 24
    media = c.read("media_item").select(F.col("id").alias("media_id"), "seq", "content_hash", "perceptual_hash")
    want = {(r["group_id"], r["media_id"]) for r in dedup.duplicate_groups(media).collect()}
    assert want and {tuple(r) for r in kept.groups().collect()} == want
    kept.fold(c.read("media_item"))  # a batch that is run again
    assert {tuple(r) for r in kept.groups().collect()} == want
    kept.drop()


STEPS = "plan_id string, media_id string, same_drive boolean, state string, seq long"


def test_transitions_are_checked_in_a_stream_as_in_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(1)
    rows = []
    for i in range(12):
        same = i % 2 == 0
        order = list(plan_states.SAME_DRIVE if same else plan_states.CROSS_DRIVE)
        if i % 3 == 0:
            order.insert(rnd.randint(1, len(order)), rnd.choice(["copied", "failed", "pending", "done"]))
        rows += [("p", f"m{i}", same, s, 10 * n) for n, s in enumerate(order)]
    rows += [("p", "slow", True, "pending", 1), ("p", "slow", True, "renamed", 5)]
    src = str(tmp_path / "in")
    put = lambda some: spark.createDataFrame(some, STEPS).coalesce(1).write.mode("append").json(src)
    got = lambda: {tuple(r) for r in spark.table("verdicts").collect()}
    want = {tuple(r) for r in plan_states.check_transitions(spark.createDataFrame(rows, STEPS)).collect()}
    put([r for r in rows if r[4] < 20])
    out = plan_states.watch_transitions(spark.readStream.schema(STEPS).json(src), 15_000)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    q = out.writeStream.outputMode("append").format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait(ready):
        end = time.time() + 60
        while time.time() < end and q.isActive and not ready(got()):
            time.sleep(0.5)
        assert ready(got()), q.exception()

    try:
        wait(lambda seen: len(seen) >= sum(r[4] < 20 for r in rows))
        put([r for r in rows if r[4] >= 20])
        wait(lambda seen: {r for r in seen if r[5] not in ("stalled", "late")} == want)
        assert {"ok", "illegal"} <= {r[5] for r in got()}
        put([("p", "m1", False, "copied", 10), ("p", "m1", False, "done", 40)])
        wait(lambda seen: {("m1", 10, "late"), ("m1", 40, "repeated")} <= {(r[1], r[2], r[5]) for r in seen})
        wait(lambda seen: ("p", "slow", 5, "renamed", "renamed", "stalled") in seen)
    finally:
        q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cursors_walk_the_whole_order(spark):
    rows = [(i, None if i % 11 == 0 else (i * 7) % 5) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, at long")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got, after = [], None
    while True:
        page = store.cursor_page(df, "at", "id", 10, after).collect()
        got += sorted(((r["id"], r["at"]) for r in page), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        nxt = page[0]["next_cursor"]
        if nxt is None:
            break
        assert len(page) == 10
        after = (nxt["key"], nxt["identity"])
    assert got == want
    assert store.cursor_page(df.limit(0), "at", "id", 10).count() == 0
