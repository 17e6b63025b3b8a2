import random

import numpy as np
from pyspark.sql import functions as F

from shoebox.operators import boxes, curation, dedup, direction, graph, junk, neighbors, persons, restructure, space

H = 3_600_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is None, x) for x in r])


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for i in range(350)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = graph.components(spark.range(350).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {i: find(i) for i in range(350)}


def test_duplicate_groups(spark):
    m = spark.createDataFrame([("a", 1, "h1", "0" * 16), ("b", 2, "h1", "f" * 16), ("c", 3, "", "0" * 15 + "3"), ("d", 4, "x", "5" * 16), ("e", 5, "y", "")], "media_id string, seq int, content_hash string, perceptual_hash string")
    q = spark.createDataFrame([("a", 0.1), ("c", 0.9)], "media_id string, composite double")
    got = rows(dedup.duplicate_groups(m, q, 4))
    assert got == [("a", "a", False), ("a", "b", False), ("a", "c", True)]
    got = rows(dedup.duplicate_groups(m, None, near=False))
    assert got == [("a", "a", True), ("a", "b", False)]
    prop = rows(dedup.dedup_proposal(dedup.duplicate_groups(m, None, near=False)))
    assert [p[2] for p in prop] == ["keep", "trash"]


def test_hamming_pairs_against_brute_force(spark):
    rnd = random.Random(2)
    hs = [rnd.getrandbits(64) for _ in range(60)]
    hs += [h ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for h in hs[:30]]
    want = sorted((i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(90) for j in range(i + 1, 90) if (hs[i] ^ hs[j]).bit_count() <= 5)
    got = dedup.hamming_pairs(spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hs)], "id int, hash string"))
    assert rows(got) == want


def test_junk(spark):
    m = spark.createDataFrame([(1, "/a/screenshot.png"), (2, "/a/b.png"), (3, "/a/c.png"), (4, "/a/d.png")], "media_id int, source_ref string")
    q = spark.createDataFrame([(1, 0.1, 0.5, 0.1), (2, 0.5, 0.95, 0.9), (3, 0.5, 0.5, 0.3)], "media_id int, sharpness double, exposure double, composite double")
    assert rows(junk.junk(m, q).select("media_id", "reason")) == [(1, f"{junk.SCREENSHOT} / {junk.BLURRED}"), (2, junk.BLOWN), (3, junk.POOR)]


def events(spark, data):
    return spark.createDataFrame([("lib", *d) for d in data], "library_id string, media_id string, created_ms long, place string, seq int")


def test_sessions(spark):
    e = events(spark, [("a", 0, None, 1), ("b", H, None, 2), ("c", 20 * H, "X", 3), ("d", 20 * H + 1, "Y", 4), ("e", 26 * H + 1, None, 5), ("f", 26 * H + 2, "X", 6), ("g", None, "X", 7)])
    got = {r["media_id"]: (r["event_no"], r["position"]) for r in curation.sessions(e).collect()}
    assert got == {"a": (1, 0), "b": (1, 1), "c": (2, 0), "d": (3, 0), "e": (3, 1), "f": (3, 2)}


def test_stories(spark):
    e = events(spark, [("a", 0, "X", 1), ("b", 1, "Y", 2)])
    e = e.withColumn("place", F.lit("X"))
    q = spark.createDataFrame([("a", 0.2), ("b", 0.95)], "media_id string, composite double")
    items = curation.story_items(curation.sessions(e), q, 1)
    assert rows(items.select("media_id", "role")) == [("a", "support"), ("b", "hero")]
    s = curation.stories(items).first()
    assert (s["cover_id"], s["n_items"], s["place"], s["title"]) == ("b", 2, "X", "1970年1月1日 X")


def test_timeline(spark):
    items = spark.createDataFrame([("s", "a", 0, "hero"), ("s", "b", 1, "support"), ("s", "x", 2, "support"), ("s", "c", 3, "support")], "story_id string, media_id string, `order` int, role string")
    m = spark.createDataFrame([("a", "photo", None), ("b", "video", 20000), ("c", "photo", None)], "media_id string, media_type string, duration_ms long")
    got = rows(direction.timeline(items, m).select("order", "start_ms", "duration_ms", "transition_in"))
    assert got == [(0, 0, 5200, "none"), (1, 4600, 12000, "crossfade"), (3, 16000, 4000, "crossfade")]
    faces = spark.createDataFrame([("a", [0.0, 0.0, 0.1, 0.1], 1), ("a", [0.4, 0.4, 0.2, 0.2], 2)], "media_id string, bbox array<double>, seq int")
    kb = direction.timeline(items, m, faces).where("media_id = 'a'").first()["kb_end"]
    assert [round(x, 6) for x in kb] == [0.34, 0.34, 0.32, 0.32]


def test_neighbors_and_clusters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 8))
    x[40:60] = x[:20] + rng.normal(size=(20, 8)) * 0.01
    f = spark.createDataFrame([(i, i, x[i].tolist()) for i in range(80)], "id int, seq int, embedding array<double>")
    d = 1 - (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    got = neighbors.top_k(f, f, 3, block=16)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i in range(80):
        want = [j for j in np.lexsort((np.arange(80), d[i])) if j != i][:3]
        assert [by[i][k] for k in (1, 2, 3)] == want
    comp = {r["node"]: r["component"] for r in neighbors.cluster_faces(f, 0.01, 10).collect()}
    assert all(comp[40 + i] == comp[i] == i for i in range(20)) and comp[79] == 79


def test_centroids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0])], "g string, embedding array<double>")
    got = {r["g"]: r["centroid"] for r in neighbors.centroids(v, "g").collect()}
    assert np.allclose(got["a"], [0.5**0.5] * 2) and got["z"] == [0.0, 0.0]


def test_verdict_fold_against_replay(spark):
    rnd = random.Random(4)
    log = [(rnd.randrange(20), rnd.randrange(3), rnd.choice(["confirm", "reject"]), rnd.randrange(100), i) for i in range(400)]
    confirm, reject = {}, {}
    for f, p, v, _, _ in sorted(log, key=lambda x: (x[3], x[4])):
        if v == "confirm":
            confirm[f] = p
            reject.get(f, set()).discard(p)
        else:
            reject.setdefault(f, set()).add(p)
            if confirm.get(f) == p:
                del confirm[f]
    yes, no = persons.fold_verdicts(spark.createDataFrame(log, "face_id int, person_id int, verdict string, created_ms long, seq int"))
    assert dict(rows(yes)) == confirm and rows(no) == sorted((f, p) for f, ps in reject.items() for p in ps)


def test_recluster(spark):
    f = spark.createDataFrame([("f1", [1.0, 0.0], "A"), ("f2", [0.99, 0.1], "A"), ("f3", [0.0, 1.0], "B"), ("f4", [-1.0, 0.0], "A"), ("f5", [-1.0, 0.1], "Z")], "face_id string, embedding array<double>, cluster_id string")
    p = spark.createDataFrame([("pa", "A", 1), ("pb", "B", 2)], "person_id string, cluster_id string, seq int")
    fb = spark.createDataFrame([("f2", "pa", "reject", 1, 1), ("f2", "pb", "confirm", 2, 2), ("f4", "pa", "reject", 3, 3)], "face_id string, person_id string, verdict string, created_ms long, seq int")
    got = {r["face_id"]: (r["cluster_id"], r["rule"]) for r in persons.recluster(f, p, fb).collect()}
    assert got["f2"] == ("B", "confirmed") and got["f1"] == ("A", "nearest") and got["f4"] == ("cluster-f4", "new") and got["f5"] == ("Z", "kept")


def test_persons(spark):
    f = spark.createDataFrame([("f1", "m1", "A", 1), ("f2", "m1", "A", 2), ("f3", "m2", "B", 3)], "face_id string, media_id string, cluster_id string, seq int")
    p = spark.createDataFrame([("pa", "A", "Ann", "f2", None), ("pb", "B", None, None, "pa")], "person_id string, cluster_id string, display_name string, cover_face_id string, merged_into string")
    assert rows(persons.list_persons(f, p)) == [("pa", "A", "Ann", 1, "m1")]
    assert persons.sync_persons(f, p).count() == 0
    people, faces = persons.merge_persons(p.withColumn("merged_into", F.lit(None).cast("string")), f, "pb", "pa")
    assert rows(persons.list_persons(faces, people).select("person_id", "photo_count")) == [("pa", 2)]


def test_folders_and_space(spark):
    items = spark.createDataFrame([("/lib/2023/a/x.jpg",), ("/lib/2024/b/y.jpg",), ("/lib/2024/b/z.jpg",), ("/lib/w.jpg",)], "to_path string")
    counts = space.folder_counts(items, "/lib")
    assert dict(rows(counts)) == {"": 4, "2023": 1, "2023/a": 1, "2024": 2, "2024/b": 2}
    tree = space.folder_tree(counts)
    assert [c["path"] for c in tree["children"]] == ["2023", "2024"] and tree["children"][1]["children"][0]["added"] == 2
    m = spark.createDataFrame([("a", "2024-01-01 00:00:00", 100), ("b", "2024-05-01 00:00:00", 300), ("c", None, 50)], "media_id string, t string, bytes long").withColumn("created_at", F.col("t").cast("timestamp"))
    assert rows(space.by_year(m)) == [("2024", 400, 2), ("unknown", 50, 1)] and space.total(m).first()[0] == 450


def test_sequence_paths_against_greedy(spark):
    names = ["/l/x.jpg", "/l/x.jpg", "/l/x_1.jpg", "/l/x_1.jpg", "/l/x_2.jpg", "/l/y.jpg", "/l/y.jpg", "/l/x.jpg"]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "seq int, base_path string")
    got = {r["seq"]: r["to_path"] for r in restructure.sequence_paths(items).collect()}
    assert len(set(got.values())) == len(names)
    assert {got[0], got[2], got[4], got[5]} == {"/l/x.jpg", "/l/x_1.jpg", "/l/x_2.jpg", "/l/y.jpg"} and got[6] == "/l/y_1.jpg"
    there = spark.createDataFrame([("/l/y.jpg",), ("/l/y_2.jpg",)], "path string")
    got = {r["seq"]: r["to_path"] for r in restructure.sequence_paths(items.where("base_path = '/l/y.jpg'"), there).collect()}
    assert got == {5: "/l/y_1.jpg", 6: "/l/y_3.jpg"}


def test_plan_states(spark):
    t = spark.createDataFrame([("p", "a", "pending", 1), ("p", "a", "done", 2), ("p", "b", "failed", 3), ("q", "c", "copied", 4)], "plan_id string, media_id string, state string, seq int")
    s = restructure.fold_states(t)
    assert rows(restructure.plan_status(s)) == [("p", "failed"), ("q", "running")]
    assert rows(restructure.unfinished(s).select("media_id")) == [("c",)]


def test_nms_and_decoders(spark):
    b = spark.createDataFrame([("i", 1, [0.0, 0.0, 10.0, 10.0], 0.9), ("i", 2, [1.0, 1.0, 10.0, 10.0], 0.8), ("i", 3, [50.0, 50.0, 10.0, 10.0], 0.7)], "image_id string, box_id int, bbox array<double>, score double")
    assert rows(boxes.nms(b).select("box_id")) == [(1,), (3,)]
    cls = [0.0] * 16
    cls[5] = 1.0
    box = [0.5, 0.5, 0.0, 0.0] * 16
    o = spark.createDataFrame([("i", 8, cls, cls, box, None, 64, 96)], "image_id string, stride int, cls array<double>, obj array<double>, bbox array<double>, kps array<double>, orig_w int, orig_h int")
    r = boxes.decode_anchors(o, 32, 32, 0.5).first()
    assert r["bbox"] == [16.0, 24.0, 16.0, 24.0] and r["score"] == 1.0 and r["landmarks"] is None
    flat = [10.0, 35.0, 20.0, 20.0] + [0.0] * 10 + [0.9] + [0.0] * 15
    r = boxes.decode_rows(spark.createDataFrame([("i", flat, 200, 100)], "image_id string, data array<double>, orig_w int, orig_h int"), 100, 100, 0.5).collect()
    assert len(r) == 1 and r[0]["bbox"] == [20.0, 20.0, 40.0, 40.0]


def test_approximate_neighbours_have_most_of_the_exact_ones(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "vec_id AS seq", "embedding")
    asked = e.where("id % 20 = 0")
    exact = {(r["query_id"], r["id"]) for r in neighbors.top_k(asked, e).collect()}
    found = {(r["query_id"], r["id"]) for r in neighbors.approximate_top_k(asked, e).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    cells = neighbors.fit_cells(e, 5)
    whole = {(r["query_id"], r["id"]) for r in neighbors.approximate_top_k(asked, e, centres=cells, probes=5).collect()}
    assert whole == exact


def test_hash_range_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    index = [rnd.getrandbits(64) for _ in range(200)]
    asked = [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(9))) for h in index[:60]]
    frame = lambda hs: spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hs)] + [(-1, "short"), (-2, None)], "id int, hash string")
    for most in (0, 1, 4, 5, 7):
        got = {(r["query_id"], r["id"]) for r in dedup.hash_range(frame(asked), frame(index), most).collect()}
        assert got == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(index) if (a ^ b).bit_count() <= most}


def test_hash_range_broadcasts_no_bands_and_meets_equal_hashes_once(spark):
    copies = spark.range(300).select("id", F.when(F.col("id") < 200, F.lit("00000000000000ff")).otherwise(F.lpad(F.hex(F.col("id") * 7919), 16, "0")).alias("hash"))
    asked = spark.createDataFrame([(1000, "00000000000000ff"), (1001, "00000000000000fe"), (1001, "00000000000000fe")], "id long, hash string")
    found = dedup.hash_range(asked, copies)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    got = [tuple(r) for r in found.where("id < 200").collect()]
    assert sorted(got) == sorted([(1000, i, 0) for i in range(200)] + [(1001, i, 1) for i in range(200)])


def test_text_grids_count_words_by_their_hash_without_a_shuffle(spark):
    import hashlib

    texts = ["a b  a", "", None, "é " * 300, "x\ny z"]
    d = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    grids = dedup.text_grids(d, keep=("kept",))
    assert "Exchange" not in grids._jdf.queryExecution().executedPlan().toString()
    for r in grids.collect():
        want = [0] * 72
        for w in [] if texts[r["doc_id"]] is None else texts[r["doc_id"]].split(" "):
            want[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 72] += 1
        assert r["grid"] == want and r["kept"] == f"k{r['doc_id']}"
    assert grids.count() == 5


def test_nms_compares_products_like_its_sql_at_the_threshold(spark):
    def box(k, s):  # two boxes of the part table; a quotient rounds to the other side of the threshold
        return [k % 10 / 20.0, s % 7 / 10.0, 0.05 + s / 100.0, 0.1 + k % 30 / 60.0]

    (x, y, w, h), (u, v, s, t) = a, b = box(0, 37), box(3, 16)
    both = max(0.0, min(x + w, u + s) - max(x, u)) * max(0.0, min(y + h, v + t) - max(y, v))
    union = w * h + s * t - both
    assert (both > 0.4 * union) != (both / union > 0.4)
    kept = boxes.nms(spark.createDataFrame([("i", 1, a, 0.9), ("i", 2, b, 0.8)], "image_id string, box_id int, bbox array<double>, score double"))
    assert kept.count() == (1 if both > 0.4 * union else 2)
