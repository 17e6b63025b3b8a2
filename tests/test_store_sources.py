import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.plans.store import nested, page
from shoebox.plans.tables import Catalogue
from shoebox.sources import fileops, files, measures, models
from shoebox.streaming import ingest


@pytest.fixture()
def store(spark, tmp_path):
    s = Catalogue(spark, str(tmp_path / "store"), 4)
    s.migrate()
    return s


def media(spark, *items):
    return spark.createDataFrame([(i, ref, "photo", "done") for i, ref in items], "id string, source_ref string, media_type string, analysis_status string")


def test_store_keeps_the_last_row_and_the_first_place(spark, store):
    assert store.migrate() == []
    store.put("media_item", media(spark, ("a", "/1"), ("b", "/2")))
    store.patch("media_item", F.col("id") == "a", analysis_status="failed", video_proxy_path="/p")
    store.upsert_media(media(spark, ("c", "/2")))
    got = [(r["id"], r["analysis_status"], r["video_proxy_path"]) for r in page(store.read("media_item"), [F.col("seq")], 0, 0).collect()]
    assert got == [("a", "failed", "/p"), ("c", "done", None)]
    with pytest.raises(ValueError):
        store.put("media_item", media(spark, ("d", "/3")).withColumn("media_type", F.lit("song")))


def test_store_reset_and_replace(spark, store):
    store.put("media_item", media(spark, ("a", "/1")))
    store.put("quality_score", spark.createDataFrame([("a", 0.5)], "media_id string, composite double"))
    store.reset_analysis()
    assert store.read("quality_score").count() == 0 and store.read("media_item").first()["analysis_status"] == "pending"
    item = lambda m: spark.createDataFrame([("s", m, 0, "hero")], "story_id string, media_id string, ord int, role string")
    store.put("story_item", item("a"))
    store.replace_part("story_item", "story_id", "s", item("b"))
    assert [r["media_id"] for r in store.read("story_item").collect()] == ["b"]
    store.replace("story_item", store.read("story_item").drop("seq").withColumn("ord", F.lit(7)))
    assert [(r["media_id"], r["ord"]) for r in store.read("story_item").collect()] == [("b", 7)]


def test_nested(spark):
    p, c = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "id string, ord int, v string")
    got = {r["id"]: [tuple(k) for k in r["kids"]] for r in nested(p, c, "id", "kids", ["ord"]).collect()}
    assert got == {"a": [(1, "x"), (2, "y")], "b": []}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.jpg", "sub/b.mp4", "notes.txt", "X.photoslibrary/c.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    return str(root)


def test_scan_and_probe(spark, tree):
    assert files.is_online(spark, tree) and not files.is_online(spark, tree + "/none")
    found = files.scan(spark, tree)
    assert sorted(os.path.basename(r["path"]) for r in found.collect()) == ["a.jpg", "b.mp4"]
    grid = lambda path, content: {"gray": list(range(9, 0, -1)) * 8, "taken_ms": 1000} if path.endswith("jpg") else 1 / 0
    got = {os.path.basename(r["source_ref"]): r for r in files.probe(files.contents(spark, tree), grid).collect()}
    assert got["a.jpg"]["perceptual_hash"] == "f" * 16 and not got["a.jpg"]["date_uncertain"]
    assert got["b.mp4"]["perceptual_hash"] == "" and got["b.mp4"]["date_uncertain"] and len(got["b.mp4"]["content_hash"]) == 64
    cut = files.slice_of(files.contents(spark, tree).where("path like '%a.jpg'"), F.lit("bytes=1-2")).first()
    assert (cut["status"], bytes(cut["body"])) == (206, b".j")


def jpeg(order="<"):
    """A header with orientation 6, a time taken and a place, and a picture of 40 x 30."""
    p = lambda f, *v: struct.pack(order + f, *v)
    entry = lambda tag, kind, n, value: p("HHI", tag, kind, n) + (value if isinstance(value, bytes) else p("I", value))
    main, shot, place, data = 8, 50, 68, 122
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + p("I", main)
    tiff += p("H", 3) + entry(0x0112, 3, 1, p("HH", 6, 0)) + entry(0x8769, 4, 1, shot) + entry(0x8825, 4, 1, place) + p("I", 0)
    tiff += p("H", 1) + entry(0x9003, 2, 20, data) + p("I", 0)
    tiff += p("H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, data + 20) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, data + 44) + p("I", 0)
    tiff += b"2024:08:15 09:30:12\0" + p("IIIIII", 33, 1, 30, 1, 36, 1) + p("IIIIII", 151, 1, 12, 1, 0, 1)
    part = lambda marker, held: bytes([0xFF, marker]) + struct.pack(">H", len(held) + 2) + held
    return b"\xff\xd8" + part(0xE1, b"Exif\0\0" + tiff) + part(0xC0, b"\x08" + struct.pack(">HH", 30, 40) + b"\x03") + b"\xff\xda\x00\x02"


def movie():
    box = lambda name, held: struct.pack(">I", len(held) + 8) + name + held
    mvhd = struct.pack(">IIIII", 0, measures.SINCE_1904 + 1_700_000_000, 0, 600, 6300) + bytes(80)
    tkhd = bytes(76) + struct.pack(">II", 1920 << 16, 1080 << 16)
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(50)) + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"tkhd", bytes(84))) + box(b"trak", box(b"tkhd", tkhd)))


def test_dates_places_and_sizes_are_read_from_files(spark, tmp_path):
    for order in "<>":
        got = measures.photo_measures(jpeg(order))
        assert (got["width"], got["height"], got["orientation"], got["taken_ms"]) == (40, 30, 6, 1723714212000)
        assert got["lat"] == pytest.approx(-33.51) and got["lng"] == pytest.approx(151.2)
    assert measures.video_measures(movie()) == {"duration_ms": 10500, "taken_ms": 1_700_000_000_000, "width": 1920, "height": 1080}
    for n in range(0, len(jpeg()), 7):  # cut files say less and end nothing
        measures.photo_measures(jpeg()[:n])
        measures.video_measures(movie()[:n])
    for name, held in (("a.jpg", jpeg()), ("b.mov", movie()), ("c.jpg", b"no picture")):
        (tmp_path / name).write_bytes(held)
    rows = {os.path.basename(r["source_ref"]): r for r in files.probe(files.contents(spark, str(tmp_path)), files.media_probe).collect()}
    assert not rows["a.jpg"]["date_uncertain"] and rows["a.jpg"]["gps_lng"] == pytest.approx(151.2) and rows["b.mov"]["duration_ms"] == 10500
    assert rows["c.jpg"]["date_uncertain"] and rows["c.jpg"]["width"] == 0


def test_incremental_stream(spark, store, tree, tmp_path):
    run = lambda: ingest.index_root(spark, tree, "r", store, str(tmp_path / "cp")).awaitTermination()
    run()
    assert store.read("media_item").count() == 2
    run()
    with open(tree + "/z.png", "wb") as f:
        f.write(b"z")
    run()
    assert store.read("media_item").count() == 3


def test_models(spark):
    m = models.MockModel()
    assert m.quality(b"x") == models.MockModel().quality(b"x") and models.fnv1a(b"") == models.FNV_OFFSET and models.fnv1a(b"a") == 0xE40C292C
    pics = spark.createDataFrame([(f"m{i}", bytes([i])) for i in range(6)], "media_id string, content binary")
    done = models.analyze(pics).cache()
    assert done.where("status = 'done'").count() == 6
    v = models.face_rows(done).select("embedding").collect()
    assert all(abs(np.linalg.norm(r[0]) - 1) < 1e-5 and len(r[0]) == models.DIM for r in v)
    px = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert models.input_tensor(px, "bgr")[0].tolist() == [[2.0, 5.0], [8.0, 11.0]] and models.resize(px, 4, 2, "contain").shape == (2, 4, 3)
    assert models.crop(px, [-5, 1, 9, 0.1]).shape == (1, 2, 3) and models.output_named({"out_cls_8": 1}, "cls", 8) == 1 and models.laplacian_variance(np.zeros((4, 4))) == 0


def test_file_operations(tmp_path):
    ops = fileops.LocalFiles(str(tmp_path / "trash"))
    a, b, c, d = (str(tmp_path / n) for n in ("a", "x/b", "c", "y/d"))
    for p in (a, c):
        with open(p, "w") as f:
            f.write(p)
    items = [fileops.Item("1", a, b, True), fileops.Item("2", c, d, False), fileops.Item("3", str(tmp_path / "none"), str(tmp_path / "q"), True)]
    log = []
    assert fileops.apply(items, ops, lambda i, s, n: log.append((i.media_id, s)), str(tmp_path)) == "failed"
    assert log == [("1", "renamed"), ("1", "done"), ("2", "copied"), ("2", "verified"), ("2", "source_trashed"), ("2", "done"), ("3", "failed")]
    assert os.path.exists(b) and os.path.exists(d) and not os.path.exists(c)
    fileops.undo([("restructure", d, c), ("move", b, a)], ops)
    assert os.path.exists(a) and os.path.exists(c) and not os.path.exists(d)
    with pytest.raises(fileops.NotEnoughSpace):
        fileops.apply([], ops, lambda *x: None, str(tmp_path), 1 << 60)
    again = fileops.Item("1", a, b, True)
    os.makedirs(os.path.dirname(b), exist_ok=True)
    os.rename(a, b)  # the move was done, its note was not
    assert fileops.apply([again], ops, lambda *x: None, str(tmp_path)) == "done"


def test_checksum_mismatch_keeps_the_original(tmp_path):
    class Broken(fileops.LocalFiles):
        def copy(self, a, b):
            with open(b, "w") as f:
                f.write("broken")

    a = str(tmp_path / "a")
    with open(a, "w") as f:
        f.write("whole")
    assert fileops.apply([fileops.Item("1", a, str(tmp_path / "b"), False)], Broken(str(tmp_path / "t")), lambda *x: None, str(tmp_path)) == "failed"
    assert os.path.exists(a) and not os.path.exists(tmp_path / "b")


def test_state_stream(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([("p", "a", "pending", 1), ("p", "a", "done", 2)], "plan_id string, media_id string, state string, seq int").write.json(src)
    s = spark.readStream.schema("plan_id string, media_id string, state string, seq int").json(src)
    q = ingest.item_states(s).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["state"], r["seq"]) for r in spark.table("states").collect()] == [("done", 2)]
