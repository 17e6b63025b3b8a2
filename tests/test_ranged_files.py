"""Files read by ranges: long videos, metadata of all picture kinds, trees listed by tasks."""

import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from shoebox.sources import files, measures, ranged, tree

from test_store_sources import jpeg, movie

BOX = lambda name, held: struct.pack(">I", len(held) + 8) + name + held
TIFF = jpeg()[12 : 12 + struct.unpack(">H", jpeg()[4:6])[0] - 8]
TAKEN = {"orientation": 6, "taken_ms": 1723714212000, "lat": pytest.approx(-33.51), "lng": pytest.approx(151.2)}


def heic(stored=0, version=1):
    """A picture of two parts whose metadata are its third item: behind all boxes, or in a box of their own."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + TIFF
    full = lambda name, held, v=0: BOX(name, bytes([v, 0, 0, 0]) + held)
    infe = lambda i, kind: full(b"infe", struct.pack(">HH", i, 0) + kind + b"\0", 2)
    iinf = full(b"iinf", struct.pack(">H", 2) + infe(1, b"hvc1") + infe(3, b"Exif"))
    ipco = BOX(b"ipco", full(b"ispe", struct.pack(">II", 512, 512)) + full(b"ispe", struct.pack(">II", 4032, 3024)))

    def whole(at):
        entry = lambda i, place, n: struct.pack(">H", i) + (struct.pack(">H", stored if i == 3 else 0) if version else b"") + struct.pack(">HHII", 0, 1, place, n)
        iloc = full(b"iloc", struct.pack(">HH", 0x4400, 2) + entry(1, 0, 9) + entry(3, at, len(exif)), version)
        meta = full(b"meta", iinf + iloc + BOX(b"iprp", ipco) + (BOX(b"idat", b"xx" + exif) if stored else b""))
        return BOX(b"ftyp", b"heic") + meta + BOX(b"mdat", b"" if stored else b"pixels" + exif)

    return whole(2) if stored else whole(len(whole(0)) - len(exif))


def png():
    chunk = lambda name, held: struct.pack(">I", len(held)) + name + held + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 480) + bytes(5)) + chunk(b"IDAT", bytes(99)) + chunk(b"eXIf", TIFF) + chunk(b"IEND", b"")


def webp(marked):
    chunk = lambda name, held: name + struct.pack("<I", len(held)) + held + bytes(len(held) % 2)
    size = lambda n: (n - 1).to_bytes(3, "little")
    held = chunk(b"VP8X", bytes(4) + size(800) + size(600)) + chunk(b"VP8 ", bytes(31)) + chunk(b"EXIF", (b"Exif\0\0" if marked else b"") + TIFF)
    return b"RIFF" + struct.pack("<I", len(held) + 4) + b"WEBP" + held


@pytest.mark.parametrize(
    ("held", "size"),
    [(heic(), (4032, 3024)), (heic(version=0), (4032, 3024)), (heic(1), (4032, 3024)), (png(), (640, 480)), (webp(True), (800, 600)), (webp(False), (800, 600)), (jpeg(), (40, 30))],
)
def test_dates_and_sizes_of_all_kinds_of_pictures(held, size):
    assert measures.photo_measures(held) == {"width": size[0], "height": size[1], **TAKEN}
    for n in range(0, len(held), 5):  # a cut file says less, or is refused as damaged
        try:
            measures.photo_measures(held[:n])
        except (ValueError, struct.error, IndexError):
            continue


def test_sizes_of_pictures_without_metadata():
    assert measures.photo_measures(b"GIF89a" + struct.pack("<HH", 7, 5)) == {"width": 7, "height": 5}
    assert measures.photo_measures(b"BM" + bytes(16) + struct.pack("<ii", 9, -4)) == {"width": 9, "height": 4}
    lossless = b"/" + struct.pack("<I", (99 << 14) | 199) + bytes(9)
    assert measures.photo_measures(b"RIFF\0\0\0\0WEBPVP8L" + struct.pack("<I", len(lossless)) + lossless) == {"width": 200, "height": 100}
    assert measures.photo_measures(TIFF)["taken_ms"] == TAKEN["taken_ms"] and measures.photo_measures(b"") == {}


def test_a_video_beyond_two_gigabytes_is_indexed_in_one_pass(spark, tmp_path):
    root = tmp_path / "films"
    root.mkdir()
    (root / "a.heic").write_bytes(heic())
    (root / "gone.jpg").symlink_to(root / "none")
    film, start, end = root / "long.mp4", BOX(b"ftyp", b"isom"), movie()[-len(movie()) + 12 + 58 :]
    hole = 3 << 30
    with open(film, "wb") as f:  # the frames are a hole of 3 GB; what describes them comes last
        f.write(start + struct.pack(">I4sQ", 1, b"mdat", hole + 16))
        f.seek(hole, os.SEEK_CUR)
        f.write(end)
    digest = hashlib.sha256(start + struct.pack(">I4sQ", 1, b"mdat", hole + 16))
    for _ in range(hole >> 24):
        digest.update(bytes(1 << 24))
    digest.update(end)
    found = files.scan(spark, str(root))
    rows = {os.path.basename(r["source_ref"]): r for r in files.probe(found, files.media_probe).collect()}
    assert set(rows) == {"a.heic", "long.mp4"}
    assert rows["long.mp4"]["content_hash"] == digest.hexdigest()
    assert (rows["long.mp4"]["duration_ms"], rows["long.mp4"]["width"], rows["long.mp4"]["date_uncertain"]) == (10500, 1920, False)
    assert rows["a.heic"]["width"] == 4032 and not rows["a.heic"]["date_uncertain"]
    last = files.slice_of(found.where("path like '%mp4'"), F.lit(f"bytes={os.path.getsize(film) - 4}-")).first()
    assert (last["status"], bytes(last["body"])) == (206, end[-4:])
    assert files.slice_of(found.where("path like '%mp4'"), F.lit("bytes=9999999999-")).first()["body"] is None


def test_a_file_is_read_by_chunks(tmp_path, monkeypatch):
    path = tmp_path / "x"
    path.write_bytes(bytes(range(256)) * 100)
    with ranged.File(str(path)) as f, ranged.File(f"file://{path}") as g:
        asked = []
        whole = f.read
        monkeypatch.setattr(f, "read", lambda at, n: asked.append(n) or whole(at, n))
        assert b"".join(f.chunks(1000)) == path.read_bytes() and set(asked) == {1000}
        assert g.read(250, 10) == bytes([250, 251, 252, 253, 254, 255, 0, 1, 2, 3]) and g.read(25_599, 9) == b"\xff" and g.read(30_000, 4) == b"" and g.read(-1, 4) == b""
    part = ranged.Part(ranged.Held(b"abcdef"), 2, 3)
    assert (part.read(0, 9), part.read(2, 9), part.read(3, 1), part.size) == (b"cde", b"e", b"", 3)


def test_a_tree_is_listed_by_parts_and_managed_libraries_are_never_entered(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    names = [f"{y}/{m}/p{i}.JPG" for y in ("2023", "2024") for m in ("01", "02") for i in range(3)] + ["top.mp4", ".jpg", "notes.txt", "2024/deep/er/est/x/y/z.heic", "A.photoslibrary/in/b.jpg", "2024/Lightroom/c.jpg", "d.lrcat"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x" * 3)
    want = sorted(str(root / n) for n in names if n.endswith(("JPG", "mp4", "heic")))
    found = files.scan(spark, str(root))
    assert found.columns == ["path", "mtime", "bytes", "media_type"] and found.rdd.getNumPartitions() > 4
    rows = found.collect()
    assert sorted(r["path"] for r in rows) == want and {r["bytes"] for r in rows} == {3} and {r["media_type"] for r in rows} == {"photo", "video"}
    entered, entries = [], tree._entries
    monkeypatch.setattr(tree, "_entries", lambda system, path: entered.append(path) or entries(system, path))
    reader = tree.TreeReader(str(root) + "/")
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == want
    assert not [p for p in entered if "library" in p or "Lightroom" in p]
    few = tree.TreeReader(str(root / "none"))
    assert [list(few.read(p)) for p in few.partitions()] == [[]]
    system, _, _ = tree._listed(str(root))
    assert tree._entries(system, str(root / "top.mp4")) == ([], [])  # what cannot be listed is passed over
