import datetime as dt

from pyspark.sql import functions as F

from shoebox.functions import geometry, hashing, media, naming, quality, vectors


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit_array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_dhash(spark):
    up, down = lit_array(*list(range(9)) * 8), lit_array(*list(range(9, 0, -1)) * 8)
    assert tuple(one(spark, hashing.dhash(up), hashing.dhash(down))) == ("0" * 16, "f" * 16)
    assert one(spark, hashing.dhash(lit_array(2, 1, 1, 0), 2, 2))[0] == "c"


def test_hamming(spark):
    h = lambda a, b: hashing.hamming(F.lit(a), F.lit(b))
    got = one(spark, h("0000", "000f"), h("ffff", "0000"), h("f" * 16, "0" * 16), h("8" + "0" * 15, "0" * 16), h("ff", "f"), h("0" * 20, "0" * 18 + "ff"))
    assert tuple(got) == (4, 16, 64, 1, 8, 8)


def test_bands(spark):
    assert one(spark, hashing.bands(F.lit("0123456789abcdef"), 6))[0] == ["01", "234", "567", "89", "abc", "def"]


def test_vectors(spark):
    a, b, z = lit_array(1, 0), lit_array(0, 2), lit_array(0, 0)
    got = one(spark, vectors.cosine_distance(a, a), vectors.cosine_distance(a, b), vectors.cosine_distance(a, z), vectors.l2_normalize(lit_array(3, 4)), vectors.l2_normalize(z))
    assert tuple(got) == (0.0, 1.0, 1.0, [0.6, 0.8], [0.0, 0.0])


def test_boxes(spark):
    fit = geometry.letterbox(F.lit(200), F.lit(100), 100, 100)
    got = one(spark, fit, geometry.iou(lit_array(0, 0, 2, 2), lit_array(1, 1, 2, 2)), geometry.iou(lit_array(0, 0, 0, 0), lit_array(0, 0, 0, 0)), geometry.unletterbox(lit_array(0, 25, 50, 50), fit, F.lit(200), F.lit(100)))
    assert tuple(got[0]) == (100, 50, 0, 25, 0.5)
    assert abs(got[1] - 1 / 7) < 1e-12 and got[2] == 0 and got[3] == [0.0, 0.0, 100.0, 100.0]


def test_ken_burns(spark):
    no_face = F.lit(None).cast("array<double>")
    got = one(spark, geometry.ken_burns(F.lit("video"), no_face), geometry.ken_burns(F.lit("photo"), no_face), geometry.ken_burns(F.lit("photo"), lit_array(0.9, 0.9, 0.1, 0.5)))
    assert got[0]["end"] == [0, 0, 1, 1] and got[1]["end"] == [0.08, 0.08, 0.84, 0.84]
    assert [round(x, 6) for x in got[2]["end"]] == [0.87, 0.75, 0.3, 0.8]


def test_quality(spark):
    got = one(spark, quality.quality(F.lit(250.0), F.lit(0.5)), quality.quality(F.lit(None).cast("double"), F.lit(0.5)))
    assert abs(got[0]["composite"] - (0.5 * 0.4 + 0.3 + 0.075 + 0.12)) < 1e-12 and got[1]["composite"] == 0.5


def test_paths(spark):
    p = F.lit
    got = one(spark, media.media_type(p("/a/b.JPG")), media.media_type(p("/a/.jpg")), media.media_type(p("x.mp4")), media.managed_by_other_app(p("/u/A.PhotosLibrary/x")), media.managed_by_other_app(p("/u/cat.lrcat")), media.managed_by_other_app(p("/u/photos")))
    assert tuple(got) == ("photo", None, "video", True, True, False)
    got = one(spark, media.is_screenshot(p("/a/My Screen Shot.png")), media.is_screenshot(p("/screenshot/a.png")), media.is_screenshot(p("/a/スクリーンショット 1.png")), media.under(p("/c/x/y"), p("/c/x")), media.under(p("/c/x/../y"), p("/c/x")), media.under(p("/c/xy"), p("/c/x")))
    assert tuple(got) == (True, False, True, True, False, False)


def test_display(spark):
    got = one(spark, media.format_bytes(F.lit(0)), media.format_bytes(F.lit(1536)), media.format_bytes(F.lit(1024**3)), media.shorten(F.lit("x" * 50)), media.progress_percent(F.lit(1), F.lit(3)), media.bearer_token(F.lit("Bearer abc")), media.chunks(F.array(*map(F.lit, range(5))), 2))
    assert tuple(got) == ("0 B", "1.5 KB", "1.0 GB", "…" + "x" * 40, 33, "abc", [[0, 1], [2, 3], [4]])


def test_byte_range(spark):
    r = lambda h: media.byte_range(F.lit(h), F.lit(10).cast("long"))
    got = one(spark, r("bytes=2-4"), r("bytes=8-"), r("bytes=10-"), r(None))
    assert [tuple(x) for x in got] == [(2, 4, 206), (8, 9, 206), (None, None, 416), (0, 9, 200)]


def at():
    return F.lit(dt.datetime(2024, 8, 15, 9, 30, 12)).cast("timestamp")


def none():
    return F.lit(None).cast("string")


def test_target_path(spark):
    def path(src, ts, event, place, rule=naming.NamingRule()):
        return naming.target_path("/lib", F.lit(src), ts, event, place, F.lit("m1"), rule)

    got = one(
        spark,
        path("/src/IMG_1234.jpg", at(), F.lit("沖縄旅行"), none()),
        path("/src/a.jpg", at(), none(), F.lit("東京")),
        path("/src/a.jpg", at(), none(), none()),
        path("/src/a.jpg", F.lit(None).cast("timestamp"), none(), none()),
        path("/src/a.jpg", at(), none(), none(), naming.NamingRule(False, False, False, True)),
    )
    assert got[0] == "/lib/2024/2024-08-15_沖縄旅行/2024-08-15_093012_IMG_1234.jpg"
    assert "/2024-08-15_東京/" in got[1] and "/2024-08-15_2024-08-15/" in got[2] and "/unknown/" in got[3] and got[4] == "/lib/a.jpg"


def test_segments(spark):
    got = one(spark, naming.sanitize_segment(F.lit('a/b:c*?"<>|')), naming.sanitize_segment(F.lit("   ")), naming.with_sequence(F.lit("/a/b.jpg"), F.lit(0)), naming.with_sequence(F.lit("/a/b.jpg"), F.lit(2)), naming.with_sequence(F.lit("/a.b/c"), F.lit(1)))
    assert tuple(got) == ("abc", "untitled", "/a/b.jpg", "/a/b_2.jpg", "/a.b/c_1")


def test_template_path(spark):
    def path(uncertain, event, template=naming.NamingTemplate(), ts=None):
        return naming.template_path("/lib", F.lit("/s/IMG_1.jpg"), at() if ts is None else ts, F.lit(uncertain), F.lit("m1"), event, none(), none(), template)

    custom = naming.NamingTemplate("{yyyy}/__{person}__{nothing}/{event}_{seq}", ("place", "date"))
    got = one(spark, path(False, F.lit("Trip")), path(True, F.lit("Trip")), path(False, none(), ts=F.lit(None).cast("timestamp")), path(False, F.lit("Trip"), custom))
    assert got[0] == "/lib/2024/2024-08-15_Trip/2024-08-15_093012_IMG_1.jpg"
    assert got[1] == got[2] == f"/lib/{naming.UNCERTAIN_FOLDER}/IMG_1.jpg"
    assert got[3] == "/lib/2024/2024-08-15.jpg"


def test_event_title(spark):
    got = one(spark, naming.event_title(at(), F.lit("東京"), F.lit(3)), naming.event_title(at(), none(), F.lit(3)), naming.event_title(F.lit(None).cast("timestamp"), F.lit("東京"), F.lit(3)))
    assert tuple(got) == ("2024年8月15日 東京", "2024年8月15日の思い出（3枚）", "東京の思い出")


def test_a_rule_and_dates_are_found_once_a_row(spark):
    from shoebox.plans.queries import QUERIES

    plan = QUERIES["template_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("from_json(") + plan.count("jsontostructs(") == 1 and plan.count("date_format(") + plan.count("dateformatclass(") <= 4
