"""Registered queries of the catalogue's reads and writes, each with the SQL of its result.

A write is a merge of a table with its changes; the query gives the table as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import geometry, media
from shoebox.operators import dedup, direction, merge
from shoebox.plans import store
from shoebox.plans.lineage import cut
from shoebox.plans.queries import _BOX, _PHASH, event_faces, hashed_documents, part_box, query, rounded, table
from shoebox.sources.files import videos_without_proxy as without_proxy

_BIT_DISTANCE = "(bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT)))::INTEGER"


# ---- roots ----


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/vol/"), "n_name").alias("path"), (F.col("n_regionkey") > 1).alias("is_online"))


_ROOTS = "r AS (SELECT n_nationkey::BIGINT AS id, '/vol/' || n_name AS path, n_regionkey > 1 AS is_online FROM nation)"


@query(f"WITH {_ROOTS} SELECT * FROM r WHERE id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, '/vol/' || s_name, true FROM supplier")
def add_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/vol/"), "s_name").alias("path"), F.lit(True).alias("is_online"))
    return merge.upsert(roots(spark, sf_dir), new, ["id"])


@query(f"WITH {_ROOTS}, c AS (SELECT c_nationkey, avg(c_acctbal) > 4500 AS up FROM customer WHERE c_nationkey < 20 GROUP BY 1) SELECT id, path, coalesce(up, is_online) AS is_online FROM r LEFT JOIN c ON c_nationkey = id")
def set_root_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("id")).agg((F.avg("c_acctbal") > 4500).alias("is_online"))
    return merge.patch(roots(spark, sf_dir), c, ["id"])


# ---- media ----

_MEDIA = "m AS (SELECT o_orderkey AS id, '/m/' || o_orderkey AS source_ref, o_orderstatus AS analysis_status FROM orders)"


def order_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/m/"), F.col("o_orderkey").cast("string")).alias("source_ref"), F.col("o_orderstatus").alias("analysis_status"))


@query(f"""
  WITH {_MEDIA}, n AS (SELECT c_custkey * 2 AS id, '/m/' || c_custkey * 3 AS source_ref, 'N' AS analysis_status FROM customer)
  SELECT * FROM m WHERE id NOT IN (SELECT id FROM n) AND source_ref NOT IN (SELECT source_ref FROM n) UNION ALL SELECT * FROM n""")
def upsert_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.concat(F.lit("/m/"), (F.col("c_custkey") * 3).cast("string")).alias("source_ref"), F.lit("N").alias("analysis_status"))
    return merge.upsert_media(order_media(spark, sf_dir), c)


@query(f"WITH {_MEDIA} SELECT p_partkey, m.id FROM part JOIN m ON m.source_ref = '/m/' || p_partkey * 4")
def media_by_source_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/m/"), (F.col("p_partkey") * 4).cast("string")).alias("source_ref"))
    return asked.join(order_media(spark, sf_dir), "source_ref").select("p_partkey", "id")


@query(f"WITH {_MEDIA} SELECT id, source_ref, CASE WHEN l_orderkey IS NULL THEN analysis_status ELSE 'failed' END AS analysis_status FROM m LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) ON l_orderkey = id")
def set_analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("id"), F.lit("failed").alias("analysis_status")).distinct()
    return merge.patch(order_media(spark, sf_dir), bad, ["id"])


@query(f"WITH {_MEDIA} SELECT id, source_ref, 'pending' AS analysis_status FROM m")
def reset_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.reset_analysis(order_media(spark, sf_dir))


@query("SELECT event_id AS id FROM events WHERE event_id % 4 = 0 AND NOT value > 300")
def videos_without_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "video").otherwise("photo").alias("media_type"), F.when(F.col("value") > 300, "/proxy").alias("video_proxy_path"))
    return without_proxy(e).select("id")


@query(f"WITH {_MEDIA} SELECT id, source_ref, analysis_status, '/proxy/' || first AS proxy FROM m LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = id")
def set_proxy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("/proxy/"), F.min("l_partkey").cast("string")).alias("proxy"))
    return merge.patch(order_media(spark, sf_dir).withColumn("proxy", F.lit(None).cast("string")), made, ["id"])


# ---- faces and persons ----


@query("SELECT media_id, string_agg(face_id::VARCHAR, ',' ORDER BY face_id) AS faces FROM (SELECT event_id AS face_id, event_id // 3 AS media_id FROM events) GROUP BY 1")
def faces_by_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_faces(spark, sf_dir)
    m = f.select("media_id").distinct()
    return store.nested(m, f.select("media_id", "face_id"), "media_id", "all", ["face_id"]).select("media_id", F.array_join(F.transform("all", lambda x: x["face_id"].cast("string")), ",").alias("faces"))


@query("SELECT event_id AS face_id, event_id // 3 AS media_id, CASE WHEN event_type = 'error' THEN 'e' || user_id ELSE user_id::VARCHAR END AS cluster_id, event_id AS seq FROM events")
def set_face_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("face_id"), F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("cluster_id"))
    return merge.patch(event_faces(spark, sf_dir), moved, ["face_id"])


@query("SELECT c_custkey AS person_id, c_mktsegment AS cluster_id, last AS merged_into FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
def set_person_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("cluster_id"), F.lit(None).cast("long").alias("merged_into"))
    into = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("person_id")).agg(F.max("o_orderkey").alias("merged_into"))
    return merge.patch(p, into, ["person_id"])


@query("SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id")
def person_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cluster_id"), "c_name")
    return event_faces(spark, sf_dir).join(p, "cluster_id").select(F.col("face_id").alias("event_id"), "c_name")


@query("SELECT c_custkey, event_id, event_type FROM customer JOIN events ON user_id = c_custkey WHERE event_type IN ('click', 'error')")
def feedback_of_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = store.by_status(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_type", ["click", "error"])
    return table(spark, sf_dir, "customer").select("c_custkey").join(e, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "event_id", "event_type")


@query(f"WITH b AS (SELECT p_partkey, p_brand, {_BOX} AS f FROM part) SELECT p_brand AS media_id, round(f[3] * f[4], 6) AS area, p_partkey AS first FROM b QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(f[3] * f[4], 9) DESC, p_partkey) = 1")
def largest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("media_id"), F.col("p_partkey").alias("seq"), F.transform(part_box(), lambda x: F.round(x, 9)).alias("bbox"))
    top = direction.largest_face(b)
    same = b.join(top.withColumnRenamed("bbox", "top"), "media_id").where(F.round(geometry.area(F.col("bbox")), 9) == F.round(geometry.area(F.col("top")), 9))
    return same.groupBy("media_id").agg(F.min("seq").alias("first"), F.first(rounded(geometry.area(F.col("top")))).alias("area")).select("media_id", "area", "first")


# ---- quality, groups, stories, settings, devices, journal ----


@query("""
  WITH n AS (SELECT l_partkey AS media_id, round(max(l_discount), 6) AS composite FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
  SELECT p_partkey AS media_id, p_size / 50.0 AS composite FROM part WHERE p_partkey NOT IN (SELECT media_id FROM n) UNION ALL SELECT * FROM n""")
def upsert_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("media_id"), (F.col("p_size") / 50.0).alias("composite"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("media_id")).agg(rounded(F.max("l_discount")).alias("composite"))
    return merge.upsert(q, new, ["media_id"])


@query("""
  WITH n AS (SELECT user_id AS story_id, event_id AS media_id, 'hero' AS role FROM events WHERE event_type = 'error')
  SELECT o_custkey AS story_id, o_orderkey AS media_id, 'support' AS role FROM orders WHERE o_custkey NOT IN (SELECT story_id FROM n) UNION ALL SELECT * FROM n""")
def replace_story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("media_id"), F.lit("support").alias("role"))
    new = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("story_id"), F.col("event_id").alias("media_id"), F.lit("hero").alias("role"))
    return merge.replace_part(old, new, "story_id")


@query("SELECT p_brand AS key, p_name AS value FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("seq"))
    return merge.last(log, ["key"], "seq").select("key", "value")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_acctbal > 0")
def device_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("token"), (F.col("s_acctbal") <= 0).alias("revoked"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", media.bearer_token(F.concat(F.lit("Bearer t"), F.col("c_custkey").cast("string"))).alias("token"))
    return d.where("not revoked").join(asked, "token").select("s_suppkey", "c_custkey")


@query("SELECT s_suppkey, s_name, s_acctbal <= 0 OR n_regionkey = 2 AS revoked FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def revoke_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    d = s.select("s_suppkey", "s_name", (F.col("s_acctbal") <= 0).alias("revoked"))
    gone = s.join(table(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lit(True).alias("revoked"))
    return merge.patch(d, gone, ["s_suppkey"])


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS steps FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def journal_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id"), "ts", "event_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(e.select("user_id").distinct(), "user_id")
    return store.nested(c, e, "user_id", "all", ["ts", "event_id"]).select("user_id", F.array_join(F.transform("all", lambda x: x["event_id"].cast("string")), ",").alias("steps"))


# ---- searches and expressions ----


@query(f"""
  WITH {_PHASH}, asked AS (SELECT DISTINCT doc_id, phash FROM hashes JOIN labels USING (doc_id))
  SELECT a.doc_id AS query_id, b.doc_id AS id, {_BIT_DISTANCE} AS distance FROM asked a JOIN hashes b ON {_BIT_DISTANCE} <= 5""")
def hash_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cut(hashed_documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("phash").alias("hash")))  # read by both sides
    asked = h.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), "id")
    return dedup.hash_range(asked, h)


@query("SELECT p_partkey, p_size % 4 = 0 AS servable FROM part")
def servable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, k = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("/lib/a..b/"), k)).when(kind == 1, F.concat(F.lit("/library/"), k)).when(kind == 2, F.concat(F.lit("/lib/../"), k)).otherwise("/lib")
    return table(spark, sf_dir, "part").select("p_partkey", media.under(path, F.lit("/lib/")).alias("servable"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_custkey END AS token FROM orders")
def bearer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey").cast("string")
    header = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Bearer t"), c)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Basic "), c))
    return table(spark, sf_dir, "orders").select("o_orderkey", media.bearer_token(header).alias("token"))


@query("""
  SELECT doc_id, CASE WHEN n_chars <= 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size,
         CASE WHEN length(text) > 42 THEN '…' || right(text, 40) ELSE text END AS short, coalesce(round(100.0 * (n_chars % 777) / 777), 0)::INTEGER AS percent FROM documents""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", media.format_bytes(F.col("n_chars")).alias("size"), media.shorten(F.col("text")).alias("short"), media.progress_percent(F.col("n_chars") % 777, F.lit(777)).alias("percent"))


@query("SELECT o_custkey, (len(a) + 2) // 3 AS n, array_to_string(a[1:3], ',') AS first, array_to_string(a[((len(a) + 2) // 3 - 1) * 3 + 1:], ',') AS last FROM (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    c = o.select("o_custkey", media.chunks(F.transform("a", lambda x: x.cast("string")), 3).alias("c"))
    return c.select("o_custkey", F.size("c").cast("long").alias("n"), F.array_join(F.element_at("c", 1), ",").alias("first"), F.array_join(F.element_at("c", -1), ",").alias("last"))


@query(f"WITH b AS (SELECT p_partkey, {_BOX} AS f FROM part) SELECT p_partkey, round(f[1], 6) AS x, round(f[4], 6) AS h, true AS same FROM b")
def json_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select("p_partkey", part_box().alias("bbox"), part_box().alias("was"))
    back = merge.decoded(merge.encoded(b, "bbox"), bbox="array<double>")
    return back.select("p_partkey", rounded(F.col("bbox")[0]).alias("x"), rounded(F.col("bbox")[3]).alias("h"), (F.col("bbox") == F.col("was")).alias("same"))
