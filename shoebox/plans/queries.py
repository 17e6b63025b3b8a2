"""Registered queries: the library's operators over the test tables, each with the SQL of its result.

The tables stand in for a media catalogue: events for pictures in time order, orders and parts for files,
embeddings for face vectors, documents for contents, customers for persons.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import geometry, hashing, media, naming, quality, vectors
from shoebox.operators import boxes, curation, dedup, direction, junk, merge, metric, neighbors, persons, restructure, space, vector_index
from shoebox.plans import store
from shoebox.plans.lineage import cut, delete, shared_dir
from shoebox.sources import models
from shoebox.streaming import plan_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}) div 1000")


def rounded(a: Column, n: int = 6) -> Column:
    return F.round(a, n)


# ---- frames that stand in for the catalogue ----


def event_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("media_id"), F.col("user_id").alias("library_id"), millis("ts").alias("created_ms"), F.col("event_type").alias("place"), F.col("event_id").alias("seq"))


def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("media_id"), F.col("value").alias("composite"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("media_id"), F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"), "o_orderpriority", "o_custkey", "o_orderstatus")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), "embedding", "label")


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256))
    return dedup.text_grids(d, keep=("content_hash",)).select("doc_id", "content_hash", hashing.dhash(F.col("grid")).alias("phash"))


#: The perceptual hash of a document's word grid, in SQL.
_PHASH = """
  words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
  buckets AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 7))::BIGINT % 72)::INTEGER AS b, count(*) AS n FROM words GROUP BY ALL),
  cells AS (SELECT d.doc_id, r.range AS i, coalesce(n, 0) AS n FROM documents d CROSS JOIN range(72) r LEFT JOIN buckets k ON k.doc_id = d.doc_id AND k.b = r.range),
  bits AS (SELECT a.doc_id, (a.i // 9) * 8 + a.i % 9 AS pos, CASE WHEN a.n > b.n THEN 1 ELSE 0 END AS bit FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.i % 9 < 8),
  nibbles AS (SELECT doc_id, pos // 4 AS k, sum(bit * (8 >> (pos % 4)::INTEGER))::INTEGER AS v FROM bits GROUP BY ALL),
  hashes AS (SELECT doc_id, string_agg(substr('0123456789abcdef', v + 1, 1), '' ORDER BY k) AS phash FROM nibbles GROUP BY doc_id)"""

_SESSIONS = """
  ordered AS (SELECT *, lag(ts) OVER u AS prev, lag(event_type) OVER u AS prev_place FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
  flagged AS (SELECT *, CASE WHEN prev IS NULL OR (epoch_us(ts) // 1000) - (epoch_us(prev) // 1000) > 21600000 OR event_type <> prev_place THEN 1 ELSE 0 END AS new FROM ordered),
  numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS event_no FROM flagged),
  sessions AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_no ORDER BY ts, event_id) - 1)::INTEGER AS position FROM numbered)"""


# ---- reads of the store ----


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 400")
def media_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return store.page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 400, 200).drop("o_orderdate")


@query("SELECT o_orderpriority AS root, count(*) AS n FROM orders GROUP BY 1")
def media_count_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("root")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def media_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_status(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["O", "P"])


@query("""
  SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS merged_into FROM orders WHERE o_totalprice > 400000 GROUP BY 1) m ON c_custkey = o_custkey
  WHERE merged_into IS NULL""")
def active_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy("o_custkey").agg(F.min("o_orderkey").alias("merged_into"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(merged, F.col("c_custkey") == F.col("o_custkey"), "left").where("merged_into is null").select("c_custkey", "c_name")


@query("""
  SELECT sha256(text) AS content_hash, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_groups_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    groups = dedup.nested_groups(d.select(F.col("content_hash").alias("group_id"), F.col("doc_id").alias("media_id"), F.lit(False).alias("is_representative")))
    return groups.where(F.size("members") > 1).select(F.col("group_id").alias("content_hash"), F.size("members").cast("long").alias("n"), F.array_join(F.transform("members", lambda m: m["media_id"].cast("string")), ",").alias("members"))


@query("SELECT doc_id AS path, n_chars AS bytes FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shoebox.sources.files import new_files

    scanned = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"))
    return new_files(scanned, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_ref")))


@query("""
  SELECT user_id, event_id, event_type, (SELECT min(event_id) FROM events b WHERE b.user_id = a.user_id) AS seq FROM events a
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lit(1).alias("_step"), F.col("event_id").alias("_at"))
    return store.latest(log, ["user_id"]).select("user_id", "event_id", "event_type", F.col("seq._at").alias("seq"))


@query("""
  SELECT c_custkey, c_mktsegment, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = store.nested(c, o, "c_custkey", "kids", ["o_orderkey"])
    return out.select("c_custkey", "c_mktsegment", F.array_join(F.transform("kids", lambda k: k["o_orderkey"].cast("string")), ",").alias("children"))


@query("""
  SELECT c_custkey AS story_id, c_name AS title, coalesce(n, 0) AS n_items FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey
  ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 30""")
def stories_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = store.page(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 30, 30)
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return first.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("story_id"), F.col("c_name").alias("title"), F.coalesce("n", F.lit(0)).alias("n_items"))


@query("""
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' END AS status, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 2 END AS rank FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def interrupted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderkey").alias("seq"))
    return restructure.interrupted(jobs).select("id", "status", "rank")


@query("""
  SELECT coalesce(a.user_id, b.user_id) AS id, coalesce(b.event_id, a.event_id) AS shown FROM (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1) a
  FULL JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'error' AND value > 400 GROUP BY 1) b ON a.user_id = b.user_id""")
def job_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kept = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("a"))
    live = e.where("event_type = 'error' and value > 400").groupBy("user_id").agg(F.max("event_id").alias("b"))
    return kept.join(live, "user_id", "full").select(F.col("user_id").alias("id"), F.coalesce("b", "a").alias("shown"))


# ---- paths and predicates ----

_NAMES = "'/Lib/' || CASE page_id % 5 WHEN 0 THEN 'IMG_1.JPG' WHEN 1 THEN 'clip.mov' WHEN 2 THEN '.jpg' WHEN 3 THEN 'notes.txt' ELSE 'a.b.HEIC' END"



def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.col("page_id") % 5
    name = F.when(ext == 0, "IMG_1.JPG").when(ext == 1, "clip.mov").when(ext == 2, ".jpg").when(ext == 3, "notes.txt").otherwise("a.b.HEIC")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/Lib/"), name).alias("path"), "url")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 4 THEN 'photo' END AS media_type FROM pages")
def media_type_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_names(spark, sf_dir).select("page_id", media.media_type(F.col("path")).alias("media_type"))


@query("""
  SELECT page_id, url FROM pages WHERE NOT (page_id % 7 = 0 OR page_id % 7 = 3)""")
def managed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 7
    path = F.concat(F.lit("/vol/"), F.when(kind == 0, "Family.photoslibrary/x").when(kind == 3, "Old.LRCAT").otherwise("plain/x"))
    p = table(spark, sf_dir, "pages").withColumn("root_id", path)
    roots = p.select("root_id").distinct().withColumn("managed_by_other_app", media.managed_by_other_app(F.col("root_id")))
    return restructure.without_managed(p, roots).select("page_id", "url")


@query("""
  SELECT page_id, status, start, stop FROM (
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 200 WHEN page_id >= length(html) THEN 416 ELSE 206 END AS status,
           CASE WHEN page_id % 3 = 0 THEN 0 WHEN page_id >= length(html) THEN NULL ELSE page_id END AS start,
           CASE WHEN page_id % 3 <> 0 AND page_id >= length(html) THEN NULL ELSE length(html) - 1 END AS stop FROM pages)""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("bytes="), F.col("page_id").cast("string"), F.lit("-")))
    p = table(spark, sf_dir, "pages").select("page_id", media.byte_range(header, F.length("html").cast("long")).alias("r"))
    return p.select("page_id", F.col("r.status").alias("status"), F.col("r.start").alias("start"), F.col("r.stop").alias("stop"))


_PART_SCORES = "((p_partkey % 100) / 100.0) AS sharpness, ((p_size * 2) / 100.0) AS exposure, ((p_partkey % 70) / 70.0) AS composite"


def part_media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 20 == 0, "/pics/Screenshot_1.png").when(F.col("p_partkey") % 20 == 1, "/pics/my screen shot.png").otherwise("/screenshot/IMG.jpg")
    m = p.select(F.col("p_partkey").alias("media_id"), name.alias("source_ref"))
    q = p.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("media_id"), (F.col("p_partkey") % 100 / 100.0).alias("sharpness"), (F.col("p_size") * 2 / 100.0).alias("exposure"), (F.col("p_partkey") % 70 / 70.0).alias("composite"))
    return m, q


_JUNK = f"""
  scored AS (SELECT p_partkey, p_partkey % 20 < 2 AS shot, p_partkey % 9 <> 0 AS known, {_PART_SCORES} FROM part),
  reasons AS (SELECT p_partkey, known, composite, list_filter([CASE WHEN shot THEN '{junk.SCREENSHOT}' END, CASE WHEN known AND sharpness < 0.2 THEN '{junk.BLURRED}' END,
    CASE WHEN known AND exposure < 0.08 THEN '{junk.DARK}' END, CASE WHEN known AND exposure > 0.92 THEN '{junk.BLOWN}' END], lambda x: x IS NOT NULL) AS r FROM scored)"""


@query(f"""
  WITH {_JUNK} SELECT p_partkey AS media_id, 'trash' AS action, CASE WHEN len(r) > 0 THEN array_to_string(r, '{junk.JOINED}') ELSE '{junk.POOR}' END AS reason
  FROM reasons WHERE len(r) > 0 OR (known AND composite < 0.35)""")
def junk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junk.junk(*part_media(spark, sf_dir))


@query("SELECT p_partkey AS media_id FROM part WHERE p_partkey % 20 < 2")
def screenshot_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = part_media(spark, sf_dir)
    return m.where(media.is_screenshot(F.col("source_ref"))).select("media_id")


# ---- scores, space ----


@query("""
  SELECT l_returnflag, l_linestatus, round(avg(composite), 6) AS composite, round(avg(mock), 6) AS mock, count(*) AS n FROM (
    SELECT l_returnflag, l_linestatus, least(1, l_quantity * 15 / 500) * 0.4 + (1 - abs(l_discount * 10 - 0.5) * 2 > 0)::INT * (1 - abs(l_discount * 10 - 0.5) * 2) * 0.3 + 0.5 * 0.15 + 0.8 * 0.15 AS composite,
           l_quantity / 50 * 0.4 + l_discount * 0.2 + l_tax * 0.2 + 0.5 * 0.2 AS mock FROM lineitem) GROUP BY 1, 2""")
def quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = quality.quality(F.col("l_quantity") * 15, F.col("l_discount") * 10)
    mock = quality.mock_composite(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax"), F.lit(0.5))
    return li.select("l_returnflag", "l_linestatus", q["composite"].alias("c"), mock.alias("m")).groupBy("l_returnflag", "l_linestatus").agg(rounded(F.avg("c")).alias("composite"), rounded(F.avg("m")).alias("mock"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS media_id, round(o_totalprice * 100)::BIGINT AS bytes FROM orders WHERE year(o_orderdate) = 1996")
def archive_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.archive(order_files(spark, sf_dir), "1996").select("media_id", "bytes")


@query("""
  SELECT coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate)::VARCHAR END, 'unknown') AS year, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS bytes, count(*) AS n FROM orders GROUP BY 1""")
def space_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = order_files(spark, sf_dir).withColumn("created_at", F.when(F.col("media_id") % 11 != 0, F.col("created_at")))
    return space.by_year(m)


@query("SELECT sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_bytes, count(*) AS n FROM orders")
def space_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.total(order_files(spark, sf_dir))


@query("""
  WITH first AS (SELECT sha256(text) AS h, min(doc_id) AS keep, count(*) AS n FROM documents GROUP BY 1)
  SELECT (SELECT sum(n_chars) FROM documents JOIN first ON sha256(text) = h WHERE n > 1 AND doc_id <> keep)::BIGINT AS duplicates,
         (SELECT coalesce(sum(n_chars), 0) FROM documents JOIN labels USING (doc_id) WHERE quality = 0)::BIGINT AS junk,
         (SELECT sum(length(html)) FROM pages WHERE page_id % 10 = 0)::BIGINT AS video_proxies""")
def reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = d.select(F.col("doc_id").alias("media_id"), F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("bytes"))
    groups = dedup.duplicate_groups(m, near=False)
    poor = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("media_id"))
    proxies = table(spark, sf_dir, "pages").where("page_id % 10 = 0").select(F.length("html").cast("long").alias("bytes"))
    return space.reclaimable(m, groups, poor, proxies)


@query("SELECT doc_id AS media_id, n_chars AS bytes FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def largest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.largest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.col("n_chars").alias("bytes")))


# ---- duplicates ----


@query("""
  WITH g AS (SELECT sha256(text) AS h, min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1),
  q AS (SELECT doc_id, max(quality)::DOUBLE AS q FROM labels GROUP BY 1)
  SELECT group_id, d.doc_id AS media_id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(q, 0) DESC, d.doc_id) = 1 AS is_representative
  FROM documents d JOIN g ON sha256(d.text) = h LEFT JOIN q ON q.doc_id = d.doc_id""")
def exact_dup_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    m = d.select(F.col("doc_id").alias("media_id"), F.col("doc_id").alias("seq"), F.sha2("text", 256).alias("content_hash"))
    q = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("media_id")).agg(F.max("quality").cast("double").alias("composite"))
    return dedup.duplicate_groups(m, q, near=False)


@query(f"WITH {_PHASH} SELECT doc_id, phash FROM hashes")
def phash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_documents(spark, sf_dir).select("doc_id", "phash")


_PAIRS = """
  firsts AS (SELECT phash, min(doc_id) AS id FROM hashes GROUP BY 1),
  pairs AS (SELECT a.id AS id_a, b.id AS id_b, (bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT)))::INTEGER AS distance
            FROM firsts a JOIN firsts b ON a.id < b.id)"""


@query(f"WITH {_PHASH}, {_PAIRS} SELECT id_a, id_b, distance FROM pairs WHERE distance <= 5")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed_documents(spark, sf_dir).groupBy(F.col("phash").alias("hash")).agg(F.min("doc_id").alias("id"))
    return dedup.hamming_pairs(h)


@query(f"""
  WITH {_PHASH} SELECT a.doc_id, (bit_count(xor(('0x' || substr(a.phash, 1, 8))::BIGINT, ('0x' || substr(b.phash, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.phash, 9, 8))::BIGINT, ('0x' || substr(b.phash, 9, 8))::BIGINT)))::INTEGER AS distance
  FROM hashes a JOIN hashes b ON b.doc_id = a.doc_id + 1""")
def hamming_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed_documents(spark, sf_dir).select("doc_id", "phash")
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("phash").alias("next"))
    return h.join(after, "doc_id").select("doc_id", hashing.hamming(F.col("phash"), F.col("next")).alias("distance"))


_NEAR = f"""
  RECURSIVE {_PHASH}, {_PAIRS},
  edges AS (SELECT f.id AS a, h.doc_id AS b FROM hashes h JOIN firsts f USING (phash) WHERE h.doc_id <> f.id UNION SELECT id_a, id_b FROM pairs WHERE distance <= 5),
  both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
  comp AS (SELECT node, min(other) AS group_id FROM reach GROUP BY 1),
  q AS (SELECT doc_id, max(quality)::DOUBLE AS q FROM labels GROUP BY 1),
  grouped AS (SELECT group_id, node AS media_id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(q, 0) DESC, node) = 1 AS is_representative, count(*) OVER (PARTITION BY group_id) AS n
              FROM comp LEFT JOIN q ON q.doc_id = node)"""


def _near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed_documents(spark, sf_dir)
    m = h.select(F.col("doc_id").alias("media_id"), F.col("doc_id").alias("seq"), "content_hash", F.col("phash").alias("perceptual_hash"))
    q = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("media_id")).agg(F.max("quality").cast("double").alias("composite"))
    return dedup.duplicate_groups(m, q)


@query(f"WITH {_NEAR} SELECT group_id, media_id, is_representative FROM grouped WHERE n > 1")
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_groups(spark, sf_dir)


@query(f"""
  WITH {_NEAR} SELECT group_id, media_id, CASE WHEN is_representative THEN 'keep' ELSE 'trash' END AS action, CASE WHEN is_representative THEN '{dedup.KEEP}' ELSE '{dedup.DUPLICATE}' END AS reason FROM grouped WHERE n > 1""")
def dedup_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_proposal(_near_groups(spark, sf_dir))


@query(f"""
  WITH {_NEAR} SELECT media_id, source AS source_ref FROM grouped JOIN documents ON doc_id = media_id WHERE n > 1 AND NOT is_representative AND doc_id % 3 <> 0""")
def trash_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("media_id"), F.col("source").alias("source_ref"))
    return dedup.trash_targets(dedup.dedup_proposal(_near_groups(spark, sf_dir)), there).select("media_id", "source_ref")


# ---- vectors and persons ----

_VECTORS = """
  v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings)"""


@query(f"""
  WITH {_VECTORS}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - list_dot_product(a.e, b.e) / (a.len * b.len) AS distance FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM d)
  SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faces(spark, sf_dir)
    return neighbors.top_k(f.where("id % 20 = 0"), f).select("query_id", "id", rounded(F.col("distance")).alias("distance"), "rank")


@query(f"""
  WITH RECURSIVE {_VECTORS}, d AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_dot_product(a.e, b.e) / (a.len * b.len) AS distance FROM v a JOIN v b ON b.vec_id < a.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d),
  edges AS (SELECT a, b FROM r WHERE rank <= 10 AND distance <= 0.6), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT x.node, e.b FROM reach x JOIN both_ways e ON e.a = x.other)
  SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.cluster_faces(faces(spark, sf_dir), 0.6)


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours from a stored index of all vectors; tests measure its recall against ``knn_topk``."""
    f = faces(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index = vector_index.VectorIndex.create(f, path)
    found = cut(index.search(f.where("id % 20 = 0")))
    delete(spark, path)
    return found.select("query_id", "id", rounded(F.col("distance")).alias("distance"), "rank")


@query(f"""
  WITH {_VECTORS}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, 1 - list_dot_product(a.e, b.e) / (a.len * b.len) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id <> b.vec_id + 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM d WHERE distance <= 0.7)
  SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 3""")
def neighbors_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors within a distance but for the one before, found by metric pruning."""
    f = faces(spark, sf_dir)
    before = f.select(F.col("id").alias("query_id"), (F.col("id") - 1).alias("id"))
    found = metric.within(f, f, 0.7, 3, banned=before)
    return found.select("query_id", "id", rounded(F.col("distance")).alias("distance"), "rank")


_CENTROIDS = """
  parts AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL),
  centroids AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM means)"""


@query(f"WITH {_CENTROIDS} SELECT label, (i - 1)::INTEGER AS i, round(x, 5) AS x FROM centroids")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = neighbors.centroids(faces(spark, sf_dir), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


@query(f"""
  WITH {_CENTROIDS}, anchors AS (SELECT label, list(x ORDER BY i) AS c FROM centroids GROUP BY 1),
  d AS (SELECT vec_id AS face_id, a.label AS person_id, 1 - list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS distance FROM embeddings, anchors a WHERE NOT (vec_id % 4 = 0 AND a.label = embeddings.label))
  SELECT face_id, person_id, round(distance, 5) AS distance FROM d WHERE distance <= 0.95 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY distance, person_id) = 1""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faces(spark, sf_dir)
    anchors = neighbors.centroids(f, "label").select(F.col("label").alias("person_id"), F.col("label").alias("seq"), "centroid")
    rejected = f.where("id % 4 = 0").select(F.col("id").alias("face_id"), F.col("label").alias("person_id"))
    return neighbors.nearest_anchor(f.select(F.col("id").alias("face_id"), "embedding"), anchors, rejected, 0.95).select("face_id", "person_id", F.round("distance", 5).alias("distance"))


@query("""
  SELECT vec_id, round(sum(x * x), 4) AS length2, round(max(abs(x)), 5) AS most FROM (SELECT vec_id, unnest(list_transform(embedding::DOUBLE[], lambda y: 3 * y / (3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))) AS x FROM embeddings) GROUP BY 1""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return faces(spark, sf_dir).select(F.col("id").alias("vec_id"), v.alias("v")).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 4).alias("length2"), F.round(F.array_max(F.transform("v", F.abs)), 5).alias("most"))


def event_feedback(spark: SparkSession, sf_dir: str, n_faces: int, n_persons: int) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')")
    return e.select((F.col("event_id") % n_faces).alias("face_id"), (F.col("user_id") % n_persons).alias("person_id"), F.when(F.col("event_type") == "click", "confirm").otherwise("reject").alias("verdict"), millis("ts").alias("created_ms"), F.col("event_id").alias("seq"))


def _verdicts(n_faces: int, n_persons: int) -> str:
    return f"""
  fb AS (SELECT event_id % {n_faces} AS face_id, user_id % {n_persons} AS person_id, event_type = 'click' AS yes, row_number() OVER (ORDER BY (epoch_us(ts) // 1000), event_id) AS t FROM events WHERE event_type IN ('click', 'error')),
  last_confirm AS (SELECT face_id, arg_max(person_id, t) AS person_id, max(t) AS t FROM fb WHERE yes GROUP BY 1),
  confirmed AS (SELECT face_id, person_id FROM last_confirm c WHERE NOT EXISTS (SELECT 1 FROM fb WHERE NOT yes AND fb.face_id = c.face_id AND fb.person_id = c.person_id AND fb.t > c.t)),
  rejected AS (SELECT face_id, person_id FROM fb GROUP BY 1, 2 HAVING NOT arg_max(yes, t))"""


@query(f"WITH {_verdicts(200, 3)} SELECT face_id, person_id, 'confirm' AS verdict FROM confirmed UNION ALL SELECT face_id, person_id, 'reject' FROM rejected")
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = persons.fold_verdicts(event_feedback(spark, sf_dir, 200, 3))
    return yes.withColumn("verdict", F.lit("confirm")).unionByName(no.withColumn("verdict", F.lit("reject")))


@query(f"""
  WITH {_verdicts(500, 4)},
  persons AS (SELECT range AS person_id, 'c' || range AS cluster_id FROM range(4)),
  faces AS (SELECT vec_id AS face_id, 'c' || label AS cluster_id, embedding::DOUBLE[] AS e FROM embeddings),
  by_confirm AS (SELECT c.person_id, e FROM confirmed c JOIN faces USING (face_id)),
  own AS (SELECT p.person_id, e FROM faces f JOIN persons p USING (cluster_id) WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.face_id = f.face_id AND r.person_id = p.person_id) AND p.person_id NOT IN (SELECT person_id FROM by_confirm)),
  basis AS (SELECT * FROM by_confirm UNION ALL SELECT * FROM own),
  parts AS (SELECT person_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM basis),
  means AS (SELECT person_id, i, avg(x) AS m FROM parts GROUP BY ALL),
  anchors AS (SELECT person_id, list(x ORDER BY i) AS c FROM (SELECT person_id, i, m / sqrt(sum(m * m) OVER (PARTITION BY person_id)) AS x FROM means) GROUP BY 1),
  near AS (SELECT face_id, person_id, 1 - list_dot_product(e, c) / sqrt(list_dot_product(e, e)) AS d FROM faces f, anchors a WHERE NOT EXISTS (SELECT 1 FROM rejected r WHERE r.face_id = f.face_id AND r.person_id = a.person_id)),
  best AS (SELECT face_id, person_id FROM near WHERE d <= 0.75 QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY d, person_id) = 1)
  SELECT f.face_id, CASE WHEN p1.cluster_id IS NOT NULL THEN p1.cluster_id WHEN p2.cluster_id IS NOT NULL THEN p2.cluster_id WHEN r.face_id IS NULL THEN f.cluster_id ELSE 'cluster-' || f.face_id END AS cluster_id,
         CASE WHEN p1.cluster_id IS NOT NULL THEN 'confirmed' WHEN p2.cluster_id IS NOT NULL THEN 'nearest' WHEN r.face_id IS NULL THEN 'kept' ELSE 'new' END AS rule
  FROM faces f LEFT JOIN confirmed c ON c.face_id = f.face_id LEFT JOIN persons p1 ON p1.person_id = c.person_id
  LEFT JOIN best b ON b.face_id = f.face_id LEFT JOIN persons p2 ON p2.person_id = b.person_id
  LEFT JOIN persons o ON o.cluster_id = f.cluster_id LEFT JOIN rejected r ON r.face_id = f.face_id AND r.person_id = o.person_id""")
def constrained_recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = faces(spark, sf_dir).select(F.col("id").alias("face_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("cluster_id"))
    p = spark.range(4).select(F.col("id").alias("person_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("cluster_id"), F.col("id").alias("seq"))
    return persons.recluster(f, p, event_feedback(spark, sf_dir, 500, 4), 0.75)


def event_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as faces: the picture is the event's hour of the log, the cluster its user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("face_id"), F.floor(F.col("event_id") / 3).alias("media_id"), F.col("user_id").cast("string").alias("cluster_id"), F.col("event_id").alias("seq"))


def customer_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person_id"), F.col("c_custkey").cast("string").alias("cluster_id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("display_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("cover_face_id"), F.when(F.col("c_custkey") % 13 == 0, "p1").alias("merged_into"))


_PERSONS = """
  f AS (SELECT event_id AS face_id, event_id // 3 AS media_id, user_id::VARCHAR AS cluster_id FROM events),
  p AS (SELECT 'p' || c_custkey AS person_id, c_custkey::VARCHAR AS cluster_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS display_name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS cover_face_id, CASE WHEN c_custkey % 13 = 0 THEN 'p1' END AS merged_into FROM customer)"""


@query(f"""
  WITH {_PERSONS}, n AS (SELECT cluster_id, count(DISTINCT media_id) AS photos, arg_min(media_id, face_id) AS first_media FROM f GROUP BY 1)
  SELECT person_id, p.cluster_id, display_name, coalesce(photos, 0) AS photo_count, coalesce(f.media_id, first_media) AS cover_media_id
  FROM p LEFT JOIN n USING (cluster_id) LEFT JOIN f ON f.face_id = p.cover_face_id WHERE merged_into IS NULL""")
def person_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons.list_persons(event_faces(spark, sf_dir), customer_persons(spark, sf_dir))


@query(f"""
  WITH {_PERSONS} SELECT 'person-' || cluster_id AS person_id, cluster_id, min(face_id) AS cover_face_id FROM f WHERE cluster_id NOT IN (SELECT cluster_id FROM p WHERE display_name IS NOT NULL) GROUP BY 2""")
def person_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = customer_persons(spark, sf_dir).where("display_name is not null")
    return persons.sync_persons(event_faces(spark, sf_dir), known).select("person_id", "cluster_id", "cover_face_id")


@query(f"WITH {_PERSONS} SELECT person_id FROM p WHERE display_name IS NULL OR display_name = ''")
def unnamed_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons.unnamed(customer_persons(spark, sf_dir)).select("person_id")


@query(f"""
  WITH {_PERSONS}, shown AS (SELECT cluster_id, media_id, min(face_id) AS face_seq FROM f GROUP BY 1, 2),
  m AS (SELECT event_id AS media_id, (epoch_us(ts) // 1000) AS created_ms, value AS composite FROM events),
  members AS (SELECT person_id, display_name, media_id, created_ms, composite, face_seq, count(*) OVER (PARTITION BY person_id) AS n, row_number() OVER (PARTITION BY person_id ORDER BY created_ms, face_seq, media_id) - 1 AS position
              FROM p JOIN shown USING (cluster_id) JOIN m USING (media_id) WHERE merged_into IS NULL AND display_name <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY composite DESC, position) AS hero_rank FROM members WHERE n >= 5)
  SELECT person_id, display_name || '{naming.MEMORIES}' AS title, arg_min(created_ms, position) AS start_ms, arg_max(created_ms, position) AS end_ms, count(*) AS n_items, max(CASE WHEN hero_rank = 1 THEN media_id END) AS cover_id
  FROM ranked GROUP BY 1, 2""")
def person_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, _ = curation.person_stories(event_faces(spark, sf_dir), customer_persons(spark, sf_dir), event_media(spark, sf_dir), event_quality(spark, sf_dir))
    return head.select("person_id", "title", "start_ms", "end_ms", "n_items", "cover_id")


# ---- events and stories ----


@query(f"WITH {_SESSIONS} SELECT event_id AS media_id, user_id AS library_id, event_no, position FROM sessions")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.sessions(event_media(spark, sf_dir)).select("media_id", "library_id", "event_no", "position")


def _story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.story_items(curation.sessions(event_media(spark, sf_dir)), event_quality(spark, sf_dir))


@query(f"""
  WITH {_SESSIONS} SELECT event_id AS media_id, user_id AS library_id, event_no, CASE WHEN row_number() OVER (PARTITION BY user_id, event_no ORDER BY value DESC, position) <= 3 THEN 'hero' ELSE 'support' END AS role FROM sessions""")
def heroes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _story_items(spark, sf_dir).select("media_id", "library_id", "event_no", "role")


@query(f"""
  WITH {_SESSIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_no ORDER BY value DESC, position) AS hero_rank FROM sessions),
  places AS (SELECT user_id, event_no, event_type AS place, count(*) AS n, min(position) AS first FROM sessions GROUP BY ALL),
  top AS (SELECT user_id, event_no, place FROM places QUALIFY row_number() OVER (PARTITION BY user_id, event_no ORDER BY n DESC, first) = 1)
  SELECT user_id AS library_id, event_no, min((epoch_us(ts) // 1000)) AS start_ms, max((epoch_us(ts) // 1000)) AS end_ms, count(*) AS n_items, max(CASE WHEN hero_rank = 1 THEN event_id END) AS cover_id, place,
         strftime(min(ts), '%Y') || '年' || month(min(ts)) || '月' || day(min(ts)) || '日 ' || place AS title
  FROM ranked JOIN top USING (user_id, event_no) GROUP BY user_id, event_no, place""")
def event_story_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.stories(_story_items(spark, sf_dir))


@query(f"""
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '思い出' ELSE event_type || '{naming.MEMORIES}' END
    ELSE strftime(ts, '%Y') || '年' || month(ts) || '月' || day(ts) || '日' || CASE WHEN event_id % 3 = 0 THEN '{naming.MEMORIES}（' || user_id || '枚）' ELSE ' ' || event_type END END AS title FROM events""")
def story_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.when(F.col("event_id") % 4 != 0, F.timestamp_millis(millis("ts")))
    return e.select("event_id", naming.event_title(start, F.when(F.col("event_id") % 3 != 0, F.col("event_type")), F.col("user_id")).alias("title"))


_CLIPS = """
  items AS (SELECT user_id AS story_id, event_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, CASE WHEN value > 400 THEN 'hero' ELSE 'support' END AS role,
                   CASE WHEN event_id % 4 = 0 THEN 'video' ELSE 'photo' END AS kind, CASE WHEN event_id % 8 = 0 THEN event_id * 7 % 20000 END AS duration_ms FROM events),
  clips AS (SELECT *, CASE WHEN kind = 'video' AND coalesce(duration_ms, 0) <> 0 THEN least(duration_ms, 12000) WHEN role = 'hero' THEN 5200 ELSE 4000 END AS d FROM items WHERE media_id % 17 <> 0)"""


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    items = e.select(F.col("user_id").alias("story_id"), F.col("event_id").alias("media_id"), (F.row_number().over(order) - 1).alias("order"), F.when(F.col("value") > 400, "hero").otherwise("support").alias("role"))
    m = e.where("event_id % 17 <> 0").select(F.col("event_id").alias("media_id"), F.when(F.col("event_id") % 4 == 0, "video").otherwise("photo").alias("media_type"), F.when(F.col("event_id") % 8 == 0, F.col("event_id") * 7 % 20000).alias("duration_ms"))
    return items, m


@query(f"""
  WITH {_CLIPS} SELECT story_id, media_id, ord::INTEGER AS ord, d::BIGINT AS duration_ms, CASE WHEN ord = 0 THEN 'none' ELSE 'crossfade' END AS transition_in,
    (coalesce(sum(d) OVER (PARTITION BY story_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 600 * sum((ord > 0)::INT) OVER (PARTITION BY story_id ORDER BY ord ROWS UNBOUNDED PRECEDING))::BIGINT AS start_ms FROM clips""")
def timeline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return direction.timeline(*_clips(spark, sf_dir)).select("story_id", "media_id", F.col("order").alias("ord"), "start_ms", "duration_ms", "transition_in")


# ---- boxes ----

_BOX = "[(p_partkey % 10) / 20.0, (p_size % 7) / 10.0, 0.05 + p_size / 100.0, 0.1 + (p_partkey % 30) / 60.0]"


def part_box() -> Column:
    k, s = F.col("p_partkey"), F.col("p_size")
    return geometry.box(k % 10 / 20.0, s % 7 / 10.0, 0.05 + s / 100.0, 0.1 + k % 30 / 60.0)


@query(f"""
  WITH b AS (SELECT p_partkey, {_BOX} AS f, p_partkey % 5 = 0 AS video, p_partkey % 7 = 0 AS no_face FROM part),
  s AS (SELECT *, least(1, f[3] * 1.6) AS w, least(1, f[4] * 1.6) AS h FROM b)
  SELECT p_partkey AS media_id, round(CASE WHEN video THEN 0 WHEN no_face THEN 0.08 ELSE greatest(0, least(1, f[1] + f[3] / 2 - w / 2)) END, 6) AS x,
         round(CASE WHEN video THEN 0 WHEN no_face THEN 0.08 ELSE greatest(0, least(1, f[2] + f[4] / 2 - h / 2)) END, 6) AS y,
         round(CASE WHEN video THEN 1 WHEN no_face THEN 0.84 ELSE greatest(0.3, w) END, 6) AS w, round(CASE WHEN video THEN 1 WHEN no_face THEN 0.84 ELSE greatest(0.3, h) END, 6) AS h FROM s""")
def ken_burns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 5 == 0, "video").otherwise("photo")
    face = F.when(F.col("p_partkey") % 7 != 0, part_box())
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("media_id"), geometry.ken_burns(kind, face).alias("k"))
    return k.select("media_id", *[rounded(F.col("k.end")[i]).alias(c) for i, c in enumerate("xywh")])


@query(f"""
  WITH b AS (SELECT p_partkey, p_brand, {_BOX} AS f FROM part), p AS (
    SELECT a.p_partkey AS a, b.p_partkey AS b, greatest(0, least(a.f[1] + a.f[3], b.f[1] + b.f[3]) - greatest(a.f[1], b.f[1])) * greatest(0, least(a.f[2] + a.f[4], b.f[2] + b.f[4]) - greatest(a.f[2], b.f[2])) AS both_, a.f[3] * a.f[4] + b.f[3] * b.f[4] AS areas
    FROM b a JOIN b b ON b.p_partkey = a.p_partkey + 1)
  SELECT a, b, round(both_ / (areas - both_), 6) AS iou FROM p""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), part_box().alias("f"))
    after = b.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("f").alias("g"))
    return b.join(after, "a").select("a", "b", rounded(geometry.iou(F.col("f"), F.col("g"))).alias("iou"))


@query("""
  WITH s AS (SELECT p_partkey, p_size * 37 AS w, 100 + p_partkey % 900 AS h FROM part), f AS (SELECT *, least(640.0 / w, 480.0 / h) AS scale FROM s),
  g AS (SELECT *, floor(w * scale + 0.5)::INTEGER AS new_w, floor(h * scale + 0.5)::INTEGER AS new_h FROM f),
  l AS (SELECT *, floor((640 - new_w) / 2)::INTEGER AS pad_x, floor((480 - new_h) / 2)::INTEGER AS pad_y FROM g)
  SELECT p_partkey, new_w, new_h, pad_x, pad_y, round(scale, 6) AS scale, round(greatest(0, least(w, (100 - pad_x) / scale)), 3) AS x, round(greatest(0, least(h, 50 / scale)), 3) AS side FROM l""")
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 37, 100 + F.col("p_partkey") % 900
    p = table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), geometry.letterbox(w, h, 640, 480).alias("l"))
    back = geometry.unletterbox(geometry.box(F.lit(100), F.lit(100), F.lit(50), F.lit(50)), F.col("l"), F.col("w"), F.col("h"))
    return p.select("p_partkey", "l.new_w", "l.new_h", "l.pad_x", "l.pad_y", rounded(F.col("l.scale")).alias("scale"), F.round(back[0], 3).alias("x"), F.round(back[3], 3).alias("side"))


@query(f"""
  WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS i FROM (SELECT p_brand AS image_id, p_partkey AS box_id, {_BOX}::DOUBLE[] AS f, p_retailprice % 97 / 97 AS score FROM part)),
  r AS (SELECT DISTINCT image_id, 0::BIGINT AS i, []::STRUCT(box_id BIGINT, score DOUBLE, f DOUBLE[])[] AS kept FROM b UNION ALL
    SELECT r.image_id, b.i, CASE WHEN len(kept) >= 100 OR len(list_filter(kept, lambda k: greatest(0, least(b.f[1] + b.f[3], k.f[1] + k.f[3]) - greatest(b.f[1], k.f[1])) * greatest(0, least(b.f[2] + b.f[4], k.f[2] + k.f[4]) - greatest(b.f[2], k.f[2]))
      > 0.4 * (b.f[3] * b.f[4] + k.f[3] * k.f[4] - greatest(0, least(b.f[1] + b.f[3], k.f[1] + k.f[3]) - greatest(b.f[1], k.f[1])) * greatest(0, least(b.f[2] + b.f[4], k.f[2] + k.f[4]) - greatest(b.f[2], k.f[2]))))) > 0
      THEN kept ELSE list_append(kept, {{'box_id': b.box_id, 'score': b.score, 'f': b.f}}) END
    FROM r JOIN b ON b.image_id = r.image_id AND b.i = r.i + 1),
  kept AS (SELECT image_id, unnest(kept) AS k FROM r QUALIFY i = max(i) OVER (PARTITION BY image_id))
  SELECT image_id, k.box_id AS box_id, round(k.score, 6) AS score FROM kept""")
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("box_id"), part_box().alias("bbox"), (F.col("p_retailprice") % 97 / 97).alias("score"))
    return boxes.nms(b).select("image_id", "box_id", rounded(F.col("score")).alias("score"))


@query("""
  WITH a AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS idx, embedding::DOUBLE[] AS e FROM embeddings),
  s AS (SELECT vec_id, idx, e, sqrt(greatest(0, least(1, x * 4)) * greatest(0, least(1, e[64 - idx] * 4))) AS score FROM a WHERE idx < 16)
  SELECT vec_id AS image_id, '8-' || idx AS box_id, round(score, 5) AS score, round((((idx % 4) + e[idx * 4 + 1]) * 8 - exp(e[idx * 4 + 3]) * 4) * 2, 4) AS x, round(exp(e[idx * 4 + 4]) * 8 * 3, 4) AS h FROM s WHERE score >= 0.2""")
def decode_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    o = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("stride"), F.transform(F.slice(e, 1, 16), lambda x: x.cast("double") * 4).alias("cls"), F.transform(F.slice(F.reverse(e), 1, 16), lambda x: x.cast("double") * 4).alias("obj"), e.alias("bbox"), F.lit(None).cast("array<float>").alias("kps"), F.lit(64).alias("orig_w"), F.lit(96).alias("orig_h"))
    d = boxes.decode_anchors(o, 32, 32, 0.2)
    return d.select("image_id", "box_id", F.round("score", 5).alias("score"), F.round(F.col("bbox")[0], 4).alias("x"), F.round(F.col("bbox")[3], 4).alias("h"))


# ---- paths of plans ----


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_files(spark, sf_dir)
    return o.withColumns({
        "source_ref": F.concat(F.lit("/src/IMG_"), (F.col("media_id") % 50).cast("string"), F.lit(".jpg")),
        "event": F.when(F.col("media_id") % 3 == 0, F.lit("Trip: A/B")), "place": F.when(F.col("media_id") % 5 == 0, F.lit("Rome")),
        "created_at": F.when(F.col("media_id") % 11 != 0, F.timestamp_millis(millis("created_at"))), "date_uncertain": F.col("media_id") % 13 == 0,
        "root_id": F.col("o_orderpriority"), "seq": F.col("media_id"),
    })


_NAMING = """
  o AS (SELECT o_orderkey AS media_id, 'IMG_' || (o_orderkey % 50) AS original, CASE WHEN o_orderkey % 3 = 0 THEN 'Trip: A/B' END AS event, CASE WHEN o_orderkey % 5 = 0 THEN 'Rome' END AS place,
               CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS ts, o_orderkey % 13 = 0 AS uncertain, o_orderpriority AS root_id, round(o_totalprice * 100)::BIGINT AS bytes FROM orders),
  t AS (SELECT *, strftime(ts, '%Y') AS y, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H%M%S') AS clock FROM o)"""
_TARGET = "CASE WHEN ts IS NULL THEN '/lib/unknown/' || original || '.jpg' ELSE '/lib/' || y || '/' || day || '_' || CASE WHEN event IS NOT NULL THEN 'Trip AB' WHEN place IS NOT NULL THEN place ELSE day END || '/' || day || '_' || clock || '_' || original || '.jpg' END"


@query(f"WITH {_NAMING} SELECT media_id, {_TARGET} AS path FROM t")
def naming_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = naming.target_path("/lib", F.col("source_ref"), F.col("created_at"), F.col("event"), F.col("place"), F.col("media_id").cast("string"))
    return order_sources(spark, sf_dir).select("media_id", p.alias("path"))


@query(f"""
  WITH {_NAMING} SELECT media_id, CASE WHEN ts IS NULL OR uncertain THEN '/lib/{naming.UNCERTAIN_FOLDER}/' || original || '.jpg'
    ELSE '/lib/' || y || '/' || day || '_' || CASE WHEN event IS NOT NULL THEN 'Trip A/B' WHEN place IS NOT NULL THEN place ELSE day END || '/' || day || '_' || clock || '_' || original || '.jpg' END AS path FROM t""")
def template_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = naming.template_path("/lib", F.col("source_ref"), F.col("created_at"), F.col("date_uncertain"), F.col("media_id").cast("string"), F.col("event"), F.col("place"), F.lit(None).cast("string"))
    return order_sources(spark, sf_dir).select("media_id", p.alias("path"))


@query(f"""
  WITH {_NAMING}, e AS (SELECT *, day || '' AS d, CASE WHEN event IS NOT NULL THEN 'Trip AB' WHEN place IS NOT NULL THEN place ELSE day END AS named, coalesce(place, day) AS placed FROM t)
  SELECT media_id, CASE left(root_id, 1)
    WHEN '1' THEN CASE WHEN ts IS NULL OR uncertain THEN '/lib/aside/' || media_id || '.jpg' ELSE '/lib/' || placed || '/' || y || '_' || media_id || 'x.jpg' END
    WHEN '2' THEN CASE WHEN ts IS NULL OR uncertain THEN '/lib/{naming.UNCERTAIN_FOLDER}/' || original || '.jpg' ELSE '/lib/all {{of it}}/' || original || '.jpg' END
    ELSE CASE WHEN ts IS NULL OR uncertain THEN '/lib/{naming.UNCERTAIN_FOLDER}/' || original || '.jpg'
      ELSE '/lib/' || y || '/' || day || '_' || CASE WHEN event IS NOT NULL THEN 'Trip A/B' WHEN place IS NOT NULL THEN place ELSE day END || '/' || day || '_' || clock || '_' || original || '.jpg' END
    END AS path FROM e""")
def template_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by the template of each row's root: one of its own, another, and none."""
    o = order_sources(spark, sf_dir)
    own = F.concat(F.lit('{"template": "{event}/{yyyy}__{id}_'), F.col("media_id").cast("string"), F.lit('x{original}", "fallback": ["nothing", "place"], "uncertain_folder": "aside", "keep_original_name": false}'))
    turn = F.substring("root_id", 1, 1)
    rule = F.when(turn == "1", own).when(turn == "2", F.lit('{"template": "/_all {of it}_//{person}/{original}"}')).when(turn == "3", F.lit("no rule"))
    p = naming.template_path_by("/lib", F.col("source_ref"), F.col("created_at"), F.col("date_uncertain"), F.col("media_id").cast("string"), F.col("event"), F.col("place"), F.lit(None).cast("string"), F.col("rule"))
    return o.withColumn("rule", naming.rule_column(rule)).select("media_id", p.alias("path"))


@query("""
  WITH h AS (SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS seed FROM part),
  a AS (SELECT p_partkey, seed, k, (seed + k * 1831565813) & 4294967295 AS a FROM h, (SELECT unnest([1, 2, 3])::BIGINT AS k)),
  t AS (SELECT *, ((xor(a, a >> 15)::HUGEINT * (a | 1)) % 4294967296)::BIGINT AS t FROM a),
  u AS (SELECT *, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)) % 4294967296)::BIGINT) & 4294967295, t) AS u FROM t)
  SELECT p_partkey, seed, k::INTEGER AS k, round(xor(u, u >> 14) / 4294967296.0, 9) AS x FROM u""")
def fixed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first numbers of the sequence that each part's name begins."""
    p = table(spark, sf_dir, "part").select("p_partkey", hashing.fnv1a(F.col("p_name").cast("binary")).alias("seed"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return p.select("p_partkey", "seed", "k", F.round(hashing.uniform(F.col("seed"), F.col("k")), 9).alias("x"))


def _target() -> Column:
    return naming.target_path("/lib", F.col("source_ref"), F.col("created_at"), F.col("event"), F.col("place"), F.col("media_id").cast("string"))


@query(f"""
  WITH {_NAMING}, b AS (SELECT media_id, {_TARGET} AS base FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY media_id) - 1 AS n FROM b)
  SELECT media_id, n::INTEGER AS n, CASE WHEN n = 0 THEN base ELSE substr(base, 1, length(base) - 4) || '_' || n || '.jpg' END AS to_path FROM n""")
def collision_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_sources(spark, sf_dir).select("media_id", "seq", _target().alias("base_path"))
    return restructure.sequence_paths(o).select("media_id", "n", "to_path")


@query(f"""
  WITH {_NAMING}, b AS (SELECT *, {_TARGET} AS base FROM t WHERE root_id <> '5-LOW'), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY media_id) - 1 AS n FROM b)
  SELECT media_id, '/src/' || original || '.jpg' AS from_path, CASE WHEN n = 0 THEN base ELSE substr(base, 1, length(base) - 4) || '_' || n || '.jpg' END AS to_path, media_id % 2 = 0 AS same_drive, bytes, n > 0 AS conflict, 'pending' AS state FROM n""")
def relocation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_sources(spark, sf_dir).withColumn("volume", F.when(F.col("media_id") % 2 == 0, "/lib").otherwise("/usb"))
    roots = spark.range(1).select(F.lit("5-LOW").alias("root_id"), F.lit(True).alias("managed_by_other_app"))
    return restructure.plan(o, roots, _target(), "/lib")


@query("SELECT coalesce(sum(CASE WHEN o_orderkey % 2 = 1 THEN round(o_totalprice * 100)::BIGINT END), 0)::BIGINT AS space_required FROM orders WHERE o_orderpriority <> '5-LOW'")
def plan_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restructure.space_required(relocation_plan(spark, sf_dir))


@query(f"""
  WITH {_NAMING}, p AS (SELECT media_id, {_TARGET} AS path FROM t), s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '')[2:-2] AS parts FROM p),
  f AS (SELECT unnest(list_transform(range(0, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS path FROM s)
  SELECT path, count(*) AS added FROM f GROUP BY 1""")
def folder_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return space.folder_counts(order_sources(spark, sf_dir).select(_target().alias("to_path")), "/lib")


@query("""
  WITH f AS (SELECT 'o' || o_orderpriority[1] || '/' || o_orderstatus AS folder, count(*) AS n FROM orders GROUP BY 1),
  p AS (SELECT '' AS path, n FROM f UNION ALL SELECT split_part(folder, '/', 1), n FROM f UNION ALL SELECT folder, n FROM f)
  SELECT path, sum(n)::BIGINT AS added FROM p GROUP BY 1""")
def folder_counts_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder counts below a root whose name has signs of patterns."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/vol/a+b (1)/o"), F.substring("o_orderpriority", 1, 1), F.lit("/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
    return space.folder_counts(o.select(path.alias("to_path")), "/vol/a+b (1)")


@query("""
  SELECT o_orderkey, o_orderdate, ((row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) // 30 + 1)::INTEGER AS page
  FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) <= 90""")
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of 30, each found from the cursor of the one before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out, after = None, None
    for page in (1, 2, 3):
        own = cut(store.cursor_page(o, "o_orderdate", "o_orderkey", 30, after).withColumn("page", F.lit(page)))
        out = own if out is None else out.unionByName(own)
        nxt = own.select("next_cursor").first()[0]
        if nxt is None:
            break
        after = (nxt["key"], nxt["identity"])
    return out.drop("next_cursor")


# ---- state machines ----


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "copied").when(F.col("event_type") == "signup", "verified").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return e.select((F.col("user_id") % 10).alias("plan_id"), F.col("user_id").alias("media_id"), state.alias("state"), F.col("event_id").alias("seq"))


_STATES = """
  s AS (SELECT user_id % 10 AS plan_id, user_id AS media_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'copied' WHEN 'signup' THEN 'verified' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state, event_id AS seq FROM events),
  folded AS (SELECT plan_id, media_id, arg_max(state, seq) AS state, max(seq) AS seq, count(*) AS n_transitions FROM s GROUP BY 1, 2)"""


@query(f"WITH {_STATES} SELECT * FROM folded")
def restructure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restructure.fold_states(event_transitions(spark, sf_dir))


@query(f"WITH {_STATES} SELECT plan_id, media_id, state FROM folded WHERE state NOT IN ('done', 'failed')")
def unfinished_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restructure.unfinished(restructure.fold_states(event_transitions(spark, sf_dir))).select("plan_id", "media_id", "state")


@query(f"WITH {_STATES} SELECT plan_id, CASE WHEN bool_or(state NOT IN ('done', 'failed')) THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'done' END AS status FROM folded GROUP BY 1")
def plan_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restructure.plan_status(restructure.fold_states(event_transitions(spark, sf_dir)))


@query("""
  SELECT 'move' AS op, '/b/' || event_id AS from_path, '/a/' || event_id AS to_path, event_id AS seq FROM events WHERE user_id = 7 AND event_type <> 'error'""")
def undo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    j = e.select(F.lit("restructure_plan").alias("ref_type"), F.col("user_id").cast("string").alias("ref_id"), F.lit("move").alias("op"), F.concat(F.lit("/a/"), F.col("event_id").cast("string")).alias("from_path"), F.concat(F.lit("/b/"), F.col("event_id").cast("string")).alias("to_path"), F.col("ts").alias("executed_at"), (F.col("event_type") != "error").alias("reversible"), F.col("event_id").alias("seq"))
    return restructure.undo_steps(j, "restructure_plan", "7").select("op", "from_path", "to_path", "seq")


from shoebox.plans import catalog_queries  # noqa: E402, F401  registers its queries here


@query("""
  WITH s AS (SELECT (user_id % 10)::VARCHAR AS plan_id, user_id::VARCHAR AS media_id, user_id % 2 = 0 AS same, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'copied' WHEN 'signup' THEN 'verified' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state FROM events),
  b AS (SELECT *, lag(state) OVER (PARTITION BY media_id ORDER BY seq) AS before FROM s)
  SELECT plan_id, media_id, seq, before, state, CASE
    WHEN before IS NULL AND state = 'pending' OR before IN ('pending', 'renamed', 'copied', 'verified', 'source_trashed') AND state = 'failed' AND (NOT same OR before = 'pending')
      OR NOT same AND (before || '>' || state) IN ('pending>copied', 'copied>verified', 'verified>source_trashed', 'source_trashed>done') THEN 'ok'
    WHEN before = state THEN 'repeated' ELSE 'illegal' END AS verdict FROM b""")
def transition_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transition of the event log against the orders that items of one drive and of two may take."""
    t = event_transitions(spark, sf_dir)
    t = t.select(F.col("plan_id").cast("string").alias("plan_id"), F.col("media_id").cast("string").alias("media_id"), (F.col("media_id") % 2 == 0).alias("same_drive"), "state", "seq")
    return plan_states.check_transitions(t)


def order_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of all orders' files: two plans, every seventh move not to be undone, places that several files were moved to."""
    o = table(spark, sf_dir, "orders")
    ref = F.when(F.col("o_orderstatus") == "F", "p1").otherwise("p2")
    to = F.concat(F.lit("/lib/"), (F.col("o_orderkey") % 5000).cast("string"))
    return o.select(F.lit("restructure_plan").alias("ref_type"), ref.alias("ref_id"), F.lit("move").alias("op"), F.concat(F.lit("/src/"), F.col("o_orderkey").cast("string")).alias("from_path"), to.alias("to_path"), F.col("o_orderdate").alias("executed_at"), (F.col("o_orderkey") % 7 != 0).alias("reversible"), F.col("o_orderkey").alias("seq"))


@query("""
  WITH j AS (SELECT '/src/' || o_orderkey AS from_path, '/lib/' || (o_orderkey % 5000) AS to_path, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0),
  l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY to_path ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  SELECT c_custkey AS media_id, from_path AS source_ref FROM customer JOIN l ON to_path = '/lib/' || c_custkey""")
def undo_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    media_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("media_id"), F.concat(F.lit("/lib/"), F.col("c_custkey").cast("string")).alias("source_ref"))
    return restructure.undo_sources(restructure.undo_steps(order_journal(spark, sf_dir), "restructure_plan", "p1"), media_)


@query("""
  SELECT p_partkey AS media_id, '/lib/' || p_partkey AS to_path FROM part
  WHERE p_size % 4 NOT IN (0, 1) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5000 = p_partkey)""")
def remaining_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("p_size") % 4 == 0, "done").when(F.col("p_size") % 4 == 1, "failed").when(F.col("p_size") % 4 == 2, "copied").otherwise("pending")
    items = table(spark, sf_dir, "part").select(F.lit("p1").alias("plan_id"), F.col("p_partkey").alias("media_id"), F.concat(F.lit("/lib/"), F.col("p_partkey").cast("string")).alias("to_path"), state.alias("state"))
    return restructure.remaining(items, order_journal(spark, sf_dir)).select("media_id", "to_path")


@query(f"""
  WITH {_PHASH}, g AS (SELECT doc_id, i // 9 AS y, i % 9 AS x, n FROM cells),
  r AS (SELECT c.doc_id, greatest(0, least(255, u.n + d.n + l.n + r.n - 4 * c.n)) AS v FROM g c
    JOIN g u ON u.doc_id = c.doc_id AND u.x = c.x AND u.y = greatest(c.y - 1, 0) JOIN g d ON d.doc_id = c.doc_id AND d.x = c.x AND d.y = least(c.y + 1, 7)
    JOIN g l ON l.doc_id = c.doc_id AND l.y = c.y AND l.x = greatest(c.x - 1, 0) JOIN g r ON r.doc_id = c.doc_id AND r.y = c.y AND r.x = least(c.x + 1, 8))
  SELECT doc_id, round(var_pop(v), 4) AS variance FROM r GROUP BY doc_id""")
def grid_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Laplacian's variance over each document's grid, in the tasks that hold the grids."""
    grids = dedup.text_grids(table(spark, sf_dir, "documents"))
    return models.sharpness(grids, "grid", 9, 8).select("doc_id", F.round("variance", 4).alias("variance"))


@query("""
  WITH t AS (SELECT o_orderkey AS id, o_custkey AS story_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
  n AS (SELECT -1 - c_custkey AS id, c_custkey AS story_id FROM customer WHERE c_custkey % 3 = 0),
  k AS (SELECT * FROM t WHERE story_id NOT IN (SELECT story_id FROM n) UNION ALL SELECT * FROM n)
  SELECT k.id, story_id, CASE WHEN id < 0 THEN 2 ELSE coalesce(c.n, 0) END::BIGINT AS clips FROM k LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON l_orderkey = id""")
def upsert_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third story gets a new timeline with two clips; the clips of the old one go with it."""
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("story_id")).agg(F.min("o_orderkey").alias("id"))
    clips = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("timeline_id"), F.col("l_linenumber").alias("ord"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select((-1 - F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("story_id"))
    made = new.select(F.col("id").alias("timeline_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    t, clips = merge.upsert_timelines(t, clips, new, made)
    return t.join(clips.groupBy(F.col("timeline_id").alias("id")).agg(F.count("*").alias("clips")), "id", "left").select("id", "story_id", F.coalesce("clips", F.lit(0)).alias("clips"))
