"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import cut, fresh
from shoebox.llm.graph import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Hashes whose bits are counted at once; a longer text is counted in pieces of this size.
_PIECE = 1 << 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text as an unsigned number: a bit is set where over half the shingle hashes set it."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _PIECE):
        piece = h[i : i + _PIECE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        prints = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_md5": pdf["text_md5"], "fp": prints})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``text_md5``, ``fp`` (the fingerprint's bits as a signed long), one row for each row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(text_col).alias("text_md5"))
    return texts.mapInPandas(_fingerprints, "doc_id long, text_md5 string, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints (column ``fp``) that connect all that differ in at most ``radius`` bits.

    Every fingerprint emits each variant within half the radius; two fingerprints within an even radius share
    one. At most 65 distinct fingerprints can emit the same variant (for radius 2), so groups are bounded
    whatever the number of copies; inside a group the smallest is paired with each of the others, which links
    the same components as all pairs do.  Pairs are deduplicated and verified bit by bit.
    """
    if radius not in (0, 2):
        raise ValueError("radius is 0 or 2: half of it is emitted as variants")
    masks = F.array(*[F.lit(0).cast("long")], *[F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(64 if radius else 0)])
    # fingerprints are few bytes and their variants many: dealt out before, so that no task makes the variants of a large share
    variants = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp").select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _grouped(distinct: DataFrame, radius: int) -> DataFrame:
    """Adds ``component`` (a fingerprint) to rows with distinct ``fp``."""
    comp = components(links(distinct.select("fp"), radius))
    return distinct.join(comp, distinct["fp"] == comp["node"], "left").drop("node").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts are lower-cased in A-Z, parted at ASCII white space and hashed as 3-word shingles, repeats included
    (XXH64, seed 42); fewer words are one shingle, none (empty, blank or null text) give fingerprint zero, which
    links like any other. ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius``
    differing bits. Equal fingerprints are brought to one row before variants are emitted, so exact copies cost
    nothing more. A null ``doc_id`` gets its component, but names none unless all ids of it are null. Repeated
    rows give repeated rows; an empty table gives an empty one; other columns of ``docs`` are not read.
    """
    fp = cut(fingerprints(docs, id_col, text_col).select("doc_id", "fp"))
    named = _grouped(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), radius)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select(F.col("fp").alias("_fp"), "component_id")
    return fp.join(named, fp["fp"] == named["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group: that with the smallest id (then text hash).

    A null id is chosen only where the group has no other; rows that repeat id and text are one document.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_md5")).alias("first")
    distinct = cut(fingerprints(docs, id_col, text_col).groupBy("fp").agg(first))
    kept = _grouped(distinct, radius).groupBy("component").agg(F.min("first").alias("first"))
    i, m, k, h = fresh(docs, "_id", "_md5", "_kept_id", "_kept_md5")
    kept = kept.select(F.col("first.doc_id").alias(k), F.col("first.text_md5").alias(h))
    keyed = docs.withColumns({i: F.col(id_col).cast("long"), m: F.md5(text_col)})
    found = keyed.join(kept, F.col(i).eqNullSafe(F.col(k)) & F.col(m).eqNullSafe(F.col(h)), "left_semi")
    return found.dropDuplicates([i, m]).drop(i, m)
