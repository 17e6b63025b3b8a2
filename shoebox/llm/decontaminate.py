"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import written
from shoebox.llm.wordhash import blocks, hashed, mix, shingles

WORDS, CONTAINED = 5, 0.8
#: Hash functions of a signature.  A window that holds 0.8 of an item of its size class has Jaccard >= 0.22 with
#: it, so a signature without a common minimum has a chance of at most 0.78 ** 64 = 1e-7.
HASHES = 64
#: Smallest size class; each further class doubles it.
LEAST_CLASS = 8
#: Items of less distinct shingles, or with more repeats than this leaves, have no signature: class EXACT joins on shingles.
DISTINCT, EXACT = 0.9, 0
#: Bits of the item filter for each item shingle, and its largest size: the filter is at most 16 MB, whatever
#: the benchmark's size (a full one filters nothing and costs time, never a match).
FILTER_BITS, FILTER_MOST = 1024, 27

_FLIP = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_FLIP) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _minima(s: np.ndarray, at: np.ndarray, j: int) -> np.ndarray:
    """Minima of the j-th hash over the runs of ``s`` that begin at ``at``."""
    return np.minimum.reduceat((s ^ _FLIP[j]) * _ODD[j], at)


def _key(low: np.ndarray, size_class: int, j: int) -> np.ndarray:
    return mix(low ^ _FLIP[(j + size_class.bit_length() * 7) % HASHES] ^ np.uint64(size_class * 1009 + j))


def _exact_keys(s: np.ndarray) -> np.ndarray:
    return mix(s ^ _FLIP[-1])


def _classes(n: np.ndarray) -> np.ndarray:
    """The size class of ``n`` shingles: LEAST_CLASS times the least power of two that holds them."""
    return LEAST_CLASS << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / LEAST_CLASS))).astype(np.int64)


def _encoded(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes and offsets of blocks of lower-cased texts."""
    for a, _, encoded in blocks([t.lower() if t else t for t in texts]):
        h, _, _, offsets = hashed(encoded)
        yield a, h, offsets


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for a, h, offsets in _encoded(pdf["text"].tolist()):
            s, at = shingles(h, offsets, WORDS)
            n = np.diff(at)
            for i in np.flatnonzero(n):
                own = np.unique(s[at[i] : at[i + 1]])
                exact = len(own) < LEAST_CLASS or len(own) < DISTINCT * n[i]
                size_class = EXACT if exact else int(_classes(n[i : i + 1])[0])
                keys = _exact_keys(own) if exact else np.array([_key(_minima(own, np.zeros(1, np.int64), j), size_class, j)[0] for j in range(HASHES)], np.uint64)
                words = min(int(offsets[i + 1] - offsets[i]), WORDS)
                rows.append((pdf["item_id"].iloc[a + i], size_class, words, own.view(np.int64).tolist(), keys.view(np.int64).tolist()))
        yield pd.DataFrame(rows, columns=["item_id", "size_class", "words", "shingles", "keys"]).astype({"shingles": object, "keys": object})


def _places(s: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return s >> shift, mix(s) >> shift


def _filter(items: DataFrame, n_shingles: int) -> tuple[np.ndarray, int]:
    """A bit for each of two places of every item shingle.  Parts are merged by Spark; at most 16 MB reach the driver."""
    bits = int(min(FILTER_MOST, max(16, np.ceil(np.log2(max(1, n_shingles) * FILTER_BITS)))))
    part = 1 << min(bits, 16)

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.concatenate([np.asarray(x, np.int64) for x in pdf["shingles"]] or [np.zeros(0, np.int64)]).view(np.uint64)
            places = np.unique(np.concatenate(_places(s, bits)).astype(np.int64))
            for p in np.unique(places // part):
                held = np.zeros(part, np.uint8)
                held[places[places // part == p] % part] = 1
                yield pd.DataFrame({"part": [int(p)], "bits": [np.packbits(held).tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pdf.iloc[:1].assign(bits=[both.tobytes()])

    merged = items.select("shingles").mapInPandas(set_bits, "part long, bits binary").groupBy("part").applyInPandas(merge, "part long, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged:
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out) if bits <= 24 else out, bits


def _hits(s: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    def look(at: np.ndarray) -> np.ndarray:
        if len(held) == 1 << bits:
            return held[at] != 0
        return (held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 != 0

    first, second = _places(s, bits)
    hit = look(first)
    some = np.flatnonzero(hit)
    hit[some] = look(second[some])
    return hit


def _window_keys(s: np.ndarray, hit: np.ndarray, classes: list[int]) -> np.ndarray:
    """Signature keys of a document's windows, for the minima that an item's shingle gives.

    A class of size m has blocks of m / 2 shingles and windows of three blocks, so that any run of m shingles
    lies inside one window.  Blocks of a class are pairs of the blocks of the class below.
    """
    keys = [np.zeros(0, np.uint64)]
    for j in range(HASHES if classes else 0):
        v = (s ^ _FLIP[j]) * _ODD[j]
        step = LEAST_CLASS // 2
        low = np.minimum.reduceat(v, np.arange(0, len(v), step))
        own = np.minimum.reduceat(np.where(hit, v, _NONE), np.arange(0, len(v), step))
        for m in classes:
            while step < m // 2:
                low, own = (np.minimum.reduceat(x, np.arange(0, len(x), 2)) for x in (low, own))
                step *= 2
            three = [np.concatenate([x, [_NONE, _NONE]]) for x in (low, own)]
            least, ours = (np.minimum(np.minimum(x[:-2], x[1:-1]), x[2:]) for x in three)
            shared = ours[(ours == least) & (ours != _NONE)]
            keys.append(_key(np.unique(shared), m, j))
    return np.unique(np.concatenate(keys))


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs ``doc_id``, ``item_id``, ``n_shingles``, ``n_shared``, ``containment`` with containment >= ``threshold``; and ``text_md5``.

    Texts are lower-cased and parted at everything but letters and digits; sets are of 5-word shingles of whole
    texts; containment is the share of the item's set that the document's set holds.  An item of 1 to 4 words is
    one shingle of so many words, and documents are scanned for runs of that length too; texts without words (empty,
    blank or null) hold and match nothing.  Items with equal sets are one item under their smallest id.  Items are
    parted by size (classes of a factor of two); their MinHash signatures are joined with those of document windows
    of the class's size.  Items of few shingles, or of many repeated ones, are joined on the shingles themselves.
    Candidate pairs are verified by exact containment over the whole document.  A scan keeps
    documents that share a shingle with any item, by a filter of bounded size; longer joins are ordinary ones
    that Spark splits where one passage is in very many documents.  Repeated rows give repeated pairs; a null
    id stays null; empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    it = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).mapInPandas(_items, "item_id long, size_class int, words int, shingles array<long>, keys array<long>")
    it = it.groupBy("size_class", "words", "shingles", "keys").agg(F.min("item_id").alias("item_id"))
    it = written(it.withColumn("item", F.monotonically_increasing_id()))
    n_shingles = it.agg(F.sum(F.size("shingles"))).first()[0] or 0
    classes = sorted(r[0] for r in it.select("size_class").distinct().collect())  # one a power of two
    short = sorted(r[0] for r in it.where(F.col("words") < WORDS).select("words").distinct().collect())  # of 1 to 4
    held, bits = _filter(it, n_shingles)
    shared = spark.sparkContext.broadcast(held)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at_, keys_, hits_ = [], [], []
            for a, h, offsets in _encoded(pdf["text"].tolist()):
                s, at = shingles(h, offsets, WORDS)
                hit = _hits(s, shared.value, bits)
                runs = [(x, y, _hits(x, shared.value, bits)) for x, y in (shingles(h, offsets, WORDS, n) for n in short)]
                texts = [np.searchsorted(y, np.flatnonzero(z), side="right") - 1 for _, y, z in [(s, at, hit), *runs]]
                for i in np.unique(np.concatenate(texts)):
                    own, mine = s[at[i] : at[i + 1]], hit[at[i] : at[i + 1]]
                    hits = np.unique(np.concatenate([own[mine], *[x[y[i] : y[i + 1]][z[y[i] : y[i + 1]]] for x, y, z in runs]]))
                    keys = [_window_keys(own, mine, [m for m in classes if m != EXACT])] if mine.any() else []
                    keys += [_exact_keys(hits)] if EXACT in classes else []
                    at_.append(a + i)
                    keys_.append(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
                    hits_.append(hits.view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at_].to_numpy(), "text_md5": pdf["text_md5"].iloc[at_].to_numpy(), "keys": pd.Series(keys_, dtype=object), "hits": pd.Series(hits_, dtype=object)})

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.md5(text_col).alias("text_md5"))
    d = d.mapInPandas(scan, "doc_id long, text_md5 string, keys array<long>, hits array<long>")
    d = written(d.withColumn("row", F.monotonically_increasing_id()))
    keyed = it.select("item", F.explode("keys").alias("key"))
    pairs = d.select("row", F.explode("keys").alias("key")).join(keyed, "key").select("row", "item").distinct()
    pairs = pairs.join(d.select("row", "doc_id", "text_md5", "hits"), "row").join(it.select("item", "item_id", "shingles"), "item")
    pairs = pairs.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", "hits")).cast("long").alias("n_shared"), "text_md5")
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no item as ``contained`` finds them."""
    found = contained(docs, items, threshold, id_col, text_col).select(F.col("doc_id").alias("_found_id"), F.col("text_md5").alias("_found_md5")).distinct()
    found = found.alias("found")
    return docs.alias("docs").join(found, F.col(f"docs.{id_col}").cast("long").eqNullSafe(F.col("found._found_id")) & F.md5(F.col(f"docs.{text_col}")).eqNullSafe(F.col("found._found_md5")), "left_anti")
