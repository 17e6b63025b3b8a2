"""Line dedup by an exact set-similarity join: rarity order, prefix, positional and length filters, verified Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import Scratch, written
from shoebox.llm.wordhash import WORD_TABLE, blocks, hashed, mix

SIMILAR = 0.8
#: Counters of the token sketch: its size is fixed, whatever the vocabulary (at most this many rows reach the driver).
COUNTERS = 1 << 17
#: Sets before it, in order of size, that a set is compared with in the group of a key; and the earlier sets of a group
#: that pass the filters and are written for it.  A set without a match that has more is compared again without that
#: limit and with FURTHER sets, and looked for by longer keys in groups that reach beyond those.
BEFORE, WRITTEN, FURTHER = 768, 16, 1 << 15
#: Bits of the filter of keys that met another: 16 MB, whatever their number.
KEY_BITS = 27
#: Bits of a set's size beside a key, and of a token's place in its set beside a line's number.
_SIZE, _POS = 31, 28
#: Line breaks become this word-parting byte, so that lines can be told after all else has become a space.
_LINES = bytes(10 if b == 10 else WORD_TABLE[b] for b in range(256))
_OTHER = np.uint64(0xA0761D6478BD642F)


def _tokens(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: each word's hash and line (numbered through the block), and each text's first line."""
    data = b"\n".join(encoded).translate(_LINES)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    begins = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in encoded], out=begins[1:])
    first_line = np.concatenate([[0], np.searchsorted(breaks, begins[1:-1] - 1) + 1, [len(breaks) + 1]])
    h, starts, _, _ = hashed([data.replace(b"\n", b" ")])
    return h, np.searchsorted(breaks, starts), first_line


def _slot(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(COUNTERS - 1)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, np.int64)
    for pdf in batches:
        for _, _, encoded in blocks(pdf["text"].tolist()):
            total += np.bincount(_slot(_tokens(encoded)[0]), minlength=COUNTERS)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"slot": some, "n": total[some]})


def least_overlap(a: np.ndarray, b: np.ndarray, similar: Fraction) -> np.ndarray:
    """Common tokens that sets of ``a`` and ``b`` tokens need for a Jaccard similarity of at least ``similar``."""
    p, q = similar.numerator, similar.denominator
    return -((-p * (a + b)) // (p + q))


def _sets(token: np.ndarray, line: np.ndarray, n_lines: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each line in order of rarity, and where each line's begin."""
    order = rank[_slot(token)].astype(np.uint64)
    clash = n_lines > 1 << 17
    if not clash:  # line, rank and the hash's upper bits fit one word
        packed = line.astype(np.uint64) << np.uint64(47) | order << np.uint64(30) | token >> np.uint64(34)
        by = np.argsort(packed)
        t, packed = token[by], packed[by]
        clash = bool(((packed[1:] == packed[:-1]) & (t[1:] != t[:-1])).any())
    if clash:
        by = np.lexsort((token, order, line))
        t = token[by]
    line = line[by]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (line[1:] != line[:-1])
    t, line = t[new], line[new]
    return t, np.searchsorted(line, np.arange(n_lines + 1))


def _sequences(token: np.ndarray, line: np.ndarray, n_lines: int) -> np.ndarray:
    """A hash of each line's words in their order."""
    at = np.searchsorted(line, np.arange(n_lines + 1))
    place = np.arange(len(token)) - at[line]
    return mix(_sums(mix(token + place.astype(np.uint64) * _OTHER), at))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _keys(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A key of 128 bits of each line's set, in two parts, and the spread hashes it is summed from."""
    size, spread = np.diff(at).astype(np.uint64), mix(t)
    return mix(_sums(spread, at) ^ size << np.uint64(40)), mix(_sums(mix(t ^ _OTHER), at) + size), spread


def _ranks(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(COUNTERS, np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(COUNTERS, dtype=np.uint32)
    return rank


LINE = "row long, doc_id long, line int, k1 long, k2 long, seq long, n int, sketch1 long, sketch2 int, prefix array<int>"


def _numbered(shared, similar: Fraction):
    """Numbers each row's lines; gives a line's token set a key, a sketch and its rarest tokens, and the line's words a hash.

    Bit i of the sketch's 96 is whether an odd number of tokens fall on i, so two sets differ in at least as many
    tokens as their sketches do in bits.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc_id = batch.column("row"), batch.column("doc_id")
            for a, _, encoded in blocks(batch.column("text").to_pylist()):
                token, line, first_line = _tokens(encoded)
                t, at = _sets(token, line, int(first_line[-1]), shared.value)
                seq, size = _sequences(token, line, int(first_line[-1])), np.diff(at)
                k1, k2, spread = _keys(t, at)
                bit = (spread >> np.uint64(8)) % np.uint64(96)
                one, upper = np.uint64(1) << (bit & np.uint64(63)), bit > 63
                sketch = np.zeros((2, len(size)), np.uint64)
                some = np.flatnonzero(size)
                if len(some):
                    for k in (0, 1):
                        sketch[k, some] = np.bitwise_xor.reduceat(np.where(upper == k, one, np.uint64(0)), at[:-1][some])
                # two more than a set's first tokens, for keys of two and three tokens
                length = np.where(size < least_size(similar), 0, np.minimum(size, _prefix(size, similar) + 2))
                ends = np.concatenate([[0], np.cumsum(length)])
                take = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(at[:-1], length)
                text = np.searchsorted(first_line, np.arange(len(size)), side="right") - 1
                of = pa.array(a + text)
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((spread[take] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [row.take(of), doc_id.take(of), pa.array((np.arange(len(size)) - first_line[text]).astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(seq.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(sketch[0].view(np.int64)), pa.array(sketch[1].astype(np.uint32).view(np.int32)), prefix],
                    ["row", "doc_id", "line", "k1", "k2", "seq", "n", "sketch1", "sketch2", "prefix"],
                )

    return lines


def least_size(similar: Fraction) -> int:
    """Sets of fewer tokens are similar to equal ones only: one token more or less is too much."""
    return -(-similar.numerator // (similar.denominator - similar.numerator)) if similar < 1 else 1 << _SIZE - 1


def _prefix(n: np.ndarray, similar: Fraction) -> np.ndarray:
    """Tokens of which similar sets share at least one."""
    return n + 1 + (-similar.numerator * n) // similar.denominator


def _candidates(similar: Fraction, tokens: int, most: int, before: int):
    """Pairs of sets that share a key of so many ``tokens`` and pass the length, positional and sketch filters.

    Rows come sorted by ``group``, a key followed by the bits of a set's size.  A set is compared with the ``before``
    sets ahead of it in its key's group that are large enough; of the earlier lines that pass, ``most`` are given.
    A set that has more, or has sets beyond those, is given as a mark (``earlier`` null, with the key).  Only sets to
    be ``asked`` for are the later of a pair.
    """

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            behind = 0 if held is None else len(held)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            group, seq, doc, at = (pdf[c].to_numpy() for c in ("group", "seq", "doc", "at"))
            line, pos = at >> _POS, at & (1 << _POS) - 1
            sketch = [pdf["sketch1"].to_numpy().view(np.uint64), pdf["sketch2"].to_numpy().view(np.uint32)]
            asked = pdf["asked"].to_numpy() if "asked" in pdf else np.ones(len(pdf), bool)
            key, n, rows = group >> _SIZE, group & (1 << _SIZE) - 1, np.arange(len(pdf))
            every = bool(asked.all())
            far = np.cumsum(np.append(False, key[1:] != key[:-1])) << 32
            reach = rows - np.searchsorted(far + n, far - (-similar.numerator * n // similar.denominator))
            seen, out, i = np.zeros(len(pdf), np.int64), [], rows[(rows >= behind) & (reach > 0)]
            for o in range(1, before + 1):
                i = i[reach[i] >= o]
                if not len(i):
                    break
                own = i if every else i[asked[i] | asked[i - o]]
                j = own - o
                need = least_overlap(n[own], n[j], similar)
                good = np.flatnonzero((np.minimum(n[own] - pos[own], n[j] - pos[j]) + tokens - 1 >= need) & (seq[own] != seq[j]))
                a, b, most_apart = own[good], j[good], (n[own] + n[j] - 2 * need)[good]
                apart = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int32) for x in sketch)
                good = np.flatnonzero(apart <= most_apart)
                if not len(good):
                    continue
                a, b, apart = a[good], b[good], apart[good]
                same = (doc[a] == doc[b]) & (line[a] == line[b])  # rows that repeat an id: either may be the later
                after = (doc[a] > doc[b]) | (doc[a] == doc[b]) & (line[a] > line[b])
                for later, earlier, use in ((a, b, after | same), (b, a, ~after)):
                    use &= asked[later]
                    l, e, d = later[use], earlier[use], apart[use]
                    few = seen[l] < most
                    seen[l] += 1
                    out.append((seq[l[few]], seq[e[few]], d[few], same[use][few]))
            if out:
                l, e, d, same = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"later": l, "earlier": pd.array(e, "Int64"), "apart": d.astype(np.int32), "same": same, "key": pd.array([0] * len(l), "Int64")}).drop_duplicates(["later", "earlier"])
            beyond = rows[(rows >= behind) & (reach > before)]
            marked = np.unique(np.concatenate([np.flatnonzero(seen > most), beyond, beyond - before - 1]))
            marked = marked[asked[marked]]
            if len(marked):
                yield pd.DataFrame({"later": seq[marked], "earlier": pd.array([pd.NA] * len(marked), "Int64"), "apart": np.int32(0), "same": False, "key": pd.array(key[marked], "Int64")})
            tail = max(len(pdf) - before - 1, 0)
            held = pdf.iloc[tail:][key[tail:] == key[-1]]

    return pairs


def matched_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", *, scratch: Scratch) -> DataFrame:
    """For each line: ``row``, ``doc_id``, ``line`` (from 0), ``tokens`` (their number), ``match``: "exact", "near" or null.

    ``row`` tells rows of ``docs`` apart; the result is read from tables in ``scratch``.  See ``dedup_lines``.
    """
    p = Fraction(similar).limit_denominator(10_000)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = d.select("text").mapInPandas(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)
    counts[sketch["slot"]] = sketch["n"]
    rank = docs.sparkSession.sparkContext.broadcast(_ranks(counts))
    lines = scratch.written(d.mapInArrow(_numbered(rank, p), LINE))
    place = F.struct("doc_id", "row", "line")
    full = lines.where("n > 0")
    copies = lambda df, *more: df.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *more)
    firsts = copies(full.where(F.col("n") >= least_size(p)), *[F.first(c).alias(c) for c in ("seq", "n", "sketch1", "sketch2", "prefix")])
    with Scratch(docs.sparkSession) as own:
        sets = own.written(firsts)
        near = _near(sets, d.select("text"), rank, p, own).select(F.col("k1").alias("_n1"), F.col("k2").alias("_n2")).distinct()
        more = sets.select("k1", "k2", "first", "copies").unionByName(copies(full.where(F.col("n") < least_size(p)))).where("copies > 1")
        decided = more.join(near, (F.col("k1") == F.col("_n1")) & (F.col("k2") == F.col("_n2")), "full")
        decided = scratch.written(decided.select(F.coalesce("k1", "_n1").alias("_k1"), F.coalesce("k2", "_n2").alias("_k2"), "first", F.col("_n1").isNotNull().alias("near")))
    light = lines.select("row", "doc_id", "line", "k1", "k2", "n")
    # sets of one line without a match, which most are, are not in ``decided``
    found = light.where("n > 0").join(decided, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    match = F.when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), "exact").when(F.col("near"), "near")
    found = found.select("row", "doc_id", "line", F.col("n").alias("tokens"), match.alias("match"))
    blank = light.where("n = 0").select("row", "doc_id", "line", F.col("n").alias("tokens"), F.lit(None).cast("string").alias("match"))
    return found.unionByName(blank)


def _near(sets: DataFrame, texts: DataFrame, rank, p: Fraction, scratch: Scratch) -> DataFrame:
    """``seq``, ``k1``, ``k2`` of the sets that have an earlier similar one.

    Similar sets share one of their first tokens, so they meet in the group of one token.  Sets that have no match
    yet are compared with more of their group, and where it reaches beyond that too, they are looked for by the next
    longer key: similar sets share two of one more first tokens, and three of two more.  Keys of three tokens hold both sets' sizes too, which
    shortens most prefixes, and meet in an ordinary join.
    """
    num, den = F.lit(p.numerator), F.lit(p.denominator)
    n = F.col("n")
    length = (n - F.ceil(num * n / den) + 1).cast("int")
    held = sets.select("seq", "n", "sketch1", "sketch2", F.coalesce(F.col("first.doc_id"), F.lit(-(1 << 63)).cast("long")).alias("doc"), F.col("first.line").alias("line"), "prefix")
    one = held.select("*", F.posexplode(F.slice("prefix", F.lit(1), length)).alias("pos", "token"))
    after = lambda least, last: F.explode(F.filter(F.sequence(F.col(least) + 1, F.greatest(last, F.col(least) + 1)), lambda x: x <= last))
    pair = F.shiftright(F.xxhash64("token", F.element_at("prefix", F.col("pos2") + 1)), _SIZE)
    columns = ["seq", "sketch1", "sketch2", "doc", F.shiftleft(F.col("line").cast("long"), _POS).bitwiseOR(F.col("pos").cast("long")).alias("at")]
    schema = "later long, earlier long, apart int, same boolean, key long"

    def met(rows: DataFrame, tokens: int, most: int, before: int) -> tuple[DataFrame, DataFrame]:
        group = F.shiftleft("key", _SIZE).bitwiseOR(n.cast("long")).alias("group")  # one number, as it is sorted by its digits
        dealt = rows.select(group, *columns, *(["asked"] if "asked" in rows.columns else [])).repartition(F.shiftright("group", _SIZE)).sortWithinPartitions("group")
        both = scratch.written(dealt.mapInPandas(_candidates(p, tokens, most, before), schema))
        return both.where("earlier is not null").drop("key"), both.where("earlier is null").select(F.col("later").alias("_seq"), F.col("key").alias("_key")).distinct()

    def open_(marks: DataFrame, near: DataFrame) -> DataFrame:
        return scratch.written(marks.join(near, F.col("_seq") == F.col("seq"), "left_anti"))

    def again(rows: DataFrame, marks: DataFrame) -> DataFrame:
        """``rows`` with a marked key; ``asked`` are those that are marked themselves."""
        some = rows.join(marks.select("_key").distinct(), F.col("key") == F.col("_key"), "left_semi")
        asked = marks.select("_seq", "_key", F.lit(True).alias("_asked"))
        return some.join(asked, (F.col("seq") == F.col("_seq")) & (F.col("key") == F.col("_key")), "left").drop("_seq", "_key").withColumn("asked", F.coalesce("_asked", F.lit(False))).drop("_asked")

    every = 1 << 31
    one = one.withColumn("key", F.col("token").cast("long"))
    pairs, marks = met(one, 1, WRITTEN, BEFORE)
    near = _verified(pairs, sets, texts, rank, p, scratch)
    marks = open_(marks, near)
    if marks.isEmpty():
        return near
    pairs, marks = met(again(one, marks), 1, every, FURTHER)
    near = near.unionByName(_verified(pairs, sets, texts, rank, p, scratch))
    marks = open_(marks, near)
    if marks.isEmpty():
        return near
    longer = after("pos", F.least(length, F.size("prefix") - 1))
    two = again(one, marks).withColumn("pos2", longer).withColumn("key", pair)
    pairs, more = met(two.drop("pos").withColumnRenamed("pos2", "pos"), 2, every, FURTHER)
    near = near.unionByName(_verified(pairs, sets, texts, rank, p, scratch))
    more = open_(more, near)
    if more.isEmpty():
        return near
    two = one.join(marks.select("_key").distinct(), F.col("key") == F.col("_key"), "left_semi").withColumn("pos2", longer).withColumn("key", pair)
    three = again(two, more)
    size = F.explode(F.sequence(F.ceil(num * n / den).cast("int"), F.floor(n * den / num).cast("int")))
    three = three.withColumn("m", size).withColumn("need", F.ceil(num * (n + F.col("m")) / (num + den)))
    last = (n - F.col("need") + 2).cast("int")
    three = three.where((F.col("pos") < last - 1) & (F.col("pos2") < last)).withColumn("pos3", after("pos2", F.least(last, F.size("prefix") - 1)))
    three = three.withColumn("key", F.xxhash64("key", F.element_at("prefix", F.col("pos3") + 1), F.least("n", "m"), F.greatest("n", "m")))
    three = scratch.written(three.select("key", "seq", "n", "m", "need", "sketch1", "sketch2", "doc", "line", "asked"))
    mine = three.where("asked").select("key", F.col("seq").alias("later"), "n", "m", "need", F.col("sketch1").alias("sketch1_"), F.col("sketch2").alias("sketch2_"), F.col("doc").alias("doc_"), F.col("line").alias("line_"))
    other = three.select(F.col("key").alias("_key"), F.col("seq").alias("earlier"), F.col("n").alias("_n"), "sketch1", "sketch2", "doc", "line")
    both = mine.join(other, (F.col("key") == F.col("_key")) & (F.col("m") == F.col("_n")) & (F.col("later") != F.col("earlier")))
    apart = F.bit_count(F.col("sketch1").bitwiseXOR(F.col("sketch1_"))) + F.bit_count(F.col("sketch2").bitwiseXOR(F.col("sketch2_")))
    same = (F.col("doc") == F.col("doc_")) & (F.col("line") == F.col("line_"))
    both = both.where((apart <= F.col("n") + F.col("m") - 2 * F.col("need")) & (F.struct("doc", "line") <= F.struct("doc_", "line_")))
    pairs = scratch.written(both.select("later", "earlier", apart.cast("int").alias("apart"), same.alias("same")).distinct())
    return near.unionByName(_verified(pairs, sets, texts, rank, p, scratch)).distinct()


def _members(keys: DataFrame, texts: DataFrame, rank, scratch: Scratch) -> DataFrame:
    """``seq``, ``k1``, ``k2``, ``tokens`` of the lines with a hash ``seq`` of some.

    Token sets are large and most lines meet no other, so they are made again from the texts and filtered by a
    bitmap of the hashes (of fixed size; a full one filters nothing); the join with the pairs is exact.
    """
    spark, part = texts.sparkSession, 1 << 13

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((1 << KEY_BITS) // 8, np.uint8)  # one a task
        for pdf in batches:
            at = pdf["seq"].to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        for q in np.flatnonzero(held.reshape(-1, part).any(axis=1)):
            yield pd.DataFrame({"part": [int(q)], "bits": [held[q * part : (q + 1) * part].tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(bits=[np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()])

    held = np.zeros((1 << KEY_BITS) // 8, np.uint8)
    parts = keys.repartitionByRange("seq").mapInPandas(set_bits, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary")
    for r in parts.toLocalIterator():
        held[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(held)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, encoded in blocks(batch.column("text").to_pylist()):
                token, line, first_line = _tokens(encoded)
                seq = _sequences(token, line, int(first_line[-1]))
                bit = seq >> np.uint64(64 - KEY_BITS)
                keep = shared.value[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1 != 0
                keep = np.flatnonzero(keep)
                keep = keep[np.unique(seq[keep], return_index=True)[1]]  # copies inside a block once
                new = np.full(len(seq), -1)
                new[keep] = np.arange(len(keep))
                some = new[line] >= 0
                order = np.argsort(new[line[some]], kind="stable")
                t, at = _sets(token[some][order], new[line[some]][order], len(keep), rank.value)
                k1, k2, _ = _keys(t, at)
                yield pa.RecordBatch.from_arrays([pa.array(seq[keep].view(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t.view(np.int64)))], ["seq", "k1", "k2", "tokens"])

    return scratch.written(texts.mapInArrow(passed, "seq long, k1 long, k2 long, tokens array<long>").groupBy("seq", "k1", "k2").agg(F.first("tokens").alias("tokens")))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, rank, p: Fraction, scratch: Scratch) -> DataFrame:
    """``seq``, ``k1``, ``k2`` of the later set of each pair that is similar by its tokens.

    First the pair whose sketches differ least is verified for each later set, then all pairs of those without a match.
    """
    with Scratch(sets.sparkSession) as own:
        pairs = own.written(pairs.groupBy("later", "earlier").agg(F.min("apart").alias("apart"), F.max("same").alias("same")))
        members = _members(pairs.select(F.explode(F.array("later", "earlier")).alias("seq")), texts, rank, own)
        best = pairs.groupBy("later").agg(F.min(F.struct("apart", "earlier", "same")).alias("b")).select("later", "b.earlier", "b.same")
        sure = own.written(_similar(best, members, sets, p))
        tried = best.select(F.col("later").alias("_later"), F.col("earlier").alias("_earlier"))
        rest = pairs.join(sure, F.col("later") == F.col("seq"), "left_anti").join(tried, (F.col("later") == F.col("_later")) & (F.col("earlier") == F.col("_earlier")), "left_anti")
        return scratch.written(sure.unionByName(_similar(rest.select("later", "earlier", "same"), members, sets, p)).distinct())


def _similar(pairs: DataFrame, members: DataFrame, sets: DataFrame, p: Fraction) -> DataFrame:
    """``seq``, ``k1``, ``k2`` of the later sets of ``pairs`` whose tokens are similar enough; of pairs marked ``same`` the order is looked up."""
    side = lambda x: members.select(F.col("seq").alias(f"{x}0"), F.col("k1").alias(f"{x}1"), F.col("k2").alias(f"{x}2"), F.col("tokens").alias(f"{x}_tokens"))
    both = pairs.join(side("l"), F.col("later") == F.col("l0")).join(side("e"), F.col("earlier") == F.col("e0"))
    common = F.size(F.array_intersect("l_tokens", "e_tokens"))
    union = F.size("l_tokens") + F.size("e_tokens") - common
    good = both.where(common * F.lit(p.denominator) >= union * F.lit(p.numerator)).select("l0", "l1", "l2", "e1", "e2", "same")
    for x in ("l", "e"):  # the first place of a set, where id and line do not tell which comes first
        placed = sets.select(F.col("k1").alias(f"_{x}1"), F.col("k2").alias(f"_{x}2"), F.col("first").alias(f"{x}_first"))
        good = good.join(placed, F.col("same") & (F.col(f"{x}1") == F.col(f"_{x}1")) & (F.col(f"{x}2") == F.col(f"_{x}2")), "left")
    return good.where(~F.col("same") | (F.col("e_first") < F.col("l_first"))).select(F.col("l0").alias("seq"), F.col("l1").alias("k1"), F.col("l2").alias("k2")).distinct()


def dedup_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_exact``, ``n_near``, ``removed`` (line numbers from 0, sorted) for each row of ``docs``.

    Lines (parted at line feeds) are sets of words (A-Z lowered, words parted at all but letters and digits).  A
    line goes where a line before it, in the order of id, row and line number, has an equal set ("exact") or one
    of a Jaccard similarity of at least ``similar`` ("near"), whether or not that line goes itself.

    The order of rarity comes from counts over all texts in a sketch of fixed size: any order gives the same
    result.  Equal sets are brought to one row first, by 128 bits of hash.  Sets meet by shuffle on their rarest
    tokens; in large groups a set is compared with a bounded number of neighbours in size, and sets that find no
    match there are looked for by two and three tokens (``_near``).  Only keys and sketches are shuffled for that;
    pairs that pass are verified on the tokens' 64-bit hashes, which are made again for their members alone.

    Lines without words are never removed; a null text is one such line; a null id sorts first; repeated rows
    are later rows; an empty table gives an empty one; other columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        m = matched_lines(docs, similar, id_col, text_col, scratch=scratch)
        hit = lambda kind: F.count(F.when(F.col("match") == kind, 1)).alias(f"n_{kind}")
        by_row = m.groupBy("row", "doc_id").agg(F.count("*").alias("n_lines"), hit("exact"), hit("near"), F.sort_array(F.collect_list(F.when(F.col("match").isNotNull(), F.col("line")))).alias("removed"))
        return written(by_row.drop("row"))


def without_lines(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``: texts without the lines that ``dedup_lines`` removes; rows must differ in their ids."""
    gone = dedup_lines(docs, similar, id_col, text_col).where(F.size("removed") > 0).select(F.col("doc_id").alias("_id"), "removed")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(gone, F.col("doc_id") == F.col("_id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return d.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"))
