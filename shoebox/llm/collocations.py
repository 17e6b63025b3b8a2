"""Phrases whose words keep company: suffix automata of shards, counts reduced over the corpus, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoebox.llm._common import Scratch, written

#: UTF-8 bytes of text that one automaton is built over.
SHARD_BYTES = 1 << 22
#: Most frequent word pairs that are handed to every task (some tens of bytes each); more are brought to their shards by a shuffle.
SHARED_PAIRS = 1 << 20
#: Phrases that one Arrow batch of results holds.
BATCH_ROWS = 1 << 18

# The bytes that part pieces, the bytes that part words, A-Z lowered.
PIECE_SIGNS, WORD_SIGNS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_SIGNS)], _KIND[list(PIECE_SIGNS)] = 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

STATES = "lang string, phrase string, least int, most int, n long"


class Words:
    """The words of joined texts: ``data`` holds each word and one space, ``ids`` are exact word ids, ``first`` marks a piece's first word."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
        kind = _KIND[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(kind == 2, out=breaks[1:])
        self.first = np.ones(len(starts), bool)
        self.first[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        self.starts = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=self.starts[1:])
        keep = kind == 0
        keep[ends] = True  # one sign after each word
        self.data = raw[keep]
        self.data[self.starts[1:] - 1] = 32
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = raw[kind == 0]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def phrases(self, last: np.ndarray, length: np.ndarray) -> pa.Array:
        """The phrases of so many words that end with the given words, joined by spaces."""
        a, b = self.starts[last - length + 1], self.starts[last + 1] - 1
        offsets = np.zeros(len(last) + 1, np.int32)
        np.cumsum(b - a, out=offsets[1:])
        at = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])]).cast(pa.string())

    def pairs(self, frequent: tuple[pa.Array, pa.Array]) -> np.ndarray:
        """For each word whether it and the one before it in its piece are a frequent pair."""
        a, b = (pc.index_in(w.cast(pa.large_binary()), value_set=self.words) for w in frequent)
        known = pc.and_(a.is_valid(), b.is_valid())
        a, b = (x.filter(known).to_numpy().astype(np.int64) for x in (a, b))
        v = max(1, len(self.words))
        out = np.zeros(len(self.ids), bool)
        out[1:] = np.isin(self.ids[:-1] * v + self.ids[1:], a * v + b) & ~self.first[1:]
        return out


def automaton(ids: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of the generalised suffix automaton of all pieces, for phrases of at most ``depth`` words.

    A state is a class of phrases that end at the same places: of each its last place ``last``, the number of
    places ``n``, the words of its longest phrase ``most`` and of its shortest ``least`` (its suffix link has
    ``least - 1`` words).  The tree of suffix links is grown level by level from the root: a phrase's extensions to
    the left are its children, and a child with as many places is the same state.  Levels are sorted as whole arrays, which gives
    the same states as adding words one by one.  A phrase met once is no longer sorted: its state reaches to
    the piece's first word.
    """
    n, v = len(ids), int(ids.max()) + 1 if len(ids) else 1
    at = np.arange(n)
    reach = np.minimum(at - np.maximum.accumulate(np.where(first, at, 0)) + 1, depth)
    out: list[tuple[np.ndarray, ...]] = []
    key, pos = ids, at
    least = count = end = np.zeros(0, np.int64)
    for d in range(1, depth + 1):
        u, where, inverse, held = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        last = pos[where]
        if d == 1:
            low = np.ones(len(u), np.int64)
        else:
            parent = u // v
            same = held == count[parent]
            low = np.where(same, least[parent], d)
            longest = np.ones(len(count), bool)
            longest[parent[same]] = False
            longest &= count > 1
            out.append((end[longest], np.full(longest.sum(), d - 1), least[longest], count[longest]))
        once = held == 1
        out.append((last[once], reach[last[once]], low[once], held[once]))
        least, count, code, end = low, held, inverse, last
        go = (count[code] > 1) & (reach[pos] > d)
        if d == depth or not go.any():
            more = count > 1
            out.append((end[more], np.full(more.sum(), d), least[more], count[more]))
            break
        key, pos = code[go] * v + ids[pos[go] - d], pos[go]
    last, most, least, count = (np.concatenate(x) for x in zip(*out, strict=True))
    return last, most, least, count


def _pair_states(lang: str, texts: list[bytes], _: object) -> Iterator[pa.RecordBatch]:
    """The root, whose places are all words, and the states of phrases of one and two words."""
    words = Words(texts)
    if len(words.ids):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([lang], [""], np.zeros(1, np.int32), np.zeros(1, np.int32), [len(words.ids)])], ["lang", "phrase", "least", "most", "n"])
        yield from _rows(lang, words, np.arange(len(words.ids)), automaton(words.ids, words.first, 2), 1)


def _long_states(depth: int) -> Callable[[str, list[bytes], object], Iterator[pa.RecordBatch]]:
    def states(lang: str, texts: list[bytes], frequent: object) -> Iterator[pa.RecordBatch]:
        """States of phrases of three words and more, all of whose word pairs are frequent."""
        if lang not in frequent:
            return
        words = Words(texts)
        if not len(words.ids):
            return
        linked = words.pairs(frequent[lang])
        run = np.cumsum(~linked)
        place = np.flatnonzero(np.bincount(run)[run] >= 3)
        if len(place):
            yield from _rows(lang, words, place, automaton(words.ids[place], ~linked[place], depth), 3)

    return states


def _rows(lang: str, words: Words, place: np.ndarray, states: tuple[np.ndarray, ...], shortest: int) -> Iterator[pa.RecordBatch]:
    last, most, least, n = (x[states[1] >= shortest] for x in states)
    for i in range(0, len(last), BATCH_ROWS):
        cut = slice(i, i + BATCH_ROWS)
        phrase = words.phrases(place[last[cut]], most[cut])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(np.maximum(least[cut], shortest).astype(np.int32)), pa.array(most[cut].astype(np.int32)), pa.array(n[cut])], ["lang", "phrase", "least", "most", "n"]
        )


def _shards(batches: Iterator[pa.RecordBatch], states: Callable, frequent: object) -> Iterator[pa.RecordBatch]:
    """Gathers texts of a task by language and builds an automaton whenever SHARD_BYTES are held."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            data = text.encode("utf-8", "surrogatepass")
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= SHARD_BYTES:
                for name, texts in held.items():
                    yield from states(name, texts, frequent)
                held, size = {}, 0
    for name, texts in held.items():
        yield from states(name, texts, frequent)


def _split(rows: list[tuple[str, str]] | pa.Table) -> dict[str, tuple[pa.Array, pa.Array]]:
    """Frequent pairs by language, as their first and second words."""
    by: dict[str, tuple[list[bytes], list[bytes]]] = {}
    for lang, phrase in rows:
        a, b = phrase.encode("utf-8", "surrogatepass").split(b" ")
        x = by.setdefault(lang, ([], []))
        x[0].append(a)
        x[1].append(b)
    return {k: (pa.array(a, pa.binary()), pa.array(b, pa.binary())) for k, (a, b) in by.items()}


def _counted(states: DataFrame, least_count: int) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``f``: the phrases of all states, and how often they occur in all shards, the root's always, others from ``least_count`` on."""
    phrases = states.select("lang", F.explode(F.sequence("least", "most")).alias("words"), "phrase", "n")
    suffix = F.when(F.col("words") == 0, "").otherwise(F.expr("substring_index(phrase, ' ', -words)"))
    sums = phrases.select("lang", "words", suffix.alias("phrase"), "n").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    return sums.where((F.col("f") >= least_count) | (F.col("words") == 0))


def collocations(docs: DataFrame, least_count: int = 100, most_words: int = 5, per_lang: int = 2000, shared_pairs: int = SHARED_PAIRS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the phrases of each language that hold together best.

    Texts are lowered (A-Z), parted into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and tabs.  ``n``
    counts a language's words, f a phrase's occurrences inside pieces, overlapping ones too.  Phrases of 2 to
    ``most_words`` words with a = f >= ``least_count`` are candidates; the score is floor(1000 a n / (l r)) at the cut into
    two parts (f: l and r) where it is lowest, the first such cut on a tie.  A candidate inside a longer one that
    occurs as often is left out; the best ``per_lang`` by score, a and phrase (UTF-8) are returned.

    Each task builds suffix automata over shards of its texts and hands on one row a state; the phrases of
    the states are summed over the corpus.  This is done for one and two words first: a longer phrase can only be frequent
    where all its word pairs are, so the second automata run over stretches of frequent pairs and what they
    leave out occurs too seldom.  Up to ``shared_pairs`` frequent pairs go to every task; where there are more, texts
    are dealt to shards and each shard is brought its own frequent pairs.  Counts are exact.  As a phrase inside
    another occurs at least as often, one is subsumed if and only if an extension by one word has its count: the
    longer phrase's suffix link, or that of the reversed texts, does not part the two.

    A null language is ``und``; null and empty texts hold no words; repeated rows count again; an empty
    table, or one without candidates, gives an empty one; other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        run = lambda batches: _shards(batches, _pair_states, None)
        short = scratch.written(_counted(docs.mapInArrow(run, STATES), least_count))
        pairs = short.where("words = 2").select("lang", "phrase")
        counts = short
        if most_words > 2:
            long = _long_states(most_words)
            if pairs.count() <= shared_pairs:
                shared = spark.sparkContext.broadcast(_split([(r[0], r[1]) for r in pairs.collect()]))
                states = docs.mapInArrow(lambda batches: _shards(batches, long, shared.value), STATES)
            else:
                states = _dealt(docs, pairs, long, scratch)
            counts = short.unionByName(scratch.written(_counted(states, least_count)))
        return written(_scored(counts, per_lang))


def _dealt(docs: DataFrame, pairs: DataFrame, long: Callable, scratch: Scratch) -> DataFrame:
    """States of long phrases where the frequent pairs are too many to share: shards of texts meet their own frequent pairs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    dealt = scratch.written(docs.where("text <> ''").select(shard, "lang", "text"))

    def own(table: pa.Table) -> pa.Table:
        found = [(table.column("shard")[0], b) for b in _shards(iter(table.to_batches()), _pair_states, None)]
        parts = [pa.table({"shard": pa.array([s.as_py()] * b.num_rows, pa.int64()), "lang": b.column("lang"), "phrase": b.column("phrase")}).filter(pc.equal(b.column("most"), 2)) for s, b in found]
        return pa.concat_tables(parts) if parts else pa.table({"shard": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string())})

    held = dealt.groupBy("shard").applyInArrow(own, "shard long, lang string, phrase string").distinct().join(pairs, ["lang", "phrase"], "left_semi")

    def grown(texts: pa.Table, frequent: pa.Table) -> pa.Table:
        known = _split(zip(frequent.column("lang").to_pylist(), frequent.column("phrase").to_pylist(), strict=True))
        batches = list(_shards(iter(texts.to_batches()), long, known))
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("least", pa.int32()), ("most", pa.int32()), ("n", pa.int64())])
        return pa.Table.from_batches([b.cast(schema) for b in batches], schema)

    return dealt.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(grown, STATES)


def _scored(counts: DataFrame, per_lang: int) -> DataFrame:
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    held = counts.where("words > 0")
    part = lambda name, f: held.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    candidates = held.where("words > 1")
    longer = candidates.where("words > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"), "f").distinct()
    alone = candidates.join(longer, ["lang", "phrase", "f"], "left_anti")
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    met = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(total, "lang")
    met = met.withColumn("score", F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"))
    best = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
