"""Substring dedup by collinear chaining: shared k-mer seeds, chains with gap costs, aligned to fuzzy passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm._common import Scratch, written
from shoebox.llm.wordhash import blocks, hashed, mix, rolled, shingles

#: Words of a seed.  Kept are the seeds whose hash is below SAMPLED, a quarter of all whatever stands around them, and
#: the one with the least hash of every WINDOW in a row, so that any WINDOW + WORDS - 1 equal words hold a common seed.
WORDS, WINDOW, SAMPLED = 3, 8, np.uint64(1 << 62)
#: An aligned passage has at least so many words, and this share of them equal.
LEAST_WORDS, SIMILAR = 45, 0.8
#: Chains of less words are not aligned; the outermost common seeds of an edited passage may be far from its ends.
LEAST_CHAIN = 15
#: All holders of a seed are paired with each other up to this many; a seed of more documents is hot.
ALL_HOLDERS = 16
#: Words between neighbouring seeds of a key of two or three hot seeds (a chain of two such is long enough and is not
#: parted), and words from the first to the last of a wide key, whose holders are all paired, however many they are.
NEAR, FAR, WIDE = 12, 35, 40
#: Bits of the filter of keys that are looked for: 16 MB, whatever their number.
KEY_BITS = 27
#: Places of one seed at equal steps of at most so many words are a run, as in a text that repeats a word or a line.
MOST_STEP = 64
#: Cost of a word of gap inside a chain (seeds are a sample, so most words between two are equal too), and the gap at which a chain is parted.
GAP_COST, MOST_GAP = 0.05, 32
#: Words around a chain that the alignment may reach into, and the score by which it may fall before it stops.
REACH, DROP = 64, 6
#: Chains of two texts with no more words between them are aligned on one slice of each.
SAME_SLICE = 128
#: Words to each side of a long equal run that are compared for many runs at once.
ASIDE = 32
#: Bits of a run's step and of the number of its places, beside its first word.
_STEP, _PLACES = 7, 28
#: In the run of a hot seed's place: no earlier document holds the seed.
_FIRST = 1 << _STEP + _PLACES
#: The byte of every so many words is known where a text is sliced.
MARK = 32


def minimizers(s: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places in ``s`` that hold the least hash of some run of ``window`` shingles of one text (or of a shorter text)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least, place, span = s.copy(), np.arange(n), 1
    while span < window:  # sliding minima by doubling; the leftmost place of the least hash
        step = min(span, window - span)
        better = (text[step:] == text[:-step]) & (least[step:] < least[:-step])
        least[:-step] = np.where(better, least[step:], least[:-step])
        place[:-step] = np.where(better, place[step:], place[:-step])
        span += step
    full = (np.arange(n) + window <= at[1:][text]) | (np.arange(n) == at[:-1][text])
    held = np.zeros(n, bool)
    held[place[full]] = True
    return np.flatnonzero(held)


def sampled(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in ``s`` that are seeds."""
    held = s < SAMPLED
    held[minimizers(s, at)] = True
    return np.flatnonzero(held)


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a place of a seed; of places in a run, only the first.  Long runs meet by a seed of their own, too."""
    for pdf in batches:
        ids = pdf["doc"].to_numpy()
        for a, _, encoded in blocks(pdf["text"].tolist()):
            h, _, _, offsets = hashed(encoded)
            s, at = shingles(h, offsets, WORDS)
            place = sampled(s, at)
            text = np.searchsorted(at, place, side="right") - 1
            long_enough = np.diff(offsets)[text] >= LEAST_WORDS
            place, text = place[long_enough], text[long_enough]
            key = s[place] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key)
            same = np.append(False, key[order][1:] == key[order][:-1])
            again = np.zeros(len(place), bool)
            again[order] = same | np.append(same[1:], False)
            one, many = np.flatnonzero(~again), np.flatnonzero(again)
            many = many[np.lexsort((place[many], s[place[many]], text[many]))]
            m = place[many]
            run = _runs(m - at[text[many]], (s[m[1:]] == s[m[:-1]]) & (text[many][1:] == text[many][:-1]))
            first = run >> _PLACES & (1 << _PLACES) - 1 == 0
            many, run = many[first], run[first]
            step, places = run >> 2 * _PLACES, run & (1 << _PLACES) - 1
            long = np.flatnonzero((places - 1) * step + WORDS >= LEAST_WORDS)
            own = np.concatenate([one, many, many[long]])
            own_run = np.concatenate([np.ones(len(one), np.int64), step << _PLACES | places, (step << _PLACES | places)[long]])
            seed = s[place[own]]
            seed[len(seed) - len(long) :] = mix(seed[len(seed) - len(long) :] + step[long].astype(np.uint64))
            place_, text_ = place[own], text[own]
            yield pd.DataFrame({"seed": seed.view(np.int64), "doc": ids[a + text_], "run": place_ - at[text_] << _STEP + _PLACES | own_run})


def _runs(word: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of each place in ``word`` its run: step, places before it and places from it on (7, 28 and 28 bits).

    ``same`` is whether a place has the seed and text of the one before it.
    """
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    step = np.where(same & (np.diff(word) <= MOST_STEP), np.diff(word), 0)
    new = np.ones(n, bool)
    new[1:] = step == 0
    new[2:] |= (step[1:] != step[:-1]) & ~new[1:-1]  # a place where the step changes begins a run
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    own = np.append(step, 0)[first]  # the step after a run's first place
    index = np.arange(n) - np.repeat(first, count)
    return np.repeat(np.where(count > 1, own, 0), count) << 56 | index << 28 | (np.repeat(count, count) - index)


def _best(doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each document's run of rows, the row whose place begins its longest run: it stands for all where the document is the earlier one."""
    rows = np.arange(len(doc))
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    return (1 << 32) - 1 - (np.maximum.reduceat(left << 32 | (1 << 32) - 1 - rows, first) & (1 << 32) - 1)


def _linked(pdf: pd.DataFrame, known: int = 0, hot_first: bool = False) -> Iterator[pd.DataFrame]:
    """Pairs of places of seeds whose rows are all in ``pdf``, and a mark with the seed for each place of a hot one.

    ``hot_first``: the first seed is hot already, and its first ``known`` rows are earlier documents only.
    """
    seed, doc, run = (pdf[c].to_numpy() for c in ("seed", "doc", "run"))
    again = doc[1:] != doc[:-1]
    again &= seed[1:] == seed[:-1]
    if not hot_first and not again.any():
        return
    new_seed = np.append(True, seed[1:] != seed[:-1])
    of = np.cumsum(new_seed) - 1  # rows of seeds that only one document has go first, as most are
    shared = np.zeros(of[-1] + 1, bool)
    shared[of[1:][again]] = True
    shared[0] |= hot_first
    use = shared[of]
    if not use.all():
        seed, doc, run, new_seed = seed[use], doc[use], run[use], new_seed[use]
    word, step, left = run >> _STEP + _PLACES, run >> _PLACES & (1 << _STEP) - 1, run & (1 << _PLACES) - 1
    rows = np.arange(len(seed))
    new = new_seed | np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(new) - 1
    best = _best(group, left)
    first = np.flatnonzero(new_seed[np.flatnonzero(new)])
    holders = np.diff(np.append(first, len(best)))
    size = holders.copy()
    if hot_first:
        holders[0] += ALL_HOLDERS
    lo, df = np.repeat(first, size), np.repeat(holders, size)
    rank, hot = np.arange(len(best)) - lo, df > ALL_HOLDERS
    some = rows[rows >= known]
    later, earlier = [], []
    cool = some[~hot[group[some]]]
    for o in range(1, min(ALL_HOLDERS, int(rank.max(initial=0)) + 1)):
        cool = cool[rank[group[cool]] >= o]
        later.append(cool)
        earlier.append(best[group[cool] - o])
    r = some[hot[group[some]]]
    yield pd.DataFrame({"later": doc[r], "earlier": 0, "hot": True, "l_at": word[r], "e_at": seed[r], "n": run[r] & _FIRST - 1 | np.where(rank[group[r]] == 0, _FIRST, 0)})
    for least, of in ((1, lambda r: lo[group[r]]), (2, lambda r: group[r] - 1)):
        own = r[rank[group[r]] >= least]
        later.append(own)
        earlier.append(best[of(own)])
    l, e = np.concatenate(later), np.concatenate(earlier)
    # a run meets a run in pieces as long as the earlier one, the last of them up to its end; else each of its places
    both = (step[l] == step[e]) & (step[l] > 0)
    stride = np.where(both, left[e], 1)
    pieces = -(-left[l] // stride)
    many, of = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces), np.repeat(np.arange(len(l)), pieces)
    index = many * stride[of]
    l, e, both = l[of], e[of], both[of]
    rest = left[l] - index
    n = WORDS + np.where(both, (np.minimum(rest, left[e]) - 1) * step[l], 0)
    l_at = word[l] + index * step[l]
    if len(l):
        yield pd.DataFrame({"later": doc[l], "earlier": doc[e], "hot": False, "l_at": l_at, "e_at": word[e], "n": n})
        short = np.flatnonzero(both & (rest < left[e]) & (index > 0))  # the last piece, up to the run's end
        if len(short):
            l, e = l[short], e[short]
            yield pd.DataFrame({"later": doc[l], "earlier": doc[e], "hot": False, "l_at": word[l] + (left[l] - left[e]) * step[l], "e_at": word[e], "n": WORDS + (left[e] - 1) * step[l]})


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by seed, document and place.

    Of a hot seed only its first and its last document's places are held, whatever the number of its rows.
    """
    held, known, hot = None, 0, False
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf["seed"].to_numpy() == pdf["seed"].iloc[-1]
        if not last.all():
            yield from _linked(pdf[~last], known, hot)
            known, hot, pdf = 0, False, pdf[last].reset_index(drop=True)
        doc = pdf["doc"].to_numpy()
        hot = hot or np.count_nonzero(doc[1:] != doc[:-1]) > ALL_HOLDERS
        done = np.flatnonzero(doc != doc[-1])
        if hot and len(done) > known:
            part = pdf.iloc[: done[-1] + 1]
            yield from _linked(part, known, True)
            best = _best(doc[: len(part)], part["run"].to_numpy() & (1 << _PLACES) - 1)
            keep = np.unique(best[[0, -1]])
            pdf, known = pdf.iloc[np.append(keep, np.arange(len(part), len(pdf)))], len(keep)
        held = pdf
    if held is not None:
        yield from _linked(held, known, hot)


def _outside(first: np.ndarray, last: np.ndarray, spans: tuple[np.ndarray, np.ndarray], together: bool) -> np.ndarray:
    """Which of the word ranges from ``first`` to ``last`` (inclusive) lie in none of the ``spans`` (first, end), or in all ``together``."""
    begin, end = spans
    if not len(begin):
        return np.ones(len(first), bool)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    if together:
        new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
        begin, end = begin[new], end[np.append(new[1:], len(end)) - 1]
    k = np.searchsorted(begin, first, side="right") - 1
    return (k < 0) | (end[k] <= last)


def _extent(run: np.ndarray) -> np.ndarray:
    """Words from the first to the last place of a run."""
    return (run >> _PLACES) * ((run & (1 << _PLACES) - 1) - 1)


def _may_repeat(begin: np.ndarray, end: np.ndarray) -> bool:
    """Whether hot seeds at these places (of runs, the first and the last) can be those of an equal run of LEAST_WORDS
    words that rare seeds do not pair.

    Any WINDOW shingles of the run hold a seed of all its holders; those that are not hot lie within LEAST_CHAIN words.
    """
    if not len(begin):
        return False
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    part = np.flatnonzero(np.append(True, begin[1:] - end[:-1] > WINDOW))
    begin, end = begin[part], end[np.append(part[1:], len(end)) - 1]
    most = 2 * WINDOW + LEAST_CHAIN - WORDS
    return bool((end - begin >= 2 * WINDOW - 1).any() or ((begin[1:] - end[:-1] <= most) & (end[1:] - begin[:-1] >= most)).any())


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """The values of lists, and the row of each (times 2^32)."""
    col = batch.column(name)
    return pc.list_parent_indices(col).to_numpy(zero_copy_only=False).astype(np.int64) << 32, pc.list_flatten(col)


def _hot(batch: pa.RecordBatch, spans: str, together: bool, around: int = 0) -> tuple[np.ndarray, ...]:
    """Of the hot seeds of a batch of documents: row and first word in one number, the place in the batch, run, whether they, with the words ``around``, lie outside ``spans``, and whether no earlier document holds the seed."""
    row, word = _flat(batch, "words")
    run = _flat(batch, "runs")[1].to_numpy(zero_copy_only=False)
    word = row + word.to_numpy(zero_copy_only=False)
    order = np.argsort(word, kind="stable")
    word, first, run = word[order], run[order] >= _FIRST, run[order] & _FIRST - 1
    return word, order, run, _outside(word - np.minimum(word & (1 << 32) - 1, around), word + _extent(run) + WORDS - 1 + around, _spans(batch, spans), together), first


def _spans(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    row, span = _flat(batch, name)
    return row + span.field("at").to_numpy(zero_copy_only=False), row + span.field("end").to_numpy(zero_copy_only=False)


def _repeatable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents whose hot seeds outside equal passages may be those of an equal run."""
    for batch in batches:
        word, _, run, out, _ = _hot(batch, "equal", False, LEAST_WORDS - 1)  # a run across the end of an equal passage is not inside
        word, run = word[out], run[out]
        at = np.searchsorted(word, np.arange(batch.num_rows + 1) << 32)
        end = word + _extent(run)
        keep = [_may_repeat(word[a:b], end[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _long_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the runs of LEAST_WORDS words that the seeds of few documents do not pair, with their places.

    A run inside an equal passage stands in an earlier document, which gives it, too.  Where words repeat at equal
    steps, one step is enough: longer stretches meet by a seed of their own.
    """
    for batch in batches:
        ids, equal = batch.column("doc").to_numpy(), _spans(batch, "equal")
        hot_row, hot = _flat(batch, "words")
        hot_row, hot = hot_row >> 32, hot.to_numpy(zero_copy_only=False)
        step = (_flat(batch, "runs")[1].to_numpy(zero_copy_only=False) & _FIRST - 1) >> _PLACES
        for a, b, encoded in blocks(batch.column("text").to_pylist()):
            h, _, _, offsets = hashed(encoded)
            s, at = shingles(h, offsets, WORDS)
            place = np.flatnonzero(s < SAMPLED)  # seeds of a run whatever stands around it
            own = (hot_row >= a) & (hot_row < b)
            hot_text, hot_at = hot_row[own] - a, at[hot_row[own] - a] + hot[own]
            of_text = lambda at_, text: s[at_] + text.astype(np.uint64) * _KEY  # noqa: B023, E731
            place = place[~np.isin(of_text(place, np.searchsorted(at, place, side="right") - 1), of_text(hot_at, hot_text))]
            count = np.maximum(np.diff(offsets) - LEAST_WORDS + 1, 0)
            text = np.repeat(np.arange(len(count)), count)
            run = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            i = np.searchsorted(place, at[text] + run)
            j = np.searchsorted(place, at[text] + run + LEAST_WORDS - WORDS, side="right") - 1
            paired = j > i
            paired[paired] = place[j[paired]] - place[i[paired]] + WORDS >= LEAST_CHAIN
            text, run = text[~paired], run[~paired]
            first = (a + text << 32) + run
            out = _outside(first, first + LEAST_WORDS - 1, equal, False)
            text, run = text[out], run[out]
            key = rolled(h, offsets[text] + run, LEAST_WORDS)
            keep = np.ones(len(run), bool)
            stepped = own & (step > 0)
            for t in np.unique(hot_row[stepped]) - a:
                lo, hi = np.searchsorted(text, [t, t + 1])
                if hi > lo:
                    for n in np.unique(step[stepped & (hot_row == a + t)]):
                        back = np.flatnonzero(run[lo:hi] >= run[lo] + n)
                        keep[lo + back] &= rolled(h, offsets[t] + run[lo + back] - n, LEAST_WORDS) != key[lo + back]
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(ids[a + text[keep]]), pa.array(run[keep])], ["seed", "doc", "at"])


def _sequences(word: np.ndarray, seed: np.ndarray, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of so many places (indices) in order, neighbours NEAR to FAR words apart, and the key of each row; ``word`` is sorted."""
    rows, key = np.arange(len(word))[:, None], mix(seed)
    for _ in range(seeds - 1):
        lo, hi = (np.searchsorted(word, word[rows[:, -1]] + d) for d in (NEAR, FAR + 1))
        count = hi - lo
        of = np.repeat(np.arange(len(rows)), count)
        nxt = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + lo[of]
        rows, key = np.column_stack([rows[of], nxt]), mix(key[of] * _KEY + seed[nxt])
    return rows, key


def _keyed_places(seeds: int, asked_only: bool, within=None, asked_for=None, wide: bool = False):
    """Keys of so many hot seeds.  Asked for are those with a place outside all passages of their document, if earlier
    documents hold each of the seeds.

    ``within``: filter of the keys of two seeds that are hot; ``asked_for``: filter of the keys that are asked for;
    ``wide``: wide keys only.
    Places inside one equal passage are left to the earlier document, which holds them, too.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                word, order, _, outside, first_holder = _hot(batch, "spans", True)
                seed = _flat(batch, "seeds")[1].to_numpy(zero_copy_only=False)[order].view(np.uint64)
                rows, key = _sequences(word, seed, seeds)
                asked = outside[rows].any(axis=1) & ~first_holder[rows].any(axis=1)
                keep = asked if asked_only else asked | _outside(word[rows[:, 0]], word[rows[:, -1]] + WORDS - 1, _spans(batch, "equal"), False)
                if wide:
                    keep = keep & (word[rows[:, -1]] - word[rows[:, 0]] >= WIDE)
                if asked_for is not None:
                    keep = keep & _has(asked_for.value, key)
                if within is not None:
                    for k in range(seeds - 1):  # all neighbours are a hot key
                        keep = keep & _has(within.value, mix(mix(seed[rows[:, k]]) * _KEY + seed[rows[:, k + 1]]))
                keep = np.flatnonzero(keep)
                doc = word[rows[keep, 0]] >> 32
                order = np.lexsort((~asked[keep], key[keep], doc))  # one row a document and key, one that is asked for if there is
                keep, doc = keep[order], doc[order]
                keep = keep[np.append(True, (doc[1:] != doc[:-1]) | (key[keep[1:]] != key[keep[:-1]]))] if len(keep) else keep
                rows, key, asked = rows[keep], key[keep], asked[keep]
                at, doc = word[rows] & (1 << 32) - 1, batch.column("_doc").to_numpy()[word[rows[:, 0]] >> 32]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(asked), *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(seeds))], ["key", "doc", "asked", *(f"at{k}" for k in range(seeds))])

    return keys


_KEY = np.uint64(0x9E3779B97F4A7C15)


def _has(held: np.ndarray, key: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    at = key >> np.uint64(64 - bits)
    return held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 != 0


def _filter(keys: DataFrame, bits: int = KEY_BITS):
    """A broadcast bitmap of the column ``key``, of fixed size."""
    slot = F.shiftrightunsigned("key", 64 - bits)
    held = np.zeros((1 << bits) // 8, np.uint8)
    parts = keys.select(F.shiftright(slot, 16).cast("int").alias("part"), slot.bitwiseAND(F.lit((1 << 16) - 1)).cast("int").alias("bit")).groupBy("part").agg(F.collect_set("bit").alias("bits"))
    for r in parts.toLocalIterator():
        at = (r["part"] << 16) + np.array(r["bits"], np.int64)
        np.bitwise_or.at(held, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    return keys.sparkSession.sparkContext.broadcast(held)


def _key_pairs(seeds: int):
    """Pairs of places of documents that hold a key, one row a seed; rows come sorted by key and document, one a document and key.

    Asked-for holders meet all before them up to ALL_HOLDERS; of more, the first and the one before, and the key is
    given as a mark (``hot``, in ``e_at``).
    """
    at = [f"at{k}" for k in range(seeds)]

    def met(pdf: pd.DataFrame, known: int, hot_first: bool) -> pd.DataFrame:
        key, doc, asked = (pdf[c].to_numpy() for c in ("key", "doc", "asked"))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        rank, lo = np.arange(len(key)) - np.repeat(first, size), np.repeat(first, size)
        hot = np.repeat(size > ALL_HOLDERS, size)
        hot[: size[0]] |= hot_first
        some = np.flatnonzero(asked & (rank > 0) & (np.arange(len(key)) >= known))
        later, earlier, cool = [], [], some[~hot[some]]
        for o in range(1, ALL_HOLDERS):
            cool = cool[rank[cool] >= o]
            if not len(cool):
                break
            later.append(cool)
            earlier.append(cool - o)
        of_hot = some[hot[some]]
        second = of_hot[rank[of_hot] > 1]
        l, e = np.concatenate([*later, of_hot, second]), np.concatenate([*earlier, lo[of_hot], second - 1])
        mark = np.unique(key[of_hot])
        none, zero = np.zeros(len(mark), np.int64), np.zeros(len(l) * seeds, bool)
        place = lambda of: np.concatenate([pdf[c].to_numpy()[of] for c in at])
        return pd.DataFrame({"later": np.append(np.tile(doc[l], seeds), none), "earlier": np.append(np.tile(doc[e], seeds), none), "hot": np.append(zero, none == 0), "l_at": np.append(place(l), none), "e_at": np.append(place(e), mark), "n": WORDS})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known, hot = None, 0, False
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["key"].to_numpy() == pdf["key"].iloc[-1]
            if not last.all():
                yield met(pdf[~last], known, hot)
                known, hot, pdf = 0, False, pdf[last]
            if hot or len(pdf) > ALL_HOLDERS:  # the first and the last holder are held, whatever their number
                yield met(pdf, known, hot)
                hot, pdf, known = True, pdf.iloc[[0, -1]], 2
            held = pdf
        if held is not None and len(held):
            yield met(held, known, hot)

    return pairs


def _met(keys: DataFrame, seeds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of places of documents that hold a key, one row a seed, and the keys of more than ALL_HOLDERS documents."""
    both = scratch.written(keys.repartition("key").sortWithinPartitions("key", "doc").mapInPandas(_key_pairs(seeds), PAIR))
    return both.where("not hot"), both.where("hot").select(F.col("e_at").alias("key")).distinct()


def _all_met(asked: DataFrame, keys: DataFrame, seeds: int) -> DataFrame:
    """Pairs of places of documents of ``asked`` and all earlier ones of ``keys`` that hold a key, one row a seed."""
    at = F.array(*[f"at{k}" for k in range(seeds)]).alias("at")
    other = keys.select(F.col("key").alias("_key"), F.struct("doc", at).alias("earlier"))
    both = asked.select("key", F.struct("doc", at).alias("later")).join(other, (F.col("key") == F.col("_key")) & (F.col("earlier.doc") < F.col("later.doc")))
    places = F.inline(F.arrays_zip(F.col("later.at").alias("l_at"), F.col("earlier.at").alias("e_at")))
    return both.select(F.col("later.doc").alias("later"), F.col("earlier.doc").alias("earlier"), F.lit(False).alias("hot"), places, F.lit(WORDS).cast("long").alias("n"))


class Fenwick:
    """Prefix maxima: the best (score, item) put at a place up to a given one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (0.0, -1)
        i += 1
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chain(l: np.ndarray, e: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Best chains of matches (``l``, ``e``: first words in the later and the earlier text, ``n``: words), disjoint.

    A chain goes forward in both texts.  Its score is its words less GAP_COST for each word between matches;
    the best predecessor of a match is a prefix maximum over the ends of earlier matches, kept in a Fenwick
    tree.  A chain is parted at a gap above MOST_GAP.
    """
    m = len(l)
    if m == 1:
        return [[0]]
    ends = np.unique(e + n)
    slot_end, slot_begin = np.searchsorted(ends, e + n).tolist(), (np.searchsorted(ends, e, side="right") - 1).tolist()
    l_, e_, n_ = l.tolist(), e.tolist(), n.tolist()
    tree, score, before = Fenwick(len(ends)), [0.0] * m, [-1] * m
    starts, stops = sorted(range(m), key=lambda i: (l_[i], e_[i])), sorted(range(m), key=lambda i: (l_[i] + n_[i], i))
    done = 0
    for i in starts:
        while done < m and l_[stops[done]] + n_[stops[done]] <= l_[i]:
            j = stops[done]
            tree.put(slot_end[j], (score[j] + GAP_COST * (l_[j] + n_[j] + e_[j] + n_[j]), j))
            done += 1
        value, j = tree.upto(slot_begin[i]) if slot_begin[i] >= 0 else (0.0, -1)
        gain = value - GAP_COST * (l_[i] + e_[i])
        score[i] = n_[i] + max(gain, 0.0)
        before[i] = j if j >= 0 and gain > 0 else -1
    free, out = [True] * m, []
    for i in sorted(range(m), key=lambda i: (-score[i], i)):
        if not free[i]:
            continue
        own = []
        while i >= 0 and free[i]:
            free[i] = False
            if own and (l_[own[-1]] - l_[i] - n_[i] > MOST_GAP or e_[own[-1]] - e_[i] - n_[i] > MOST_GAP):
                out.append(own[::-1])
                own = []
            own.append(i)
            i = before[i]
        out.append(own[::-1])
    return out


def _all_chains(pair: np.ndarray, l: np.ndarray, e: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of pairs of texts, as words of the later and the earlier text and words of each match; matches come sorted by pair."""
    order = np.lexsort((l, l - e, pair))
    pair, l, e, n = pair[order], l[order], e[order], n[order]
    new = np.ones(len(l), bool)  # matches that meet or follow each other on one diagonal are one match
    new[1:] = (l[1:] - e[1:] != l[:-1] - e[:-1]) | (pair[1:] != pair[:-1])
    far = (np.cumsum(new) - 1) * (1 << 33)
    stop = np.maximum.accumulate(far + l + n)
    new[1:] |= (far + l)[1:] > stop[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(l)) - 1
    pair, l, e, n = pair[first], l[first], e[first], stop[last] - far[last] - l[first]
    order = np.lexsort((e, l, pair))
    pair, l, e, n = pair[order], l[order], e[order], n[order]
    high = np.maximum.accumulate((pair << 33) + l + n)
    part = np.flatnonzero(np.append(True, ((pair << 33) + l)[1:] > high[:-1] + MOST_GAP))  # a chain is parted here
    count = np.diff(np.append(part, len(l)))
    for i in part[(count == 1) & (n[part] >= LEAST_CHAIN)]:
        yield pair[i], l[i : i + 1], e[i : i + 1], n[i : i + 1]
    a = part[count == 2]
    b = a + 1
    l_gap, e_gap = l[b] - l[a] - n[a], e[b] - e[a] - n[a]
    both = (np.minimum(l_gap, e_gap) >= 0) & (np.maximum(l_gap, e_gap) <= MOST_GAP) & (n[a] > GAP_COST * (l_gap + e_gap))
    for i in a[both & (l[b] + n[b] - l[a] >= LEAST_CHAIN)]:
        yield pair[i], l[i : i + 2], e[i : i + 2], n[i : i + 2]
    for i in np.concatenate([a[~both], b[~both]]):
        if n[i] >= LEAST_CHAIN:
            yield pair[i], l[i : i + 1], e[i : i + 1], n[i : i + 1]
    more = (count > 2) & (high[part + count - 1] - (pair[part] << 33) - l[part] >= LEAST_CHAIN)
    for i, m in zip(part[more], count[more], strict=True):
        for own in chain(l[i : i + m], e[i : i + m], n[i : i + m]):
            own = i + np.array(own)
            if l[own[-1]] + n[own[-1]] - l[own[0]] >= LEAST_CHAIN and n[own].sum() > WORDS:
                yield pair[i], l[own], e[own], n[own]


def _slices(chains: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Chains of one pair of texts put together where they lie near each other in both, with the number of matches of each."""
    if len(chains) == 1:
        yield *chains[0], [len(chains[0][0])]
        return
    held, l_end, e_low, e_high = [], 0, 0, 0
    joined = lambda: (*(np.concatenate(x) for x in zip(*held, strict=True)), [len(c[0]) for c in held])
    for c in sorted(chains, key=lambda c: (c[0][0], c[1][0])):
        l, e, n = c
        stop = (l[-1] + n[-1], e[-1] + n[-1])
        if held and (l[0] > l_end + SAME_SLICE or e[0] > e_high + SAME_SLICE or stop[1] < e_low - SAME_SLICE):
            yield joined()
            held = []
        l_end, e_low, e_high = (max(l_end, stop[0]), min(e_low, e[0]), max(e_high, stop[1])) if held else (stop[0], e[0], stop[1])
        held.append(c)
    if held:
        yield joined()


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by pair; the last pair of a batch may go on in the next."""
    rest = None

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        later, earlier, hot, l_at, e_at, words = (pdf[c].to_numpy() for c in ("later", "earlier", "hot", "l_at", "e_at", "n"))
        edge = np.flatnonzero(np.concatenate([[True], (later[1:] != later[:-1]) | (earlier[1:] != earlier[:-1]) | (hot[1:] != hot[:-1])]))
        stop = np.append(edge[1:], len(later))
        low, high = np.minimum.reduceat(l_at, edge), np.maximum.reduceat(l_at + words, edge)
        some = ((stop - edge > 1) | (np.maximum.reduceat(words, edge) > WORDS)) & (high - low >= LEAST_CHAIN)
        rows = []
        for a, b in zip(edge[hot[edge]], stop[hot[edge]], strict=True):
            rows.append((later[a], 0, True, 0, 0, 0, 0, l_at[a:b], e_at[a:b], words[a:b], []))
        some &= ~hot[edge]
        use = np.repeat(some, stop - edge)
        by_pair: dict[int, list] = {}
        if use.any():
            pair = np.repeat(edge, stop - edge)[use]
            for p, *c in _all_chains(pair, l_at[use], e_at[use], words[use]):
                by_pair.setdefault(p, []).append(c)
        for p, chains in by_pair.items():
            for l, e, n, parts in _slices(chains):
                rows.append((later[p], earlier[p], False, l.min(), (l + n).max(), e.min(), (e + n).max(), l, e, n, parts))
        return pd.DataFrame(rows, columns=["later", "earlier", "hot", "l_first", "l_last", "e_first", "e_last", "l", "e", "n", "parts"])

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        tail = (pdf["later"] == pdf["later"].iloc[-1]) & (pdf["earlier"] == pdf["earlier"].iloc[-1]) & (pdf["hot"] == pdf["hot"].iloc[-1])
        rest, pdf = pdf[tail], pdf[~tail]
        if len(pdf):
            yield found(pdf)
    if rest is not None and len(rest):
        yield found(rest)


def _gap(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Equal words of two short runs in order (a longest common subsequence)."""
    if not a or not b:
        return []
    if len(a) == len(b) and len(a) <= 2:
        return [(i, i) for i in range(len(a)) if a[i] == b[i]]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int], matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages (first and end word in a, in b, similarity) of two word sequences along a chain of equal runs.

    Runs grow to both sides while words are equal; the gaps between them are aligned; the ends go on past
    unequal words in reach of DROP.  Of the aligned words, runs of highest score are kept in which an equal word
    counts 1 and a word without partner loses enough that no run of less than SIMILAR equal words has a
    positive score.  Similarity is equal words to the longer side's words.
    """
    pairs: list[tuple[int, int]] = []
    for i, j, n in matches:
        if pairs and (i <= pairs[-1][0] or j <= pairs[-1][1]):
            skip = max(pairs[-1][0] + 1 - i, pairs[-1][1] + 1 - j)
            i, j, n = i + skip, j + skip, n - skip
        if pairs and n > 0:
            x, y = pairs[-1][0] + 1, pairs[-1][1] + 1
            while x < i and y < j and a[x] == b[y]:
                pairs.append((x, y))
                x, y = x + 1, y + 1
            back = []
            while i - 1 >= x and j - 1 >= y and a[i - 1] == b[j - 1]:
                i, j, n = i - 1, j - 1, n + 1
                back.append(1)
            pairs += [(x + u, y + v) for u, v in _gap(a[x:i], b[y:j])]
        pairs += [(i + t, j + t) for t in range(n) if a[i + t] == b[j + t]]
    if not pairs:
        return []
    for step in (-1, 1):  # on past both ends; what does not pay is cut off below
        x, y = pairs[0] if step < 0 else pairs[-1]
        more: list[tuple[int, int]] = []
        score = best = 0
        while True:
            x, y = x + step, y + step
            if not (0 <= x < len(a) and 0 <= y < len(b)):
                break
            if a[x] == b[y]:
                score += 1
                more.append((x, y))
                best = max(best, score)
            else:
                score -= 1
                if score < best - DROP:
                    break
        pairs = more[::-1] + pairs if step < 0 else pairs + more
    lose = round(SIMILAR / (1 - SIMILAR), 9)
    out, score, best, start, stop = [], 0.0, 0.0, 0, -1

    def keep() -> None:
        if stop >= start:
            (i, j), (x, y) = pairs[start], pairs[stop]
            words = max(x - i, y - j) + 1
            similar = (stop - start + 1) / words
            if words >= LEAST_WORDS and similar >= SIMILAR:
                out.append((i, x + 1, j, y + 1, similar))

    for t, (i, j) in enumerate(pairs):
        if t:
            score -= lose * (max(i - pairs[t - 1][0], j - pairs[t - 1][1]) - 1)
        if score < 0 or best - score > lose * MOST_GAP:
            keep()
            score, best, start, stop = 0.0, 0.0, t, t - 1
        score += 1
        if score > best:
            best, stop = score, t
    keep()
    if not out and len(pairs) >= SIMILAR * LEAST_WORDS:  # the run of highest score may be a part, too short, of one similar enough
        i, j = np.array(pairs).T
        level = np.cumsum(np.append(0, 1 - lose * (np.maximum(np.diff(i), np.diff(j)) - 1)))
        after = np.maximum.accumulate(level[::-1])[::-1]  # falls, so the last place not below a level is found by bisection
        last = len(level) - np.searchsorted(after[::-1], level - 1 - 1e-6) - 1
        # the last place whose own level is high enough is where the maximum after it first drops below
        start = int(np.argmax(i[last] - i))
        stop = int(last[start])
        keep()
    return out


def _equal_runs(h: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, e_lo: np.ndarray, e_hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages around single matches of ``n`` words, from words ``x`` and ``y`` of texts from ``lo`` to ``hi`` and ``e_lo`` to ``e_hi``: words gained to the left
    and to the right, equal words, and which of them this tells like ``align`` (the match is equal and long enough, and the ends are in reach)."""
    of = np.repeat(np.arange(len(n)), n)
    t = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    good = n >= LEAST_WORDS
    good[of[h[x[of] + t] != h[y[of] + t]]] = False
    gained, equal = [], n.copy()
    for step, i, j, room in ((-1, x - 1, y - 1, np.minimum(x - lo, y - e_lo)), (1, x + n, y + n, np.minimum(hi - x - n, e_hi - y - n))):
        k = np.arange(ASIDE)
        there = k < room[:, None]
        a, b = (np.clip(v[:, None] + step * k, 0, len(h) - 1) for v in (i, j))
        same = there & (h[a] == h[b])
        score = np.cumsum(np.where(same, 1, -1), axis=1)
        ended = ~there | (score < np.maximum(np.maximum.accumulate(score, axis=1), 0) - DROP)
        live = np.cumsum(ended, axis=1) == 0
        good &= ended.any(axis=1) | (room <= ASIDE)
        value = np.cumsum(np.where(same, 1, -round(SIMILAR / (1 - SIMILAR), 9)), axis=1)
        value = np.where(live & same, value, -1.0)
        most = value.max(axis=1)
        at = np.argmax(value, axis=1) if step > 0 else ASIDE - 1 - np.argmax(value[:, ::-1], axis=1)
        more = np.where(most > 0 if step > 0 else most >= 0, at + 1, 0)
        gained.append(more)
        equal += np.where(k < more[:, None], same, False).sum(axis=1)
    return *gained, equal, good


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "other_id", "start_byte", "end_byte", "other_start", "other_end", "n_words", "similarity", "at"]
    for batch in batches:
        out = [[np.zeros(0, np.float64 if k == 7 else np.int64)] for k in range(9)]
        # whole texts stay bytes here, so the places of words are those of the text
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            col = lambda c: part.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            rows = part.num_rows
            h, starts, ends, offsets = hashed(part.column("l_slice").to_pylist() + part.column("e_slice").to_pylist())
            l, e, n, parts = (flat(c) for c in ("l", "e", "n", "parts"))
            chains = np.diff(part.column("parts").offsets.to_numpy())
            row = np.repeat(np.arange(rows), chains)  # of each chain
            begin = np.cumsum(parts) - parts
            of = row[np.repeat(np.arange(len(parts)), parts)]  # of each match
            word0 = [np.maximum(col(c) - REACH, 0) // MARK * MARK for c in ("l_first", "e_first")]
            lo, hi, e_lo, e_hi = offsets[:rows], offsets[1 : rows + 1], offsets[rows : 2 * rows], offsets[rows + 1 :]
            x, y = lo[of] + l - word0[0][of], e_lo[of] + e - word0[1][of]
            n = np.minimum(n, np.minimum(hi[of] - x, e_hi[of] - y))
            one = begin[(parts == 1) & (n[begin] > 0)]
            o = of[one]
            left, right, equal, good = _equal_runs(h, x[one], y[one], n[one], lo[o], hi[o], e_lo[o], e_hi[o])
            slow = np.ones(len(parts), bool)
            slow[np.searchsorted(begin, one[good])] = False
            a, b = (x[one] - left)[good], (y[one] - left)[good]
            words = (left + n[one] + right)[good]
            found = []
            res = [np.column_stack([o[good], a, a + words, b, b + words])]
            similar = [equal[good] / np.maximum(words, 1)]
            for c in np.flatnonzero(slow):
                r, own = row[c], slice(begin[c], begin[c] + parts[c])
                p, q = max(lo[r], x[own].min() - REACH - MARK), min(hi[r], (x[own] + n[own]).max() + REACH + MARK)
                u, v = max(e_lo[r], y[own].min() - REACH - MARK), min(e_hi[r], (y[own] + n[own]).max() + REACH + MARK)
                matches = [m for m in zip((x[own] - p).tolist(), (y[own] - u).tolist(), n[own].tolist(), strict=True) if m[2] > 0]
                found += [(r, p + i, p + j, u + z, u + w, s) for i, j, z, w, s in align(h[p:q].tolist(), h[u:v].tolist(), matches)]
            res.append(np.array([f[:5] for f in found], np.int64).reshape(-1, 5))
            similar.append(np.array([f[5] for f in found], np.float64))
            r, i, j, z, w = np.concatenate(res).T
            l_from, e_from = col("l_from"), col("e_from")
            values = [col("later")[r], col("earlier")[r], starts[i] + l_from[r], ends[j - 1] + l_from[r], starts[z] + e_from[r], ends[w - 1] + e_from[r], j - i, np.concatenate(similar), word0[0][r] + i - lo[r]]
            for k, value in enumerate(values):
                out[k].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names)


def _marked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds the first byte of every MARK-th word."""
    marks: list[np.ndarray] = []
    for _, _, encoded in blocks(batch.column("text").to_pylist()):
        _, starts, _, offsets = hashed(encoded)
        marks += [starts[offsets[t] : offsets[t + 1] : MARK] for t in range(len(encoded))]
    ends = np.concatenate([[0], np.cumsum([len(m) for m in marks])])
    flat = np.concatenate([np.zeros(0, np.int64), *marks])
    return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["doc", "text", "marks"])


def _asked_texts(texts: DataFrame, docs: DataFrame, marked: bool = False) -> DataFrame:
    """``texts`` of the column ``_doc`` of ``docs``, and perhaps a few more; ``marked``: with the first byte of every MARK-th word."""
    bits = min(KEY_BITS, max(20, (16 * docs.count()).bit_length()))
    wanted = _filter(docs.select(F.xxhash64("_doc").alias("key")), bits)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _has(wanted.value, batch.column("key").to_numpy().view(np.uint64), bits)
            batch = batch.select(["doc", "text"]).filter(pa.array(keep))
            yield _marked(batch) if marked else batch

    return texts.select("doc", "text", F.xxhash64("doc").alias("key")).mapInArrow(some, "doc long, text string" + ", marks array<long>" * marked)


PASSAGE = "doc_id long, other_id long, start_byte long, end_byte long, other_start long, other_end long, n_words long, similarity double, at long"


PAIR = "later long, earlier long, hot boolean, l_at long, e_at long, n long"


def _chained(pairs: DataFrame) -> DataFrame:
    sorted_ = pairs.repartition("later", "earlier").sortWithinPartitions("later", "earlier", "hot")
    return sorted_.mapInPandas(_chains, "later long, earlier long, hot boolean, l_first long, l_last long, e_first long, e_last long, l array<long>, e array<long>, n array<long>, parts array<int>")


def _passages_of(chains: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Passages that ``chains`` are aligned to; ``at`` is their first word."""
    chains = scratch.written(chains.withColumn("pair", F.monotonically_increasing_id()))
    side = lambda doc, x: F.struct(F.col(doc).alias("_doc"), "pair", F.lit(x == "l").alias("is_later"), F.col(f"{x}_first").alias("first"), F.col(f"{x}_last").alias("last"))
    needs = chains.select(F.inline(F.array(side("later", "l"), side("earlier", "e"))))
    sliced = _asked_texts(texts, needs, True).join(needs, F.col("doc") == F.col("_doc"))
    begin = F.coalesce(F.get("marks", F.floor(F.greatest(F.col("first") - REACH, F.lit(0)) / MARK).cast("int")), F.lit(0))
    end = F.coalesce(F.get("marks", F.ceil((F.col("last") + REACH) / MARK).cast("int")), F.octet_length("text"))
    sliced = sliced.select("pair", "is_later", begin.alias("from"), F.substring(F.col("text").cast("binary"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("slice"))
    of = lambda c, is_later: F.max(F.when(F.col("is_later") == is_later, F.col(c)))
    both = sliced.groupBy("pair").agg(of("slice", True).alias("l_slice"), of("slice", False).alias("e_slice"), of("from", True).alias("l_from"), of("from", False).alias("e_from"))
    return scratch.written(chains.drop("hot").join(both, "pair").mapInArrow(_aligned, PASSAGE).distinct())


def _hot_places(marks: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the places of their hot seeds, the words of their passages, and of those that are equal."""
    span = F.struct("at", (F.col("at") + F.col("n_words")).alias("end"))
    spans = found.groupBy("doc_id").agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("similarity") == 1, span)).alias("equal"))
    return marks.join(spans, F.col("_doc") == F.col("doc_id"), "left").drop("doc_id")


def _keyed(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``doc``, ``doc_id``, ``text``; ``doc`` tells rows apart and is in the order of ids, and whether it is another number than the id."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    if d.groupBy("doc_id").count().where("count > 1").isEmpty():
        return d.select(F.col("doc_id").alias("doc"), "doc_id", "text"), False
    return scratch.written(d.sort("doc_id", F.xxhash64("text")).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text")), True


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least LEAST_WORDS words that a document shares, in at least SIMILAR of its words, with an earlier one.

    One row a passage: ``doc_id``, ``other_id`` (smaller), ``start_byte``, ``end_byte``, ``other_start``,
    ``other_end`` (UTF-8 bytes of the two texts), ``n_words``, ``similarity``.

    Seeds are a sample of the runs of WORDS words of whole texts (A-Z lowered, parted at all but letters and digits).
    Every place of a seed in the later text meets the seed's first place in the earlier one, or where that repeats it
    at equal steps, its longest run.  The documents of a seed are all paired with each other up to ALL_HOLDERS.
    Pairs are chained, and chains aligned on the words around them (REACH words to each side), which alone leave the
    text table.  Exact copies are passages as long as the text.

    A hot seed, which more documents hold, pairs a place with the first document and the one before only.  Its places
    that no passage covers then meet by longer keys: by two hot seeds, and where those are hot, too (and pair in the same
    way), by three.  Places that are not covered then and lie in keys of three of at least WIDE words are paired with all
    earlier holders of the key, however many.  Runs of LEAST_WORDS equal words that rare seeds do not pair are paired by
    their hash with the first document that holds them.

    WINDOW + WORDS - 1 equal words always hold a common seed, so two such runs within MOST_GAP words are always
    compared; where edits are denser, it is a matter of chance.  So it is with hot passages whose common seeds make no
    wide key, and with places that share one seed of few documents beside hot ones.

    Null and short texts have no passages; null ids are left out, as a row could not name them; rows that repeat
    an id are texts of their own and are not paired with each other; an empty table gives an empty result; other
    columns are not read.
    """
    with Scratch(docs.sparkSession) as scratch:
        d, renamed = _keyed(docs, id_col, text_col, scratch)
        texts = d.select("doc", "text")
        seeds = texts.mapInPandas(_seeds, "seed long, doc long, run long")
        pairs = seeds.repartition("seed").sortWithinPartitions("seed", "doc", "run").mapInPandas(_links, PAIR)
        chains = scratch.written(_chained(pairs))
        found = _passages_of(chains.where("not hot"), texts, scratch)
        marks = chains.where("hot").select(F.col("later").alias("_doc"), F.col("l").alias("words"), F.col("e").alias("seeds"), F.col("n").alias("runs"))
        hot = scratch.written(_hot_places(marks, found))
        repeatable = hot.select("_doc", "words", "runs", "equal").mapInArrow(_repeatable, "_doc long, words array<long>, runs array<long>, equal array<struct<at: long, end: long>>")
        repeatable = scratch.written(repeatable)
        runs = _asked_texts(texts, repeatable).join(repeatable, F.col("doc") == F.col("_doc")).select("doc", "text", "words", "runs", "equal").mapInArrow(_long_runs, "seed long, doc long, at long")
        runs = scratch.written(runs)
        ends = runs.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min_by("at", "doc").alias("lo_at")).where("lo < hi")
        more = runs.join(ends, "seed").where("doc <> lo")
        more = more.select(F.col("doc").alias("later"), F.col("lo").alias("earlier"), F.lit(False).alias("hot"), F.col("at").alias("l_at"), F.col("lo_at").alias("e_at"), F.lit(LEAST_WORDS).cast("long").alias("n"))
        # keys of two hot seeds, of three, and those wide ones of three whose holders are all paired
        within = crowded = keys = None
        for number, every in ((2, False), (3, False), (3, True)):
            places = "key long, doc long, asked boolean, " + ", ".join(f"at{k} long" for k in range(number))
            asked = scratch.written(hot.mapInArrow(_keyed_places(number, True, within, crowded, every), places))
            some = not asked.isEmpty()
            if some and every:
                more = _all_met(asked, keys, number)
            elif some:
                keys = scratch.written(hot.mapInArrow(_keyed_places(number, False, within, _filter(asked)), places))
                met, narrow = _met(keys, number, scratch)
                more = met if more is None else more.unionByName(met)
            if more is not None:
                found = found.unionByName(_passages_of(_chained(more), texts, scratch))
            if not some or every or narrow.isEmpty():
                break
            within, crowded, more = (_filter(narrow), None, None) if number == 2 else (within, _filter(narrow), None)
            hot = scratch.written(_hot_places(marks, found))
        out = found.drop("at").distinct()
        if renamed:
            out = scratch.written(out)
            name = lambda c: d.select(F.col("doc").alias(f"_{c}"), F.col("doc_id").alias(f"{c}_"))
            for c in ("doc_id", "other_id"):
                out = out.join(name(c), F.col(c) == F.col(f"_{c}")).withColumn(c, F.col(f"{c}_")).drop(f"_{c}", f"{c}_")
            out = out.where("doc_id <> other_id").distinct()
        return written(out)


def without_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``: texts without the bytes of their passages in ``found``; spans of one document may overlap."""
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set(F.struct("start_byte", "end_byte"))).alias("spans"))

    @F.pandas_udf("string")
    def cut_out(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None:
                out.append(t)
                continue
            b, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
            for s in own:
                parts.append(b[at : max(at, s["start_byte"])])
                at = max(at, s["end_byte"])
            out.append(b"".join([*parts, b[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.join(spans, F.col("doc_id") == F.col("_id"), "left").select("doc_id", cut_out("text", "spans").alias("text"))
