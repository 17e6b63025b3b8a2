"""Packing of token pieces into as few sequences as can be: best fit first, then exchanges between underfull sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm import tokens
from shoebox.llm._common import Scratch, written

#: Pieces that one group, packed by one task, is meant to hold.
GROUP_ROWS = 1 << 16
#: Emptiest sequences in which an exchange looks for two pieces at once.
PAIR_DONORS = 32
#: Turns of trades with full sequences that may empty none before the search ends.
PATIENCE = 6
#: Rounds over the underfull sequences end when one empties fewer than one in so many.
WORTH = 1000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, underfull boolean"


class Sequences:
    """Sequences of at most ``capacity`` tokens made of pieces of given lengths."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.fill: list[int] = []
        self.held: list[dict[int, list[int]]] = []  # of each sequence: the pieces of each length

    def add(self, pieces: list[tuple[int, int]]) -> int:
        """A new sequence of pieces (length, number)."""
        own: dict[int, list[int]] = defaultdict(list)
        for length, i in pieces:
            own[length].append(i)
        self.held.append(own)
        self.fill.append(sum(length for length, _ in pieces))
        return len(self.fill) - 1

    def best_fit(self, pieces: list[tuple[int, int]]) -> None:
        """Longest pieces first, each into the fullest sequence that has room for it."""
        room: dict[int, list[int]] = defaultdict(list)
        free = 0  # bit r: some sequence has room for r tokens
        for length, i in sorted(pieces, reverse=True):
            fits = free >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                s = room[r].pop()
                if not room[r]:
                    free &= ~(1 << r)
                self.held[s][length].append(i)
                self.fill[s] += length
            else:
                s = self.add([(length, i)])
            left = self.capacity - self.fill[s]
            room[left].append(s)
            free |= 1 << left

    def _give(self, a: int, b: int, length: int) -> None:
        """Moves a piece of this length from one sequence to another."""
        own = self.held[a][length]
        self.held[b][length].append(own.pop())
        if not own:
            del self.held[a][length]
        self.fill[a] -= length
        self.fill[b] += length

    def exchange(self) -> int:
        """Local search over the underfull sequences; the number of exchanges made.

        Sequences are taken from the fullest down.  Each gains as much as its room allows by an exchange with a sequence no
        fuller than itself: a piece moves in, one goes out for a longer one, two for one, or one for two.  Every such
        exchange adds to the sum of squared fills, so sweeps end; they are repeated until one finds nothing.  Then
        underfull sequences trade places with full ones, which leaves the sum as it is but sets other pieces free, and sweeps
        begin anew, until PATIENCE such turns in a row have emptied no sequence.
        """
        total, waited, turn, least = 0, 0, 0, len(self.fill)
        while True:
            while made := self._sweep():
                total += made
            used = sum(f > 0 for f in self.fill)
            waited = 0 if used < least else waited + 1
            least, turn = used, turn + 1
            if waited > PATIENCE or used <= -(-sum(self.fill) // self.capacity) or not self._trade(random.Random(turn)):
                return total

    def _trade(self, rnd: random.Random) -> int:
        """Fills each underfull sequence, where it can, by a piece of a full one that thereby lacks as much; the number of trades."""
        where: dict[int, list[int]] = defaultdict(list)
        for s, f in enumerate(self.fill):
            if f == self.capacity and (len(self.held[s]) > 1 or len(next(iter(self.held[s].values()))) > 1):
                for length in self.held[s]:
                    where[length].append(s)
        gone, made = set(), 0
        for t in [s for s, f in enumerate(self.fill) if 0 < f < self.capacity]:
            room = self.capacity - self.fill[t]
            ways = [(q, s) for q in (0, *sorted(self.held[t])) for s in where.get(q + room, ())]
            if ways:
                out, donor = rnd.choice(ways)
                if donor not in gone:
                    gone.add(donor)
                    self._give(donor, t, out + room)
                    if out:
                        self._give(t, donor, out)
                    made += 1
        return made

    def _sweep(self) -> int:
        order = sorted((s for s, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda s: (self.fill[s], s))
        where: dict[int, dict[int, None]] = defaultdict(dict)  # donors that hold a piece of each length, the emptiest first
        for s in order:
            for length in self.held[s]:
                where[length][s] = None
        present = sum(1 << length for length in where)

        def note(s: int, length: int) -> None:
            nonlocal present
            if length in self.held[s]:
                where[length][s] = None
                present |= 1 << length
            else:
                where[length].pop(s, None)
                if not where[length]:
                    present &= ~(1 << length)

        made, low = 0, 0
        for t in reversed(order):
            for length in self.held[t]:
                where[length].pop(t, None)
                if not where[length]:
                    present &= ~(1 << length)
            while 0 < self.fill[t] < self.capacity and present:
                while low < len(order) and not self.fill[order[low]]:
                    low += 1
                found = self._best(t, present, where, order[low : low + PAIR_DONORS])
                if found is None:
                    break
                donor, into, out = found
                for length in into:
                    self._give(donor, t, length)
                for length in out:
                    self._give(t, donor, length)
                for length in {*into, *out}:
                    note(donor, length)
                made += 1
        return made

    def _best(self, t: int, present: int, where: dict[int, dict[int, None]], emptiest: list[int]) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that fills most of a sequence's room: donor, lengths that come in, lengths that go out."""
        room, own = self.capacity - self.fill[t], sorted(self.held[t])
        gain, best = 0, None

        def one(out: tuple[int, ...]) -> bool:
            nonlocal gain, best
            size = sum(out)
            p = (present & ((1 << size + room + 1) - 1)).bit_length() - 1
            if p - size > gain:
                gain, best = p - size, (next(iter(where[p])), (p,), out)
            return gain == room

        if one(()) or any(one((q,)) for q in own):
            return best
        twice = [q for q in own if len(self.held[t][q]) > 1]
        if any(one((q, r)) for i, q in enumerate(own) for r in own[i + 1 :]) or any(one((q, q)) for q in twice):
            return best
        for s in emptiest:
            if s == t or self.fill[s] > self.fill[t]:
                continue
            lengths = sorted(self.held[s])
            known = set(lengths)
            for q in (0, *own):
                for p in lengths:
                    want = room + q - p
                    r = want if want in known else max((x for x in lengths if x < want), default=0)
                    if r and p + r - q > gain and (r != p or len(self.held[s][p]) > 1):
                        gain, best = p + r - q, (s, (p, r), (q,) if q else ())
                        if gain == room:
                            return best
        return best


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``: each text's ids and ``end``, cut into pieces of ``capacity`` tokens where there are more, the first piece shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, safe, held = tokens.byte_level(tokenizer, False)
        lengths = tokens.Lengths(held)
        coded = lambda texts: [np.array(ids, "<u4").tobytes() for ids in encode(texts)]

        def spaced(parts: list[str]) -> list[bytes]:
            """Ids of parts after a space: those that may stand side by side are encoded as one text and cut again."""
            if tokens.all_sound(parts):
                text, ends = tokens.joined(parts)
                ids = np.array(encode([text])[0], "<u4")
                cuts = lengths.cuts(ids, ends)
                if cuts is not None:
                    data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return coded([" " + p for p in parts])

        after, opening = tokens.Memory(spaced), tokens.Memory(coded)
        last, names = end.to_bytes(4, "little"), [c.split()[0] for c in PIECES.split(", ")]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            texts = [tokens.parts(t) if t and safe else [t or ""] for t in batch.column("text").to_pylist()]
            opening.learn([t[:1] for t in texts])
            after.learn([t[1:] for t in texts])
            rows = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = opening[parts[0]] + b"".join(map(after.__getitem__, parts[1:])) + last
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = capacity if start else (n - 1) % capacity + 1
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def _packed(table: pa.Table, capacity: int) -> pa.Table:
    """Packs one group: pieces without a sequence by best fit, sequences of the rounds before as they are, then exchanges."""
    rids, lengths, old = (table.column(c).to_pylist() for c in ("rid", "length", "sequence_id"))
    sequences, before, new = Sequences(capacity), defaultdict(list), []
    for i in sorted(range(len(rids)), key=rids.__getitem__):
        (new if old[i] is None else before[old[i]]).append((lengths[i], i))
    sequences.best_fit(new)
    for s in sorted(before):
        sequences.add(before[s])
    sequences.exchange()
    order, ids, offsets, underfull = [], [], [], []
    for own, fill in zip(sequences.held, sequences.fill, strict=True):
        pieces = sorted((i for x in own.values() for i in x), key=rids.__getitem__)
        at = 0
        for i in pieces:
            order.append(i)
            ids.append(rids[pieces[0]])
            offsets.append(at)
            underfull.append(fill < capacity)
            at += lengths[i]
    kept = table.drop_columns(["sequence_id", "offset", "underfull", "grp"]).take(pa.array(order, pa.int64()))
    return kept.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("underfull", pa.array(underfull, pa.bool_()))


def pack(pieces: DataFrame, capacity: int = 1024, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens (columns of ``token_pieces``).

    Pieces of full length are sequences of their own.  The others are dealt to groups of about ``group_rows`` by a
    hash of a row number; each group is packed by best fit and improved by exchanges.  Underfull sequences alone go on:
    they are dealt to fewer groups each round and improved further, until one group holds them all or a round empties
    fewer than one in WORTH.  Rounds are written to the shared folder.  A sequence is named by the row number of its first piece.
    """
    with Scratch(pieces.sparkSession) as scratch:
        held = scratch.written(pieces.select(F.monotonically_increasing_id().alias("rid"), *[c.split()[0] for c in PIECES.split(", ")]))
        full = held.where(F.col("length") >= capacity).select("*", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        left = held.where(F.col("length") < capacity).select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("underfull"))
        done, turn, bins = [full], 0, None
        while True:
            groups = max(1, -(-left.count() // group_rows))
            own = F.xxhash64(F.coalesce("sequence_id", "rid"), F.lit(turn))
            dealt = left.withColumn("grp", F.pmod(own, F.lit(groups))).repartition(min(groups, 1 << 15), "grp")
            now = scratch.written(dealt.groupBy("grp").applyInArrow(lambda t: _packed(t, capacity), PLACED))
            left, turn = now.where("underfull"), turn + 1
            was, bins = bins, left.where("offset = 0").count()
            if groups == 1 or was is not None and was - bins < max(1, was // WORTH):
                done.append(now.drop("underfull"))
                break
            done.append(now.where("not underfull").drop("underfull"))
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return written(out.drop("rid"))


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``: every document's tokens, packed.

    A document is the ids of its whole text by the byte-level ``tokenizer`` file, special strings as the library takes them
    by default, and ``end``; a null text is empty and has ``end`` alone.  Only documents of more than ``capacity`` tokens are
    cut.  Repeated rows are packed each, an empty table gives an empty one, other columns are not read.
    """
    return pack(token_pieces(docs, tokenizer, end, capacity, id_col, text_col), capacity)
